"""Spark jobs that turn document collections into action facts and process models."""
