"""Cheap scores of chunks and the choice of those worth a model call.

Chunks are rows (run_id, chunk_index, section_path, chunk_text, has_table, has_list, section_depth). All scores but TF-IDF
are projections; TF-IDF counts within a run, and the gray policy is a window over it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import staging
from ..sources.terms import DEFAULT_TERMS, SEEDED_QUERIES
from .tagger import Tagger, default_tagger, first_verbs

#: Path words of sections with little to extract.
NOISE = ("appendix", "appendices", "glossary", "introduction", "overview", "table of contents")
ROLES, MODALS = ("user", "admin", "system", "administrator"), ("may", "must", "shall", "can")


@dataclass(frozen=True)
class Weights:
    heading: float = 0.15
    table_list: float = 0.1
    depth: float = 0.05
    appendix: float = -0.1
    exact: float = 0.25
    pattern: float = 0.2
    context: float = 0.15
    lexical: float = 0.1
    accept: float = 0.4
    gray: float = 0.2
    top_gray: int = 10
    adjacency: bool = True
    terms: dict[str, list[str]] = field(default_factory=lambda: DEFAULT_TERMS)
    queries: list[str] = field(default_factory=lambda: SEEDED_QUERIES)


def _any_in(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def structural_score(chunks: DataFrame, w: Weights | None = None) -> DataFrame:
    """heading_relevant, has_table_list, depth_score and appendix_penalty, from path and block features."""
    w = w or Weights()
    path = F.lower(F.array_join("section_path", " "))
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    return chunks.withColumns({
        "heading_relevant": one(_any_in(path, w.terms["heading_relevant_terms"])),
        "has_table_list": one(F.col("has_table") | F.col("has_list")),
        "depth_score": F.least(F.col("section_depth") / 5.0, F.lit(1.0)),
        "appendix_penalty": one(_any_in(path, NOISE)),
    })


#: Beyond so many terms an automaton looks for all of them at once.
LISTED_TERMS = 200
_automata: dict[str, tuple] = {}


def _automaton(key: str, terms: list[tuple[int, str]]):
    """The automaton of numbered terms, made once a worker."""
    if key not in _automata:
        import ahocorasick

        made = ahocorasick.Automaton()
        for n, (_, term) in enumerate(terms):
            if term:
                made.add_word(term, n)
        made.make_automaton()
        _automata.clear()
        _automata[key] = (made, [n for n, (_, term) in enumerate(terms) if not term])
    return _automata[key]


def _found_at_once(own: dict[str, list[str]], chunks: DataFrame) -> Callable[[Column], Column]:
    """A column function: terms found in a text, in order, and the number of each one's category. The plan holds no term."""
    listed = [(k, x) for k, terms in enumerate(own.values()) for x in terms]
    key = hashlib.sha256(repr(listed).encode()).hexdigest()
    sent = chunks.sparkSession.sparkContext.broadcast(listed)

    @F.pandas_udf("terms array<string>, kinds array<int>")
    def look(text: pd.Series) -> pd.DataFrame:
        terms = sent.value
        automaton, empty = _automaton(key, terms)
        rows = []
        for x in text:
            hits = sorted({n for _, n in automaton.iter(x)} | set(empty)) if x is not None and len(automaton) else sorted(empty)
            rows.append(([terms[n][1] for n in hits], [terms[n][0] for n in hits]))
        return pd.DataFrame(rows, columns=["terms", "kinds"])

    return look


def lexicon_match(chunks: DataFrame, w: Weights | None = None, listed_terms: int = LISTED_TERMS) -> DataFrame:
    """matched_terms and their number by category; a phrase counts once, as a substring, in its first category.

    Up to ``listed_terms`` terms are looked up by expressions, more by one automaton a worker, which passes over a text once
    however many terms there are; the result is the same. Null texts and paths count as empty."""
    w = w or Weights()
    text = F.regexp_replace(F.lower(F.concat_ws(" ", F.array_join("section_path", " "), "chunk_text")), r"(?U)\s+", " ")
    seen: set[str] = set()
    own: dict[str, list[str]] = {}
    for category, terms in w.terms.items():
        own[category] = [x for x in dict.fromkeys(terms) if x not in seen]
        seen.update(own[category])
    none = F.expr("cast(array() as array<string>)")
    if len(seen) > listed_terms:
        c = chunks.withColumn("_found", _found_at_once(own, chunks)(text))
        of = lambda n: F.size(F.filter("_found.kinds", lambda x: x == n))
        sizes = {k: of(n) for n, k in enumerate(own)}
        matched = F.col("_found.terms")
    else:
        c = chunks.withColumn("_text", text)
        hits = {k: F.filter(F.array(*(F.lit(x) for x in v)), lambda x: F.contains(F.col("_text"), x)) if v else none for k, v in own.items()}
        sizes, matched = {k: F.size(h) for k, h in hits.items()}, F.concat(*hits.values()) if hits else none
    counts = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(k).alias("k"), n.alias("n")) for k, n in sizes.items())), lambda x: x["n"] > 0)) if sizes else F.expr("cast(map() as map<string,int>)")
    return c.withColumns({"matched_terms": matched, "match_counts": counts}).drop("_text", "_found")


def token_patterns(chunks: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """Names of the word patterns in a text, ordered by where they first fire; none for a null text.

    What follows ``must`` or ``may`` is tagged in its sentence (``tagger``, by default the one of this package), and counts
    where it is a verb. Texts without these words pass the tagger as nulls."""
    text, tagger = F.lower("chunk_text"), tagger or default_tagger()
    rules = {"prohibition_shall_not": r"\b(?:shall|must)\s+not\b", "condition_if_when": r"\b(?:if|when|unless)\b", "role_modal": rf"\b(?:{'|'.join(ROLES)})\s+(?:{'|'.join(MODALS)})\b"}

    @F.pandas_udf("must int, may int")
    def verbs(shown: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([first_verbs(tagger, x, ("must", "may")) if x is not None else [0, 0] for x in shown], columns=["must", "may"])

    c = chunks.withColumn("_verbs", verbs(F.when(F.rlike(text, F.lit(r"(?U)\b(?:must|may)\b")), F.col("chunk_text"))))
    found = [F.struct(F.col("_verbs.must").alias("at"), F.lit("obligation_must_verb").alias("name")), F.struct(F.col("_verbs.may").alias("at"), F.lit("permission_may_verb").alias("name"))]
    found += [F.struct(F.regexp_instr(text, F.lit("(?U)" + r)).alias("at"), F.lit(k).alias("name")) for k, r in rules.items()]
    return c.withColumn("patterns", F.transform(F.array_sort(F.filter(F.array(*found), lambda x: x["at"] > 0)), lambda x: x["name"])).drop("_verbs")


def context_cooccurrence(chunks: DataFrame, w: Weights | None = None, width: int = 10, scale: float = 3.0) -> DataFrame:
    """context_boost: how often action and object, permission or restriction and role, state and object stand close.

    Terms are looked up once a token, as bits; a window is the OR of its tokens' bits, built by doubling shifts."""
    w = w or Weights()
    sets = [w.terms[k] for k in ("action_verbs", "object_domain_terms", "role_nouns", "state_indicators")]
    sets.insert(2, [*w.terms["permission_terms"], *w.terms["restriction_terms"]])
    tokens = F.regexp_extract_all(F.lower(F.coalesce("chunk_text", F.lit(""))), F.lit("[a-z0-9а-яё]+"), F.lit(0))

    def bits(token: Column) -> Column:
        out = F.lit(0)
        for k, terms in enumerate(sets):
            words = [x for x in dict.fromkeys(terms) if x and " " not in x]
            if words:
                out = out.bitwiseOR(F.when(_any_in(token, words), F.lit(1 << k)).otherwise(F.lit(0)))
        return out

    c = chunks.withColumn("_m", F.transform(tokens, bits))
    reach = 1
    while reach < width:
        by = min(reach, width - reach)
        c = c.withColumn("_m", F.zip_with("_m", F.slice("_m", by + 1, F.greatest(F.size("_m"), F.lit(1))), lambda a, b: a.bitwiseOR(F.coalesce(b, F.lit(0)))))
        reach += by
    both = lambda x, m: F.when(x.bitwiseAND(m) == m, 1).otherwise(0)
    n = F.size("_m")
    hits = F.aggregate(F.slice("_m", 1, F.greatest(n - 1, F.lit(0))), F.lit(0), lambda s, x: s + both(x, 0b00011) + both(x, 0b01100) + both(x, 0b10010))
    return c.withColumn("context_boost", F.when(n > 1, F.least(scale * hits / (n - 1), F.lit(1.0))).otherwise(0.0)).drop("_m")


#: Parts in which a run's terms are ranked before its vocabulary is.
VOCABULARY_PARTS = 64

#: What counts as a word for TF-IDF.
WORD = r"[\p{L}\p{N}_]{2,}"


def tfidf_relevance(chunks: DataFrame, w: Weights | None = None, vocabulary: int = 5000) -> DataFrame:
    """(run_id, chunk_index, lexical_score): greatest cosine of a chunk with the seeded queries, within its run.

    The queries are documents of every run besides its chunks. Term counts are written once; document frequencies, ranks and
    the queries' norms are summed from them by run and term, and one aggregate by chunk gives its norm and its product with
    every query. The queries' own counts are a small table, sent to all tasks. Scores are rounded to nine digits, so that the
    order in which terms are added cannot part equal chunks. Null texts have no words and score 0; rows that repeat a chunk
    add up."""
    w = w or Weights()
    spark, n_queries = chunks.sparkSession, len(w.queries)
    keys = chunks.select("run_id", F.col("chunk_index").cast("int").alias("chunk_index"), "chunk_text")
    words = lambda rows, *c: rows.select(*c, F.explode(F.regexp_extract_all(F.lower(F.coalesce("chunk_text", F.lit(""))), F.lit(WORD), F.lit(0))).alias("term"))
    tf = staging.materialize(words(keys, "run_id", "chunk_index").groupBy("run_id", "term", "chunk_index").agg(F.count("*").alias("tf")), "term-counts")
    runs = staging.materialize(keys.groupBy("run_id").agg((F.count("*") + n_queries).alias("n")), "run-sizes")
    asked = words(spark.createDataFrame([(k, q) for k, q in enumerate(w.queries)], "query int, chunk_text string"), "query")
    asked = asked.groupBy("term").agg(*(F.count_if(F.col("query") == k).alias(f"q{k}") for k in range(n_queries)), F.count("*").alias("q_total"), F.count_distinct("query").alias("q_df"))
    asked = [tuple(r) for r in asked.collect()]  # the terms of the queries, a parameter
    known = spark.createDataFrame(asked, ", ".join(["term string", *(f"q{k} long" for k in range(n_queries)), "q_total long", "q_df long"]))
    of_queries = F.explode(F.array(*(F.struct(F.lit(r[0]).alias("term"), F.lit(r[-2]).alias("total"), F.lit(r[-1]).alias("df")) for r in asked))) if asked else None
    by_term = tf.groupBy("run_id", "term").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
    if of_queries is not None:
        by_term = by_term.unionByName(runs.select("run_id", of_queries.alias("x")).select("run_id", "x.*")).groupBy("run_id", "term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))
    # a run's terms are ranked in parts first, so that its last ranking takes VOCABULARY_PARTS x vocabulary rows at most
    for part in (F.pmod(F.xxhash64("term"), F.lit(VOCABULARY_PARTS)), F.lit(0)):
        rank = F.row_number().over(Window.partitionBy("run_id", "part").orderBy(F.desc("total"), "term"))
        by_term = by_term.withColumn("part", part).withColumn("rank", rank).where(F.col("rank") <= vocabulary)
    vocab = by_term.join(runs, "run_id")
    vocab = vocab.select("run_id", "term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")).join(F.broadcast(known), "term", "left").fillna(0, [f"q{k}" for k in range(n_queries)])
    vocab = staging.materialize(vocab.drop("q_total", "q_df"), "vocabulary")
    x = F.col("tf") * F.col("idf")
    q = [F.col(f"q{k}") * F.col("idf") for k in range(n_queries)]
    norms = vocab.where(" + ".join(f"q{k}" for k in range(n_queries)) + " > 0" if n_queries else "false").groupBy("run_id").agg(F.count("*").alias("_"), *(F.sqrt(F.sum(y * y)).alias(f"norm{k}") for k, y in enumerate(q))).drop("_")
    sums = tf.join(vocab, ["run_id", "term"]).groupBy("run_id", "chunk_index").agg(F.sqrt(F.sum(x * x)).alias("norm"), *(F.sum(x * y).alias(f"dot{k}") for k, y in enumerate(q)))
    cosines = [F.when(F.col(f"norm{k}") > 0, F.col(f"dot{k}") / (F.col("norm") * F.col(f"norm{k}"))) for k in range(n_queries)]
    best = F.greatest(F.lit(0.0), F.lit(0.0), *cosines)
    scores = sums.join(norms, "run_id").select("run_id", "chunk_index", F.round(F.least(best, F.lit(1.0)), 9).alias("best"))
    return keys.select("run_id", "chunk_index").join(scores, ["run_id", "chunk_index"], "left").select("run_id", "chunk_index", F.coalesce("best", F.lit(0.0)).alias("lexical_score"))


def weighted_score(chunks: DataFrame, w: Weights | None = None) -> DataFrame:
    """prefilter_score with feature_breakdown."""
    w = w or Weights()
    matches = F.size("matched_terms")
    parts = {
        "structural": w.heading * F.col("heading_relevant") + w.table_list * F.col("has_table_list") + w.depth * F.col("depth_score") + w.appendix * F.col("appendix_penalty"),
        "exact_match": w.exact * F.least(matches, F.lit(5)) / 5.0, "pattern": w.pattern * F.least(F.size("patterns"), F.lit(3)) / 3.0,
        "context_boost": w.context * F.col("context_boost"), "lexical": w.lexical * F.col("lexical_score"),
    }
    total = sum(list(parts.values())[1:], parts["structural"])
    breakdown = F.map_from_arrays(F.array(*(F.lit(k) for k in parts)), F.array(*parts.values()))
    return chunks.withColumns({"prefilter_score": F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), "feature_breakdown": breakdown})


def threshold_decision(chunks: DataFrame, w: Weights | None = None) -> DataFrame:
    w = w or Weights()
    s = F.col("prefilter_score")
    return chunks.withColumn("decision", F.when(s >= w.accept, "keep").when(s >= w.gray, "gray").otherwise("reject"))


def gray_zone_selection(chunks: DataFrame, w: Weights | None = None) -> DataFrame:
    """selected_for_llm: kept chunks, and gray ones next to a kept one or among the best of their run."""
    w = w or Weights()
    order = Window.partitionBy("run_id").orderBy("chunk_index")
    best = Window.partitionBy("run_id", "decision").orderBy(F.desc("prefilter_score"), "chunk_index")
    near = (F.coalesce(F.lag("decision").over(order), F.lit("")) == "keep") | (F.coalesce(F.lead("decision").over(order), F.lit("")) == "keep")
    c = chunks.withColumn("_near", near & F.lit(w.adjacency)).withColumn("_rank", F.row_number().over(best))
    chosen = (F.col("decision") == "keep") | ((F.col("decision") == "gray") & (F.col("_near") | (F.col("_rank") <= w.top_gray)))
    return c.withColumn("selected_for_llm", chosen).drop("_near", "_rank")


def score_chunks(chunks: DataFrame, w: Weights | None = None) -> DataFrame:
    """All scores, the decision and the selection."""
    c = context_cooccurrence(token_patterns(lexicon_match(structural_score(chunks, w), w)), w)
    c = c.join(tfidf_relevance(chunks, w), ["run_id", "chunk_index"])
    return gray_zone_selection(threshold_decision(weighted_score(c, w), w), w)


def prefilter_verdicts(scored: DataFrame) -> DataFrame:
    """Numbers of accepted, rejected and gray chunks of a run."""
    d, s = F.col("decision"), F.col("selected_for_llm")
    return scored.groupBy("run_id").agg(F.count_if(d == "keep").alias("accepted"), F.count_if(d == "reject").alias("rejected"), F.count_if((d == "gray") & s).alias("gray_accepted"), F.count_if((d == "gray") & ~s).alias("gray_rejected"))
