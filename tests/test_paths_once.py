"""What comes off a stack of goals is computed once a row."""

from factloom.operators import paths


def test_marks_are_looked_for_once(spark):
    goal = "struct<kind:string,name:string,above:array<string>>"
    e, s = ("E", "a", []), ("S", "x", ["a"])
    rows = spark.createDataFrame([(1, ["b"], [e, s]), (2, ["a", "a"], [e]), (3, ["a"], [e]), (4, [], [s, e])], f"id int, path array<string>, stack array<{goal}>")
    df = paths._settle(rows)
    assert df._jdf.queryExecution().executedPlan().toString().count("array_position") == 1
    assert sorted((r.id, r.path, [g.kind for g in r.stack]) for r in df.collect()) == [(1, ["b", "a"], ["S"]), (3, ["a", "a"], []), (4, [], ["S", "E"])]
