"""Cases of the operators on small rows."""

import itertools
import random

import pytest
from factloom.functions import text as t
from factloom.operators import batching, chunks, graph, normalize, parsing, paths, prefilter, records, responses
from factloom.plans import queries as plans
from factloom.sources import ingest, staging, terms
from factloom.streaming import streams
from pyspark.sql import functions as F


@pytest.mark.parametrize(("raw", "slug"), [("Submit Form", "submit_form"), ("  a  b ", "a_b"), ("A-B.C,D", "a_b_c_d"), ("", ""), ("   ", ""), ("x__y", "x_y"), ("(Note)!", "note"), ("É", "")])
def test_slug(spark, raw, slug):
    assert spark.range(1).select(t.slugify(F.lit(raw))).first()[0] == slug


def test_tokens_and_repr(spark):
    r = spark.range(1).select(t.estimate_tokens(F.lit("  ")), t.estimate_tokens(F.lit("ab")), t.estimate_tokens(F.lit("x" * 17)), t.list_repr(F.array(F.lit("a'b"), F.lit("c\\d")))).first()
    assert tuple(r) == (0, 1, 4, repr(["a'b", "c\\d"]))


DRAFT = "run_id string, seq long, verb string, primary_object string, primary_actor string, input_state string, output_state string, action_label string"


def test_normalize_and_collisions(spark):
    config = normalize.NormalizeConfig({"object": {"form": "application_form"}, "role": {"user": "applicant"}}, frozenset({"banned"}), "v")
    rows = [("r", 1, "Submit", "form", "User", "draft", "submitted", "Submit form"), ("r", 2, "Submit", "Form", None, None, " ", None), ("r", 3, "Approve", "banned", "", None, None, "")]
    out = normalize.normalize_drafts(spark.createDataFrame(rows, DRAFT), config).orderBy("seq").collect()
    assert [o.action_canonical for o in out] == ["submit_application_form", "submit_application_form", "approve_unknown_object"]
    assert (out[0].primary_actor_key, out[0].input_state_key, out[1].primary_actor_key, out[1].output_state_key) == ("applicant", "application_form__draft", "unknown_actor", "application_form__unknown_state")
    assert any("reserved" in w for w in out[2].warnings) and out[0].form_list == ["draft", "submitted", "Submit", "form", "User"]
    c = normalize.action_collisions(normalize.normalize_drafts(spark.createDataFrame(rows, DRAFT), config)).collect()
    assert [(x.action_canonical, x.n_records, x.merged) for x in c] == [("submit_application_form", 2, False)]
    assert c[0].surface_forms == ["draft", "submitted", "Submit", "form", "User", "Submit form", "Form"]


def test_upsert_keeps_first_identity_and_last_values(spark):
    schema = "run_id string, chunk_hash string, id long, seq long, text string"
    out = records.upsert_chunks(spark.createDataFrame([("r", "h", 1, 9, "old")], schema), spark.createDataFrame([("r", "h", 2, 1, "a"), ("r", "h", 3, 2, "b"), ("r", "g", 4, 1, None)], schema))
    assert sorted(tuple(r) for r in out.collect()) == [("r", "g", 4, 1, None), ("r", "h", 1, 2, "b")]


def test_pages_and_status(spark):
    rows = spark.createDataFrame([("r", i) for i in range(5)], "run_id string, k int")
    assert [r.k for r in records.list_by_run(rows, "k", 2, 2).orderBy("k").collect()] == [2, 3]
    with pytest.raises(ValueError, match="limit"):
        records.list_by_run(rows, "k", 0, 501)
    s = records.public_run_status(spark.createDataFrame([(" Completed",), (None,), ("odd",)], "status string"))
    assert [r.public_status for r in s.collect()] == ["succeeded", "unknown", "unknown"]


def fold_groups(blocks):
    groups, head, prior = [], None, None
    for path, kind in blocks:
        if head is None or not (path[: len(head)] == head and chunks.joins_group(prior[1], prior[0], kind, path)):
            groups.append([])
            head = path
        groups[-1].append((path, kind))
        prior = (path, kind)
    return [len(g) for g in groups]


def test_group_units_against_a_fold(spark):
    rng, rows, want = random.Random(3), [], {}
    for d in range(30):
        blocks = [(rng.choice([[], ["a"], ["a", "b"], ["c"]]), rng.choice(["heading", "paragraph", "list", "table", "note"])) for _ in range(rng.randint(1, 25))]
        rows += [(d, i, p, k, f"t{i}") for i, (p, k) in enumerate(blocks)]
        want[d] = fold_groups(blocks)
    u = spark.createDataFrame(rows, "doc_id long, unit_index int, section_path array<string>, block_type string, text string")
    got = {}
    for r in chunks.group_units(u).groupBy("doc_id", "group_id").count().orderBy("doc_id", "group_id").collect():
        got.setdefault(r.doc_id, []).append(r["count"])
    assert got == want


def test_split_text_is_greedy_and_bounded():
    text = "aaa\n\nbbb\n\n" + "c" * 25
    parts = chunks.split_text(text, 12)
    assert parts == ["aaa\n\nbbb", "c" * 12, "c" * 12, "c"] and all(len(p) <= 14 for p in parts)


def test_gray_zone(spark):
    rows = [("r", i, d, s) for i, (d, s) in enumerate([("gray", 0.4), ("gray", 0.35), ("gray", 0.45)])] + [("q", i, d, 0.3) for i, d in enumerate(["gray", "keep", "gray"])]
    c = spark.createDataFrame(rows, "run_id string, chunk_index int, decision string, prefilter_score double")
    two = prefilter.gray_zone_selection(c, prefilter.Weights(top_gray=2, adjacency=False)).where("run_id = 'r'").orderBy("chunk_index")
    assert [r.selected_for_llm for r in two.collect()] == [True, False, True]
    near = prefilter.gray_zone_selection(c, prefilter.Weights(top_gray=0)).where("run_id = 'q'").orderBy("chunk_index")
    assert [r.selected_for_llm for r in near.collect()] == [True, True, True]


def test_patterns_in_order(spark):
    c = spark.createDataFrame([(0, "When ready the user must submit. It must not fail"), (1, "may the"), (2, None)], "chunk_index int, chunk_text string")
    got = {r.chunk_index: r.patterns for r in prefilter.token_patterns(c).collect()}
    assert got[0] == ["condition_if_when", "role_modal", "obligation_must_verb", "prohibition_shall_not"] and got[1] == [] and not got[2]


def test_batches_hold_what_is_available(spark):
    rng = random.Random(1)
    rows = [(f"r{k % 3}", k, rng.randint(0, 400)) for k in range(90)]
    got = batching.pack_token_batches(spark.createDataFrame(rows, "run_id string, chunk_index int, estimated_tokens int"), 600, 0, 100).collect()
    sums = {}
    for r in got:
        sums.setdefault((r.run_id, r.batch_index), []).append(r.estimated_tokens)
    assert len(got) == 90 and all(sum(v) <= 500 or len(v) == 1 for v in sums.values())
    alone = batching.pack_token_batches(spark.createDataFrame(rows, "run_id string, chunk_index int, estimated_tokens int"), 50).collect()
    assert len({(r.run_id, r.batch_index) for r in alone}) == 90


@pytest.mark.parametrize(("bits", "available"), [(0, 50), (2, 7), (2, 300), (3, 40), (14, 60), (2, 0)])
def test_batches_of_a_hot_run_do_not_depend_on_its_blocks(spark, monkeypatch, bits, available):
    monkeypatch.setattr(batching, "BLOCK_BITS", bits)
    rng = random.Random(bits + available)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), k, rng.choice([None, 0, 0, 1, rng.randint(0, 30), rng.randint(0, 90)]), {"k": k}) for k in range(200)]
    rows += [("hot", None, 5, None), ("b", 1, 10, None), ("zero", 1, 0, None), ("zero", 2, None, None)]
    want, state = {}, {}
    for run, k, tokens, _ in sorted(rows, key=lambda r: (r[0] or "", r[1] is not None, r[1] or 0)):
        tokens = tokens or 0
        if run not in state:
            state[run] = (0, tokens)
        elif available <= 0 or state[run][1] + tokens > available:
            state[run] = (state[run][0] + 1, tokens)
        else:
            state[run] = (state[run][0], state[run][1] + tokens)
        want[run, k] = state[run][0]
    c = spark.createDataFrame(rows, "run_id string, chunk_index int, estimated_tokens int, m map<string,int>").repartition(5)
    got = batching.pack_token_batches(c, available + 100)
    assert got.columns == [*c.columns, "batch_index"]
    assert {(r.run_id, r.chunk_index): r.batch_index for r in got.collect()} == want and got.count() == len(rows)


def test_batches_of_repeated_chunks_and_of_none(spark):
    rows = [("r", 1, 30), ("r", 2, 30), ("r", 2, 30), ("r", 3, 30), (None, None, None)]
    c = spark.createDataFrame(rows, "run_id string, chunk_index int, estimated_tokens int").withColumn("batch_index", F.lit(9))
    got = sorted((r.run_id or "", r.chunk_index or 0, r.batch_index) for r in batching.pack_token_batches(c, 170).collect())
    assert got == [("", 0, 0), ("r", 1, 0), ("r", 2, 1), ("r", 2, 1), ("r", 3, 2)]
    assert batching.pack_token_batches(c.limit(0), 170).count() == 0


def test_calls_are_retried_only_when_transient(spark):
    rows = spark.createDataFrame([("a", "s", "ok"), ("b", "s", "down")], "cache_key string, system_text string, user_text string")

    def call(system, user):
        if user == "down":
            raise TimeoutError
        return "[]"

    got = {r.cache_key: r for r in batching.extract_batches(rows, call, 2, 1, delay=0).collect()}
    assert (got["a"].response, got["a"].error_kind, got["b"].response, got["b"].error_kind, got["b"].retry_count) == ("[]", None, None, "TimeoutError", 1)


@pytest.mark.parametrize(("raw", "kind"), [("[]", None), ('[{"verb": null}]', None), ('[{"verb": "a"}, {"action_label": "b"}]', None), ("", "empty"), (None, "empty"), ("  ", "empty"), ("nope", "not_json"), ('{"a": 1}', "not_array"), ('["s"]', "item_not_object"), ('[{"x": "a"}]', "unknown_key"), ('[{"verb": 123}]', "not_string"), ('[{"verb": ["a"]}]', "not_string")])
def test_responses(spark, raw, kind):
    r = responses.parse_responses(spark.createDataFrame([(raw,)], "raw_response string")).first()
    assert (r.valid, r.error_kind) == (kind is None, kind)


def test_model_from_actions(spark):
    rows = [("r", "A", "x", "s1", "s2"), ("r", "A", "x", " ", "s3"), ("r", "", "fallback", None, None), ("r", "  ", "x", "s", "s")]
    out = graph.model_from_actions(spark.createDataFrame(rows, "run_id string, action_label string, action_canonical string, input_state_key string, output_state_key string"))
    assert sorted((r.action, r.init_states, r.final_states, r.b_value) for r in out.collect()) == [("A", ["s1"], ["s2", "s3"], 1), ("fallback", [], [], 1)]


def ways(model, action, above=()):
    """All paths to an action by plain recursion."""
    if action in above or action not in model:
        return []
    options = [[p for m in sorted(model) if s in model[m][1] for p in ways(model, m, (*above, action))] for s in model[action][0]]
    out = []
    for combo in itertools.product(*options):
        path = [a for p in combo for a in p]
        if all(path.count(a) <= 2 for a in path) and path.count(action) < 2:
            out.append([*path, action])
    return out


def test_paths_against_recursion(spark):
    rng, rows, models = random.Random(7), [], {}
    for run in range(12):
        n = rng.randint(2, 5)
        models[run] = {f"a{i}": (rng.sample(["s0", "s1", "s2", "s3"], rng.choice([0, 0, 1, 1, 2])), rng.sample(["s0", "s1", "s2", "s3"], rng.randint(1, 2))) for i in range(n)}
        rows += [(run, a, i, f, rng.randint(1, 10)) for a, (i, f) in models[run].items()]
    m = spark.createDataFrame(rows, "run_id int, action string, init_states array<string>, final_states array<string>, b_value int")
    out = paths.enumerate_paths(m, m.select("run_id", F.col("action").alias("target")), save=staging.materialize).orderBy("run_id", "target", "path_index").collect()
    got = {}
    for r in out:
        got.setdefault((r.run_id, r.target), []).append(r.path)
        assert not r.truncated
    want = {(run, a): w for run, model in models.items() for a in model if (w := ways(model, a))}
    assert got == want
    for mode in ("QG", "RANDOM"):
        best = paths.enumerate_paths(m, m.select("run_id", F.col("action").alias("target")), mode, save=staging.materialize)
        assert best.groupBy("run_id", "target").count().where("count > 1").isEmpty()


def test_process_paths_cover_all_lines(spark, tmp_path):
    lines = [(1, n, f) for n in range(1, 8) for f in ("AR" if n in (2, 6) else "N")] + [(2, 1, "A"), (2, 2, "N"), (2, 2, "R")]
    spark.createDataFrame([(o, n, f, 10 * n + len(f)) for o, n, f in lines], "l_orderkey long, l_linenumber int, l_returnflag string, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 11), (2, 12)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    want, run_orders = set(), (1, 2)  # a run is an order
    for order in run_orders:
        steps = {}
        for _, n, f in (x for x in lines if x[0] == order):
            steps.setdefault(n, []).append(f"{f}{n}")
        want |= {(order, p[-1], ">".join(p)) for p in itertools.product(*(steps[n] for n in sorted(steps)))}
    got = [(r.run_id, r.target, r.path) for r in plans.paths_all(spark, str(tmp_path)).collect()]
    assert len(got) == len(want) == 6 and set(got) == want


def test_documents_of_several_micro_batches(spark, tmp_path):
    schema = "run_id string, chunk_hash string, seq long, id long"
    for k, rows in enumerate([[("a", "h", 1, 1)], [("a", "h", 2, 2), ("b", "g", 1, 3)], [("c", "g", 1, 4)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    docs = streams.read_stream(spark, f"{tmp_path}/in", schema, files_per_trigger=1)
    table = streams.BucketedTable(spark, f"{tmp_path}/out", ["run_id", "chunk_hash"], 4)
    streams.stream_documents(docs, lambda batch: batch, streams.upsert_buckets(table, records.upsert_chunks), f"{tmp_path}/check").awaitTermination()
    got = {(r.run_id, r.chunk_hash): (r.id, r.seq) for r in table.read().collect()}
    assert set(got) == {("a", "h"), ("b", "g"), ("c", "g")} and (tmp_path / "out" / "data" / "v=2").exists()


def test_markdown_and_html_paths(spark):
    md = "# A\ntext\n## B\n- item\n| c |\n# D\nmore"
    b = parsing.parse_markdown_blocks(spark.createDataFrame([(1, md), (2, None), (3, "")], "doc_id long, text string")).orderBy("unit_index").collect()
    assert [(r.block_type, r.section_path) for r in b] == [("heading", ["A"]), ("paragraph", ["A"]), ("heading", ["A", "B"]), ("list", ["A", "B"]), ("table", ["A", "B"]), ("heading", ["D"]), ("paragraph", ["D"])]
    assert parsing.html_blocks("<h1>T &amp; U</h1><p>one<br>two<table><tr><td>x</td></tr></table><script>no()</script>") == [("heading", 1, "T & U"), ("paragraph", 0, "one two"), ("table", 0, "| x |\n| --- |")]


def test_uploads(spark):
    u = spark.createDataFrame([(" ", "text/plain", 1), ("a.exe", "", 1), ("a.md", "image/png", 1), ("a.txt", "", 1), ("b", "", 1), ("a.pdf", "application/pdf", 99)], "filename string, content_type string, size_bytes long")
    got = [r.reject_reason for r in ingest.validate_uploads(u, 50).collect()]
    assert got == ["filename is required", "extension not allowed: exe", "content type not allowed: image/png", None, "extension not allowed: (none)", "file too large"]


def test_term_files(tmp_path):
    for c in terms.CATEGORIES:
        (tmp_path / f"{c}.txt").write_text("# note\n\n  Foo  \nbar\n")
    (tmp_path / "role_nouns_ru.txt").write_text("роль\n")
    t_ = terms.read_term_tables(str(tmp_path))
    assert t_["role_nouns"] == ["foo", "bar", "роль"] and t_["action_verbs"] == ["foo", "bar"]
    (tmp_path / "role_nouns.txt").unlink()
    with pytest.raises(FileNotFoundError):
        terms.read_term_tables(str(tmp_path))
    assert terms.parse_aliases("Doc -> document\nx=\n# c", lambda s: s.strip().lower()) == {"doc": "document", "x": "x"}


def test_term_tables_as_rows(spark, tmp_path):
    """Files and folders Spark wrote give the same pairs as the lists; comments, blanks and repeats go."""
    (tmp_path / "role_nouns.txt").write_text("# c\n\n  User \nuser\nAdmin\n", "utf-8")
    (tmp_path / "role_nouns_ru.txt").write_text("  Админ\n", "utf-8")
    spark.createDataFrame([("When",), ("#x",)], "value string").write.text(str(tmp_path / "condition_indicators.txt"))
    got = {tuple(r) for r in terms.term_tables(spark, str(tmp_path)).collect()}
    assert got == {("role_nouns", "user"), ("role_nouns", "admin"), ("role_nouns", "админ"), ("condition_indicators", "when")}
    merged = terms.with_russian()
    assert merged["role_nouns"][:2] == ["user", "admin"] and "админ" in merged["role_nouns"] and list(merged) == list(terms.CATEGORIES)


def test_folds_carry_columns(spark):
    """Columns beside those a fold reads come through it as they are, nulls and nested ones too."""
    rows = [("d", k, ["s"], "paragraph", str(k), None if k % 2 else k, {"k": [k]}) for k in range(5)]
    u = spark.createDataFrame(rows, "doc_id string, unit_index int, section_path array<string>, block_type string, text string, n long, m map<string,array<int>>")
    got = sorted((r.unit_index, r.n, r.m["k"][0], r.group_id) for r in chunks.group_units(u).collect())
    assert got == [(k, None if k % 2 else k, k, 0) for k in range(5)]
    empty = chunks.group_units(u.limit(0))
    assert empty.count() == 0 and empty.columns[-1] == "group_id"
