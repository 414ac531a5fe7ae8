"""Letters of every script, alias tables of any size, and lexicons of very many terms."""

import unicodedata

import numpy as np
import pytest
from factloom.functions import text as t
from factloom.operators import normalize, prefilter
from pyspark.sql import functions as F


def slugs(spark, texts):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").repartition(4)
    return [r.s for r in rows.select("i", t.slugify(t.transliterate(F.lower("x"))).alias("s")).orderBy("i").collect()]


def test_no_letter_slugs_to_nothing(spark):
    letters = [chr(k) for k in range(0x80, 0x10000) if unicodedata.category(chr(k)).startswith("L") and unicodedata.name(chr(k), "")]
    got = dict(zip(letters, slugs(spark, letters), strict=True))
    assert len(letters) > 45_000
    assert {c for c, s in got.items() if not s} <= set("ъьЪЬ")  # signs that only change the letter before
    assert all(s.replace("_", "").isalnum() and s.isascii() for c, s in got.items() if s)
    ideographs = [c for c in letters if "一" <= c <= "鿿"]
    assert len({got[c] for c in ideographs}) == len(ideographs)


def test_scripts(spark):
    words = ["שלום", "한국어 학교", "Привет мир", "Ελλάδα", "Straße", "ＷＩＤＥ", "中国", "ひらがな", "हिन्दी", "ไทย", "𠀀", "naïve", "plain", "", None, "مرحبا", "-- !"]
    assert slugs(spark, words) == ["shinlamedvavmem", "hangugeo_haggyo", "privet_mir", "ellada", "strasse", "wide", "u4e2du56fd", "hiragana", "hainadaii", "saraaimaimalaithothahanyoyak", "u20000", "naive", "plain", "", None, "meemrehhahbehalef", ""]


@pytest.mark.parametrize("bound", [1 << 30, 0])
def test_alias_tables_equal_the_map(spark, bound):
    n = 30_000
    table = spark.range(n).select(F.lit("object").alias("kind"), F.concat(F.lit("Alias "), "id").alias("alias"), F.concat(F.lit("name "), (F.col("id") % 100).cast("string")).alias("canonical"))
    more = spark.createDataFrame([("object", "alias 5", "a first"), ("object", "kept", ""), ("object", None, "x"), ("verb", "alias 6", "z")], "kind string, alias string, canonical string")
    held = normalize.alias_table(table.unionByName(more), "object")
    want = {f"alias_{i}": f"name_{i % 100}" for i in range(n)} | {"alias_5": "a_first", "kept": "kept"}
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(["alias_5", "alias_6", "alias_29999", "kept", "other", None, *["alias_7"] * 50])], "i int, slug string")
    got = normalize.resolve_by_table(rows, "slug", held, "to", bound)
    assert {r.i: r.to for r in got.collect()} == {r.i: want.get(r.slug, r.slug) for r in rows.collect()} and got.columns == ["i", "slug", "to"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("BroadcastHashJoin" in plan) == (bound > 0)


def test_drafts_by_table_equal_drafts_by_map(spark):
    drafts = spark.createDataFrame([("r", i, v, o, a, "draft", None, None) for i, (v, o, a) in enumerate([("Submit", "form", "User"), ("send", "FORM ", None), ("", "empty", "admin"), (None, None, "odd")])], "run_id string, seq long, verb string, primary_object string, primary_actor string, input_state string, output_state string, action_label string")
    maps = {"role": {"user": "applicant", "admin": "administrator"}, "object": {"form": "application_form"}, "verb": {"send": "submit"}}
    table = spark.createDataFrame([(k, x, y) for k, m in maps.items() for x, y in m.items()], "kind string, alias string, canonical string")
    one, two = (normalize.normalize_drafts(drafts, c) for c in (normalize.NormalizeConfig(maps, frozenset({"empty"})), normalize.NormalizeConfig(reserved=frozenset({"empty"}), table=table)))
    key = ["seq", "action_canonical", "primary_actor_key", "input_state_key", "warnings"]
    assert sorted(map(tuple, one.select(*key).collect())) == sorted(map(tuple, two.select(*key).collect())) and one.columns == two.columns


def test_drafts_keep_columns_of_any_name(spark):
    rows = [("r", 1, "Submit", "form", None, None, None, None, "mine", "own", 5)]
    d = spark.createDataFrame(rows, "run_id string, seq long, verb string, primary_object string, primary_actor string, input_state string, output_state string, action_label string, _slug_verb string, action_canonical string, _row int")
    r = normalize.normalize_drafts(d).first()
    assert (r.action_canonical, r._slug_verb, r._row, r.primary_actor_key) == ("submit_form", "mine", 5, "unknown_actor")


def test_an_automaton_equals_the_list(spark):
    rng = np.random.default_rng(4)
    letters = np.array(list("abcdeé"))
    terms = sorted({"".join(rng.choice(letters, int(n))) for n in rng.integers(2, 7, 14_000)})[:10_000]
    w = prefilter.Weights(terms={"one": terms[:6000], "none": [], "two": [*terms[5000:], "two words", ""]})
    texts = ["".join(rng.choice([*letters, " "], 300)) for _ in range(40)] + [None, "", "Two \n\t WORDS", "É" * 9]
    chunks = spark.createDataFrame([(i, ["A", None, "b"], x) for i, x in enumerate(texts)], "i int, section_path array<string>, chunk_text string")
    small = prefilter.Weights(terms={k: v[:150] for k, v in w.terms.items()})
    found = lambda listed, w: {r.i: (r.matched_terms, r.match_counts) for r in prefilter.lexicon_match(chunks, w, listed).select("i", "matched_terms", "match_counts").collect()}
    assert found(10**9, small) == found(0, small)
    got, seen, own = found(200, w), set(), []
    for k, v in w.terms.items():
        own += [(k, x) for x in dict.fromkeys(v) if x not in seen]
        seen.update(v)
    for i, x in enumerate(texts):
        full = " ".join(" ".join(y for y in ("A b", x) if y is not None).lower().split(" ")) if x != "Two \n\t WORDS" else "a b two words"
        hits = [(k, y) for k, y in own if y in full]
        assert got[i][0] == [y for _, y in hits]
        assert got[i][1] == {k: n for k in w.terms if (n := sum(a == k for a, _ in hits))}
    size = lambda w: len(prefilter.lexicon_match(chunks, w)._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(w) - size(prefilter.Weights(terms={k: v[:400] for k, v in w.terms.items()}))) < 200
