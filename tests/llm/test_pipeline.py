"""Stages of the pipeline over a small corpus: what each must take out goes, clean documents stay."""

import hashlib
import tracemalloc
import zlib

import corpus_pipeline
import numpy as np
import pytest
from factloom.llm import chosen_path, crf_quality, hilbert_pack, marks, pfp_dedup, store
from pyspark.sql import functions as F
from test_ops import library_ids, plain_line_features, removed_marks, shingles


def test_stages_keep_columns_and_clean_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("row", F.lit("odd"))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = store.materialize(stage(spark, docs, sf), f"test-{name}")
        if name == "packing":
            assert out.count() > 0 and out.columns[:2] == ["doc_id", "start"]
            break
        assert out.columns == docs.columns
        if name == "quality":
            kept = out.join(labels, "doc_id")
            good, bad = labels.join(docs, "doc_id").where("quality = 1").count(), kept.where("quality = 0").count()
            assert kept.where("quality = 1").count() >= 0.98 * good and bad <= 2
        if name == "near_duplicates":
            assert 0 < out.count() < docs.count() and out.count() == out.select("doc_id").distinct().count()
        if name == "repeated_strings":
            assert out.count() == docs.count()
            assert pfp_dedup.remove_repeats(out, whole_characters=True).agg(F.sum("n_removed")).first()[0] < pfp_dedup.remove_repeats(docs, whole_characters=True).agg(F.sum("n_removed")).first()[0]
            assert out.where("text is not null and n_chars <> length(text)").count() == 0
        docs = out


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_nothing(spark, sf, name):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, sf).count() == 0


def plain_score(model, text):
    """Marginals of a text's lines by products over the chain, in plain Python, weighted by bytes."""
    lines = plain_line_features(text or "")
    if not lines:
        return model.prior
    x = [(np.array(f, float) - model.mean) / model.scale for _, f in lines]
    none = np.zeros(len(x[0]))
    move = np.exp(model.transition - model.transition.max())
    e = []
    for k in range(len(x)):
        full = np.concatenate([x[k], x[k - 1] if k else none, x[k + 1] if k + 1 < len(x) else none, [k == 0, k + 1 == len(x), 1]])
        good = 1 / (1 + np.exp(-np.clip(full @ model.emission, -30, 30)))
        e.append(np.array([1 - good, good]) + 1e-12)
    ahead, behind = [e[0] / e[0].sum()], [np.ones(2)]
    for v in e[1:]:
        a = v * (ahead[-1] @ move)
        ahead.append(a / a.sum())
    for v in reversed(e[1:]):
        b = move @ (v * behind[-1])
        behind.append(b / b.sum())
    p = [a * b for a, b in zip(ahead, reversed(behind), strict=True)]
    return sum(n * q[1] / q.sum() for (n, _), q in zip(lines, p, strict=True)) / sum(n for n, _ in lines)


def plain_groups(rows):
    """The documents of least id of each group of near copies."""
    sets = [shingles(r["text"], 5) for r in rows]
    label = list(range(len(rows)))
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    moved = True
    while moved:
        moved = False
        for i, j in links:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                moved = True
    return [r for i, r in enumerate(rows) if label[i] == i]


def plain_repeats(rows):
    """Texts without the characters that lie whole in strings of 100 bytes met before."""
    out = []
    for r, mark in zip(rows, removed_marks([(r["text"] or "").encode() for r in rows]), strict=True):
        text, at = "", 0
        for c in r["text"] or "":
            n = len(c.encode())
            text += "" if mark[at : at + n].all() else c
            at += n
        out.append(r if text == (r["text"] or "") else {**r, "text": text, "n_chars": len(text)})
    return out


def plain_mix(rows, seed=20):
    """Each row as often as Pareto sampling takes it, from ranks sorted within the source."""
    size = [len((r["text"] or "").translate({k: " " for k in range(9, 14)}).split(" ")) - (r["text"] or "").translate({k: " " for k in range(9, 14)}).split(" ").count("") for r in rows]
    total = {}
    for r, n in zip(rows, size, strict=True):
        total[r["source"]] = total.get(r["source"], 0) + n
    order = sorted(total, key=lambda x: (x is None, x))
    weight, target = {x: (3, 1, 2)[i % 3] for i, x in enumerate(order)}, {}
    while True:
        rest = [x for x in order if x not in target]
        share = {x: (1.5 * sum(total.values()) - sum(target.values())) * weight[x] / sum(weight[y] for y in rest) for x in rest}
        over = [x for x in rest if share[x] > 2 * total[x]]
        if not over:
            break
        target |= {x: 2.0 * total[x] for x in over}
    target |= share
    out = []
    for x in order:
        ratio = min(target[x] / total[x], 2.0) if total[x] else 0.0
        whole, f = int(ratio), ratio - int(ratio)
        need, ranked = target[x] - whole * total[x], []
        for r, n in zip(rows, size, strict=True):
            if r["source"] == x:
                out += [r] * whole
                digest = hashlib.md5(f"{seed}:{r['doc_id']}:{hashlib.md5((r['text'] or '').encode()).hexdigest()}".encode()).hexdigest()
                u = (int(digest[:13], 16) + 0.5) / (1 << 52)
                ranked.append((u / (1 - u), r["doc_id"], n, r))
        before = 0
        for _, _, n, r in sorted(ranked, key=lambda q: q[:2]) if f > 0 else ():
            out += [r] if before + n / 2 <= need else []
            before += n
    return out


def plain_pieces(rows, length=2048):
    """Pieces of the ids laid end to end in the order of the curve."""
    ids = library_ids([r["text"] for r in rows], "byte_bpe_50k.json")
    key = hilbert_pack.document_keys(np.concatenate(ids), np.array([len(x) for x in ids]), hilbert_pack._tables(50257))
    assert len({(k, r["doc_id"]) for k, r in zip(key, rows, strict=True)}) == len(set(key.tolist()))  # no ties but of copies
    out, at = [], 0
    for k in np.argsort(key, kind="stable"):
        start = 0
        while start < len(ids[k]):
            n = min(length - at % length, len(ids[k]) - start)
            out.append((rows[k]["doc_id"], start, n, zlib.crc32(np.array(ids[k][start : start + n], "<u4").tobytes()), len(ids[k]), at // length, at % length))
            start, at = start + n, at + n
    return out


def test_run_against_brute_force(spark, sf, tmp_path):
    """All rows of the pipeline, from documents with null and blank texts and without source, by plain Python."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    shared = " ".join(f"wörd{k}" for k in range(30))
    more = [(10_000 + k, t, "en", s, 0) for k, (t, s) in enumerate([(None, "web"), (" ", None), (f"First of the two: {shared}. It ends here.", None), (f"The second one, {shared}; and other words follow it.", "web"), ("Alone.", None)])]
    base = str(tmp_path)
    docs.unionByName(spark.createDataFrame(more, docs.schema)).write.parquet(f"{base}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{base}/labels.parquet")
    docs = spark.read.parquet(f"{base}/documents.parquet")
    model = crf_quality.train(docs, spark.read.parquet(f"{base}/labels.parquet"))
    rows = sorted((r.asDict() for r in docs.collect()), key=lambda r: r["doc_id"])
    rows = [r for r in rows if plain_score(model, r["text"]) >= 0.3]
    quality = len(rows)
    rows = plain_groups(rows)
    assert len(rows) < quality < docs.count()
    rows = plain_mix(plain_repeats(rows))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, base).select(columns).collect()) == sorted(plain_pieces(rows))


def test_batches_of_near_duplicates_are_bounded(spark, sf):
    """Also when the stage runs alone, and the stage after it gets its own bound."""
    docs, bound = spark.read.parquet(f"{sf}/documents.parquet").limit(20), "spark.sql.execution.arrow.maxBytesPerBatch"
    stages = dict(corpus_pipeline.STAGES)
    spark.conf.set(bound, "64m")
    out = store.materialize(stages["near_duplicates"](spark, docs, sf), "test-bound")
    assert spark.conf.get(bound) == "2m" and out.count() > 0
    stages["repeated_strings"](spark, out, sf)
    assert spark.conf.get(bound) == "8m"


def test_blocks_of_near_duplicates_take_little_memory():
    """Two full blocks on full sets, exact, in a few tens of MB."""
    draw = np.random.default_rng(7)
    stock = np.unique(draw.integers(0, 1 << 63, 20_000).astype(np.uint64))
    q = [np.sort(draw.choice(stock, 200, replace=False)) for _ in range(chosen_path.BLOCK)]
    p = [np.union1d(x[:-4], stock[k : k + 4]) for k, x in enumerate(q[:128])] + [np.zeros(0, np.uint64)]
    tracemalloc.start()
    try:
        got = chosen_path.similar_rows(p, q, 80)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    near = draw.choice(len(q), 40, replace=False)
    for a in [*range(0, 129, 16), 128]:
        for b in {*near.tolist(), a}:
            both = len(np.intersect1d(p[a], q[b]))
            assert got[a, b] == (100 * both >= 80 * (len(p[a]) + len(q[b]) - both))
    assert got.any() and not got[128].any()
    assert peak < 45 << 20, peak


def test_repeated_strings_start_one_worker_a_task(spark, sf, monkeypatch):
    """The bitmap is looked up without Python, and Arrow batches are small until the runs are written."""
    docs, bound = spark.read.parquet(f"{sf}/documents.parquet"), "spark.sql.execution.arrow.maxBytesPerBatch"
    written, bounds = store.materialize, {}

    def noted(df, name):
        bounds[name] = spark.conf.get(bound), "EvalPython" in df._jdf.queryExecution().executedPlan().toString()
        return written(df, name)

    monkeypatch.setattr(store, "materialize", noted)
    for stage in ("near_duplicates", "repeated_strings"):
        out = dict(corpus_pipeline.STAGES)[stage](spark, docs, sf)
        assert "EvalPython" not in out._jdf.queryExecution().executedPlan().toString()
    assert {name for name in bounds if name.startswith("pfp-")} == {"pfp-phrases", "pfp-hot", "pfp-open", "pfp-runs"}
    assert set(bounds.values()) == {("2m", False)}
    assert spark.conf.get(bound) == "8m"


def test_marked_rows(spark):
    """Every row that could match a key is marked, null ids too, and few others."""
    keys = spark.createDataFrame([(k if k % 7 else None, k * k) for k in range(0, 3000, 3)], "a long, b long")
    rows = [(k if k % 7 else None, k * k) for k in range(3000)]
    frame = spark.createDataFrame(rows + rows[:50], "a long, b long")
    got = marks.marked(frame, keys, "a", "b")
    assert got.columns == ["a", "b", "hit"] and sorted(map(str, got.drop("hit").collect())) == sorted(map(str, frame.collect()))
    hit = {(r.a, r.b) for r in got.where("hit").collect()}
    assert {tuple(r) for r in keys.collect()} <= hit and len(hit) < 1050
    assert got.where("hit is null").count() == 0
    assert marks.marked(frame, keys.limit(0), "a", "b").where("not hit").count() == 3050
