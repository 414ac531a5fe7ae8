"""Each operator against brute force, an exact round trip or held-out labels, with nulls, ties, empties and odd columns."""

import hashlib
import itertools
import json
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from factloom.llm import chosen_path, components, crf_quality, elias_fano, flat_graph, hilbert_pack, media_tar, pareto_mix, pfp_dedup, prefix_targets, registry, store, textbytes, token_counts, tokenids
from pyspark.sql import functions as F

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
DOC = "doc_id long, text string, lang string, source string, n_chars long, row string, b int, k0 string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS, n))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(4)
    base = [prose(rng, int(n)) for n in rng.integers(30, 120, 40)]
    near = [t.replace("alpha", "omega", 1) for t in base[:10]] + base[10:14]
    special = [None, "", " ", "x", "one two", "é" * 150, "a" * 450, "ab " * 300, "tail   ퟿<|endoftext|></s>", prose(rng, 9000), "no\nnewline\n\n", "Ünï cödé " * 40]
    return [*base, *near, *special]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", 0, "odd", i, "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def raw(texts):
    return [(t or "").encode() for t in texts]


# --- shared pieces -------------------------------------------------------------------------------------------------


def test_span_hashes_and_slices():
    data = np.frombuffer(b"abcabcxabc", np.uint8)
    h = textbytes.span_hashes(data, np.array([0, 3, 7, 0]), np.array([3, 6, 10, 2]))
    assert h[0] == h[1] == h[2] != h[3]
    assert list(textbytes.slices(np.array([0, 5, 50, 51, 52]), 10)) == [(0, 1), (1, 2), (2, 4)]


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(200)]
    label = {x: x for p in pairs for x in p}
    for _ in label:
        moved = False
        for a, b in pairs:
            m = min(label[a], label[b])
            moved |= label[a] != m or label[b] != m
            label[a] = label[b] = m
        if not moved:
            break
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: label[x] for p in pairs if p[0] != p[1] for x in p}


@pytest.mark.parametrize(("name", "change"), [("byte_bpe_50k.json", None), ("word_bpe_49k.json", None), ("byte_bpe_50k.json", "prefix"), ("word_bpe_49k.json", "split")])
def test_unit_encoder_equals_library(texts, name, change, tmp_path):
    path = public_tokenizers.path(name)
    if change:  # a file whose cut rules are not known: whole texts go to the library
        setting = json.loads(open(path, encoding="utf-8").read())
        setting["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": change == "prefix", "trim_offsets": True, "use_regex": change == "prefix"}
        path = str(tmp_path / name)
        open(path, "w", encoding="utf-8").write(json.dumps(setting))
    e = tokenids.UnitEncoder(path)
    assert e.cuts == (change is None)
    odd = [*[t or "" for t in texts], "don't stop, U.S.A. 's", " lead", "x  y\t z  w", "á, é .", "\x01 \x01a", "日本語 テキスト", "<|endoftext|> x<|startoftext|>y", "3.14,15 #tag$%&*"]
    data = np.frombuffer("".join(odd).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t.encode()) for t in odd])])
    for _ in range(2):  # the second time from the cache
        ids, n = e.encode(data, at)
        stop = np.cumsum(n)
        for k, t in enumerate(odd):
            assert ids[stop[k] - n[k] : stop[k]].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, t


# --- 1 -------------------------------------------------------------------------------------------------------------


def test_quality_on_held_out_documents(spark):
    big = "/root/testdata/sf0.01"
    s = registry.op1_crf_quality(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert len(s) > 50 and (s.predicted == s.quality).mean() > 0.95 and s.score.between(0, 1).all()


def test_quality_edges(spark, docs, none):
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in crf_quality.quality_scores(docs, empty).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(20)] + [(None, 0), (3, None), (4, 7)], "doc_id long, quality int")
    assert {r.score for r in crf_quality.quality_scores(docs, one).collect()} == {1.0}
    assert crf_quality.quality_scores(none, one).count() == 0


def plain_line_features(t):
    """(bytes, features) of each line of a text that is not empty, in plain Python."""
    lines, seen, said, prior = [], set(), set(), None
    for b in (b for b in t.encode().split(b"\n") if b):
        words = [w for w in re.split(rb"[ \t\r]", b) if w]
        n, letters = max(len(words), 1), sum(c < 128 and chr(c).isalpha() or c >= 128 for c in b)
        symbols = sum(33 <= c < 127 and not chr(c).isalnum() and chr(c) not in ".,;:?'\"()-" for c in b)
        new = stutter = 0
        for w in words:
            new += w not in seen
            stutter += w == prior
            seen.add(w)
            prior = w
        lines.append((len(b), [np.log1p(len(b)), sum(65 <= c < 91 for c in b) / max(letters, 1), symbols / len(b), b.count(b"!") / n, b.count(b"|") / n, sum(48 <= c < 58 for c in b) / len(b), min(len(b) / n, 40) / 10, new / n, float(b in said), sum(c in b".,;:?" for c in b) / n, sum(c >= 128 for c in b) / len(b), np.log1p(len(words)), stutter / n, stutter / n > 0.25]))
        said.add(b)
    return lines


def test_line_features_and_score_against_plain_python(spark):
    texts = ["One two two. 12!\nONE two|x\n\none two two. 12!", "a b\r\nc", "x" * 50, "\n\n", "Zwölf Boxkämpfer, jagen"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    x, doc, size = crf_quality.line_features(data, at)
    want = [(k, *line) for k, t in enumerate(texts) for line in plain_line_features(t)]
    assert [(int(d), int(s)) for d, s in zip(doc, size, strict=True)] == [(d, s) for d, s, _ in want]
    assert np.allclose(x, np.array([f for _, _, f in want], float))
    rng = np.random.default_rng(1)
    model = crf_quality.LineCrf(x.mean(0), x.std(0) + 1, rng.normal(size=3 * crf_quality.N_FEATURES + 3), rng.normal(size=(2, 2)), 0.4)
    p = model.marginals(x, doc)
    out = {r.doc_id: r.score for r in crf_quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for k in range(len(texts)):
        own = doc == k
        assert out[k] == pytest.approx((p[own] * size[own]).sum() / size[own].sum() if own.any() else 0.4)


def test_lines_of_a_document_may_differ(spark):
    rng = np.random.default_rng(17)
    junk = lambda: " ".join("$$%# BUY!!! ||| 999"[: int(rng.integers(8, 19))] for _ in range(4))
    docs, labels, kinds = [], [], {}
    for i in range(600):
        good = i % 2
        odd = int(rng.integers(0, 3)) if i % 3 == 0 else 0  # lines of the other kind in a third of the documents
        kind = [good] * (odd * 3 + 2) + [1 - good] * odd
        rng.shuffle(kind)
        docs.append((i, "\n".join(prose(rng, 12) + "." if k else junk() for k in kind)))
        labels.append((i, good))
        kinds[i] = kind
    frame, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = crf_quality.train(frame, known)
    held = [i for i, t in docs if zlib.crc32(str(i).encode()) % 5 == 0]
    data = np.frombuffer("".join(docs[i][1] for i in held).encode(), np.uint8)
    x, doc, _ = crf_quality.line_features(data, np.concatenate([[0], np.cumsum([len(docs[i][1].encode()) for i in held])]))
    p, truth = model.marginals(x, doc), np.concatenate([kinds[i] for i in held])
    mixed = np.array([len(set(kinds[i])) > 1 for i in held])[doc]
    assert mixed.sum() > 50 and ((p >= 0.5) == truth)[mixed].mean() > 0.95
    scores = {r.doc_id: r.predicted for r in crf_quality.quality_scores(frame, known).collect()}
    assert np.mean([scores[i] == i % 2 for i in held]) > 0.95


def test_the_fit_is_bounded_by_lines(spark, monkeypatch):
    monkeypatch.setattr(crf_quality, "FIT_LINES", 60)
    sizes = []
    monkeypatch.setattr(crf_quality, "fit_documents", lambda x, doc, size, y: sizes.append(len(x)) or crf_quality.fit(x, doc, y[doc], rounds=1))
    docs = spark.createDataFrame([(i, "\n".join(f"line {k} of {i}" for k in range(9))) for i in range(40)], "doc_id long, text string")
    crf_quality.train(docs, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int"))
    assert 27 <= sizes[0] <= 60


def test_forward_backward_against_all_labelings():
    rng = np.random.default_rng(1)
    odds, doc, move = rng.normal(size=7), np.array([0, 0, 0, 0, 1, 2, 2]), rng.normal(size=(2, 2))
    p, expected = crf_quality.forward_backward(odds, doc, move)
    pairs = np.zeros((2, 2))
    for d in range(3):
        at = np.flatnonzero(doc == d)
        z, own = 0.0, np.zeros(len(at))
        part = np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=len(at)):
            w = np.exp(sum(odds[i] * v for i, v in zip(at, y, strict=True)) + sum(move[a, b] for a, b in itertools.pairwise(y)))
            z += w
            own += w * np.array(y)
            for a, b in itertools.pairwise(y):
                part[a, b] += w
        pairs += part / z
        assert np.allclose(p[at], own / z, atol=1e-6)
    assert np.allclose(expected, pairs, atol=1e-6)


def test_blocks_of_lines_give_the_same_as_one_line_after_another():
    rng = np.random.default_rng(5)
    doc = np.repeat(np.arange(6), [1, 2, 400, 37, 36, 5])
    odds, move = 3 * rng.normal(size=len(doc)), rng.normal(size=(2, 2))
    p, expected = crf_quality.forward_backward(odds, doc, move)
    e = np.stack([1 / (1 + np.exp(odds)), 1 / (1 + np.exp(-odds))], 1)
    want, pairs = np.zeros(len(doc)), np.zeros((2, 2))
    for d in range(6):
        at, m = np.flatnonzero(doc == d), np.exp(move)
        a, b = np.zeros((len(at), 2)), np.ones((len(at), 2))
        for t in range(len(at)):
            a[t] = e[at[t]] * (a[t - 1] @ m if t else 1)
            a[t] /= a[t].sum()
        for t in range(len(at) - 2, -1, -1):
            b[t] = m @ (e[at[t + 1]] * b[t + 1])
            b[t] /= b[t].sum()
        want[at] = (a * b)[:, 1] / (a * b).sum(1)
        for t in range(len(at) - 1):
            pair = a[t][:, None] * m * (e[at[t + 1]] * b[t + 1])[None]
            pairs += pair / pair.sum()
    assert np.allclose(p, want, atol=1e-8) and np.allclose(expected, pairs, atol=1e-6)


def test_a_long_text_neither_voids_nor_stalls_the_fit(spark, monkeypatch):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    known = crf_quality.usable_labels(labels).orderBy(F.xxhash64("id")).first()
    long = "\n".join(f"l {k}" for k in range(200_001))
    longer = docs.withColumn("text", F.when(F.col("doc_id") == known.id, F.lit(long)).otherwise(F.col("text")))

    def accuracy(frame):
        s = crf_quality.quality_scores(frame, labels).where("held_out").join(labels, "doc_id").where(F.col("doc_id") != known.id)
        return s.agg(F.avg(F.expr("cast(predicted = quality as double)"))).first()[0]

    plain, odd = accuracy(docs), accuracy(longer)
    assert plain > 0.9 and abs(plain - odd) < 0.01
    monkeypatch.setattr(crf_quality, "DOC_LINES", 10)
    with pytest.warns(UserWarning, match="no labelled document"):
        none = crf_quality.train(spark.createDataFrame([(3, long)], "doc_id long, text string"), spark.createDataFrame([(3, 1)], "doc_id long, quality int"))
    assert none.prior == 0.5


def test_long_texts_take_few_steps():
    rng = np.random.default_rng(6)
    doc = np.repeat([0, 1], [190_000, 5])
    began = time.time()
    crf_quality.forward_backward(rng.normal(size=len(doc)), doc, np.eye(2))
    assert time.time() - began < 3  # 7 s line after line on an idle machine
    assert crf_quality.DOC_LINES * 10 <= crf_quality.FIT_LINES  # no text takes most of the fit


# --- 2 -------------------------------------------------------------------------------------------------------------


def test_media_round_trip(docs, none, texts):
    got = {r.doc_id: r for r in media_tar.media_table(docs).collect()}
    assert len(got) == len(texts)
    for i, b in enumerate(raw(texts)):
        p = b + b" " * (-len(b) % 192 or (0 if b else 192))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.width, r.height * 192) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), 192, len(p))
        stored = open(r.shard.removeprefix("file:"), "rb").read()[r.offset : r.offset + r.length]
        assert hashlib.sha256(stored).hexdigest() == r.media_sha256 and media_tar.decode_png(stored).tobytes() == p
    assert len({(r.shard, r.offset) for r in got.values()}) == len({r.digest for r in got.values()})
    assert media_tar.media_table(none).count() == 0


def test_media_holds_no_more_than_its_bound(spark, monkeypatch):
    monkeypatch.setattr(media_tar, "HELD_BYTES", 200)
    monkeypatch.setattr(media_tar, "MET_DIGESTS", 3)
    rng = np.random.default_rng(3)
    some = [prose(rng, 30) for _ in range(40)]
    rows = [(i, some[i % 40]) for i in range(120)] + [(200 + i, f"{i} {prose(rng, 9)}") for i in range(30)] + [(None, some[0])]
    got = media_tar.media_table(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows) and len({(r.shard, r.offset) for r in got}) == 70
    for r in got:
        t = dict(rows)[r.doc_id].encode()
        assert r.payload_sha256 == hashlib.sha256(t + b" " * (-len(t) % 192)).hexdigest()


# --- 3 -------------------------------------------------------------------------------------------------------------


def test_links_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(260, 16))
    v = np.concatenate([base, base[:60] + 0.1 * rng.normal(size=(60, 16)), base[:20], np.tile(base[0], (30, 1)) + 0.05 * rng.normal(size=(30, 16))]).astype(np.float32)
    label = rng.integers(0, 3, len(v))
    rows = [(i, x.tolist(), int(k), "odd") for i, (x, k) in enumerate(zip(v, label, strict=True))]
    bad = [(1000, None, 1, ""), (1001, [0.0] * 16, 1, ""), (1002, [float("nan")] * 16, 1, ""), (1003, [None] + [1.0] * 15, 1, ""), (1004, v[0].tolist(), None, ""), (1005, [], 1, ""), (1006, [1.0, 2.0], 1, "")]
    t = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int, grp string")
    got = {r.vec_id: r for r in flat_graph.near_links(t).collect()}
    x = v.astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    assert len(got) == len(rows) + len(bad)
    assert [got[i].n_links for i in range(len(v))] == near.sum(1).tolist()
    for i, j in zip(*np.nonzero(near), strict=True):
        assert got[i].component_id == got[j].component_id <= min(i, j)
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in (1000, 1001, 1002, 1003, 1004, 1005, 1006))
    assert flat_graph.near_links(t.limit(0)).count() == 0


def test_links_of_very_small_and_very_large_vectors(spark):
    rng = np.random.default_rng(12)
    base = rng.normal(size=(1400, 12))
    v = np.concatenate([base, base[:300] + 0.08 * rng.normal(size=(300, 12))])
    factor = np.ones(len(v))
    factor[[3, 7, 1403, 1500]], factor[[4, 8, 1404, 1600]] = 1e-200, 1e200
    t = spark.createDataFrame([(i, (x * f).tolist(), 0) for i, (x, f) in enumerate(zip(v, factor, strict=True))], "vec_id long, embedding array<double>, label int")
    x = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = x @ x.T >= 0.93
    np.fill_diagonal(near, False)
    got = {r.vec_id: r.n_links for r in flat_graph.near_links(t).collect()}
    assert len(v) > flat_graph.SHARD and near.sum() > 200 and [got[i] for i in range(len(v))] == near.sum(1).tolist()


def test_search_reaches_recall_over_many_shards(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(1500, 24))
    v = np.concatenate([base, base[:300] + 0.12 * rng.normal(size=(300, 24))])
    t = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    _, classes = flat_graph.classes_of(t, "vec_id", "embedding", "label")
    shards = flat_graph.deal_shards(classes, 1, shard=300)
    assert shards.groupBy("gid").count().agg(F.max("count")).first()[0] <= 300
    pairs = flat_graph.search(shards, flat_graph.build(shards), 0.93)
    assert flat_graph.audit_recall(classes, pairs, 0.93) >= 0.9


def test_links_of_a_dense_group_over_several_shards(spark):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=32)
    v = centre + 0.42 * np.linalg.norm(centre) / np.sqrt(32) * rng.normal(size=(4 * flat_graph.SHARD, 32))
    t = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    x = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = x @ x.T >= 0.93
    np.fill_diagonal(near, False)
    assert near.sum() > len(v)
    got = {r.vec_id: r.n_links for r in flat_graph.near_links(t).collect()}
    assert [got[i] for i in range(len(v))] == near.sum(1).tolist()


def test_searches_leave_their_shards(spark):
    """Vectors along curves that hold several times a shard's vectors, where every shard's edge has near ones beyond it."""
    rng = np.random.default_rng(12)
    turn = rng.uniform(0, 2 * np.pi, (2, 900))
    planes = np.linalg.qr(rng.normal(size=(24, 4)))[0]
    v = np.concatenate([np.cos(t)[:, None] * planes[:, 2 * k] + np.sin(t)[:, None] * planes[:, 2 * k + 1] for k, t in enumerate(turn)]) + 0.01 * rng.normal(size=(1800, 24))
    t = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    x = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = {(int(a), int(b)) for a, b in zip(*np.nonzero(x @ x.T >= 0.93), strict=True) if b < a}
    _, classes = flat_graph.classes_of(t, "vec_id", "embedding", "label")
    shards = flat_graph.deal_shards(classes, 1, shard=400)
    assert shards.where("dense").isEmpty() and shards.select("gid").distinct().count() > 6
    lists = flat_graph.build(shards)
    inside = flat_graph.search(shards, lists, 0.93)
    found = {(r.a, r.b) for r in flat_graph.walk_on(shards, lists, inside, 0.93).collect()}
    assert found <= near and inside.count() < 0.99 * len(near) < len(found)


def test_blocks_count_links_and_connect(spark, monkeypatch):
    monkeypatch.setattr(flat_graph, "BLOCK", 40)
    rng = np.random.default_rng(13)
    v = rng.normal(size=(150, 4))
    x = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = x @ x.T >= 0.93
    np.fill_diagonal(near, False)
    n = rng.integers(1, 4, 150)
    groups = [(g, i, v[i].tolist(), int(n[i]), [7, 8] if i % 3 == 0 else [g]) for i in range(150) for g in ((7, 8) if i % 3 == 0 else (7,) if i % 3 == 1 else (8,))]
    out = flat_graph.block_links(spark.createDataFrame(groups, "gid long, id long, v array<double>, n long, gids array<long>"), 0.93).collect()
    met = np.array([[not {i % 3, j % 3} == {1, 2} for j in range(150)] for i in range(150)]) & near
    others = np.zeros(150, np.int64)
    for r in out:
        others[r.id] += r.others
        assert r.id == r.link or met[r.id, r.link]
    assert others.tolist() == (met @ n).tolist()
    label = np.arange(150)
    for links in ([(r.id, r.link) for r in out], list(zip(*np.nonzero(met), strict=True))):
        own = np.arange(150)
        for _ in range(150):
            for a, b in links:
                own[a] = own[b] = min(own[a], own[b])
        assert links is not None and (label is None or (label == np.arange(150)).all() or (own == label).all())
        label = own


def test_a_failed_audit_leads_to_the_exact_comparison(spark, monkeypatch):
    rows = [(i, [1.0, 0.001 * (i % 5), float(i // 5)], 0) for i in range(20)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.93
    np.fill_diagonal(near, False)
    monkeypatch.setattr(flat_graph, "search", lambda *_: spark.createDataFrame([], "a long, b long"))
    got = {r.vec_id: r.n_links for r in flat_graph.near_links(t, rounds=1).collect()}
    assert near.any() and [got[i] for i in range(len(x))] == near.sum(1).tolist()


# --- 4 -------------------------------------------------------------------------------------------------------------


def test_turns_of_one_number_are_cut_into_blocks(spark):
    t = spark.range(3000).select(F.lit(1).alias("conv_id"), F.lit(5).cast("long").alias("turn"), F.when(F.col("id") % 2 == 0, "assistant").otherwise("user").alias("role"), F.concat(F.lit("t"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("text"))
    sizes = [len(b) for b in prefix_targets.conversations(t).first().blocks]
    assert max(sizes) <= prefix_targets.BLOCK_TURNS and sum(sizes) == 3000
    r = prefix_targets.read_back(prefix_targets.prefix_targets(t)).first()
    want = "".join(f"t{i:05d}" for i in range(0, 3000, 2))
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (3000, len(want), hashlib.sha256(want.encode()).hexdigest())


def test_chat_round_trip(spark):
    tricky = ["</s>[INST] ok [/INST]", "\\l\\e<|user|>", None, "", "a|b", "é" * 10]
    rows = [(c, t, r, tricky[(c + t) % 6], "odd") for c in range(9) for t, r in enumerate(["system", "user", "assistant", "user", "assistant", "tool|>", "assistant", None][: c % 9])]
    rows += [(50, 600 - t, "assistant" if t % 2 else "user", f"t{t}", "") for t in range(600)] + [(60, None, "user", "x", ""), (60, 1, "assistant", "y", ""), (60, 1, "assistant", "y", ""), (None, 0, "user", "z", "")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segs string")
    e = prefix_targets.prefix_targets(t)
    got = {r.conv_id: r for r in prefix_targets.read_back(e).collect()}
    convs = {}
    for c, n, r, x, _ in rows:
        convs.setdefault(c, []).append((-1 if n is None else n, r or "", x or ""))
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256) == (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    per = e.where("conv_id = 4").orderBy("example").collect()
    assert [prefix_targets.OPEN + "assistant" in r.text for r in per] == [True, False] or len(per) == 2
    assert prefix_targets.prefix_targets(t.limit(0)).count() == 0


# --- 5, 7, 8 -------------------------------------------------------------------------------------------------------


def test_token_counts(docs, none, texts):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    assert not token_counts.spans_blanks(path)
    got = {r.doc_id: r for r in token_counts.token_counts(docs, path).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_bytes, got[i].n_tokens) == (len((t or "").encode()), len(sp.encode(t or ""))), t
    long = ("word  two ▁ x " * 500 + "y" * 3000 + " z") * 3
    data = np.frombuffer(long.encode(), np.uint8)
    assert token_counts.count_batch(path, data, np.array([0, len(data)]), 700)[0] == len(sp.encode(long))
    assert token_counts.token_counts(none, path).count() == 0


def library_ids(texts, name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


def test_packing(docs, none, texts):
    want = library_ids(texts, "byte_bpe_50k.json")
    pieces = hilbert_pack.pack(docs.repartition(5), public_tokenizers.path("byte_bpe_50k.json"), 256).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        own = want[p.doc_id]
        assert p.doc_tokens == len(own) and p.ids_crc32 == zlib.crc32(np.array(own[p.start : p.start + p.length], "<u4").tobytes())
        by_doc.setdefault(p.doc_id, []).append((p.start, p.length))
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert set(by_doc) == set(range(len(texts)))
    for total, spans in [*((len(want[k]), v) for k, v in by_doc.items()), *((None, v) for v in by_sequence.values())]:
        at = 0
        for start, length in sorted(spans):
            assert start == at and length > 0
            at += length
        assert total in (None, at)
    full = [sum(n for _, n in v) for v in by_sequence.values()]
    assert sum(f != 256 for f in full) <= 1
    assert hilbert_pack.pack(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_hilbert_curve_steps_by_one():
    grid = np.array(list(itertools.product(range(8), repeat=2)))
    order = grid[np.argsort(hilbert_pack.hilbert_key(grid, 3))]
    assert sorted(hilbert_pack.hilbert_key(grid, 3).tolist()) == list(range(64))
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_token_files(docs, none, texts, spark):
    want, before = library_ids(texts, "word_bpe_49k.json"), 0
    got = {r.doc_id: r for r in elias_fano.token_files(docs.repartition(3), public_tokenizers.path("word_bpe_49k.json")).collect()}
    for i, ids in enumerate(want):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (before, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        before += len(ids)
    odd = spark.createDataFrame([(None, "b"), (5, "a"), (5, "a"), (-3, None)], "doc_id long, text string")
    out = sorted((r.start, r.doc_id) for r in elias_fano.token_files(odd, public_tokenizers.path("word_bpe_49k.json")).collect())
    assert [d for _, d in out] == [None, -3, 5, 5]
    same = spark.createDataFrame([(None, f"a{i % 7}") for i in range(300)] + [(5, "b")] * 300, "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    shards = store.materialize(elias_fano.write_shards(same, store.fresh(spark, "ids"), public_tokenizers.path("word_bpe_49k.json")), "shards")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert shards.where("n_docs > 200").isEmpty()
    spans = sorted((r.start, r.n_tokens, r.doc_id) for r in elias_fano.read_shards(shards).collect())
    assert [d for _, _, d in spans] == [None] * 300 + [5] * 300 and all(a + n == b for (a, n, _), (b, _, _) in itertools.pairwise(spans))
    assert elias_fano.token_files(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("values", [[], [0], [7], [0, 0, 0], list(range(2000)), [3, 3, 900_000, 900_000, 1 << 40]])
def test_elias_fano(values):
    e = elias_fano.EliasFano.from_bytes(elias_fano.EliasFano.of(np.array(values, np.int64)).to_bytes())
    assert e.select(0, len(values)).tolist() == values
    for i in range(0, len(values), max(1, len(values) // 7)):
        assert e.select(i, i + 1).tolist() == [values[i]]


# --- 6 -------------------------------------------------------------------------------------------------------------


def removed_marks(bodies, length=100):
    seen, out = set(), []
    for b in bodies:
        mark = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                mark[i : i + length] = True
            seen.add(w)
        out.append(mark)
    return out


def check_repeats(frame, rows):
    """rows: (doc_id, text) as in the frame; rows that are equal count once, null ids come first, then digests of texts decide."""
    digest = {t: h for t, h in frame.select("text", F.xxhash64(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("h")).distinct().collect()}
    order = sorted({(d is not None, d or 0, digest[t], t or "") for d, t in rows})
    marks = dict(zip([(o[0], o[1], o[3]) for o in order], removed_marks([o[3].encode() for o in order]), strict=True))
    got = pfp_dedup.remove_repeats(frame).collect()
    assert len(got) == len(rows)
    for r in got:
        b, mark = (r.row.text or "").encode(), marks[(r.row.doc_id is not None, r.row.doc_id or 0, r.row.text or "")]
        spans = int((np.diff(np.concatenate([[0], mark.astype(int)])) == 1).sum())
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == (len(b), int(mark.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~mark])), r.row.doc_id


@pytest.mark.parametrize(("hot", "in_slice"), [(2000, 16), (1, 16), (2000, 1), (1, 1)])
def test_repeats_against_brute_force(docs, none, texts, spark, monkeypatch, hot, in_slice):
    monkeypatch.setattr(pfp_dedup, "HOT_PHRASES", hot)
    monkeypatch.setattr(pfp_dedup, "HOT_IN_SLICE", in_slice)
    shared = prose(np.random.default_rng(9), 40)
    more = [f"{i} {shared} {prose(np.random.default_rng(i), 30)} {shared[7:]}" for i in range(25)] + ["xyz" * 200, "xyz" * 90]
    rows = [*enumerate([*texts, *more])]
    d = docs.select("doc_id", "text", "row").unionByName(spark.createDataFrame([(len(texts) + i, t, "odd") for i, t in enumerate(more)], "doc_id long, text string, row string"))
    check_repeats(d.repartition(4), rows)
    assert pfp_dedup.remove_repeats(none).count() == 0


@pytest.mark.parametrize("known", [1 << 16, 40])
def test_strings_of_hot_triggers_and_repeated_rows(spark, monkeypatch, known):
    monkeypatch.setattr(pfp_dedup, "HOT_PHRASES", 1)
    monkeypatch.setattr(pfp_dedup, "KNOWN_STRINGS", known)
    monkeypatch.setattr(pfp_dedup, "PARSE_BYTES", 3000)
    monkeypatch.setattr(pfp_dedup, "HELD_ROWS", 20)
    shared = prose(np.random.default_rng(19), 40)
    rows = [(i // 2, f"{prose(np.random.default_rng(i // 2), 3)} {shared} {prose(np.random.default_rng(500 + i // 2), 3)}") for i in range(400)]
    check_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows)


def test_held_strings_are_thinned_to_their_first():
    same, other = b"a" * 100, b"b" * 100
    rows = [(5, 1, 0, 0, same), (5, 1, 0, 3, other), (5, 2, 0, 0, same), (5, 2, 0, 1, same + b"c"), (5, 3, 0, 9, other)]
    spans = np.array([0, 0, 0, 1, 0])
    place = pfp_dedup.pack_place(np.zeros(5, np.int64), np.array([r[3] for r in rows]), np.array([r[3] for r in rows]), np.array([r[3] for r in rows]) + spans)
    table = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows]), pa.array(place), pa.array([r[4] for r in rows])], names=["p", "d", "th", "place", "body"])
    kept, gone = pfp_dedup.thinned(table)
    assert [(r["d"], r["body"]) for r in kept.to_pylist()] == [(1, same), (1, other), (2, same + b"c")]
    assert gone.to_pydict() == {"d": [2, 3], "th": [0, 0], "from": [0, 9], "to": [0, 9]}


@pytest.mark.parametrize("one_id", [None, 7])
def test_repeats_of_very_many_rows_of_one_id(spark, one_id):
    rng = np.random.default_rng(5)
    passages = [prose(rng, 25) for _ in range(60)]
    rows = [(one_id, f"{prose(rng, 6)} {passages[i % 60]} {i} {prose(rng, 8)}") for i in range(4000)]
    rows += rows[:50] + [(one_id, None), (3, passages[0] + " and more of it")]
    check_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), rows)


def test_suffix_order_is_that_of_the_bytes():
    rng = np.random.default_rng(6)
    data = rng.integers(97, 99, 900).astype(np.uint8)
    begin = np.arange(0, 800)
    array, rank = pfp_dedup.suffix_order(data, begin, 100)
    strings = [data[i : i + 100].tobytes() for i in begin]
    assert [strings[i] for i in array] == sorted(strings)
    assert len(set(rank.tolist())) == len(set(strings))


def test_repeats_keep_characters_whole_and_repeated_rows(spark):
    t = "é" * 120 + "ü" * 10
    d = spark.createDataFrame([(1, "x" + t), (2, "yz" + t), (2, "yz" + t), (None, "q")], "doc_id long, text string")
    out = pfp_dedup.remove_repeats(d, whole_characters=True).collect()
    assert len(out) == 4
    for r in out:
        bytes(r.kept).decode()
    assert len({bytes(r.kept) for r in out if r.row.doc_id == 2}) == 1


# --- 9 -------------------------------------------------------------------------------------------------------------


def shingles(text, k):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize(("k", "leaf", "block", "node_blocks"), [(2, 64, 2048, 256), (5, 64, 2048, 256), (2, 2, 3, 256), (2, 2, 3, 1)])
def test_near_duplicates_against_brute_force(docs, none, texts, spark, monkeypatch, k, leaf, block, node_blocks):
    for name, value in (("LEAF", leaf), ("BLOCK", block), ("NODE_BLOCKS", node_blocks)):
        monkeypatch.setattr(chosen_path, name, value)
    rng = np.random.default_rng(8)
    chain = [prose(rng, 80).split()]
    for i in range(25):  # each like the one before, the ends unlike each other
        nxt = list(chain[-1])
        nxt[(3 * i) % 80] = f"new{i}"
        chain.append(nxt)
    more = [" ".join(c).upper() for c in chain]
    every = [*texts, *more]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(len(texts) + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    sets = [shingles(t, k) for t in every]
    label = list(range(len(every)))
    links = [(i, j) for i in range(len(every)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    for _ in every:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    got = {r.doc_id: r for r in chosen_path.near_components(d, words=k).collect()}
    assert [(got[i].n_shingles, got[i].component_id, got[i].kept) for i in range(len(every))] == [(len(sets[i]), label[i], label[i] == i) for i in range(len(every))]
    if leaf == 64 and k == 5:
        kept = sorted(r.doc_id for r in chosen_path.deduplicate(d, words=k).collect())
        assert kept == [i for i in range(len(every)) if label[i] == i]
        twice = spark.createDataFrame([(1, more[0], "a"), (1, more[0], "b"), (None, more[0], "c"), (2, None, "d"), (2, None, "e")], "doc_id long, text string, digest string")
        assert sorted(r.doc_id for r in chosen_path.deduplicate(twice).collect()) == [1, 2, 2]
        assert chosen_path.near_components(none).count() == 0


def test_near_duplicates_without_ids_or_of_one_id(spark):
    rng = np.random.default_rng(21)
    base = [prose(rng, 60) for _ in range(150)]
    rows = [(one, t + end) for one in (None, 4) for t in base for end in ("", " and")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    wanted = d.select("doc_id", F.xxhash64("text").alias("digest"), F.monotonically_increasing_id().alias("id"), F.lit(0).cast("long").alias("k0"), F.lit(0).cast("long").alias("k1"))
    joined = chosen_path._set_table(d, store.materialize(wanted, "wanted"), 5, "doc_id", "text")
    assert joined.count() == 0  # every text meets its own class alone, whose key here is none of theirs
    out = chosen_path.near_components(d).collect()
    assert len(out) == 600 and sum(r.kept for r in out) == 150


def test_misses_are_bounded_at_any_depth():
    depth, trees = chosen_path.forest(250_000)
    assert chosen_path.missed(depth, 0.8) ** trees <= 1e-7 and chosen_path.missed(0, 0.8) < 0.05


# --- 10 ------------------------------------------------------------------------------------------------------------


def test_mix(docs, none, texts, spark):
    got = pareto_mix.mix(docs, keep=("doc_id", "source")).collect()
    assert len(got) == len(texts) and all(r.copies in (0, 1, 2) and r.taken == r.copies * r["size"] for r in got)
    size, target, taken = {}, {}, {}
    for r in got:
        assert r["size"] == len(re.findall("[^\x20\x09-\x0d]+", texts[r.doc_id] or ""))
        size[r.source] = size.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    budget, capped = 1.5 * sum(size.values()), {}
    while True:
        rest = [s for s in order if s not in capped]
        share = {s: (budget - sum(capped.values())) * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 2 * size[s]]
        if not over:
            break
        capped |= {s: 2.0 * size[s] for s in over}
    for s, want in {**share, **capped}.items():
        assert target[s] == pytest.approx(want)
        assert abs(taken[s] - want) <= max(r["size"] for r in got if r.source == s)
    again = pareto_mix.mix(docs.repartition(7), keep=("doc_id", "source")).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    repeated = pareto_mix.repeat_copies(docs)
    assert repeated.columns == docs.columns and repeated.count() == sum(r.copies for r in got)
    assert pareto_mix.mix(none).count() == 0


def test_shared_folder_comes_from_the_session(spark):
    assert store.shared_dir(spark) == store.shared_dir(spark)
