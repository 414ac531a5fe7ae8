"""The operators of lines, phrases and middles against brute force, with nulls, ties, empties, long texts and odd columns."""

import hashlib
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from factloom.llm import fim_frames, line_runs, phrases, textbytes

DOC = "doc_id long, text string, lang string, source string, row string, dropped int, _lines int, h1 int, shard string, form string"
WORDS = "alpha beta Gamma delta, epsilon zeta. eta theta\tiota".split(" ")


def frame(spark, texts, langs=None, ids=None):
    rows = [((ids or range(len(texts)))[i], t, (langs or ["en"] * len(texts))[i], "s", "r", 1, 2, 3, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(9)
    base = [" ".join(rng.choice(WORDS, int(n))) for n in rng.integers(1, 200, 60)]
    return [*base, None, "", " ", "x", "é" * 90, "with <S> inside", "ends <", "P>starts", "𝔘niçode 😀 " * 30, "long " * 40_000, "a\n\nb\n", *base[:5]]


# --- fill in the middle ----------------------------------------------------------------------------------------------


def plan(i, n):
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    return min(h[0] % (n + 1), h[1] % (n + 1)), max(h[0] % (n + 1), h[1] % (n + 1)), h[2] % 100 >= 90, h[3] % 100 < 20


def arranged(i, text):
    text = text or ""
    a, b, plain, spm = plan(i, len(text))
    if not text or plain or any(c in text for c in ("<P>", "<S>", "<M>")):
        return "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return ("spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if spm else ("psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("units", [7, 1000, 1 << 16])
def test_middles_against_plain_python(spark, texts, units, monkeypatch):
    monkeypatch.setattr(fim_frames, "FRAME_UNITS", units)
    own = [t for t in texts if units > 100 or len(t or "") < 2000]
    ids = [None, *range(1, len(own))]
    docs = frame(spark, own, ids=ids)
    got = {r.doc_id: r for r in fim_frames.fim_digests(docs).collect()}
    assert len(got) == len(own)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for i, t in zip(ids, own, strict=True):
        form, a, m, out = arranged(i, t)
        r = got[i]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (len(t or ""), form, a, m, sha(out), sha(t or ""))
    shown = {r.doc_id: (r.form, r.text) for r in fim_frames.arranged_texts(fim_frames.write_frames(docs)).collect()}
    assert all(shown[i] == (arranged(i, t)[0], arranged(i, t)[3]) for i, t in zip(ids, own, strict=True))


def test_only_frames_of_a_range_are_read(monkeypatch):
    seen = []

    class Fake(fim_frames.Frames):
        def __init__(self):
            pass

        def text(self, shard, offset, length):
            seen.append(offset)
            return "0123456789"

    x = fim_frames.Arranged(Fake(), "s", 5, [3] * 4, [10, 20, 30, 40], "psm", 12, 25)
    assert x.size == 40 + 9 and "".join(x.stream(3, 8)) == "01234" and seen == [5]
    assert "".join(x.stream()) == "<P>" + "0123456789" + "01" + "<S>" + "56789" + "0123456789" + "<M>" + "23456789" + "01234"
    assert "".join(fim_frames.restored(x, "psm")) == "0123456789" * 4


def test_middles_of_nothing(spark):
    assert fim_frames.fim_digests(spark.createDataFrame([], DOC)).collect() == []


# --- lines -----------------------------------------------------------------------------------------------------------


def lines_left(rows, least_docs=5, least_chars=40):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least_chars:
                held[key(line)].add(-1 if i is None else i)
    gone = {k: max(v) for k, v in held.items() if len(v) >= least_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if gone.get(key(x), i if i is not None else -1) == (-1 if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (4, 2), (7, 3)])
def test_lines_against_brute_force(spark, texts, batches, fanout, monkeypatch):
    monkeypatch.setattr(line_runs, "FANOUT", fanout)
    rng = np.random.default_rng(3)
    common = [f"Common line number {k} of very many documents, Ünï {k}" for k in range(12)]
    rows = []
    for i in range(150):
        picked = [("  " if rng.random() < 0.3 else "") + (x.upper() if rng.random() < 0.3 else x) + "\t\r" for x in rng.choice(common, int(rng.integers(0, 5)), p=[0.4, *[0.6 / 11] * 11])]
        rows.append((None if i in (7, 8) else i - i % 3 if i % 10 == 0 else i, "\n".join([*picked, "own line " * 6 + str(i), *picked[:1], "short"])))
    rows += [(200 + i, t) for i, t in enumerate(texts)] + [(500, rows[5][1])] * 6 + [(501, common[2]), (502, common[2] + "\n")]
    docs = frame(spark, [t for _, t in rows], ids=[i for i, _ in rows])
    got = Counter(tuple(r) for r in line_runs.kept_digests(docs, batches=batches).collect())
    assert got == lines_left(rows)
    assert sum(n for _, _, n, _ in got) > 50
    full = line_runs.remove_repeated_lines(docs, batches=batches)
    assert full.columns == ["row", "n_lines", "n_dropped", "kept"] and full.select("row.*").columns == docs.columns


def test_runs_are_levelled_and_settled_keys_stay_out(spark):
    runs = line_runs.LineRuns(spark, least_docs=3, fanout=2, buckets=4)
    shape, sizes = [], []
    for b in range(5):
        lines = spark.createDataFrame([(100 - 10 * b - k, 1, 0, h, h) for k in range(4) for h in (7, 1000 + b)], "doc_id long, text_hash long, pos int, h1 long, h2 long")
        runs.add(lines)
        shape.append([len(x) for x in runs.levels])
        sizes.append(sum(spark.table(n).where("h1 = 7").count() for n, _ in runs.runs))
    assert shape == [[1], [0, 1], [1, 1], [0, 0, 1], [1, 0, 1]] and sizes == [1] * 5  # the key of every batch is in the first run alone
    assert {(r.h1, r.last_doc) for r in runs.settled().collect()} == {(7, 100), *((1000 + b, 100 - 10 * b) for b in range(5))}
    names = [n for n, _ in runs.runs]
    runs.close()
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_lines_of_nothing(spark):
    assert line_runs.kept_digests(spark.createDataFrame([], DOC)).collect() == []


# --- phrases ---------------------------------------------------------------------------------------------------------


def best_phrases(rows, support, top):
    count, total = defaultdict(Counter), Counter()
    for lang, t in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in (1, 2, 3):
                count[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, c in count.items():
        found = []
        for p, a in c.items():
            if len(p) < 2 or a < support:
                continue
            if len(p) == 2 and any(q[:2] == p or q[1:] == p for q, b in c.items() if len(q) == 3 and b >= support and 100 * b >= 50 * a):
                continue
            score, _, l, r = min(((1_000_000 * a * a) // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("shards", "bits", "held"), [(1, 24, 1 << 20), (3, 24, 50), (4, 7, 1 << 20)])
def test_phrases_against_brute_force(spark, texts, shards, bits, held, monkeypatch):
    monkeypatch.setattr(phrases, "MARK_BITS", 1 << bits)
    monkeypatch.setattr(phrases, "HELD", held)
    langs = [("en", "fr", None, "und")[i % 4] for i in range(len(texts))]
    own = [(lang, t if t is None or len(t) < 9000 else t[:9000]) for lang, t in zip(langs, texts, strict=True)]
    docs = frame(spark, [t for _, t in own], langs)
    got = sorted(tuple(r) for r in phrases.collocations(docs, 10, 25, shards=shards).collect())
    assert got == best_phrases(own, 10, 25)


def test_words_stop_at_documents_and_pieces():
    data = np.frombuffer(b"One two. ThreeFour\tfive\nsix", np.uint8)
    w = phrases.Words(data, np.array([0, 13, 13, 27]), np.array([1, 2, 3], np.uint64), np.array([0, 1, 2]))
    assert [bytes(w.data[a:b]).decode() for a, b in zip(w.start, w.end, strict=True)] == ["one", "two", "thre", "efour", "five", "six"]
    assert w.texts(w.starts(2), 2).to_pylist() == ["one two", "efour five"]
    assert w.lang.tolist() == [1, 1, 1, 3, 3, 3]


def test_equal_first_hashes_are_told_apart():
    key, second = np.array([5, 5, 6, 5], np.uint64), np.array([1, 2, 3, 1], np.uint64)
    assert [x.tolist() for x in phrases._exact(key, second)] == [[0, 2, 3], [1]]


def test_phrases_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], DOC)).collect() == []
    assert phrases.collocations(frame(spark, [None, "", " . "])).collect() == []


def test_hashes_of_both_kinds_differ():
    w = phrases.Words(np.frombuffer(b"ab ba ab", np.uint8), np.array([0, 8]), np.array([1], np.uint64), np.array([0]))
    assert w.hash[0] == w.hash[2] != w.hash[1] and w.second()[0] == w.second()[2] != w.second()[1] and w.hash[0] != w.second()[0]
    assert textbytes.U64 is np.uint64


def sums_of_a_task(plan, texts):
    """Sums by key of what a task sends on for one batch of texts, and the most bytes that it held in numpy at once."""

    class Inputs:
        def mapInArrow(self, run, schema):
            self.run = run
            return self

        def groupBy(self, *columns):
            return self

        agg = groupBy

    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(np.zeros(len(texts), np.int32)), pa.array(texts)], names=["lang", "shard", "text"])
    task = plan(Inputs()).run
    tracemalloc.start()
    try:
        sent = [(out.schema, out.serialize()) for out in task(iter([batch]))]  # copies, in Arrow's memory
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    got = Counter()
    for schema, out in sent:
        *key, n = (column.to_pylist() for column in pa.ipc.read_record_batch(out, schema).columns)
        for k, x in zip(zip(*key, strict=True), n, strict=True):
            got[k] += x
    return got, most


def test_phrases_of_a_task_stay_small_and_whole(spark):
    rng = np.random.default_rng(4)
    word = [f"w{i:07d}" for i in range(300_000)]
    texts = [" ".join(word[i] for i in rng.integers(0, len(word), 250)) for _ in range(2500)]
    got, most = sums_of_a_task(lambda x: phrases._counted(x, (1,), lambda w, at, words: np.ones(len(at), bool)), texts)
    assert {k[2]: n for k, n in got.items()} == Counter(w for t in texts for w in t.split(" "))
    assert most < 40 << 20
    got, most = sums_of_a_task(lambda x: phrases._mined(x, 2, lambda w, at: np.ones(len(at), bool)), texts)
    assert sum(got.values()) == 249 * len(texts) and most < 25 << 20


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(textbytes, "SHORT_SLICE", 100)
    long = "one two three. four five; six seven eight nine\n" * 40 + "last words"
    texts = ["", long, "short text", None, "unbroken " * 50 + "end. " + "a b c, " * 30, long + ".", "", "x" * 300, None]
    batch = pa.RecordBatch.from_arrays([pa.array(list("abcdefgha")), pa.array(np.arange(9) % 3), pa.array(["skipped", *texts]).slice(1)], names=["lang", "shard", "text"])
    parts = list(phrases._slices(iter([batch])))
    assert max(len(w.data) for w in parts) == 454 and sorted(len(w.data) for w in parts)[-3] <= 100
    got = Counter((w.names[lang], int(w.shard[at]), words, p) for w in parts for words in (1, 2, 3) for at, lang, p in ((a, int(w.lang[a]), w.texts(np.array([a]), words)[0].as_py()) for a in w.starts(words)))
    want = Counter()
    for k, t in enumerate(texts):
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", t or ""):
            w = piece.split()
            want.update(("abcdefgha"[k], k % 3, n, " ".join(w[i : i + n])) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    assert got == want
