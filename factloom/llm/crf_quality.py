"""Document quality from a linear-chain conditional random field over lines.

Every line that is not empty is a node with two labels, good and bad. Its features are rates of byte classes, word and
line repetition within the document, and the same of the line before and the line after. Only documents are labelled, so
line labels are latent: a first fit, of lines alone, gives them their document's label; then, ``REFINE`` times, every document's marginals
are tilted no more than it takes for ``MOSTLY`` of its bytes to carry its label, and the model is fitted to these. So
lines of a document differ where their features do. A document's score is the mean of its lines' forward-backward
marginals, weighted by their bytes.

The fit uses at most ``fit_docs`` labelled documents, the ones of least hash among those of at most ``DOC_LINES`` lines and
``DOC_BYTES`` bytes, and of these, in that order, no more than hold ``FIT_LINES`` lines and ``FIT_BYTES`` bytes together. Longer
documents are left out one by one, so none of them keeps others from the fit; if labelled documents exist and all are
longer, a warning says so. Everything else covers all documents. Null
texts are empty; texts without lines score the share of good documents in the fit. Labels other than 0 and 1 and labels
of null ids are ignored, repeated labels of an id count once (the lower), repeated documents are scored alike; without
usable labels of both kinds every score is that share, or 0.5 without any. An empty table gives an empty result. Other
columns may be kept, and are never read as inputs.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store
from . import textbytes as tb

FIT_DOCS = 4000
FIT_LINES, FIT_BYTES = 60_000, 64 << 20
#: What one fitted document may hold.
DOC_LINES, DOC_BYTES = 6_000, 4 << 20
REFINE, MOSTLY = 1, 0.85
N_FEATURES = 14
_CLASS = np.zeros((256, 7), np.float32)  # upper, lower or other letter, digit, symbol, exclamation, bar, not ASCII
_CLASS[65:91, 0] = 1
_CLASS[97:123, 1] = 1
_CLASS[48:58, 2] = 1
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:?'\"()-"], 3] = 1
_CLASS[33, 4] = 1
_CLASS[124, 5] = 1
_CLASS[128:, 6] = 1
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b".,;:?")] = True


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line that is not empty, its document, its bytes)."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    breaks = np.flatnonzero(data == 10)
    start = np.union1d(np.flatnonzero(cut[:n]), breaks + 1)
    start = start[start < n]
    end = np.minimum(np.append(start[1:], n), n)
    ends_in_break = (end > start) & (data[np.maximum(end - 1, 0)] == 10) if n else np.zeros(0, bool)
    end = end - ends_in_break
    kept = end > start
    start, end = start[kept], end[kept]
    if not len(start):
        return np.zeros((0, N_FEATURES)), np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.searchsorted(offsets, start, side="right") - 1
    size = (end - start).astype(float)
    rates = np.zeros((len(start), 8))
    for k in range(7):
        upto = np.concatenate([[0], np.cumsum(_CLASS[data, k], dtype=np.float64)])
        rates[:, k] = upto[end] - upto[start]
    upto = np.concatenate([[0], np.cumsum(_PUNCT[data], dtype=np.int64)])
    rates[:, 7] = upto[end] - upto[start]
    letters = rates[:, 0] + rates[:, 1] + rates[:, 6]
    line_hash = tb.span_hashes(data, start, end)
    repeat = ~_first_seen(doc, line_hash)
    inside = (data != 32) & (data != 10) & (data != 9) & (data != 13)
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    word_start = np.flatnonzero(inside & (~before | cut[:n]))
    word_end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    word_doc = np.searchsorted(offsets, word_start, side="right") - 1
    word_hash = tb.span_hashes(data, word_start, word_end)
    fresh = _first_seen(word_doc, word_hash)
    again = np.zeros(len(word_hash), bool)  # the same word twice running
    again[1:] = (word_hash[1:] == word_hash[:-1]) & (word_doc[1:] == word_doc[:-1])
    line = np.searchsorted(start, word_start, side="right") - 1
    words = np.bincount(line, minlength=len(start)).astype(float)
    new = np.bincount(line, weights=fresh, minlength=len(start))
    some = np.maximum(words, 1)
    stutter = np.bincount(line, weights=again, minlength=len(start)) / some
    out = np.stack([
        np.log1p(size), rates[:, 0] / np.maximum(letters, 1), rates[:, 3] / size, rates[:, 4] / some, rates[:, 5] / some, rates[:, 2] / size,
        np.minimum(size / some, 40) / 10, new / some, repeat.astype(float), rates[:, 7] / some, rates[:, 6] / size, np.log1p(words), stutter, stutter > 0.25,
    ], 1)
    return out, doc, (end - start)


def _first_seen(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the hash is the document's first of its kind."""
    first = np.zeros(len(h), bool)
    if len(h):
        order = np.lexsort((h, doc))
        d, v = doc[order], h[order]
        head = np.concatenate([[True], (d[1:] != d[:-1]) | (v[1:] != v[:-1])])
        first[order[head]] = True
    return first


def with_neighbours(x: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after (zeros at the document's ends), and flags for the ends."""
    same = doc[1:] == doc[:-1] if len(doc) else np.zeros(0, bool)
    prior, following = np.zeros_like(x), np.zeros_like(x)
    prior[1:][same] = x[:-1][same]
    following[:-1][same] = x[1:][same]
    head = np.concatenate([[1.0], 1.0 - same]) if len(doc) else np.zeros(0)
    tail = np.concatenate([1.0 - same, [1.0]]) if len(doc) else np.zeros(0)
    return np.concatenate([x, prior, following, head[:, None], tail[:, None], np.ones((len(x), 1))], 1)


@dataclass
class LineCrf:
    """Weights: emission log-odds of good over bad, and a 2 x 2 table of transition scores."""

    mean: np.ndarray
    scale: np.ndarray
    emission: np.ndarray
    transition: np.ndarray
    prior: float

    def marginals(self, x: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Chance of the label good for each line; ``doc`` is sorted."""
        return forward_backward(with_neighbours((x - self.mean) / self.scale, doc) @ self.emission, doc, self.transition)[0]


def forward_backward(odds: np.ndarray, doc: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marginals of good, expected transition counts of all documents), all documents in step.

    Documents are cut into blocks of about the root of the longest one's lines. All blocks walk through their lines together,
    first for what each does to the chances it is entered with, then, when entries and exits are known, for the marginals.
    So a text of n lines takes some 4 times the root of n steps, not n."""
    n = len(odds)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    head = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    size = np.diff(np.append(head, n))
    width = int(np.ceil(np.sqrt(size.max())))
    blocks = -(-size // width)
    owner = np.repeat(np.arange(len(head)), blocks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start, first = head[owner] + nth * width, nth == 0
    length = np.minimum(width, head[owner] + size[owner] - start)
    move = np.exp(transition - transition.max())
    good = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    e = np.stack([1 - good, good], 1) + 1e-12

    order = np.argsort(-length, kind="stable")  # the blocks that still have a line j are the first ones
    begin, opens = start[order], first[order]
    active = np.searchsorted(-length[order], -np.arange(width), side="left")
    product = np.broadcast_to(np.eye(2), (len(order), 2, 2)).copy()
    for j in range(width):
        k = active[j]
        step = product[:k] @ move if j else np.where(opens[:k, None, None], product[:k], product[:k] @ move)
        step = step * e[begin[:k] + j][:, None, :]
        product[:k] = step / step.sum((1, 2), keepdims=True)
    whole = np.empty_like(product)
    whole[order] = product

    entry, leave = np.full((len(owner), 2), 0.5), np.full((len(owner), 2), 0.5)
    at = np.cumsum(blocks) - blocks
    longest = np.argsort(-blocks, kind="stable")
    at, count = at[longest], blocks[longest]
    going = np.searchsorted(-count, -np.arange(count[0] + 1), side="left")
    for q in range(1, int(count[0])):
        k = at[: going[q]] + q
        into = np.einsum("ki,kij->kj", entry[k - 1], whole[k - 1])
        entry[k] = into / into.sum(1, keepdims=True)
    for q in range(int(count[0]) - 1, 0, -1):
        k = at[: going[q]] + q
        out = np.einsum("kij,kj->ki", whole[k], leave[k])
        leave[k - 1] = out / out.sum(1, keepdims=True)

    alpha, beta = np.empty_like(e), np.empty_like(e)
    chance = entry[order]
    for j in range(width):
        k = active[j]
        step = chance[:k] @ move if j else np.where(opens[:k, None], chance[:k], chance[:k] @ move)
        step = step * e[begin[:k] + j]
        chance[:k] = alpha[begin[:k] + j] = step / step.sum(1, keepdims=True)
    chance = leave[order]
    for j in range(width - 1, -1, -1):
        k = active[j]
        beta[begin[:k] + j] = chance[:k]
        step = (e[begin[:k] + j] * chance[:k]) @ move.T
        chance[:k] = step / step.sum(1, keepdims=True)
    both = alpha * beta
    inner = np.flatnonzero(doc[1:] == doc[:-1])
    pair = alpha[inner][:, :, None] * move[None] * (e[inner + 1] * beta[inner + 1])[:, None, :]
    pair = pair / pair.sum((1, 2), keepdims=True)
    return both[:, 1] / both.sum(1), pair.sum(0)


def fit(x: np.ndarray, doc: np.ndarray, label: np.ndarray, rounds: int = 400, ridge: float = 1e-4, soft: float = 5e-4, seen: np.ndarray | None = None, alone: bool = False) -> LineCrf:
    """Maximum likelihood by Adam steps; ``label`` is the chance of good of each line; ``soft`` holds transitions.

    ``seen``: how often labels follow each other, counted from ``label`` where it is 0 or 1. ``alone``: from a line's own
    features only, without its neighbours' and without transitions."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    full = with_neighbours((x - mean) / scale, doc)
    if alone:
        full[:, x.shape[1] : -1] = 0
    w, t = np.zeros(full.shape[1]), np.zeros((2, 2))
    if seen is None:
        inner = np.flatnonzero(doc[1:] == doc[:-1])
        seen = np.zeros((2, 2))
        np.add.at(seen, (label[inner], label[inner + 1]), 1)
    moment = [np.zeros(len(w) + 4), np.zeros(len(w) + 4)]
    for k in range(1, rounds + 1):
        p, expected = forward_backward(full @ w, doc, t)
        g = np.concatenate([full.T @ (label - p) / len(label) - ridge * w, ((seen - expected) / len(label) - soft * t).ravel()])
        moment[0] = 0.9 * moment[0] + 0.1 * g
        moment[1] = 0.99 * moment[1] + 0.01 * g * g
        step = 0.1 * (1 - k / (rounds + 1)) * (moment[0] / (1 - 0.9**k)) / (np.sqrt(moment[1] / (1 - 0.99**k)) + 1e-8)
        w, t = w + step[:-4], t + (0 if alone else step[-4:].reshape(2, 2))
    return LineCrf(mean, scale, w, t, 0.5)


def tilted(model: LineCrf, x: np.ndarray, doc: np.ndarray, size: np.ndarray, y: np.ndarray, most: float = MOSTLY) -> tuple[np.ndarray, np.ndarray]:
    """Line marginals and expected transitions after each document's odds are moved no more than it takes for a byte-weighted
    mean of ``most`` towards its label ``y`` (one a document, by number)."""
    odds = with_neighbours((x - model.mean) / model.scale, doc) @ model.emission
    total = np.maximum(np.bincount(doc, weights=size, minlength=len(y)), 1)
    low, high = np.zeros(len(y)), np.full(len(y), 20.0)
    sign = np.where(y == 1, 1.0, -1.0)

    def reached(by: np.ndarray) -> np.ndarray:
        p = forward_backward(odds + (by * sign)[doc], doc, model.transition)[0]
        share = np.bincount(doc, weights=size * p, minlength=len(y)) / total
        return np.where(y == 1, share, 1 - share) >= most

    high = np.where(reached(low), 0.0, high)
    for _ in range(12):
        middle = (low + high) / 2
        enough = reached(middle)
        low, high = np.where(enough, low, middle), np.where(enough, middle, high)
    return forward_backward(odds + (high * sign)[doc], doc, model.transition)


def fit_documents(x: np.ndarray, doc: np.ndarray, size: np.ndarray, y: np.ndarray) -> LineCrf:
    """A model of lines from the labels of documents (``doc``: 0, 1, ... ; ``y``: a label each)."""
    model = fit(x, doc, y[doc], alone=True)
    for _ in range(REFINE):
        p, seen = tilted(model, x, doc, size, y)
        model = fit(x, doc, p, seen=seen)
    return model


def usable_labels(labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality") -> DataFrame:
    """One 0 or 1 for each id outside the held-out fifth."""
    known = labels.select(labels[doc_id].alias("id"), labels[quality].cast("int").alias("y")).where("id is not null and y in (0, 1)")
    return known.where(~is_held_out(F.col("id"))).groupBy("id").agg(F.min("y").alias("y"))


def is_held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, doc_id: str = "doc_id", text: str = "text") -> LineCrf:
    """Fits on the labelled documents of least hash, ``fit_docs`` of them at most, and no more than the bounds on lines and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.text_column(batch.column(2))
            y, ids = batch.column(1).to_numpy(zero_copy_only=False), batch.column(0).to_numpy(zero_copy_only=False)
            for i, j in tb.slices(offsets, tb.SHORT_SLICE):
                x, d, size = line_features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][d].astype(np.int64)), pa.array(np.arange(len(d))), pa.array(y[i:j][d].astype(np.int64)), pa.array(size), pa.array(list(x), pa.list_(pa.float64()))], names=["h", "line", "y", "size", "x"])

    body = F.coalesce(docs[text].cast("binary"), F.lit(b""))
    lines = F.regexp_count(F.coalesce(docs[text].cast("string"), F.lit("")), F.lit("\n")) + 1
    sizes = docs.select(docs[doc_id].alias("id"), lines.alias("lines"), F.octet_length(body).alias("bytes"))
    known = usable_labels(labels, doc_id)
    short = sizes.join(known, "id").groupBy("id", "y").agg(F.max("lines").alias("lines"), F.max("bytes").alias("bytes")).where((F.col("lines") <= DOC_LINES) & (F.col("bytes") <= DOC_BYTES))
    least = store.materialize(short.orderBy(F.xxhash64("id"), "id").limit(fit_docs), "quality-sample")  # bounded, hence broadcast
    upto = Window.orderBy(F.xxhash64("id"), "id")  # over fit_docs rows at most
    bounded = least.select("id", "y", F.sum("lines").over(upto).alias("lines"), F.sum("bytes").over(upto).alias("bytes")).where((F.col("lines") <= FIT_LINES) & (F.col("bytes") <= FIT_BYTES)).select("id", "y")
    found = docs.select(docs[doc_id].alias("id"), body.alias("b")).join(F.broadcast(bounded), "id").select(F.xxhash64("id").alias("h"), "y", "b").dropDuplicates(["h"])
    rows = found.select("h", "y", "b").mapInArrow(run, "h long, line long, y long, size long, x array<double>").toPandas()
    if not len(rows) and not sizes.join(known, "id", "left_semi").isEmpty():
        warnings.warn(f"no labelled document has at most {DOC_LINES} lines and {DOC_BYTES} bytes; every score is 0.5", stacklevel=2)
    if not len(rows) or rows.y.nunique() < 2:
        share = float(rows.y.mean()) if len(rows) else 0.5
        return LineCrf(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(3 * N_FEATURES + 3), np.zeros((2, 2)), share)
    rows = rows.sort_values(["h", "line"], kind="stable")
    doc = rows.h.rank(method="dense").to_numpy().astype(np.int64) - 1
    y = np.zeros(doc[-1] + 1, np.int64)
    y[doc] = rows.y.to_numpy()
    model = fit_documents(np.stack(rows.x.to_list()), doc, rows["size"].to_numpy().astype(float), y)
    model.prior = float(y.mean())
    return model


def score(docs: DataFrame, model: LineCrf, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, score, n_lines and good_lines of every document."""
    flat = not model.emission.any()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.text_column(batch.column(batch.num_columns - 1))
            for i, j in tb.slices(offsets, tb.SHORT_SLICE):
                x, d, size = line_features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                p = np.full(len(d), model.prior) if flat else model.marginals(x, d)
                weight = np.bincount(d, weights=size, minlength=j - i)
                total = np.bincount(d, weights=size * p, minlength=j - i)
                s = np.clip(np.where(weight > 0, total / np.maximum(weight, 1), model.prior), 0, 1)
                lines = np.bincount(d, minlength=j - i)
                good = np.bincount(d, weights=p >= 0.5, minlength=j - i).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[:-1]), pa.array(s), pa.array(lines.astype(np.int64)), pa.array(good)], names=[*(f"k{k}" for k in range(len(keep))), "score", "n_lines", "good_lines"])

    source = docs.select(*(docs[c].alias(f"k{k}") for k, c in enumerate(keep)), F.coalesce(docs[text].cast("binary"), F.lit(b"")).alias("b"))
    schema = ", ".join([*(f"k{k} {source.schema[k].dataType.simpleString()}" for k in range(len(keep))), "score double", "n_lines long", "good_lines long"])
    return source.mapInArrow(run, schema).toDF(*keep, "score", "n_lines", "good_lines")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, fit_docs: int = FIT_DOCS) -> DataFrame:
    """doc_id, held_out, score, predicted, n_lines and good_lines of every document."""
    s = score(docs, train(docs, labels, fit_docs))
    return s.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "n_lines", "good_lines")
