"""Token ids of whole texts, by the tokenizers library, with repeated words encoded once.

Both vocabularies split a text into words before they merge bytes. No word reaches over a blank (0x20) followed by an
ASCII graphic character or a Latin letter: what follows such a blank starts a new word. None reaches from a Latin letter
over one of ``,.!?;:#$%&*`` either. A text is cut there into units, each distinct unit is encoded by the library, and the
ids of the units are laid end to end. Added tokens hold no such places, so no cut falls inside one.

The library's cost lies in the call, not in the merges, so plain units are encoded many to a call with a separator whose
id then marks their ends; units that hold white space or the separator are encoded alone. The cache of units has a fixed
number of slots and a pool of ids of fixed size.

A file with other rules than these two, or with added tokens that may hold such a place, has no such cuts: its texts are
encoded whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from . import textbytes as tb

_SLOT_BITS = 20
_POOL = 1 << 23
_JOIN = 64

_GRAPHIC = np.zeros(256, bool)
_GRAPHIC[0x21:0x7F] = True
_GRAPHIC[0xC3:0xCC] = True
_MARK = np.zeros(256, bool)
_MARK[list(b",.!?;:#$%&*")] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_TAIL = np.zeros(256, bool)  # second bytes of U+00C0..U+00FF, but for the two arithmetic signs
_TAIL[0x80:0xC0] = True
_TAIL[[0x97, 0xB7]] = False
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True
_PLAIN[0xC3] = True
_PLAIN[0x80:0xC0] = True


#: The normalizers and word rules for which the cuts above hold.
_NO_SPACE = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
_WORDS = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_FOLD = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
KNOWN_RULES = (
    (None, {**_NO_SPACE, "use_regex": True}),
    (_FOLD, {"type": "Sequence", "pretokenizers": [_WORDS, {**_NO_SPACE, "use_regex": False}]}),
)


def may_cut(setting: dict) -> bool:
    """Whether texts may be cut into units: the rules are known, and no added token holds a blank or reaches over one."""
    added = setting.get("added_tokens") or []
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and re.fullmatch(r"<\|[a-z]+\|>", t["content"]) for t in added)
    return plain and setting["model"].get("dropout") is None and (setting.get("normalizer"), setting.get("pre_tokenizer")) in KNOWN_RULES


class UnitEncoder:
    """Encodes byte slices with one tokenizer file; keeps the ids of units it has seen."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.type = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.glue, self.mark = None, -1
        with open(path, encoding="utf-8") as f:
            self.cuts = may_cut(json.load(f))
        for glue, char in (("\n", "\n"), (" \x01 ", "\x01")) if self.cuts else ():
            ids = self.tokenizer.encode(" it's," + glue + " two" + glue + "One.", add_special_tokens=False).ids
            alone = self.tokenizer.encode(char, add_special_tokens=False).ids
            if len(alone) == 1 and ids.count(alone[0]) == 2:
                self.glue, self.mark = glue, alone[0]
                break
        self.clear(_POOL)

    def clear(self, pool: int) -> None:
        self.key = np.zeros(1 << _SLOT_BITS, np.uint64)
        self.at = np.zeros(1 << _SLOT_BITS, np.int32)
        self.size = np.zeros(1 << _SLOT_BITS, np.int32)
        self.pool = np.zeros(max(_POOL, pool), self.type)
        self.used = 0

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of ids of each text). ``offsets`` starts at 0."""
        n = len(data)
        if not n:
            return np.zeros(0, self.type), np.zeros(len(offsets) - 1, np.int64)
        cut = np.zeros(n, bool)
        if self.cuts:
            cut[:-1] = (data[:-1] == 0x20) & _GRAPHIC[data[1:]]
            letter = _LETTER[data]
            letter[1:] |= _TAIL[data[1:]] & (data[:-1] == 0xC3)
            cut[1:] |= letter[:-1] & _MARK[data[1:]]
        cut[offsets[:-1][offsets[:-1] < n]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
        h = tb.span_hashes(data, start, end) | np.uint64(1)
        slot = (h >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        hit = self.key[slot] == h
        at, size = self.at[slot].astype(np.int64), self.size[slot].astype(np.int64)
        miss = np.flatnonzero(~hit)
        if len(miss):
            new, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            where = miss[first]
            flat, counts = self._library(data, start[where], end[where])
            if self.used + len(flat) > len(self.pool):
                lengths = np.where(hit, size, 0)  # what this slice still needs of the old pool moves to the new one
                kept = self.pool[tb.ragged(at, lengths)]
                self.clear(len(kept) + len(flat))
                self.pool[: len(kept)], self.used = kept, len(kept)
                at = np.cumsum(lengths) - lengths
            begin = self.used + np.cumsum(counts) - counts
            self.pool[self.used : self.used + len(flat)] = flat
            self.used += len(flat)
            to = (new >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
            self.key[to], self.at[to], self.size[to] = new, begin, counts
            at[miss], size[miss] = begin[back], counts[back]
        ids = self.pool[tb.ragged(at, size)]
        text = np.searchsorted(offsets, start, side="right") - 1
        return ids, np.bincount(text, weights=size, minlength=len(offsets) - 1).astype(np.int64)

    def _library(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of each unit, end to end, and their numbers."""
        odd = np.concatenate([[0], np.cumsum(~_PLAIN[data])])
        inner = start + (data[start] == 0x20)
        plain = (odd[end] == odd[inner]) & (end > inner) & (self.glue is not None)
        body = data.tobytes()
        units = [body[a:b].decode("utf-8", "replace") for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        n_plain, n_calls = int(plain.sum()), 0
        joined = [units[k] for k in order[:n_plain].tolist()]
        calls = [self.glue.join(joined[i : i + _JOIN]) for i in range(0, n_plain, _JOIN)] if n_plain else []
        n_calls = len(calls)
        parts = []
        counts = np.zeros(len(units), np.int64)
        if calls:
            for e in self.tokenizer.encode_batch_fast(calls, add_special_tokens=False):
                parts.append(np.array(e.ids, self.type))
                parts.append(np.array([self.mark], self.type))
            ids = np.concatenate(parts)
            ends = np.flatnonzero(ids == self.mark)
            if len(ends) != n_plain:
                raise ValueError(f"{n_plain} units came back as {len(ends)}")
            counts[:n_plain] = np.diff(np.concatenate([[-1], ends])) - 1
            parts = [ids[ids != self.mark]]
        if n_plain < len(units):
            alone = [e.ids for e in self.tokenizer.encode_batch_fast([units[k] for k in order[n_plain:].tolist()], add_special_tokens=False)]
            counts[n_plain:] = [len(x) for x in alone]
            parts += [np.array(x, self.type) for x in alone]
        flat = np.concatenate(parts) if parts else np.zeros(0, self.type)
        begin = np.cumsum(counts) - counts
        rank = np.argsort(order)  # back to the order of the units
        return flat[tb.ragged(begin[rank], counts[rank])], counts[rank]


_encoders: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """The encoder of a file, one a worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = UnitEncoder(path)
    return _encoders[path]
