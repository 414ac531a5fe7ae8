"""A part-of-speech tagger: a hidden Markov model, trained on the tagged sentences beside this file.

Tags: D determiner, N noun, V verb, B forms of be, have and do as helpers, M modal, A adjective, R adverb, P preposition,
C conjunction, T to, O pronoun, X not, Q number, and the full stop for punctuation. Words that were not seen are judged by
their endings, as in the rare words of the training; the best tags of a sentence are found by Viterbi's recursion."""

from __future__ import annotations

import pkgutil
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

TAGS = "DNVBMARPCTOXQ."
TOKEN = re.compile(r"\w+(?:['’]\w+)*|[^\w\s]")
SENTENCE_END = re.compile(r"[.!?]+(?=\s|$)|\n+")
LONGEST_ENDING = 4


@dataclass
class Tagger:
    """Logarithms: of a tag after a tag (the first row: at the start), of words by tag, and of tags by ending."""

    follows: np.ndarray
    words: dict[str, np.ndarray]
    endings: dict[str, np.ndarray]
    shares: np.ndarray
    seen: dict[str, np.ndarray] = field(default_factory=dict, repr=False)

    def scores(self, word: str) -> np.ndarray:
        """Log chance of the word by tag, up to a constant of the word."""
        low = word.lower()
        if low in self.words:
            return self.words[low]
        if not any(c.isalnum() for c in word):
            return _only(".")
        if any(c.isdigit() for c in word):
            return _only("Q")
        for n in range(min(LONGEST_ENDING, len(low)), -1, -1):
            if (end := low[len(low) - n :]) in self.endings:
                return self.endings[end]
        return -self.shares

    def tag(self, words: list[str]) -> str:
        """The best tag of each word, as one text."""
        if not words:
            return ""
        best = self.follows[0] + self.scores(words[0])
        back = np.zeros((len(words), len(TAGS)), np.int8)
        for k in range(1, len(words)):
            way = best[:, None] + self.follows[1:]
            back[k] = way.argmax(0)
            best = way[back[k], np.arange(len(TAGS))] + self.scores(words[k])
        at = [int(best.argmax())]
        for k in range(len(words) - 1, 0, -1):
            at.append(int(back[k, at[-1]]))
        return "".join(TAGS[i] for i in reversed(at))


def _only(tag: str) -> np.ndarray:
    out = np.full(len(TAGS), -20.0)
    out[TAGS.index(tag)] = 0.0
    return out


def read_tagged(text: str) -> list[list[tuple[str, str]]]:
    """Sentences of (word, tag) from lines of word_tag."""
    return [[tuple(x.rsplit("_", 1)) for x in line.split()] for line in text.splitlines() if line.strip()]


def train(sentences: list[list[tuple[str, str]]], rare: int = 2) -> Tagger:
    """Counts of tags after tags and of words by tag, smoothed; endings are those of words seen ``rare`` times at most."""
    at = {t: k for k, t in enumerate(TAGS)}
    follows = np.full((len(TAGS) + 1, len(TAGS)), 0.1)
    words: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(TAGS)))
    for s in sentences:
        prior = 0
        for word, tag in s:
            follows[prior, at[tag]] += 1
            words[word.lower()][at[tag]] += 1
            prior = at[tag] + 1
    share = sum(words.values()) + 0.5
    share = share / share.sum()
    # open classes alone take words that were not seen
    open_ = np.array([t in "NVAR" for t in TAGS])
    endings: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(TAGS)))
    counts = Counter({w: int(c.sum()) for w, c in words.items()})
    for word, tags in words.items():
        if counts[word] <= rare and any(c.isalpha() for c in word):
            for n in range(min(LONGEST_ENDING, len(word)) + 1):
                endings[word[len(word) - n :]] += tags * open_
    whole = endings[""] / max(1.0, endings[""].sum()) if "" in endings else share
    log = lambda x: np.log(np.maximum(x, 1e-9))
    smooth = {"": whole}
    for n in range(1, LONGEST_ENDING + 1):  # an ending's tags lean on those of the shorter one
        for end in [e for e in endings if len(e) == n]:
            smooth[end] = (endings[end] + 2 * smooth.get(end[1:], whole)) / (endings[end].sum() + 2)
    by_ending = {e: log(p * open_ + 1e-6) - log(share) for e, p in smooth.items()}
    by_word = {w: log((c + 1e-4) / (c.sum() + 1e-4 * len(TAGS))) - log(share) for w, c in words.items()}
    return Tagger(log(follows / follows.sum(1, keepdims=True)), dict(by_word), by_ending, log(share))


@lru_cache
def default_tagger() -> Tagger:
    """The model of the sentences beside this file."""
    return train(read_tagged(pkgutil.get_data(__package__, "tagged.txt").decode()))


def sentences(text: str):
    """(start, end) of the sentences of a text."""
    start = 0
    for m in SENTENCE_END.finditer(text):
        yield start, m.end()
        start = m.end()
    if start < len(text):
        yield start, len(text)


def first_verbs(tagger: Tagger, text: str, modals: tuple[str, ...]) -> list[int]:
    """For each modal where it first stands before a verb, from 1 and in UTF-16 units as Java counts, or 0; only sentences with one are tagged."""
    any_ = re.compile(rf"\b(?:{'|'.join(modals)})\b")
    found = dict.fromkeys(modals, 0)
    low = text.lower()
    if len(low) != len(text):  # a letter whose small form is longer
        low = text
    for start, end in sentences(low):
        if all(found.values()) or not any_.search(low, start, end):
            continue
        tokens = list(TOKEN.finditer(text, start, end))
        tags = tagger.tag([m[0] for m in tokens])
        for k in range(len(tokens) - 1):
            word = tokens[k][0].lower()
            if word in found and not found[word] and tags[k + 1] == "V":
                found[word] = len(text[: tokens[k].start()].encode("utf-16-le")) // 2 + 1
    return [found[m] for m in modals]
