"""Text functions on columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters whose ASCII spelling does not follow from their decomposition.
LETTERS = {
    "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i", "ħ": "h", "ŋ": "ng",
    "а": "a", "б": "b", "в": "v", "г": "g", "ґ": "g", "д": "d", "е": "e", "є": "ie", "ж": "zh", "з": "z", "и": "i", "і": "i",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh",
    "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "iu", "я": "ia",
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m",
    "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "u", "φ": "ph", "χ": "kh", "ψ": "ps", "ω": "o",
}
#: Blocks whose lower-case letters are spelt: Latin, Greek, Cyrillic and wide Latin; and the combining marks, which are left out.
SCRIPTS = ((0xC0, 0x250), (0x370, 0x500), (0x1E00, 0x2000), (0xFF41, 0xFF5B))
MARKS = (0x300, 0x370)
#: What counts as white space at the ends of a text.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _spellings() -> dict[str, str]:
    """ASCII spelling of every lower-case letter of ``SCRIPTS``: its own, or that of what it decomposes to without marks."""
    found = dict(LETTERS)
    for c in (chr(k) for block in SCRIPTS for k in range(*block)):
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if c not in found and c.lower() == c and c.isalpha() and base != c and base.isalnum() and all(x in LETTERS or x.isascii() for x in base):
            found[c] = "".join(LETTERS.get(x, x) for x in base)
    return found


SPELLINGS = _spellings()
#: Letters that become several; the others, and after them the marks, go through one ``translate``.
SEVERAL = {c: v for c, v in SPELLINGS.items() if len(v) > 1}
_SINGLE = {c: v for c, v in SPELLINGS.items() if len(v) == 1}
SIMPLE_FROM = "".join(_SINGLE) + "".join(c for c, v in SPELLINGS.items() if not v) + "".join(map(chr, range(*MARKS)))
SIMPLE_TO = "".join(_SINGLE.values())


def strip(text: Column) -> Column:
    """Without white space, of any script, at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


#: Letters and vowel signs of this block are spelt by their Unicode names; Hangul syllables by their parts, of which the
#: standard's formula tells which; what is left (ideographs, and all beyond) by its code point.
NAMED = (0x80, 0x3200)
HANGUL, PARTS = (0xAC00, 0xD7A4), (19, 21, 28)


def _named(c: str) -> str:
    """What a letter's name says after LETTER, SYLLABLE, CHARACTER or VOWEL SIGN, without marks: alef, ka, ko."""
    name = unicodedata.name(c, "")
    for word in ("VOWEL SIGN ", "SYLLABLE ", "LETTER ", "CHARACTER "):
        if word in name:
            rest = name.rpartition(word)[2].partition(" WITH ")[0].split()
            rest = [x for x in rest if x not in ("SMALL", "CAPITAL", "FINAL", "INITIAL", "MEDIAL", "ISOLATED")] or rest
            return "".join(x for x in "".join(rest).lower() if x.isascii() and x.isalnum())
    return ""


def _hangul_parts() -> list[list[str]]:
    """Spellings of first consonants, vowels and last consonants (none first), as they stand in the names of syllables."""
    spelt = lambda first, vowel, last: unicodedata.name(chr(HANGUL[0] + (first * PARTS[1] + vowel) * PARTS[2] + last)).split()[-1].lower()
    vowels = [spelt(11, v, 0) for v in range(PARTS[1])]  # the twelfth consonant is silent
    return [[spelt(f, 0, 0).removesuffix(vowels[0]) for f in range(PARTS[0])], vowels, [spelt(11, 0, x).removeprefix(vowels[0]) for x in range(PARTS[2])]]


NAMES = [_named(chr(k)) for k in range(*NAMED)]
HANGUL_PARTS = _hangul_parts()


def _listed(items: list[str]) -> Column:
    """A constant array, folded from one text, so that the plan holds one value however long the list is."""
    return F.split(F.lit("|".join(items)), r"\|")


def _spelt(char: Column) -> Column:
    """A character of any script as ASCII; those that are no letters or marks as they are."""
    code = F.ascii(char)
    syllable = code - HANGUL[0]
    part = lambda k, n: F.element_at(_listed(HANGUL_PARTS[k]), (n + 1).cast("int"))
    hangul = F.concat(part(0, F.floor(syllable / (PARTS[1] * PARTS[2]))), part(1, F.floor(syllable / PARTS[2]) % PARTS[1]), part(2, syllable % PARTS[2]))
    name = F.when((code >= NAMED[0]) & (code < NAMED[1]), F.nullif(F.element_at(_listed(NAMES), code - NAMED[0] + 1), F.lit("")))
    point = F.when(F.rlike(char, F.lit(r"[\p{L}\p{Cn}]")), F.concat(F.lit("u"), F.lower(F.hex(code)))).otherwise(F.lit(""))
    return F.when(code < 128, char).when((code >= HANGUL[0]) & (code < HANGUL[1]), hangul).when(F.rlike(char, F.lit(r"[\p{L}\p{M}\p{Cn}]")), F.coalesce(name, point)).otherwise(char)


def transliterate(text: Column) -> Column:
    """Letters of any script as ASCII, without marks; texts that are ASCII pass by, null stays null.

    Lower-case Latin, Greek and Cyrillic letters are spelt by a fixed table (of which hard and soft signs alone have no
    letter); texts in which other letters are left go through a table by code point, character by character. So every
    other letter becomes at least one ASCII letter or digit, and different ideographs stay different."""
    known = text
    for char, plain in SEVERAL.items():
        known = F.replace(known, F.lit(char), F.lit(plain))
    known = F.translate(known, SIMPLE_FROM, SIMPLE_TO)
    rest = F.rlike(text, F.lit(OTHERS))
    return F.when(F.octet_length(text) == F.length(text), text).when(rest, F.array_join(F.transform(F.split(known, ""), _spelt), "")).otherwise(known)


#: Letters and marks that the fixed table does not spell, and code points that are newer than the regular expressions.
OTHERS = r"[[\p{L}\p{M}\p{Cn}]&&[^\p{ASCII}" + "".join(SPELLINGS) + rf"\x{{{MARKS[0]:x}}}-\x{{{MARKS[1] - 1:x}}}]]"


def slugify(text: Column) -> Column:
    """A snake_case key: whatever is not a-z or 0-9 in lower case becomes one underscore a run, and none stays at the ends."""
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))


def free_prefix(df: DataFrame) -> str:
    """A prefix that no column's name has, for columns that stand beside a caller's."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The frame with columns that are computed once a row.

    A projection alone is merged into the ones above it, which repeats its expressions at every use, and filters are pushed
    through it; neither happens to the row that a generator makes."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def estimate_tokens(text: Column) -> Column:
    """0 for a blank text, else a quarter of its stripped characters, 1 at least."""
    n = F.length(strip(text))
    return F.when(n.isNull() | (n == 0), 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4).cast("int")))


def list_repr(items: Column) -> Column:
    """A list of strings as Python prints it, for strings without control characters."""
    def one(x: Column) -> Column:
        escaped = F.replace(x, F.lit("\\"), F.lit("\\\\"))
        single = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
        return F.when(F.contains(x, F.lit("'")) & ~F.contains(x, F.lit('"')), F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(single)

    return F.concat(F.lit("["), F.array_join(F.transform(items, one), ", "), F.lit("]"))


def extension(name: Column) -> Column:
    """What follows the last dot, in lower case; empty without a dot."""
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))
