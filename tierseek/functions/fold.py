"""Folding, trimming and word splitting: the same table drives the driver's strings and the executors' columns."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that trimming strips, and curly quotes with what they fold to.
BLANK = "\t\n\x0b\x0c\r \xa0                　﻿"
QUOTES = {"‘": "'", "’": "'", "“": '"', "”": '"'}
MARKS = "[̀-ͯ]"
W = r"[\p{L}\p{N}_]"
_blank = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in BLANK) + "]"


def _units(s: str) -> int:
    return len(s.encode("utf-16-le")) // 2


def fold_char(c: str) -> str:
    """Lower case without diacritics, if that keeps the length; else lower case, if that does; else the character."""
    if c in QUOTES:
        return QUOTES[c]
    low = c.lower()
    bare = "".join(x for x in unicodedata.normalize("NFD", low) if not "̀" <= x <= "ͯ")
    bare = {"ł": "l", "ς": "σ"}.get(bare, bare)
    return next(x for x in (bare, low, c) if _units(x) == _units(c))


@lru_cache(maxsize=1)
def fold_table() -> tuple[str, str]:
    """All characters below U+20000 that fold to another one, and what to."""
    pairs = [(c, f) for c in map(chr, range(0x20000)) if not "\ud800" <= c <= "\udfff" and (f := fold_char(c)) != c]
    return "".join(c for c, _ in pairs), "".join(f for _, f in pairs)


@lru_cache(maxsize=1)
def _compositions() -> list[tuple[str, str]]:
    """Base and mark pairs with their composed form; those whose base is itself composed come after it."""
    found = []
    for c in map(chr, range(0x20000)):
        if "\ud800" <= c <= "\udfff":
            continue
        d = unicodedata.decomposition(c)
        if d and not d.startswith("<") and len(p := d.split()) == 2:
            pair = "".join(chr(int(x, 16)) for x in p)
            if "̀" <= pair[1] <= "ͯ" and unicodedata.normalize("NFC", pair) == c:
                found.append((len(unicodedata.normalize("NFD", c)), pair, c))
    return [(p, c) for _, p, c in sorted(found)]


def trim_str(s: str) -> str:
    return s.strip(BLANK)


def fold_str(s: str) -> str:
    s = trim_str(s)
    if re.search(MARKS, s):
        s = unicodedata.normalize("NFC", s)
    return "".join(map(fold_char, s))


def words_str(s: str) -> list[str]:
    """Runs of letters, numbers and underscores."""
    import regex

    return regex.findall(r"[\p{L}\p{N}_]+", s)


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{_blank}+|{_blank}+$", "")


def lead(c: Column) -> Column:
    """How many characters trim() strips on the left."""
    return F.length(c) - F.length(F.regexp_replace(c, f"^{_blank}+", ""))


def compose(c: Column) -> Column:
    """Canonical composition of letters with marks of U+0300 to U+036F. Row by row only where such a mark occurs.

    Marks are expected in canonical order, which is how decomposed text is written.
    """
    pairs = F.split(F.lit(" ".join(p + x for p, x in _compositions())), " ")
    return F.when(c.rlike(MARKS), F.aggregate(pairs, c, lambda s, p: F.replace(s, F.left(p, F.lit(2)), F.right(p, F.lit(1))))).otherwise(c)


def fold(c: Column) -> Column:
    """The folded text of a composed and trimmed column."""
    return F.translate(c, *fold_table())


def normalise_text(c: Column) -> Column:
    return fold(compose(trim(c)))


def split_words(c: Column) -> Column:
    return F.filter(F.split(c, r"[^\p{L}\p{N}_]+", -1), lambda w: w != "")
