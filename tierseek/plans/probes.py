"""Mistyped queries made from good ones, the kind of edit between two texts, and probes drawn from a column."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def transposed(word: str, at: int = 1) -> str:
    """Two neighbours exchanged."""
    return word[:at] + word[at : at + 2][::-1] + word[at + 2 :]


def doubled(word: str, at: int = 1) -> str:
    """One character typed twice."""
    return word[: at + 1] + word[at:]


def substituted(word: str, at: int = 1, by: str = "x") -> str:
    """One character replaced; by another one where it is the same already."""
    return word[:at] + (by if word[at : at + 1] != by else chr(ord(by) + 1)) + word[at + 1 :]


def every_other(word: str) -> str:
    return word[::2]


def without_accents(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


MUTATORS = {"transposed": transposed, "doubled": doubled, "substituted": substituted, "every_other": every_other, "without_accents": without_accents}


def edit_kind(typed: Column, meant: Column) -> Column:
    """'same', 'substitution', 'swap', 'insertion' (typed lacks a character), 'deletion' (typed has one too many), or null for more than one edit."""
    n, m = F.length(typed), F.length(meant)
    differs = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: ~F.substring(typed, i, F.lit(1)).eqNullSafe(F.substring(meant, i, F.lit(1))))
    first, second = F.get(differs, F.lit(0)), F.get(differs, F.lit(1))
    crossed = (F.substring(typed, first, F.lit(1)) == F.substring(meant, second, F.lit(1))) & (F.substring(typed, second, F.lit(1)) == F.substring(meant, first, F.lit(1)))
    return (
        F.when(typed == meant, "same")
        .when((n == m) & (F.size(differs) == 1), "substitution")
        .when((n == m) & (F.size(differs) == 2) & (second == first + 1) & crossed, "swap")
        .when((n == m - 1) & (F.levenshtein(typed, meant) == 1), "insertion")
        .when((n == m + 1) & (F.levenshtein(typed, meant) == 1), "deletion")
    )


def probes(df: DataFrame, text: str, key: str, n: int = 20) -> list[tuple[str, object, str]]:
    """(kind, key, query) for the n rows of least key hash: the text itself, its first word, its longest word, and that word through each mutator."""
    rows = df.where(F.length(F.trim(text)) > 0).orderBy(F.xxhash64(key), key).select(key, text).limit(n).collect()
    out = []
    for row in rows:
        words = row[text].split()
        long = max(words, key=len)
        out += [("text", row[key], row[text]), ("first_word", row[key], words[0]), ("longest_word", row[key], long)]
        out += [(name, row[key], typed) for name, change in MUTATORS.items() if len(long) >= 4 and (typed := change(long)) != long]
    return out
