"""Matching a stream: the match keeps no state, so it filters and scores rows as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tierseek.operators.match import fuzzy_match, matching


def match_stream(df: DataFrame, text: str, query: str, acronym: bool = False, out: str = "match") -> DataFrame:
    """The rows of a (streaming) DataFrame that match, with their MATCH. Ranking is for a batch over the sink."""
    return matching(df, fuzzy_match(text, query, acronym), out)
