"""DuckDB SQL for one query against a column, written from the rules as plain loops over positions: recursive for the chain, enumerated for corrections.

For queries of lower-case ASCII letters, digits, underscores and spaces, and columns of ASCII text.
"""

from __future__ import annotations

import re

W = r"[\p{L}\p{N}_]"


def _at(text: str, q: str, after: bool = False, before: bool = True) -> str:
    """The first place (from 1) of q in text at a word's start, with after also at its end; null if there is none."""
    ok = f"substr({text}, i, length({q})) = {q}"
    if before:
        ok += f" AND (i = 1 OR NOT regexp_matches(substr({text}, i - 1, 1), '{W}'))"
    if after:
        ok += f" AND (i + length({q}) > length({text}) OR NOT regexp_matches(substr({text}, i + length({q}), 1), '{W}'))"
    return f"list_min(list_filter(range(1, length({text}) - length({q}) + 2), lambda i: {ok}))"


def _ladder(field: str, norm: str, raw: str, q: str) -> str:
    """A struct {score, tier, ranges} for a query given by columns."""
    one = lambda at, x: f"CAST(({at}) - 1 AS VARCHAR) || '-' || CAST(({at}) + length({x}) - 2 AS VARCHAR)"
    hit = lambda score, tier, ranges: f"struct_pack(score := CAST({score} AS DOUBLE), tier := '{tier}', ranges := {ranges})"
    words = f"list_filter(regexp_split_to_array({q}, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '')"
    places = f"list_transform({words}, lambda w: struct_pack(a := {_at(norm, 'w', after=True)}, n := length(w)))"
    several = f"len({words}) > 1 AND len(list_filter({places}, lambda p: p.a IS NULL)) = 0"
    joined = f"array_to_string(list_transform(list_sort({places}), lambda p: CAST(p.a - 1 AS VARCHAR) || '-' || CAST(p.a + p.n - 2 AS VARCHAR)), ';')"
    return f"""CASE WHEN {field} = {raw} THEN {hit(0, 'exact', one('1', field))}
  WHEN {norm} = {q} THEN {hit(0.1, 'normalised-exact', one('1', norm))}
  WHEN starts_with({norm}, {q}) THEN {hit(0.5, 'prefix', one('1', q))}
  WHEN {_at(field, raw)} IS NOT NULL THEN {hit(0.9, 'boundary-exact', one(_at(field, raw), raw))}
  WHEN {_at(norm, q)} IS NOT NULL THEN {hit(1, 'boundary', one(_at(norm, q), q))}
  WHEN {several} THEN {hit(1.5, 'multi-word', joined)}
  WHEN contains({norm}, {q}) THEN {hit(2, 'contains', one(f'strpos({norm}, {q})', q))} END"""


def _missing(q: str) -> str:
    """How many of the query's character classes norm lacks."""
    classes = {c if c.isalpha() else "".join(str(d) for d in range(10) if d % 4 == int(c) % 4) for c in q if c.isalnum()}
    # digits fall into classes by their character code, of which 48 is that of 0 and divisible by 4
    return " + ".join(f"CAST(NOT regexp_matches(norm, '[{c}]') AS INTEGER)" for c in sorted(classes)) or "0"


def match_sql(table: str, column: str, query: str, rescue: str = "true") -> str:
    """CTEs, the last of which, m, has (field, score, tier, ranges, corrected) of each distinct text that matches.

    rescue: an SQL condition over literal (field, score), the literal hits of the distinct texts, and the table itself.
    """
    assert re.fullmatch(r"[a-z0-9_ ]+", query) and query == query.strip()
    q, words, m = f"'{query}'", query.split(), len(query)
    longest = m if len(words) == 1 else max(map(len, words))
    # where a chunk may open for each query character
    admits = ", ".join(
        f"list_filter(range(1, length(norm) + 1), lambda i: substr(norm, i, 1) = '{c}' AND (i = 1 OR NOT regexp_matches(substr(norm, i - 1, 1), '{W}') OR substr(norm, i, {len(query[k : k + 3])}) = '{query[k : k + 3]}'))"
        for k, c in enumerate(query)
    )
    subjects = [(None, query)] if len(words) == 1 else [(i, w) for i, w in enumerate(words)]
    parts = []
    for i, s in subjects:
        if len(s) < 4:
            continue
        head, tail = ("", "") if i is None else ("".join(w + " " for w in words[:i]), "".join(" " + w for w in words[i + 1 :]))
        where = "true" if i is None else " AND ".join([f"NOT contains(norm, '{s}')"] + [f"contains(norm, '{w}')" for j, w in enumerate(words) if j != i])
        n, floor = len(s), "CASE WHEN length(norm) <= 64 THEN 5 WHEN length(norm) <= 1024 THEN 6 ELSE 7 END"
        full = lambda x: f"'{head}' || {x} || '{tail}'"
        swap = f"substr('{s}', 1, i - 1) || substr('{s}', i + 1, 1) || substr('{s}', i, 1) || substr('{s}', i + 2)"
        drop = f"substr('{s}', 1, i - 1) || substr('{s}', i + 1)"
        parts.append(f"SELECT field, norm, i AS ord, {swap} AS need, {full('(' + swap + ')')} AS cq FROM lit, range(1, {n}) AS r(i) WHERE {where} AND substr('{s}', i, 1) <> substr('{s}', i + 1, 1)")
        if n >= 5:
            parts.append(f"SELECT field, norm, 1000 + i AS ord, {drop} AS need, {full('(' + drop + ')')} AS cq FROM lit, range(1, {n + 1}) AS r(i) WHERE {where} AND {n} >= {floor}")
            wrong = f"list_filter(range(1, {n + 1}), lambda j: substr(norm, i + j - 1, 1) <> substr('{s}', j, 1))"
            parts.append(
                f"SELECT field, norm, (CASE WHEN bad[1] > {n // 2} THEN 2000 ELSE 100000 END) + i AS ord, substr(norm, i, {n}) AS need, {full(f'substr(norm, i, {n})')} AS cq "
                f"FROM (SELECT field, norm, i, {wrong} AS bad FROM (SELECT field, norm, unnest(range(1, length(norm) - {n} + 2)) AS i FROM lit) WHERE {where}) WHERE len(bad) = 1 AND {n} >= {floor}"
            )
    none = "SELECT field, norm, 0 AS ord, '' AS need, '' AS cq FROM lit WHERE false"
    relaxed = 1 if longest >= 5 else 0
    cost = f"""CASE WHEN (c[1] = 1 OR NOT regexp_matches(substr(norm, c[1] - 1, 1), '{W}')) THEN
        CASE WHEN c[2] = length(norm) OR NOT regexp_matches(substr(norm, c[2] + 1, 1), '{W}') THEN 0.2 ELSE 0.4 END
        WHEN c[2] - c[1] >= 2 THEN 0.8 ELSE 1.6 END"""
    return f"""f AS (SELECT DISTINCT {column} AS field, lower({column}) AS norm FROM {table} WHERE {column} IS NOT NULL),
lit AS (SELECT field, norm, {_ladder('field', 'norm', q, q)} AS hit FROM f),
literal AS (SELECT field, hit.score AS score FROM lit WHERE hit IS NOT NULL),
mode AS (SELECT ({rescue}) AND {longest} >= 4 AS corrects, ({rescue}) AND {longest} >= 5 AS relaxes),
admit AS (SELECT field, norm, [{admits}] AS adm FROM lit, mode WHERE hit IS NULL AND {_missing(query)} <= CASE WHEN relaxes THEN {relaxed} ELSE 0 END),
starts AS (SELECT field, norm, adm, n, adm[1][n] AS pos FROM admit, range(1, 5) AS r(n) WHERE n <= len(adm[1])),
walk AS (
  SELECT field, norm, adm, n, 1 AS k, [[pos, pos]] AS cs FROM starts
  UNION ALL
  SELECT field, norm, adm, n, k + 1, CASE WHEN substr(norm, last + 1, 1) = substr({q}, k + 1, 1)
      THEN list_append(cs[1:len(cs) - 1], [cs[len(cs)][1], last + 1]) ELSE list_append(cs, [nxt, nxt]) END
  FROM (SELECT *, cs[len(cs)][2] AS last, list_min(list_filter(adm[k + 1], lambda i: i > cs[len(cs)][2])) AS nxt FROM walk WHERE k < {m})
  WHERE substr(norm, last + 1, 1) = substr({q}, k + 1, 1) OR nxt IS NOT NULL),
priced AS (SELECT field, norm, n, cs, 2.0 + list_sum(list_transform(cs, lambda c: {cost})) AS price FROM walk
  WHERE k = {m} AND {m} / (cs[len(cs)][2] - cs[1][1] + 1) >= 0.18),
chains AS (SELECT field, norm, cs, price FROM priced QUALIFY row_number() OVER (PARTITION BY field ORDER BY round(price, 9), n) = 1),
inserted AS (SELECT field, norm, 0 AS ord, substr(norm, cs[1][1], cs[2][2] - cs[1][1] + 1) AS cq FROM chains
  WHERE len(cs) = 2 AND cs[2][1] = cs[1][2] + 2 AND regexp_matches(substr(norm, cs[1][2] + 1, 1), '{W}') AND {m} >= 4 AND (SELECT {rescue})),
cand AS (SELECT DISTINCT field, norm, ord + 1 AS ord, cq FROM ({' UNION ALL '.join(parts) or none}) WHERE contains(norm, need) AND (SELECT corrects FROM mode)
  AND field IN (SELECT field FROM admit)
  UNION ALL SELECT field, norm, ord, cq FROM inserted),
rerun AS (SELECT field, ord, cq, {_ladder('field', 'norm', 'cq', 'cq')} AS hit FROM cand),
every AS (
  SELECT field, hit.score AS score, hit.tier AS tier, hit.ranges AS ranges, '' AS corrected, -1 AS ord FROM lit WHERE hit IS NOT NULL
  UNION ALL SELECT field, hit.score + 2.1, 'corrected', hit.ranges, cq, ord FROM rerun WHERE hit IS NOT NULL
  UNION ALL SELECT field, price, 'fuzzy', array_to_string(list_transform(cs, lambda c: CAST(c[1] - 1 AS VARCHAR) || '-' || CAST(c[2] - 1 AS VARCHAR)), ';'), '', 1000000 FROM chains),
m AS (SELECT field, score, tier, ranges, corrected FROM every
  QUALIFY row_number() OVER (PARTITION BY field ORDER BY CAST(ord < 0 AS INTEGER) DESC, round(score, 9), ord) = 1)"""


def budget(table: str, column: str, query: str) -> str:
    """Whether a search looks for corrections: under ten rows hold the query literally, and it isn't one word of under five characters."""
    long = len(query.split()) > 1 or len(query) >= 5
    return f"{str(long).lower()} AND (SELECT count(*) FROM {table} JOIN literal ON {column} = literal.field WHERE literal.score <= 2) < 10"


def rows_sql(table: str, key: str, column: str, query: str, select: str, where: str = "true", search: bool = False, end: str = "") -> str:
    """All rows of a table that match a query; search: with the budget of a search instead of corrections always."""
    ctes = match_sql(table, column, query, budget(table, column, query) if search else "true")
    return f"WITH RECURSIVE {ctes}\nSELECT {select.format(key=key)} FROM {table} t JOIN m ON t.{column} = m.field WHERE {where} {end}"
