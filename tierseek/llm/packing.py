"""Best-fit packing: per bin, a bitset subset-sum over the lengths still there finds the fullest combination.

Only the multiset of lengths matters to a bin, and there are at most max_len of them. So the driver plans over the
histogram (max_len rows, whatever the input), applies a combination as often as the counts allow, and gets a short list
of patterns; pieces find their place by their rank among pieces of the same length.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierseek.llm.common import table

VOCABULARY = "byte_bpe_50k"
#: The one alternative of the pattern that looks ahead. Without it the pattern is a regular language, which is split in half the time.
AHEAD = r"|\s+(?!\S)|\s+"
_SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_RUN, _RUN_END = re.compile(_SPACE * 2), re.compile(f"{_SPACE}(?={_SPACE}[^{_SPACE[1:]})")


@lru_cache(maxsize=2)
def encoder(json_path: str, ranks_path: str, pattern: str):
    """text -> uint32 ids. The ranks file is the same vocabulary as the JSON file and splits several times faster;
    texts that hold a special token's string go through the JSON file's own tokenizer. Looking ahead matters only in a run of white
    space, of which all but the last character is one piece: a text is cut there, and its parts are split without looking ahead."""
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path)
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    plain = tiktoken.Encoding("bpe", pat_str=pattern.removesuffix(AHEAD) + r"|\s+", mergeable_ranks=ranks, special_tokens={}) if pattern.endswith(AHEAD) else None

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
        cuts = [m.end() for m in _RUN_END.finditer(text)] if _RUN.search(text) else []
        if plain is None or len(cuts) > 16 + len(text) // 256:  # many short parts take longer than looking ahead
            return fast.encode_to_numpy(text, disallowed_special=())
        if not cuts:
            return plain.encode_to_numpy(text, disallowed_special=())
        return np.concatenate([plain.encode_to_numpy(text[a:b], disallowed_special=()) for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)])

    return encode


def default_encoder(vocabulary: str = VOCABULARY):
    import public_tokenizers as P

    return encoder(P.path(f"{vocabulary}.json"), P.path(f"{vocabulary}.tiktoken"), P.PATTERN)


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The multiset of lengths, at most counts[l] of each, with the largest sum that fits in room; longer ones preferred."""
    bits, steps, want = 1, [], (1 << (room + 1)) - 1
    for length in sorted((l for l, c in counts.items() if c and l <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left:
            take = min(k, left)
            steps.append((length, take, bits))
            bits |= (bits << (length * take)) & want
            left, k = left - take, k * 2
        if bits >> room:
            break
    at, used = bits.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return sorted(used.items(), reverse=True)


def plan(counts: dict[int, int], max_len: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, pieces per sequence, first sequence, offset in it) for all pieces.

    Minimum bin slack: each bin is seeded with the longest piece left, and filled as far as the others can fill it.
    A combination is repeated while every length in it lasts, so the number of combinations depends on max_len alone.
    """
    counts = {l: c for l, c in counts.items() if c}
    placed, out, sequence = dict.fromkeys(counts, 0), [], 0
    while counts:
        top = max(counts)
        counts[top] -= 1
        combination = dict(fullest(counts, max_len - top))
        counts[top] += 1
        combination[top] = combination.get(top, 0) + 1
        times = min(counts[l] // k for l, k in combination.items())
        offset = 0
        for l, k in sorted(combination.items(), reverse=True):
            out.append((l, placed[l], placed[l] + times * k, k, sequence, offset))
            placed[l] += times * k
            offset += l * k
            counts[l] -= times * k
            if not counts[l]:
                del counts[l]
        sequence += times
    return out


def _pieces(max_len: int, end_id: int, with_ids: bool, vocabulary: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, part, seen = default_encoder(vocabulary), TaskContext.get().partitionId(), np.zeros(max_len + 1, np.int64)
        last, cut = None, []
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                if not cut or text != last:  # copies of a text mostly stand together
                    ids = np.append(encode(text) if text else np.zeros(0, np.uint32), np.uint32(end_id)).astype("<u4")
                    first = len(ids) % max_len or max_len
                    cuts = [0, *range(first, len(ids), max_len), len(ids)]
                    cut = [(i, a, b - a, zlib.crc32(ids[a:b].tobytes()), ids[a:b].astype(np.int32) if with_ids else None) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
                    last = text
                for *piece, some in cut:
                    row = (doc_id, *piece, part, int(seen[piece[2]]))
                    rows.append((*row, some) if with_ids else row)
                    seen[piece[2]] += 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", *["ids"] * with_ids]).astype({"doc_id": "Int64"})

    return run


def pack(docs: DataFrame, max_len: int = 1024, end_id: int = 2, with_ids: bool = False, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces of all documents (doc_id, text) with their place: sequence_id and offset.

    A document is its token ids and then end_id. If longer than max_len it is cut into pieces of max_len, of which the
    first may be shorter. Null and empty texts are end_id alone; a null doc_id stays null; repeated rows are packed
    once each; an empty table gives no pieces; other columns are ignored. with_ids adds the ids themselves.

    One pass makes the pieces, written once; of them only counts by length reach the driver (max_len rows at most).
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids array<int>" * with_ids
    pieces = table(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(_pieces(max_len, end_id, with_ids, vocabulary), schema))
    counts = table(pieces.groupBy("part", "length").count())
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("count")).collect()}
    by_length = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("count").over(by_length), F.lit(0)).alias("before"))
    rows = plan(histogram, max_len) or [(0, 0, 0, 1, 0, 0)]
    places = docs.sparkSession.createDataFrame(rows, "of long, low long, high long, k long, seq long, slot long")
    rank = F.col("before") + F.col("nth")
    found = pieces.join(before, ["part", "length"]).withColumn("rank", rank)
    # the plan has a few rows for each possible length, so its size is bounded by max_len
    found = found.join(F.broadcast(places), (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    nth = F.col("rank") - F.col("low")
    return found.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("seq") + F.expr("(rank - low) div k")).alias("sequence_id"),
        (F.col("slot") + nth % F.col("k") * F.col("length")).alias("offset"),
        *["ids"] * with_ids,
    )
