"""The pipeline's stages on a small table, each against brute force."""

import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest

from tierseek.llm import mixing, packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words int, base int, size string"


def texts():
    r = random.Random(12)
    words = "the of and to in house water green stone light paper cloud river field mountain winter summer morning evening silver".split()
    fresh = lambda n: [r.choice(words) + (str(r.randrange(90)) if r.random() < 0.5 else "") for _ in range(n)]
    rows = [(i, " ".join(fresh(r.choice([60, 120, 200, 1500])))) for i in range(60)]
    long = fresh(300)
    rows += [(100, " ".join(long)), (101, " ".join(long))]
    for i in range(25):  # near copies, around the threshold
        w = list(long)
        for _ in range(i):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows.append((110 + i, " ".join(w)))
    rows += [(d, t + " write to a.b@c.example.com or call +1 (017) 555-7713 now") for d, t in rows[:5]]
    rows += [(200, "short text"), (201, None), (202, ""), (203, "word " * 80), (204, " ".join(fresh(70)) + " # $ % & |" * 20)]
    return [(d, t, "en", r.choice(["s1", "s2", None]), 0, f"k{d}", d, 1, "z") for d, t in rows]


def shingles(text, k):
    w = text.encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(docs, k, share):
    sets, top = [(d, shingles(t, k)) for d, t in docs], {d: d for d, _ in docs}
    find = lambda x: x if top[x] == x else find(top[x])
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and len(x & y) >= share * len(x | y) - 1e-9:
                p, q = sorted((find(a), find(b)))
                top[q] = p
    return {d: find(d) for d, _ in docs}


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("docs")
    spark.createDataFrame(texts(), SCHEMA).coalesce(2).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.fixture(scope="module")
def outputs(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        rows = [tuple(r) for r in docs.collect()]
        out.append((docs.columns, rows))
        docs = spark.createDataFrame(rows, docs.schema).coalesce(2)
    return out


def test_stages_equal_brute_force(spark, sf_dir, outputs):
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = sorted(map(tuple, source.collect()), key=str)
    quality, near, pii, mixed, packed = outputs
    assert all(columns == source.columns for columns, _ in outputs[:-1])
    # quality: all ordinary texts and no others
    assert sorted(quality[1], key=str) == [r for r in before if r[0] < 200]
    # near duplicates: the smallest id of each component, with all its rows
    rows = [(r[0], r[1]) for r in quality[1]]
    by_id = {}
    for d, t in rows:
        by_id.setdefault(d, []).append(t)
    flat = [(d, i, t) for d, ts in by_id.items() for i, t in enumerate(ts)]
    comp = components([((d, i), t) for d, i, t in flat] , 5, 0.8)
    top = {}
    for (d, _), (low, _) in comp.items():  # rows that share an id are one document
        top.setdefault(d, set()).add(low)
    assert sorted(near[1], key=str) == sorted((r for r in quality[1] if min(top[r[0]]) == r[0]), key=str)
    assert len(near[1]) < len(quality[1])
    # personal data: gone, all else as it was
    was = Counter((r[0], r[1].replace("a.b@c.example.com", "[EMAIL]").replace("+1 (017) 555-7713", "[PHONE]"), *r[2:]) for r in near[1])
    assert Counter(pii[1]) == was
    # the mix: as often as copies() says, near the targets
    times = Counter(mixed[1])
    assert set(times) <= set(pii[1]) and all(times[r] <= 2 * n for r, n in Counter(pii[1]).items())
    words, order = {}, sorted({r[3] for r in pii[1] if r[3]}) + [None]
    for r in pii[1]:
        words[r[3]] = words.get(r[3], 0) + len(r[1].split())
    goal = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(words.items()), "source string, size long"), (3, 1, 2), 1.5, 2.0).collect()}
    for s in order:
        assert abs(sum(len(r[1].split()) for r in mixed[1] if r[3] == s) - goal[s]) <= 0.05 * goal[s]
    # pieces: each document's ids once, in pieces of at most 1024, without gaps in a sequence
    encode, want = packing.default_encoder(packing.VOCABULARY), Counter()
    for r in mixed[1]:
        ids = np.append(encode(r[1]), np.uint32(2)).astype("<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want.update((r[0], i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter(r[:5] for r in packed[1]) == want
    places = {}
    for r in packed[1]:
        places.setdefault(r[5], []).append((r[6], r[3]))
    for p in places.values():
        ends = [a + n for a, n in sorted(p)]
        assert [a for a, _ in sorted(p)] == [0, *ends[:-1]] and ends[-1] <= 1024


def test_run_equals_its_stages(spark, sf_dir, outputs):
    assert sorted(tuple(r)[:5] for r in corpus_pipeline.run(spark, sf_dir).collect()) == sorted(r[:5] for r in outputs[-1][1])


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
