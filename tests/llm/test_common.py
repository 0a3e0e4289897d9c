"""Word hashes and the filter of ids."""

import random

from tierseek.llm import common


def test_word_hashes(monkeypatch):
    r = random.Random(5)
    words = [bytes(r.choice(b"abc\xc3\xa9\x1c\x85") for _ in range(r.choice([1, 2, 3, 9, 70]))) for _ in range(400)] + [b"z" * 5000, b"z" * 5001]
    text = b"".join(r.choice([b" ", b"\n", b"\t \r\v\f"]) + w for w in words)
    whole = common.word_hashes(text).tolist()
    assert len(whole) == len(text.split()) == len(words)
    assert len(set(whole)) == len(set(words)) == len(set(zip(words, whole, strict=True)))
    monkeypatch.setattr(common, "SLICE", 50)
    assert common.word_hashes(text).tolist() == whole
    assert common.word_hashes(b"").tolist() == common.word_hashes(b" \n ").tolist() == []


def test_gram_hashes():
    h = common.word_hashes(" ".join(map(str, range(100))).encode())
    for k in range(1, 20):
        g = common.gram_hashes(h, k)
        assert len(set(g.tolist())) == 101 - k
        assert common.gram_hashes(h[30 : 30 + k], k)[0] == g[30]
    assert len(common.gram_hashes(h[:2], 5)) == 1


def test_among(spark, monkeypatch):
    rows = spark.createDataFrame([(i % 700 - 50, str(i)) for i in range(1000)] + [(None, "x")], "doc_id long, text string")
    ids = spark.range(0, 2000, 7).withColumnRenamed("id", "doc_id")
    expected = sorted((i % 700 - 50, str(i)) for i in range(1000) if i % 700 >= 50 and (i % 700 - 50) % 7 == 0)
    for places in (common.PLACES, common.PER_ROW, 16):
        monkeypatch.setattr(common, "PLACES", places)
        assert sorted(map(tuple, common.among(rows, "doc_id", ids).collect())) == expected
    assert common.among(rows, "doc_id", ids.limit(0)).count() == 0
