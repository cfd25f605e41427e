import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from tests.llm import brute

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, most=2):
    w = WORD.findall(brute.lower(text))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1)]


def bucket(f, buckets):
    return zlib.crc32(f.encode()) % buckets


def expected(docs, target, share=25, seed=7, least=20, buckets=10_000, most=2):
    s, t = Counter(), Counter()
    for counts, texts in ((s, [r[1] for r in docs]), (t, target)):
        for x in texts:
            counts.update(bucket(f, buckets) for f in features(x, most)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    rows = []
    for doc, text in docs:
        n, fs = features(text, most)
        weight = sum(gain(bucket(f, buckets)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    good = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    rank = {id(r): k + 1 for k, r in enumerate(good[: share * len(good) // 100])}
    return Counter((*r, rank.get(id(r))) for r in rows)


TEXTS = [(r[0], r[1]) for r in brute.awkward()]
ODD = "Straße №5 \U0001f642 x@y.zz A1b2 -- " + "é" * 90 + " " + "w" * 70 + " end\x00z " + "q" * 64
DOCS = TEXTS + [(200 + k, " ".join(f"w{(k * j) % 97} Common {ODD if j == 3 else ''}" for j in range(k % 60))) for k in range(150)] + [(None, ODD), (31, ODD), (31, ODD)]
TARGET = ["w3 common w5 common", None, "", "alpha3 alpha4 alpha5", ODD]


@pytest.mark.parametrize("size,most,buckets", [(1 << 16, 2, 10_000), (7, 2, 10_000), (40, 3, 97), (1, 1, 10)])
def test_resample(spark, size, most, buckets):
    from anchorloom.llm import importance

    docs = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in DOCS], "doc_id long, text string, `row` int, own string, score int")
    target = spark.createDataFrame([(k, t) for k, t in enumerate(TARGET)], "item_id long, text string")
    got = importance.resample(docs, target, most=most, buckets=buckets, size=size).collect()
    assert Counter(tuple(r) for r in got) == expected(DOCS, TARGET, most=most, buckets=buckets)


def test_empty_tables(spark):
    from anchorloom.llm import importance

    docs, target = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(docs, target).count() == 0
    some = spark.createDataFrame(DOCS, "doc_id long, text string")
    assert Counter(tuple(r) for r in importance.resample(some, target).collect()) == expected(DOCS, [])


def test_chunks_own_each_start_once():
    from anchorloom.llm import importance as im

    data = b"ab cd, efg--h \xc3\xa9\xc3\xa9 " * 30
    words = im.WORD.findall(data)
    for size in (1, 2, 5, 64):
        for most in (1, 2, 3):
            cut = list(im.chunks(data, most, size))
            assert b"".join(c[:own] for c, own in cut) == data
            assert [w for c, own in cut for w in im.WORD.findall(c[:own])] == words
            own = [b" ".join(f) for c, n in cut for w in [im.WORD.findall(c[:n]) + im.WORD.findall(c[n:])] for i in range(len(im.WORD.findall(c[:n]))) if len(f := w[i : i + most]) == most]
            assert own == [b" ".join(words[i : i + most]) for i in range(len(words) - most + 1)]


def test_highest_shares_are_drawn_more(spark):
    """Documents like the target are drawn far more often than others, of which a tenth would be drawn."""
    from anchorloom.llm import importance

    docs = [(k, " ".join(f"{'math' if k % 10 == 0 else 'news'}{(k * 7 + j) % 30}" for j in range(40))) for k in range(600)]
    target = spark.createDataFrame([(1, " ".join(f"math{j}" for j in range(30)) * 3)], "item_id long, text string")
    got = importance.resample(spark.createDataFrame(docs, "doc_id long, text string"), target, share=10).where("rank is not null").collect()
    assert len(got) == 60 and sum(r.doc_id % 10 == 0 for r in got) > 40
