import numpy as np
import pytest
from pyspark.sql import functions as F


def removed(rows, size=20):
    """Words removed of each text, by tuples of words in a dictionary of first starts."""
    first, out = {}, []
    for d, t in rows:
        ws, cover = t.split(), set()
        for i in range(len(ws) - size + 1):
            if first.setdefault(tuple(ws[i : i + size]), (d, i)) != (d, i):
                cover.update(range(i, i + size))
        out.append((d, len(cover)))
    return out


@pytest.mark.parametrize("letters", ["a", "b", "c", "d", "ef", "gh"])
def test_equal_windows_on_both_sides_of_word_2_20(spark, letters):
    from anchorloom.llm import substring_dedup

    own = [f"w{k}" for k in range((1 << 20) - 10)]
    passage = [letters[k % len(letters)] for k in range(21 if len(letters) == 1 else 30)]
    text = " ".join([*own, *passage, *[f"z{k}" for k in range(60)]])
    got = substring_dedup.remove(spark.createDataFrame([(1, text)], "doc_id long, text string")).select("doc_id", "n_removed").collect()
    assert [tuple(r) for r in got] == removed([(1, text)]) and got[0].n_removed > 0


def test_least_places_do_not_depend_on_the_stretch(monkeypatch):
    from anchorloom.llm import substring_dedup as sd

    h = np.random.default_rng(3).integers(0, 1 << 63, 5000, dtype=np.uint64)
    h[1000:1400], h[2000:2003] = h[5], h[7]
    whole = sd.Windows(h, 20, 8)
    monkeypatch.setattr(sd, "PLACES", 64)
    monkeypatch.setattr(sd.common, "grams", lambda x, k: x[: len(x) - k + 1] & ~np.uint64((1 << 20) - 1))
    small = sd.Windows(h, 20, 8)
    monkeypatch.setattr(sd, "PLACES", 1 << 20)
    large = sd.Windows(h, 20, 8)
    assert whole.n == small.n and (small.anchors == large.anchors).all() and (small.many == large.many).all()


def test_repeated_rows_stay_once(spark):
    from anchorloom.llm import near_join

    t, other = " ".join(f"w{k}" for k in range(40)), " ".join(f"v{k}" for k in range(40))
    rows = [(1, t, "b"), (1, t, "a"), (2, t, "c"), (1, other, "d"), (3, other, "e"), (5, None, "f"), (5, None, "g"), (6, " ", "h"), (6, " ", "h"), (None, t, "i"), (None, t, "i")]
    got = near_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    want = [(1, t, "a"), (1, other, "d"), (5, None, "f"), (5, None, "g"), (6, " ", "h"), (6, " ", "h"), (None, t, "i"), (None, t, "i")]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_labelled_rows_are_bounded(spark, monkeypatch):
    """Many rows of one labelled doc_id do not outgrow the sample."""
    from anchorloom.llm import quality_model as qm

    stats = spark.range(500).select((F.col("id") % 2).alias("doc_id"), F.array(*[F.col("id").cast("double")] * len(qm.NAMES)).alias("x"))
    seen = []
    monkeypatch.setattr(qm, "fit", lambda x, y: seen.append(len(y)))
    monkeypatch.setattr(qm, "held_out", lambda: F.lit(False))
    qm.learn(stats, spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int"), sample=30)
    assert seen == [30]
