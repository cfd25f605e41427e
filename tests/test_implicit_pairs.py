"""Samples of numbered pairs against pairs made outright."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from anchorloom.operators import implicit
from anchorloom.operators.pairs import genomic_rank

CENTERS = [("A", "1", c) for c in (5, 10, 10, 30, 31, 2_000_000, 2_000_001, 9_000_000)] + [("A", "X", c) for c in (0, 7, 8)] + [("B", "1", 4), ("B", "2", 100), ("B", "2", 1_048_576), ("C", "1", 3)]


def frame(spark, rows=CENTERS):
    return spark.createDataFrame(rows, "cell_type string, chr string, center long")


def every(radius, rows=CENTERS):
    reach = 2 * radius if radius else 0
    spots = sorted(set(rows))
    return {(a[0], a[1], a[2], b[2]) for a in spots for b in spots if a[:2] == b[:2] and a[2] + reach < b[2]}


def drawn(spark, want, strata=("cell_type",), seed=1, radius=None, known=None, rows=CENTERS):
    keys = sorted({tuple(r[: len(strata)]) for r in rows})
    sizes = spark.createDataFrame([(*k, want) for k in keys], ", ".join(f"{s} string" for s in strata) + ", want long")
    return [tuple(r) for r in implicit.sample(frame(spark, rows), sizes, list(strata), seed, radius, known).select("cell_type", "chr", "x", "y").collect()]


@pytest.mark.parametrize("radius", [None, 1, 10, 500_000])
def test_partners_are_all_pairs(spark, radius):
    rows = implicit.partners(frame(spark), radius).collect()
    ranked = {(r.cell_type, r.chr, r["rank"]): r.x for r in rows}
    assert {(r.cell_type, r.chr, r.x, ranked[r.cell_type, r.chr, k]) for r in rows for k in range(r.first, r.last)} == every(radius)


@pytest.mark.parametrize("strata", [("cell_type",), ("cell_type", "chr")])
def test_numbers_are_in_order(spark, strata):
    ranked = implicit.partners(frame(spark), 1)
    made = implicit.numbered(ranked, list(strata)).collect()
    for key in {tuple(r[s] for s in strata) for r in made}:
        own = sorted((r.chr, r.x, r.base, r.many) for r in made if tuple(r[s] for s in strata) == key)
        assert [b for *_, b, _ in own] == [sum(m for *_, m in own[:k]) for k in range(len(own))]


def test_exact_size_none_known_none_twice(spark):
    candidates = every(1)
    known = sorted(candidates)[::3]
    table = spark.createDataFrame([*known, known[0], ("A", "9", 1, 2)], "cell_type string, chr string, x long, y long")
    for want in (0, 1, 7, 1000):
        got = drawn(spark, want, radius=1, known=table)
        assert len(got) == len(set(got)) and set(got) <= candidates - set(known)
        for cell in "ABC":
            assert sum(g[0] == cell for g in got) == min(want, sum(c[0] == cell for c in candidates - set(known)))
    per = Counter((g[0], g[1]) for g in drawn(spark, 2, ("cell_type", "chr")))
    assert per == {k: min(2, n) for k, n in Counter((c[0], c[1]) for c in every(None)).items()}


def test_reruns_agree_and_seeds_differ(spark):
    assert sorted(drawn(spark, 5)) == sorted(drawn(spark, 5))
    assert len({tuple(sorted(drawn(spark, 5, seed=s))) for s in range(4)}) > 1


def test_uniform(spark):
    """1,000 cells with the same 15 pairs, 5 drawn in each: every pair comes up about 333 times."""
    rows = [(f"c{k}", "1", c) for k in range(1000) for c in (1, 2, 3, 4, 5, 6)]
    counts = Counter(g[2:] for g in drawn(spark, 5, rows=rows))
    assert len(counts) == 15 and sum(counts.values()) == 5000
    assert sum((n - 1000 / 3) ** 2 / (1000 / 3) for n in counts.values()) < 40


def test_many_pairs_cost_draws_only(spark):
    """50,000 centres make 1.25 billion pairs; a hundred are drawn."""
    centers = spark.range(50_000).select(F.lit("A").alias("cell_type"), F.lit("1").alias("chr"), (F.col("id") * 3000).alias("center"))
    sizes = spark.createDataFrame([("A", 100)], "cell_type string, want long")
    got = implicit.sample(centers, sizes, ["cell_type"], 3, 2500).collect()
    assert len(got) == 100 and all(r.x + 5000 < r.y and r.x % 3000 == r.y % 3000 == 0 for r in got)
    assert min(r.x for r in got) < 30_000_000 and max(r.y for r in got) > 120_000_000


def test_genomic_rank(spark):
    rows = [("A", c, s) for c in ("10", "2", "X", "Y", "1") for s in (5, 3_000_000, 7)] + [("B", "Y", 1)]
    made = genomic_rank(spark.createDataFrame(rows, "cell_type string, chr string, start long"), "start").collect()
    order = {c: k for k, c in enumerate(["1", "2", "10", "X", "Y"])}
    want = {r: k + 1 for k, r in enumerate(sorted((r for r in rows if r[0] == "A"), key=lambda r: (order[r[1]], r[2])))} | {rows[-1]: 1}
    assert {(r.cell_type, r.chr, r.start): r.rn for r in made} == want


def test_genomic_layout_prunes(spark, tmp_path):
    import pyarrow.parquet as pq

    from anchorloom.sources import writers

    rows = [(c, ch, s) for c in "AB" for ch in ("1", "10", "2", "X") for s in range(0, 50_000_000, 1_000_000)]
    writers.genomic(spark.createDataFrame(rows, "cell_type string, chr string, x_start long"), str(tmp_path / "g"))
    spans = []
    for f in sorted((tmp_path / "g").glob("*.parquet")):
        t = pq.read_table(f).to_pylist()
        spans.append([(r["cell_type"], {"1": 1, "2": 2, "10": 10, "X": 100}[r["chr"]], r["x_start"]) for r in t])
    assert len(spans) > 1 and all(s == sorted(s) for s in spans)
    spans.sort(key=lambda s: s[0])
    assert all(a[-1] < b[0] for a, b in zip(spans, spans[1:]))
    assert sum(s[0] <= ("A", 2, 3_000_000) and s[-1] >= ("A", 2, 2_000_000) for s in spans) == 1
