"""Plans whose cost must not grow faster than their input: window frames, join sides that estimates take for small."""

import pyarrow as pa
from pyspark.sql import functions as F

from pyspark.sql import functions as F

from anchorloom.operators import implicit, intervals, motifs, ordering
from anchorloom.sources import chains, readers
from anchorloom.sources.settled import settled


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_nearest_distance_keeps_no_frame_to_the_last_row(spark):
    """Spark sums such a frame anew for each row; results in one crowded bin equal brute force."""
    starts = [(k * 37) % 5000 for k in range(400)]
    b = spark.createDataFrame([("A", "1", s, s + 3 + s % 11) for s in starts], "cell_type string, chr string, start long, end long")
    points = [k * 13 % 5200 for k in range(300)]
    found = intervals.nearest_distance(spark.createDataFrame([("A", "1", p) for p in points], "cell_type string, chr string, p long"), b)
    assert "unboundedfollowing" not in plan(found).lower()
    want = {p: min(max(0, s - p, p - s - 3 - s % 11) for s in starts) for p in points}
    assert {r.p: r.dist for r in found.collect()} == want


def test_slices_do_not_broadcast_the_genome(spark, tmp_path):
    """Chunks come out of a few byte ranges, which adaptive planning takes for a small table."""
    letters = {f"chr{k}": "".join("ACGT"[(k + i * i) % 4] for i in range(3000 + k)) for k in range(1, 5)}
    (tmp_path / "g.fa").write_text("".join(f">NC_1 chromosome {n[3:]}, whole\n{s}\n" for n, s in letters.items()))
    rows = [(n, k * 97 % 2900, k * 97 % 2900 + 20, f"n{k}") for k in range(40) for n in letters]
    parts = spark.createDataFrame(rows, "chr string, start long, end long, name string")
    found = motifs.slices_of_chunks(parts, readers.fasta_chunks(spark, (tmp_path / "g.fa").as_uri(), reach=20, width=512, size=1 << 10), 512)
    assert sorted((r.chr, r.name, r.seq) for r in found.collect()) == sorted((n, name, letters[n][a:e]) for n, a, e, name in rows)
    assert "BroadcastHashJoin" not in plan(found)


def test_drawn_numbers_are_not_broadcast(spark):
    """Numbers come from exploding a few rows after a shuffle; what draws are looked up in grows too."""
    centers = spark.createDataFrame([("A", "1", k * 9000) for k in range(60)], "cell_type string, chr string, center long")
    ranked = settled(implicit.partners(centers, 2500))
    numbered = settled(implicit.numbered(ranked, ["cell_type"]))
    sizes = settled(spark.createDataFrame([("A", 1770, 1770, 0, 30)], "cell_type string, n long, want long, known long, width long"))
    found = implicit._looked_up(implicit._drawn(sizes, ["cell_type"], 42), sizes, numbered, ranked, ["cell_type"])
    assert len({(r.x, r.y) for r in found.collect()}) == 1770
    assert plan(found).partition("Initial Plan")[0].count("SortMergeJoin") == 2


def test_best_chains_make_no_pairs_of_blocks(spark):
    """Sixty blocks lie on each place; some are longer than a bin, some tie in score. Brute force goes place by place."""
    rows = []
    for k in range(180):
        start, length = k * 131 % 3000 + (8192 - 1500), 20_000 if k % 45 == 0 else 300 + k * 17 % 900
        rows.append(("1" if k % 9 else "X", start, start + length, "2", k * 1000, "-" if k % 2 else "+", k * 31 % 50, k))
    found = chains.best(spark.createDataFrame(rows, "chr string, start long, end long, to_chr string, to_start long, strand string, score long, id long"))
    assert "Join" not in plan(found)
    want = {}
    for c, start, end, *_, score, k in sorted(rows, key=lambda r: (r[6], -r[7])):
        want.update({(c, p): k for p in range(start, end)})
    own, got, parts = {r[7]: r for r in rows}, {}, {}
    for r in found.collect():
        for p in range(r.start, r.end):
            assert (r.chr, p) not in got
            got[r.chr, p] = r.id
        _, start, end, to_chr, to_start, strand, score, _ = own[r.id]
        assert (r.to_chr, r.strand, r.score, r.to_start) == (to_chr, strand, score, to_start + (end - r.end if strand == "-" else r.start - start))
        parts.setdefault(r.id, []).append((r.start, r.end))
    assert got == want
    assert not any(a[1] == b[0] for each in parts.values() for a, b in zip(sorted(each), sorted(each)[1:]))


def test_running_sums_of_small_groups_are_not_broadcast(spark):
    """Groups of a few rows each: sums by bin are nearly as many as rows."""
    df = settled(spark.range(3000).selectExpr("id div 3 as chain", "0L as row", "id % 3 as place"))
    found = ordering.running_sum(df, ["chain"], ["row"], ["place"], F.col("place") + 1, "through")
    assert {(r.chain, r.place): r.through for r in found.collect()} == {(c, k): (1, 3, 6)[k] for c in range(1000) for k in range(3)}
    assert "BroadcastHashJoin" not in plan(found)


def test_stretches_of_a_batch_are_bounded():
    texts = ["ACGT" * (k % 7) if k % 5 else None for k in range(200)] + ["A" * 500]
    b = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["name", "seq"])
    parts = list(motifs.stretches(b, 100))
    assert pa.Table.from_batches(parts).to_pylist() == b.to_pylist()
    assert all(p.num_rows == 1 or sum(len(x or "") for x in p.column(1).to_pylist()) <= 100 for p in parts) and len(parts) > 20


def test_overlap_join_does_not_broadcast_copied_rows(spark):
    a = settled(spark.createDataFrame([("A", "1", k * 50, k * 50 + 20_000) for k in range(200)], "cell_type string, chr string, start long, end long"))
    found = intervals.overlap_join(a, a.where("start % 100 = 0"))
    assert found.count() == sum(abs(k - j) * 50 < 20_000 for k in range(200) for j in range(0, 200, 2))
    assert "Broadcast" not in plan(found)
