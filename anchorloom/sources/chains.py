"""Alignment chains (UCSC's chain format) as blocks for liftover.

A chain is a header (score, both sides' names, sizes, strands and ranges, id) and lines "size gap gap", the last "size". A block
begins where the sizes and gaps before it end: running sums over its chain. Places of a reverse side count from that side's
end; blocks give them on the forward strand. Comment lines start with "#".
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anchorloom.functions.genomic import bare_chr
from anchorloom.operators.intervals import BIN, binned
from anchorloom.operators.ordering import running_sum
from anchorloom.sources.settled import settled, ship

NAMES = "score t_name t_size t_strand t_start t_end q_name q_size q_strand q_start q_end id".split()
NUMBERS = ("score", "t_size", "t_start", "t_end", "q_size", "q_start", "q_end", "id")
BLOCKS = ["chr", "start", "end", "to_chr", "to_start", "strand", "score", "id"]
#: Blocks of a chain that are summed in a row.
ROW = 4096


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, chain, header fields, lines): a row for each chain; one whose ranges disagree with its blocks fails in blocks()."""
    texts = spark.read.text(path, lineSep="chain ").select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("chain"), "value")
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: (F.trim(x) != "") & ~x.startswith("#"))
    bits = F.split(F.trim(F.try_element_at("lines", F.lit(1))), r"\s+")
    fields = [F.try_element_at(bits, F.lit(k + 1)).cast("long" if n in NUMBERS else "string").alias(n) for k, n in enumerate(NAMES)]
    return texts.withColumn("lines", lines).where("size(lines) > 0").select("file", "chain", *fields, F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))).alias("lines"))


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """BLOCKS of all chains of the files. Lines are settled when this is called, as they are summed twice."""
    each = records(spark, path).select("*", F.posexplode("lines").alias("place", "line")).drop("lines")
    bits = F.split(F.trim("line"), r"\s+")
    number = lambda k: F.coalesce(F.try_element_at(bits, F.lit(k)).cast("long"), F.lit(0).cast("long"))
    each = settled(each.withColumns({"size": number(1), "t_gap": number(2), "q_gap": number(3), "row": F.floor(F.col("place") / ROW)}).drop("line"))
    for side in "tq":
        each = running_sum(each, ["chain"], ["row"], ["place"], F.col("size") + F.col(f"{side}_gap"), f"{side}_through")
    at = lambda s: F.col(f"{s}_start") + F.col(f"{s}_through") - F.col(f"{s}_gap") - F.col("size")
    made = each.withColumns({"start": at("t"), "q": at("q")}).withColumn("end", F.col("start") + F.col("size"))
    bad = (F.col("t_strand") != "+") | (F.col("end") > F.col("t_end")) | (F.col("q") + F.col("size") > F.col("q_end"))
    forward = F.when(F.col("q_strand") == "-", F.col("q_size") - F.col("q") - F.col("size")).otherwise(F.col("q"))
    forward = F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.concat(F.lit("a chain's blocks leave its range: id "), F.coalesce(F.col("id").cast("string"), F.lit("none"))))).otherwise(forward)
    return made.select(bare_chr("t_name").alias("chr"), "start", "end", bare_chr("q_name").alias("to_chr"), forward.cast("long").alias("to_start"), F.col("q_strand").alias("strand"), "score", "id")


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts (_s, _e) of the blocks that are best, of rows in order of chr, _bin and start: a heap holds the blocks at hand, best first."""
    group, heap, at, out, last = None, [], 0, [], None

    def advance(to: float) -> None:
        nonlocal at, last
        while heap and at < to:
            end, row = heap[0][3], heap[0][-1]
            if end <= at:
                heapq.heappop(heap)
                continue
            stop = min(end, to)
            if last is not None and last[0] is row and last[2] == at:
                last[2] = stop
            else:
                last = [row, at, stop]
                out.append(last)
            at = stop

    def made() -> pa.RecordBatch:
        columns = [*zip(*[row for row, _, _ in out], strict=True), [s for _, s, _ in out], [e for _, _, e in out]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PART.types, strict=True)], schema=_PART)

    n = 0
    for b in batches:
        for *row, place in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (row[0], place) != group:
                advance(math.inf)
                group, heap, last, at = (row[0], place), [], None, place * BIN
            low, high = max(row[1], place * BIN), min(row[2], (place + 1) * BIN)
            advance(low)
            at, n, (score, k) = max(at, low), n + 1, row[6:8]
            # Nulls go first, as in Spark's order; n keeps rows from being compared.
            heapq.heappush(heap, ((score is not None, -(score or 0)), (k is not None, k or 0), row[1], high, n, row))
        if len(out) > 1 and out[-1] is last:
            kept = out.pop()  # it may go on
            yield made()
            out[:] = [kept]
    advance(math.inf)
    if out:
        yield made()


_PART = pa.schema([(c, pa.string() if c in ("chr", "to_chr", "strand") else pa.int64()) for c in [*BLOCKS, "_s", "_e"]])


def best(found: DataFrame) -> DataFrame:
    """Blocks cut so that each place is in one at most: the one of greatest score, then of least id, that covers it.

    Each bin's blocks are swept once in order (Python, a heap of those at hand), so work goes with blocks and not with how many of them
    overlap; parts that a bin's edge cut are put together again."""
    ship(found.sparkSession)
    each = binned(found.select(*[F.col(c).cast(t).alias(c) for c, t in zip(BLOCKS, ("string", "long", "long", "string", "long", "string", "long", "long"), strict=True)]), "_bin")
    dealt = each.repartition(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chr", "_bin").sortWithinPartitions("chr", "_bin", "start", "id")
    kinds = ", ".join(f"`{f.name}` {'string' if pa.types.is_string(f.type) else 'long'}" for f in _PART)
    part = dealt.mapInArrow(_swept, kinds)
    line = W.partitionBy(*BLOCKS).orderBy("_s")
    fresh = F.coalesce((F.col("_s") != F.lag("_e").over(line)).cast("int"), F.lit(1))
    island = F.sum("_fresh").over(line.rowsBetween(W.unboundedPreceding, 0))
    part = part.withColumn("_fresh", fresh).withColumn("_island", island).groupBy(*BLOCKS, "_island").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"))
    moved = F.when(F.col("strand") == "-", F.col("to_start") + F.col("end") - F.col("_e")).otherwise(F.col("to_start") + F.col("_s") - F.col("start"))
    return part.select("chr", F.col("_s").alias("start"), F.col("_e").alias("end"), "to_chr", moved.alias("to_start"), "strand", "score", "id")
