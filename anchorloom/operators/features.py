"""Wide features of pairs, column selection and aligned union."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorloom.functions.genomic import CELL
from anchorloom.operators.intervals import nearest_distance, overlap_count

COORDINATES = ("chr", "x", "x_start", "x_end", "y", "y_start", "y_end")


def peaks_features(pairs: DataFrame, peaks: DataFrame, experiment: str) -> DataFrame:
    """pairs with {x,y}_<experiment>_counts and _distance: each distinct anchor is looked up once for both sides.

    A cell and chromosome without peaks leaves the distance null; ready() reports it."""
    sides = F.explode(F.array(*[F.struct(F.col(s).alias("p"), F.col(f"{s}_start").alias("start"), F.col(f"{s}_end").alias("end")) for s in "xy"]))
    spots = pairs.select(CELL, "chr", sides.alias("a")).select(CELL, "chr", "a.*").distinct()
    counts = overlap_count(spots, peaks, "counts")
    near = nearest_distance(spots, peaks, "distance")
    both = spots.join(counts, [CELL, "chr", "start", "end"]).join(near, [CELL, "chr", "p"])
    out = pairs
    for s in "xy":
        one = both.select(CELL, "chr", F.col("p").alias(s), F.col("start").alias(f"{s}_start"), F.col("end").alias(f"{s}_end"), F.col("counts").cast("short").alias(f"{s}_{experiment}_counts"), F.col("distance").cast("int").alias(f"{s}_{experiment}_distance"))
        out = out.join(one, [CELL, "chr", s, f"{s}_start", f"{s}_end"], "left")
    return out


def with_distance(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("distance", (F.col("y") - F.col("x")).cast("int"))


def concat_aligned(frames: list[DataFrame], cells: list[str] | None = None) -> DataFrame:
    """Union by name, columns that one lacks null; with cells, checks that exactly these are present."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    if cells is not None:
        found = {r[0] for r in out.select(CELL).distinct().limit(len(cells) + 1).collect()}
        if found != set(cells):
            raise ValueError(f"cells are {sorted(found)}, not {sorted(cells)}")
    return out


def select_features(df: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Columns to train on: include wins over exclude; label and cell_type come along unless label is included."""
    unknown = [c for c in [*(include or []), *(exclude or [])] if c not in df.columns]
    if unknown:
        raise ValueError(f"no such columns: {unknown}")
    if not include and (kept := {"label", CELL} & set(exclude or [])):
        raise ValueError(f"{sorted(kept)} cannot be excluded")
    if include:
        if exclude:
            warnings.warn("include and exclude are both given; exclude is ignored", stacklevel=2)
        return df.select(*[f"`{c}`" for c in include], *([] if "label" in include else ["label", CELL]))
    return df.drop(*(exclude or []))


def training(df: DataFrame) -> DataFrame:
    return df.drop(*COORDINATES)


def drop_nulls(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """df without rows that hold a null or NaN, and a report of one row: rows, rows dropped and how many each column lacks."""
    bare = [F.col(f"`{c}`").isNull() | (F.isnan(f"`{c}`") if t in ("float", "double") else F.lit(False)) for c, t in df.dtypes]
    hit = reduce(lambda a, b: a | b, bare)
    report = df.agg(F.count("*").alias("_rows"), F.count_if(hit).alias("_dropped"), *[F.count_if(n).alias(c) for n, c in zip(bare, df.columns, strict=True)])
    return df.where(~hit), report


def check_same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> None:
    """Fail unless a and b hold the same distinct keys."""
    sides = a.select(*keys, F.lit(1).alias("_side")).unionByName(b.select(*keys, F.lit(2).alias("_side")))
    alone = sides.groupBy(*keys).agg(F.count_distinct("_side").alias("_sides")).where("_sides < 2").limit(1).collect()
    if alone:
        raise ValueError(f"only one table holds {[alone[0][k] for k in keys]}")
