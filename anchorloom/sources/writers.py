"""Sinks: TSV, Parquet by cell, FASTA, JSON parameters, models and a table of runs."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorloom.functions.genomic import CELL, chromosome_rank


def tsv(df: DataFrame, path: str, by_cell: bool = False) -> None:
    out = df.write.mode("overwrite").option("sep", "\t").option("header", True)
    (out.partitionBy(CELL) if by_cell else out).csv(path)


def parquet(df: DataFrame, path: str, by_cell: bool = False) -> None:
    out = df.write.mode("overwrite")
    (out.partitionBy(CELL) if by_cell else out).parquet(path)


def genomic(df: DataFrame, path: str, by: str = "x_start") -> None:
    """Parquet in ranges of cell, chromosome and `by`, sorted within: reads of an interval skip all other files and row groups."""
    keys = [F.col(CELL), chromosome_rank(), F.col(by)]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def fasta(df: DataFrame, path: str, name: str = "name", seq: str = "seq") -> None:
    df.select(F.concat(F.lit(">"), name, F.lit("\n"), seq).alias("value")).write.mode("overwrite").text(path)


def parameters(values: dict, path: str) -> None:
    Path(path).write_text(json.dumps(values, indent=1, sort_keys=True))


def load_parameters(path: str) -> dict | None:
    return json.loads(Path(path).read_text()) if Path(path).exists() else None


def model(fitted, path: str) -> None:
    fitted.write().overwrite().save(path)


def log_run(spark: SparkSession, path: str, run: str, values: dict[str, float], tags: dict[str, str] | None = None) -> None:
    """Append a run's metrics (times among them) to a table of runs, one row for each metric."""
    rows = [(run, k, float(v), json.dumps(tags or {}, sort_keys=True)) for k, v in sorted(values.items())]
    spark.createDataFrame(rows, "run string, metric string, value double, tags string").write.mode("append").parquet(path)
