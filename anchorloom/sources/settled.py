"""What executors must share: intermediate tables, so that a plan that is read several times is run once, and this package."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once for each application: functions that run there import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    target = Path(tempfile.mkdtemp(prefix="anchorloom-")) / "anchorloom_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted((root / "anchorloom").rglob("*.py")):
            z.write(f, f.relative_to(root).as_posix())
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def scratch(spark: SparkSession) -> str:
    """A new folder's URI below spark.checkpoint.dir; in local mode below a temporary folder where that is unset."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = Path(tempfile.mkdtemp(prefix="anchorloom-checkpoint-")).as_uri()
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/anchorloom/{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df, run now, as a Parquet table in the shared folder: lineage is cut and lost executors lose nothing."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
