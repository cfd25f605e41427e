"""Pieces the training-data operators share: scratch tables, code shipping, shared files and word splitting."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these bytes: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
WORD_SPLIT = "[ \\t-\\r]+"

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers once for each application, so that they can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    target = Path(tempfile.mkdtemp(prefix="anchorloom-")) / "anchorloom_src.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted((root / "anchorloom").rglob("*.py")):
            z.write(f, f.relative_to(root).as_posix())
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def scratch(spark: SparkSession) -> str:
    """A new folder's URI below the folder that all executors share (spark.checkpoint.dir; in local mode a temporary one if unset)."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = Path(tempfile.mkdtemp(prefix="anchorloom-checkpoint-")).as_uri()
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/anchorloom/{uuid.uuid4().hex}"


def written(df: DataFrame, compression: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, reread: lineage is cut and lost executors lose nothing."""
    path = scratch(df.sparkSession)
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.parquet(path)
    out._scratch = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables made by written() that no later plan reads."""
    for df in tables:
        if path := getattr(df, "_scratch", None):
            delete(df.sparkSession, path)


def delete(spark: SparkSession, uri: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(uri)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def free_shuffles(spark: SparkSession) -> None:
    """Ask the JVM to collect plans that nothing refers to, upon which Spark deletes their shuffle files."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes and rows of the Arrow batches that Python workers get: long texts must not add up."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def semi(big: DataFrame, ids: DataFrame, key: str, limit: int = 1_000_000) -> DataFrame:
    """Rows of big whose key is in ids (a written table of distinct keys): broadcast up to `limit` keys, shuffled beyond."""
    return big.join(F.broadcast(ids) if ids.count() <= limit else ids, key, "left_semi")


# Files in the shared folder, from workers.


def _fs(uri: str):
    u = urlparse(uri)
    if u.scheme in ("", "file"):
        return None, u.path or uri
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class SharedFile:
    """Writes a file under a name of this attempt's own and renames it when whole: a retried task replaces it."""

    def __init__(self, uri: str):
        self.fs, self.path = _fs(uri)
        self.own = f"{self.path}.{uuid.uuid4().hex}"
        folder = os.path.dirname(self.path)
        if self.fs:
            self.fs.create_dir(folder, recursive=True)
            self.out = self.fs.open_output_stream(self.own)
        else:
            os.makedirs(folder, exist_ok=True)
            self.out = open(self.own, "wb")  # noqa: SIM115

    def write(self, data: bytes) -> None:
        self.out.write(data)

    def done(self) -> None:
        self.out.close()
        if self.fs:
            self.fs.move(self.own, self.path)
        else:
            os.replace(self.own, self.path)


def mapped(uri: str, dtype: str) -> np.ndarray:
    """The file as an array: memory-mapped where the shared folder is mounted, read otherwise."""
    fs, path = _fs(uri)
    if fs:
        with fs.open_input_file(path) as f:
            return np.frombuffer(f.read(), dtype)
    return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)


# Words, in workers.


def words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words as UTF-8. bytes.split() and bytes.lower() know ASCII only, so they match the word class and A-Z exactly."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, bound: int = 400_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.bound:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


STEP = 0x9E3779B97F4A7C15


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all windows of k words, given the words' hashes: polynomials in STEP, joined from windows of powers
    of two words, and mixed."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power = lambda w: np.uint64(pow(STEP, w, 1 << 64))
    levels, w = {1: h}, 1
    while 2 * w <= k:
        levels[2 * w] = levels[w][:-w] * power(w) + levels[w][w:]
        w *= 2
    out, span = levels[w][:n], w
    while w > 1:
        w //= 2
        if k & w:
            out = out * power(w) + levels[w][span : span + n]
            span += w
    return mix(out)
