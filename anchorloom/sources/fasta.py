"""FASTA in pieces: byte ranges of files are tasks, and a record of any length becomes rows of at most a chunk each.

1. Files are cut into ranges of bytes. Whether a range begins inside a header follows from the line it begins in.
2. Each range counts its headers and the letters before its first and after its last one. Running sums over a file's ranges,
   a row for each, tell where in which record a range begins.
3. Each range is read once more and gives the chunks whose first letter it holds; what a chunk lacks at the range's end is
   read from beyond it.

Letters are all but white space, as they stand. A record starts at ">" at a line's start; its header is at most HEADER
bytes long. What precedes a file's first header is left out. A record without letters is one empty chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anchorloom.sources.files import opened, read_at
from anchorloom.sources.settled import ship

#: Bytes of a range, of the longest header, and of a read beyond a range.
RANGE, HEADER, AHEAD = 8 << 20, 1 << 16, 1 << 16
SPACE = b" \t\n\r\x0b\x0c"
CHUNK = 1 << 16


def items(file, size: int, a: int, b: int) -> Iterator[tuple[str, bytes]]:
    """("head", line) and ("letters", ...) of the lines' parts in [a, b), in order. A header belongs to the range of its ">"."""
    back = read_at(file, max(0, a - HEADER), min(a, HEADER))
    data, at = read_at(file, a, b - a), 0
    line = back.rfind(b"\n") + 1
    if line < len(back) and back[line : line + 1] == b">" and (line or a <= HEADER):
        at = data.find(b"\n") + 1 or len(data)  # in a header that an earlier range has
    fresh = at > 0 or line == len(back)
    while at < len(data):
        if fresh and data[at : at + 1] == b">":
            end = data.find(b"\n", at)
            head = data[at + 1 : end] if end >= 0 else data[at + 1 :] + read_at(file, b, HEADER).partition(b"\n")[0]
            yield "head", head.rstrip(b"\r")
            at = end + 1 if end >= 0 else len(data)
            continue
        end = data.find(b"\n>", at)
        yield "letters", data[at : end + 1 if end >= 0 else len(data)].translate(None, SPACE)
        at, fresh = (end + 1, True) if end >= 0 else (len(data), False)


def ranges(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(file, bytes, part) of the files' byte ranges; globs and folders as Spark lists them, contents are not read."""
    found = spark.read.format("binaryFile").load(path).where("length > 0").select(F.col("path").alias("file"), F.col("length").alias("bytes"))
    each = found.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / size))))
    return each.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file", "part")


def index(cut: DataFrame, size: int = RANGE) -> DataFrame:
    """ranges() with head, the header of the record that they begin in (null before the first), and its letters before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, whole, part in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                heads, last, letters = 0, None, 0
                with opened(name) as f:
                    for kind, data in items(f, whole, part * size, min(whole, (part + 1) * size)):
                        if kind == "head":
                            heads, last, letters = heads + 1, data.decode("utf-8", "replace"), 0
                        else:
                            letters += len(data)
                yield pa.RecordBatch.from_pylist([{"file": name, "bytes": whole, "part": part, "heads": heads, "last": last, "letters": letters}], schema)

    schema = pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("part", pa.int64()), ("heads", pa.int64()), ("last", pa.string()), ("letters", pa.int64())])
    made = cut.mapInArrow(run, "file string, bytes long, part long, heads long, last string, letters long")
    line = W.partitionBy("file").orderBy("part")
    made = made.withColumn("record", F.sum("heads").over(line.rowsBetween(W.unboundedPreceding, 0)))
    # Letters of the record that a range ends in, up to its end.
    made = made.withColumn("through", F.sum("letters").over(W.partitionBy("file", "record").orderBy("part").rowsBetween(W.unboundedPreceding, 0)))
    before = line.rowsBetween(W.unboundedPreceding, -1)
    return made.select("file", "bytes", "part", F.last("last", True).over(before).alias("head"), F.coalesce(F.lag("through").over(line), F.lit(0)).alias("before"))


class Chunks:
    """Letters of records in a row, given out as (head, chunk, letters)."""

    def __init__(self, width: int, reach: int):
        self.width, self.reach, self.head = width, reach, None

    def begin(self, head: str | None, at: int, first: int) -> None:
        """From letter `at` of the record on; chunks from `first` on are wanted."""
        self.head, self.at, self.next, self.held, self.base = head, at, first, bytearray(), at

    def add(self, data: bytes) -> Iterator[tuple[str, int, bytes]]:
        self.held += data
        self.at += len(data)
        while self.at >= self.next * self.width + self.width + self.reach:
            yield self._cut()
        drop = min(self.next * self.width, self.at) - self.base
        if drop > 0:
            del self.held[:drop]
            self.base += drop

    def _cut(self) -> tuple[str, int, bytes]:
        low = self.next * self.width - self.base
        self.next += 1
        return self.head, self.next - 1, bytes(self.held[low : low + self.width + self.reach])

    def end(self, owned: int) -> Iterator[tuple[str, int, bytes]]:
        """What is left of a record that ends here, of chunks that begin before letter `owned`; an empty one is chunk 0."""
        while self.next * self.width < min(owned, self.at) or (self.next == 0 and owned >= 0):
            yield self._cut()


def _chunks(name: str, whole: int, part: int, head: str | None, before: int, size: int, width: int, reach: int) -> Iterator[tuple[str, int, bytes]]:
    with opened(name) as f:
        a, b = part * size, min(whole, (part + 1) * size)
        made = Chunks(width, reach)
        made.begin(head, before, max(1, -(-before // width)))  # chunk 0 is its header's range's
        for kind, data in items(f, whole, a, b):
            if kind == "letters":
                if made.head is not None:
                    yield from made.add(data)
            else:
                if made.head is not None:
                    yield from made.end(made.at)
                made.begin(data.decode("utf-8", "replace"), 0, 0)
        owned = made.at
        while b < whole and made.head is not None and (made.next * width < owned or made.next == 0):
            c = min(whole, b + AHEAD)
            for kind, data in items(f, whole, b, c):
                if kind == "head":
                    b = whole
                    break
                for chunk in made.add(data):
                    if chunk[1] * width < owned or chunk[1] == 0:
                        yield chunk
            b = max(b, c)
        if made.head is not None:
            yield from made.end(owned)


def chunks(spark: SparkSession, path: str, reach: int = 0, width: int = CHUNK, size: int = RANGE) -> DataFrame:
    """(head, chunk, seq) of all records of the files: `width` letters each and the first `reach` (at most width) of the next."""
    if reach > width:
        raise ValueError("chunks reach into the next one only")
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, letters = [], 0
            for row in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                for chunk in _chunks(*row, size, width, reach):
                    held.append(chunk)
                    letters += len(chunk[2])
                    if letters > size or len(held) >= 10_000:
                        yield batch(held)
                        held, letters = [], 0
            if held:
                yield batch(held)

    def batch(held: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held]), pa.array([h[1] for h in held], pa.int32()), pa.array([h[2].decode("latin-1") for h in held])], ["head", "chunk", "seq"])

    dealt = index(ranges(spark, path, size), size).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file", "part")  # the sums had a file in one place
    return dealt.mapInArrow(run, "head string, chunk int, seq string")
