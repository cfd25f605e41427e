"""Token-ID / binary output: flat files of unsigned ids plus 64-bit document offsets, memory-mapped on reading.

Format, for each part in ascending document order: `part-N.ids` (ids, little-endian, 2 bytes if the vocabulary allows,
else 4), `part-N.doc` (int64 doc_id), `part-N.off` (uint64, one more than documents: ids before each document over the
whole corpus). A part's base is the prefix sum of the parts before it, so no task needs another's ids.

Defined cases: null text is an empty document (its end id alone); null doc_id sorts first and reads back as null;
rows that share a doc_id are separate documents in order of text; an empty table gives an empty result; extra columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorloom.llm import common
from anchorloom.llm.tokens import END, encoder, tokenizer_path

NO_ID = -(1 << 63)


def write(docs: DataFrame, to: str, tokenizer: str | None = None, end: int = END) -> list[tuple[int, int, int, int, str]]:
    """Write docs (doc_id, text) to the folder; (part, documents, ids, base, dtype) of each part, one row for each task."""
    spark, path = docs.sparkSession, tokenizer or tokenizer_path()
    common.ship(spark)
    common.small_batches(spark)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = ordered.repartitionByRange(common.parts(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc, n, total, files = TaskContext.get().partitionId(), encoder(path), 0, 0, None
        for b in batches:
            if not b.num_rows:
                continue
            files = files or {k: common.SharedFile(f"{to}/part-{part:06d}.{k}") for k in ("ids", "doc", "len")}
            ids = enc.encode(b.column(1), end)
            lengths = np.array([len(x) for x in ids], "<u8")
            files["ids"].write(b"".join(x.tobytes() for x in ids))
            files["doc"].write(np.array([NO_ID if d is None else d for d in b.column(0).to_pylist()], "<i8").tobytes())
            files["len"].write(lengths.tobytes())
            n, total = n + len(ids), total + int(lengths.sum())
        if files:
            for f in files.values():
                f.done()
            yield pa.RecordBatch.from_pylist([{"part": part, "documents": n, "ids": total, "dtype": enc.dtype}])

    found = sorted(ordered.mapInArrow(run, "part long, documents long, ids long, dtype string").collect())
    base, out = 0, []
    for part, n, ids, dtype in found:
        out.append((part, n, ids, base, dtype))
        base += ids
    return out


def read(spark: SparkSession, at: str, index: list[tuple[int, int, int, int, str]], size: int = 1 << 20) -> DataFrame:
    """(doc_id, start, ids as little-endian uint32) of every document in the files. Writes each part's offsets first."""
    common.ship(spark)
    schema = "part long, documents long, ids long, base long, dtype string"
    n = max(1, len(index))
    rows = spark.createDataFrame(index, schema).repartitionByRange(n, "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            stem = f"{at}/part-{row['part']:06d}"
            lengths = common.mapped(f"{stem}.len", "<u8")
            off = common.SharedFile(f"{stem}.off")
            starts = np.concatenate([np.zeros(1, "<u8"), np.cumsum(lengths, dtype="<u8")]) + np.uint64(row["base"])
            off.write(starts.astype("<u8").tobytes())
            off.done()
            offsets, doc, ids = common.mapped(f"{stem}.off", "<u8"), common.mapped(f"{stem}.doc", "<i8"), common.mapped(f"{stem}.ids", row["dtype"])
            a = 0
            while a < len(doc):
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + np.uint64(size), "right")) - 1)
                cut = offsets[a : b + 1].astype(np.int64)
                block = np.asarray(ids[cut[0] - row["base"] : cut[-1] - row["base"]]).astype("<u4").tobytes()
                ends = 4 * (cut - cut[0])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([None if d == NO_ID else d for d in doc[a:b].tolist()], pa.int64()),
                        pa.array(cut[:-1], pa.int64()),
                        pa.array([block[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.binary()),
                    ],
                    ["doc_id", "start", "ids"],
                )
                a = b

    return rows.mapInArrow(run, "doc_id long, start long, ids binary")

