"""Resampling towards a target distribution by hashed n-gram importance weights.

1. Features are a text's runs of 1 to `most` words, each in the bucket that its bytes' CRC-32 gives. Buckets are counted
   over all source and all target texts; a bucket's gain is the scaled log of its target share over its source share.
2. Long texts are cut at word boundaries into overlapping chunks: a chunk owns the features that start in it and carries
   the most - 1 words that follow, so none is lost or counted twice. Chunks are dealt over all tasks, so a text of any length is no hot
   task; counts and gains of chunks are summed by document.
3. A document's weight is the floored mean of its gains; Gumbel noise from a digest of its doc_id is added, and the highest
   scores are drawn, which samples without replacement by exp(weight / SCALE). Ranks come from range partitions.

CRC-32 is linear: the CRC of a run of words follows from those of its words by a table for each length, so runs are
hashed by array operations without being built. Only bucket counts (`buckets` numbers for each task) and the gains
(as many) leave the tasks.

Defined cases: null text has no words; a text without words has weight 0; a null doc_id has noise from an empty one, comes
last among ties and is drawn like others; rows that share a doc_id are documents each, ties between them go to fewer
features; empty source or target counts as zeros; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorloom.llm import common
from anchorloom.llm.ranks import ranked

BUCKETS, MOST, SHARE, SEED, LEAST, SCALE = 10_000, 2, 25, 7, 20, 1000
#: Bytes that a chunk owns at least; texts up to that are one chunk.
CHUNK = 1 << 16
#: On UTF-8 bytes of lowered text: what is neither an ASCII digit, an ASCII letter nor beyond ASCII ends a word.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Word lengths with a table of their own, and words remembered.
LENGTHS, MEMORY = 64, 400_000


def _shifts() -> np.ndarray:
    """[length, byte, value]: what `length` zero bytes appended make of the CRC register's bytes."""
    bits = np.array([1 << k for k in range(32)], np.uint32)
    out = np.zeros((LENGTHS + 1, 4, 256), np.uint32)
    for length in range(LENGTHS + 1):
        for byte in range(4):
            for k in range(8):
                half = np.arange(256) >> k & 1 == 1
                out[length, byte, half] ^= bits[8 * byte + k]
        for _ in range(8):
            bits = np.where(bits & 1, bits >> 1 ^ np.uint32(0xEDB88320), bits >> 1)
    return out


class Hasher:
    """Buckets of all runs of words of texts."""

    def __init__(self, buckets: int, most: int):
        self.buckets, self.most, self.shifts = buckets, most, _shifts()
        self._clear()

    def _clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.word, self.crc, self.spaced = [], array("I"), array("I")

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self.number) > MEMORY:
            self._clear()
        for w in set(words).difference(self.number):
            self.number[w] = len(self.word)
            self.word.append(w)
            self.crc.append(zlib.crc32(w))
            self.spaced.append(zlib.crc32(b" " + w))
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def runs(self, texts: list[tuple[bytes, int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each length of runs, (text, bucket) of those that start in the first `own` bytes of a text; with own words first.

        Yields (words owned by each text) at the first length only."""
        split, own = [], []
        for data, first in texts:
            ws = WORD.findall(data[:first])
            own.append(len(ws))
            if first < len(data):
                ws += WORD.findall(data[first:])
            split.append(ws)
        sizes = np.array([len(w) for w in split], np.int64)
        owned = np.array(own, np.int64)
        at = self._numbers([w for ws in split for w in ws])
        lengths = np.array([len(w) for w in self.word], np.int64)[at] + 1
        crc, spaced = np.array(self.crc, np.uint32)[at], np.array(self.spaced, np.uint32)[at]
        text = np.repeat(np.arange(len(split)), sizes)
        place = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        left, starts = np.repeat(sizes, sizes) - place, place < np.repeat(owned, sizes)
        current = crc
        for k in range(1, self.most + 1):
            if k > 1:
                n = max(0, len(at) - k + 1)
                before, last = current[:n], slice(k - 1, k - 1 + n)
                size = np.minimum(lengths[last], LENGTHS)
                current = spaced[last].copy()
                for byte in range(4):
                    current ^= self.shifts[size, byte, before >> np.uint32(8 * byte) & np.uint32(255)]
                for i in np.flatnonzero(lengths[last] > LENGTHS).tolist():
                    current[i] = zlib.crc32(b" " + self.word[at[i + k - 1]], int(before[i]))
            n = len(current)
            kept = starts[:n] & (left[:n] >= k)
            yield text[:n][kept], (current[kept] % np.uint32(self.buckets)).astype(np.int64), owned


def _lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def chunks(data: bytes, most: int, size: int = CHUNK) -> Iterator[tuple[bytes, int]]:
    """(bytes, how many of them are its own) of each chunk of a lowered text."""
    a = 0
    while a < len(data):
        b = min(len(data), a + size)
        if b < len(data) and (rest := WORD.match(data, b)) and WORD.match(data, b - 1):
            b = rest.end()
        end = b
        for _ in range(most - 1):
            if m := WORD.search(data, end):
                end = m.end()
        yield data[a:end], b - a
        a = b


def _pieces(docs: DataFrame, most: int, size: int) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, text, own) of short texts as they lie, and of long texts' chunks, dealt over all tasks."""
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [_lowered(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary()), pa.array([len(t) for t in made], pa.int64())], ["row", "doc_id", "text", "own"])

    def long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, doc, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                for k, (data, own) in enumerate(chunks(_lowered(text), most, size)):
                    yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([doc], pa.int64()), pa.array([data], pa.binary()), pa.array([own], pa.int64()), pa.array([k])], ["row", "doc_id", "text", "own", "chunk"])

    schema, is_long = "row long, doc_id long, text binary, own long", F.octet_length("text") > size
    cut = slim.where(is_long).mapInArrow(long, schema + ", chunk long").repartition(common.parts(docs.sparkSession), "row", "chunk").drop("chunk")
    return slim.where(~is_long).mapInArrow(short, schema), cut


def _blocks(b: pa.RecordBatch) -> Iterator[tuple[int, list[tuple[bytes, int]]]]:
    for at in range(0, b.num_rows, 250):
        part = b.slice(at, 250)
        yield at, list(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True))


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, most: int = MOST, size: int = CHUNK) -> np.ndarray:
    """How many features of all texts each bucket has."""
    common.ship(docs.sparkSession)
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = Hasher(buckets, most), np.zeros(buckets, np.int64)
        for b in batches:
            for _, texts in _blocks(b):
                for _, bucket, _ in hasher.runs(texts):
                    total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "many"])

    short, long = _pieces(docs, most, size)
    found = short.unionByName(long).mapInArrow(run, "bucket long, many long").groupBy("bucket").agg(F.sum("many").alias("many")).collect()
    out = np.zeros(buckets, np.int64)  # a number for each bucket
    for r in found:
        out[r.bucket] = r.many
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(SCALE ln(target share / source share)) of each bucket, one added to each count."""
    n, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(SCALE * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, most: int = MOST, size: int = CHUNK) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row of docs."""
    common.ship(docs.sparkSession)
    common.small_batches(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast(gain)  # a number for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(len(table.value), most)
        for b in batches:
            n, features, total = b.num_rows, np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            words = np.zeros(n, np.int64)
            for at, texts in _blocks(b):
                for text, bucket, owned in hasher.runs(texts):
                    ends = np.searchsorted(text, np.arange(len(texts) + 1))
                    sums = np.concatenate([[0], np.cumsum(table.value[bucket])])
                    features[at : at + len(texts)] += np.diff(ends)
                    total[at : at + len(texts)] += np.diff(sums[ends])
                    words[at : at + len(texts)] = owned
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(words), pa.array(features), pa.array(total)], ["row", "doc_id", "n_words", "n_features", "total"])

    schema = "row long, doc_id long, n_words long, n_features long, total long"
    short, long = _pieces(docs, most, size)
    sums = long.mapInArrow(run, schema).groupBy("row", "doc_id").agg(*[F.sum(c).alias(c) for c in ("n_words", "n_features", "total")])
    made = short.mapInArrow(run, schema).unionByName(sums)
    mean = F.expr("case when n_features > 0 then (total - pmod(total, n_features)) div n_features else 0L end")
    return made.select("doc_id", "n_words", "n_features", mean.alias("weight"))


def noise(seed: int = SEED) -> Column:
    """SCALE times Gumbel noise from a digest of doc_id, floored."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, seed: int = SEED, least: int = LEAST, buckets: int = BUCKETS, most: int = MOST, size: int = CHUNK) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of each row of docs; rank is null where not drawn.

    share percent of the documents with at least `least` words are drawn. size: bytes of a chunk; results do not depend on it."""
    gain = gains(bucket_counts(docs, buckets, most, size), bucket_counts(target.withColumn("doc_id", F.lit(None)), buckets, most, size))
    made = weighed(docs, gain, most, size).withColumn("score", F.col("weight") + noise(seed)).withColumn("spread", F.monotonically_increasing_id())
    scored = common.written(made)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "spread"]
    placed = ranked(scored.where(f"n_words >= {least}"), [], order)
    drawn = F.col("_rank") < F.floor(F.col("_size") * share / 100)
    out = placed.withColumn("rank", F.when(drawn, F.col("_rank") + 1)).drop("_rank", "_size")
    return out.unionByName(scored.where(f"n_words < {least}").withColumn("rank", F.lit(None).cast("long"))).drop("spread")
