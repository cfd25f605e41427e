"""LM scoring: an interpolated modified Kneser-Ney bigram model, counted in Spark and looked up in sorted arrays.

Training counts words, then word pairs as (number << 32 | number), in Spark; each is range-partitioned, sorted and
written to flat files in the shared folder, which scoring workers memory-map. A pair's continuation counts and a
context's numbers of followers seen once, twice and more often are gathered as the sorted pairs are written. The driver
holds the parts' first keys, the discounts, and the pairs that occur MOST times or more, whose counts do not fit into the
files' 32 bits: at most one for MOST tokens. Words are numbered in 31 bits; training on more distinct ones fails.

A text is its words in lower case (A-Z) and one end, which also serves as the context of the first word. Three discounts
come from counts of counts; the lowest order is interpolated with a uniform distribution over the words known and one
unknown, so every text has a finite score and probabilities add up to one.

Defined cases: null text is an empty text (its end alone); rows with null doc_id are trained on; repeated rows are
counted as often as they occur; without training rows every token has probability 1 / (0 + 1); an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorloom.llm import common, sorted_files

WORDS, PAIRS = {"word": "<i8", "n": "<u8"}, {"pair": "<i8", "n": "<u4"}
STATS = {"id": "<i8", "before": "<u4", "once": "<u4", "twice": "<u4", "more": "<u4"}
#: Counts of pairs in the files stop here.
MOST = (1 << 32) - 1
#: White space is in no word.
END = b"\n"


@dataclass
class Model:
    words: sorted_files.Index
    pairs: sorted_files.Index
    stats: sorted_files.Index
    tokens: int
    discounts: tuple[float, float, float]
    low_discounts: tuple[float, float, float]
    low_rest: float
    #: Pairs in order and their counts, where these are MOST or more.
    frequent: tuple[list[int], list[int]] = ((), ())

    @property
    def vocabulary(self) -> int:
        return sum(n for _, _, n in self.words)

    @property
    def types(self) -> int:
        return sum(n for _, _, n in self.pairs)


def held_out(doc_id: str = "doc_id", modulus: int = 7, rest: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == rest, F.lit(False))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """For counts of 1, 2 and more, from how many have a count of 1 to 4; where too few are known, one half of each."""
    if not all((n1, n2, n3)):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.0), float(k)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def _tokens(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[pa.RecordBatch, list[int], np.ndarray]]:
    """Blocks of rows: each text's number of tokens, and all tokens' hashes, ends included."""
    hashes = common.WordHashes()
    for b in batches:
        for at in range(0, b.num_rows, 500):
            block = b.slice(at, 500)
            split = [[*common.words(t, lower=True), END] for t in block.column(column).to_pylist()]
            yield block, list(map(len, split)), hashes.of([w for ws in split for w in ws]).astype(np.int64)


def _pairs(ids: np.ndarray, lengths: list[int], end: int) -> np.ndarray:
    """(context << 32 | word) of every token."""
    context = np.concatenate([[end], ids[:-1]])
    context[np.cumsum([0, *lengths[:-1]])] = end
    return context << 32 | ids


def train(docs: DataFrame, most: int = MOST) -> Model:
    """Learn from the texts of docs (text). Counts of pairs from `most` on are kept apart."""
    spark = docs.sparkSession
    common.ship(spark)
    common.small_batches(spark)
    docs = docs.select(F.col("text").cast("string").alias("text"))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for value, many in sorted_files.summed(h for _, _, h in _tokens(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(many)], ["word", "n"])

    counted = docs.mapInArrow(count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = common.scratch(spark)
    words = sorted_files.write(counted, total, WORDS)
    if sum(n for _, _, n in words) >= 1 << 31:
        raise ValueError("2^31 distinct words or more")
    common.free_shuffles(spark)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sorted_files.lookup(words, WORDS)
        end = int(known.find(np.array([common.WordHashes()[END]], np.uint64).astype(np.int64))[1]["row"][0])
        pairs = (_pairs(known.find(h)[1]["row"], lengths, end) for _, lengths, h in _tokens(batches))
        for value, many in sorted_files.summed(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(many)], ["pair", "n"])

    paired = docs.mapInArrow(count_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    ordered = paired.repartitionByRange(common.parts(spark), "pair").sortWithinPartitions("pair")
    to = common.scratch(spark)

    def write_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of kind p (the part; first, rows and counts of counts), c (context: followers), w (word: contexts) and f (frequent pair: count)."""
        from pyspark import TaskContext

        stem, files, first, rows, classes = f"{to}/part-{TaskContext.get().partitionId():06d}", None, 0, 0, np.zeros(4, np.int64)
        seen: list[np.ndarray] = []

        def gathered() -> Iterator[pa.RecordBatch]:
            word, many = np.unique(np.concatenate(seen), return_counts=True)
            none = np.zeros(len(word), np.int64)
            yield row("w", word, many, none, none, none)

        def row(kind: str, *columns: np.ndarray) -> pa.RecordBatch:
            n = len(columns[0])
            return pa.RecordBatch.from_arrays([pa.array([kind] * n), pa.array([stem] * n if kind == "p" else [None] * n, pa.string()), *(pa.array(np.asarray(c, np.int64)) for c in columns)], ["kind", "stem", "id", "a", "b", "c", "d"])

        for b in batches:
            if not b.num_rows:
                continue
            pair, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            if files is None:
                files, first = {k: common.SharedFile(f"{stem}.{k}") for k in PAIRS}, int(pair[0])
            files["pair"].write(pair.astype("<i8").tobytes())
            files["n"].write(np.minimum(n, most).astype("<u4").tobytes())
            high = n >= most
            if high.any():
                none = np.zeros(int(high.sum()))
                yield row("f", pair[high], n[high], none, none, none)
            rows += len(pair)
            classes += np.bincount(n[n <= 4], minlength=5)[1:]
            context = pair >> 32
            start = np.concatenate([[0], np.flatnonzero(np.diff(context)) + 1])
            each = [np.add.reduceat(x.astype(np.int64), start) for x in (n == 1, n == 2, n > 2)]
            yield row("c", context[start], np.zeros(len(start)), *each)
            seen.append(pair & 0xFFFFFFFF)
            if sum(map(len, seen)) >= 2_000_000:
                yield from gathered()
                seen = []
        if seen:
            yield from gathered()
        if files:
            for f in files.values():
                f.done()
            yield pa.RecordBatch.from_arrays([pa.array(["p"]), pa.array([f"{stem}|{rows}"]), *(pa.array([int(x)]) for x in (first, *classes))], ["kind", "stem", "id", "a", "b", "c", "d"])

    side = common.written(ordered.mapInArrow(write_pairs, "kind string, stem string, id long, a long, b long, c long, d long"))
    common.free_shuffles(spark)
    made = sorted(side.where("kind = 'p'").collect(), key=lambda r: r.stem)
    pairs = [(r.stem.rpartition("|")[0], r.id, int(r.stem.rpartition("|")[2])) for r in made]
    summed = side.where("kind in ('c', 'w')").groupBy("id").agg(*[F.sum(a).alias(b) for a, b in zip("abcd", list(STATS)[1:], strict=True)])
    stats = common.written(summed)
    index = sorted_files.write(stats, common.scratch(spark), STATS)
    low = stats.agg(*[F.count_if(F.col("before") == k) for k in (1, 2, 3, 4)], F.count_if(F.col("before") > 2)).first()
    frequent = tuple(map(list, zip(*sorted((r.id, r.a) for r in side.where("kind = 'f'").select("id", "a").collect()), strict=True))) or ((), ())
    tokens = sum_of(spark, words)
    common.forget(side, stats)
    low_d = discounts(*(low[k] for k in range(4)))
    types = sum(n for _, _, n in pairs)
    rest = (low_d[0] * low[0] + low_d[1] * low[1] + low_d[2] * low[4]) / types if types else 1.0
    return Model(words, pairs, index, tokens, discounts(*(sum(r[k] for r in made) for k in "abcd")), low_d, rest, frequent)


def sum_of(spark, index: sorted_files.Index) -> int:
    """All counts of the words' files, part by part."""
    if not index:
        return 0
    rows = spark.createDataFrame(index, "stem string, first long, n long").repartition(len(index))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pylist([{"n": int(common.mapped(f"{s}.n", WORDS["n"]).sum())} for s in b.column(0).to_pylist()])

    return rows.mapInArrow(run, "n long").agg(F.sum("n")).first()[0]


def probabilities(model: Model, lengths: list[int], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each token under the model, and its count in training."""
    known, n = sorted_files.lookup(model.words, WORDS).find(np.concatenate([hashes, np.array([common.WordHashes()[END]], np.uint64).astype(np.int64)]))
    ids, counts = np.where(known, n["row"], -1), n["n"].astype(np.int64)
    end, ids, counts, known = int(ids[-1]), ids[:-1], counts[:-1], known[:-1]
    starts = np.cumsum([0, *lengths[:-1]])
    context = np.concatenate([[end], ids[:-1]])
    context[starts] = end
    context_count = np.concatenate([[0], counts[:-1]])
    context_count[starts] = n["n"][-1]
    both = known & (context >= 0)
    pair = np.zeros(len(ids), np.int64)
    pair[both] = sorted_files.lookup(model.pairs, PAIRS).find(context[both] << 32 | ids[both])[1]["n"]
    if len(model.frequent[0]):
        key, many = (np.array(x, np.int64) for x in model.frequent)
        asked = context << 32 | ids
        at = np.minimum(np.searchsorted(key, asked), len(key) - 1)
        pair = np.where(both & (key[at] == asked), many[at], pair)
    of = sorted_files.lookup(model.stats, STATS)
    before = np.where(known, of.find(ids)[1]["before"], 0).astype(float)
    followers = of.find(context)[1]

    def less(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
        return np.maximum(c - np.select([c == 0, c == 1, c == 2], [0.0, d[0], d[1]], d[2]), 0)

    low = less(before, model.low_discounts) / max(model.types, 1) + model.low_rest / (model.vocabulary + 1)
    total = np.maximum(context_count, 1)
    free = sum(d * followers[k] for d, k in zip(model.discounts, ("once", "twice", "more"), strict=True)) / total
    seen = (context_count > 0) & (context >= 0)
    return np.where(seen, less(pair.astype(float), model.discounts) / total + free * low, low), counts


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of each row of docs: log10 of add-one and of the model's probability."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, lengths, hashes in _tokens(batches, 1):
            p, counts = probabilities(model, lengths, hashes)
            starts = np.cumsum([0, *lengths[:-1]])
            base = np.log10((counts + 1) / (model.tokens + model.vocabulary + 1))
            columns = [pa.array(lengths, pa.int64()), pa.array(np.add.reduceat((counts > 0).astype(np.int64), starts)), *(pa.array(np.add.reduceat(x, starts)) for x in (base, np.log10(p)))]
            yield pa.RecordBatch.from_arrays([block.column(0), *columns], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
