"""Packing by lexical retrieval: related documents share a training window.

1. Texts are encoded once and written. Whole windows of long documents are windows by themselves; the rest, the tails, are
   packed. How many tails hold each token id is summed over all of them.
2. Each tail's SIGNATURE terms of greatest BM25 weight (with the corpus's counts) name its place: tails are range-partitioned
   and sorted by them, so those that share rare terms lie together wherever they came from. The row's number ends the key,
   so a third of all rows with one signature is still spread over partitions.
3. A task walks along its range with GROUP tails at hand in a sharded BM25 index (SHARD_DOCUMENTS tails a shard; counts are
   the corpus's). The longest free tail is a seed; every shard returns its unused neighbours, which fill the seed's window
   greedily, nearest first; the last one is cut to fit and its rest stays free. What is left free when a window cannot be
   filled joins the next GROUP, so every window is full but the last of a task.

A seed's neighbours come from its own stretch of the order, not from the whole corpus: asking the whole corpus takes time
with the square of its size. Every id lies in exactly one piece; the driver holds counts by token id only.

Defined cases: null text is an empty document (its end id alone); null doc_id is packed and read back as null; repeated
rows are packed as often as they occur; ties in score go to the longer tail, then the earlier one; an empty table gives
an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorloom.llm import common
from anchorloom.llm.tokens import END, encoder, tokenizer_path

#: SHARD_DOCUMENTS bounds a shard of the index; results do not depend on it.
WINDOW, GROUP, SHARD_DOCUMENTS, SIGNATURE = 2048, 512, 4096, 3
K1, B = 1.2, 0.75
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
NAMED = "part int, signature long, number long, doc_id long, tail binary, width int, tokens long"
#: Documents whose terms are sorted at a time.
BLOCK = 256
#: Keys sampled for the bounds of ranges.
BOUNDS = 50_000
COLUMNS = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
#: Corpus statistics: number of documents, their mean length, and documents that hold each term.
Corpus = tuple[int, float, np.ndarray]


def idf(corpus: Corpus) -> np.ndarray:
    """Of each term; none for terms that half of all documents hold, which part nothing."""
    total, _, df = corpus
    return np.maximum(np.log((total - df + 0.5) / (df + 0.5)), 0)


def saturated(counts: np.ndarray, length: np.ndarray | float, mean: float) -> np.ndarray:
    """What BM25 makes of the times that a term occurs in a document of this length."""
    return counts * (K1 + 1) / (counts + K1 * (1 - B + B * length / mean))


def distinct(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, times) of the terms of each document, in that order, from one sort for all of them."""
    if not docs or not (ids := np.concatenate(docs)).size:
        return (np.zeros(0, np.int64),) * 3
    bits = int(ids.max()).bit_length()
    kind = np.uint32 if bits + len(docs).bit_length() <= 32 else np.uint64
    key = np.repeat(np.arange(len(docs), dtype=kind) << kind(bits), [len(d) for d in docs]) | ids.astype(kind)
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    held = key[first]
    return (held >> kind(bits)).astype(np.int64), (held & kind((1 << bits) - 1)).astype(np.int64), np.diff(first, append=len(key))


class Bm25:
    """One shard of the inverted index over token ids: for each term the documents that hold it and their weights."""

    def __init__(self, docs: list[np.ndarray], corpus: Corpus | None = None, rare: np.ndarray | None = None):
        """rare: idf() of the corpus, if at hand."""
        self.n = len(docs)
        lengths = np.array([max(1, len(d)) for d in docs], float)
        doc, term, count = distinct(docs)
        if corpus is None:
            corpus = (self.n, float(lengths.mean()), np.bincount(term))
        rare = idf(corpus) if rare is None else rare
        kept = rare[term] > 0
        doc, term, count = doc[kept], term[kept], count[kept].astype(float)
        self.terms = np.split(term, np.searchsorted(doc, np.arange(1, self.n)))
        order = np.argsort(term, kind="stable")
        self.vocabulary, self.first, self.df = np.unique(term[order], return_index=True, return_counts=True)
        self.doc = doc[order]
        self.weight = saturated(count[order], lengths[self.doc], corpus[1]) * rare[term[order]]

    def scores(self, query: int | np.ndarray) -> np.ndarray:
        """Of all documents of the shard, for one of them or for distinct terms."""
        terms = self.terms[query] if isinstance(query, int) else query
        if not len(self.vocabulary) or not len(terms):
            return np.zeros(self.n)
        at = np.minimum(np.searchsorted(self.vocabulary, terms), len(self.vocabulary) - 1)
        at = at[self.vocabulary[at] == terms]
        df, first = self.df[at], self.first[at]
        ends = np.cumsum(df)
        posting = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - df), df)
        return np.bincount(self.doc[posting], self.weight[posting], self.n)


def fill(tails: list[np.ndarray], window: int = WINDOW, corpus: Corpus | None = None, last: bool = True, shard_documents: int = SHARD_DOCUMENTS) -> tuple[list[list[tuple[int, int, int]]], np.ndarray]:
    """Windows as lists of (tail, start, length), and each tail's tokens used. Unless last, only full windows are made."""
    rare = None if corpus is None else idf(corpus)
    shards = [Bm25(tails[a : a + shard_documents], corpus, rare) for a in range(0, len(tails), shard_documents)]
    used, left, out = np.zeros(len(tails), np.int64), np.array([len(t) for t in tails]), []
    rank, total = np.arange(len(tails)), int(left.sum())
    while total and (last or total >= window):
        seed = int(np.argmax(left))
        terms = shards[seed // shard_documents].terms[seed % shard_documents]
        score = np.concatenate([s.scores(terms) for s in shards])
        score[seed] = np.inf
        free, made, room = np.flatnonzero(left > 0), [], window
        for t in free[np.lexsort((rank[free], -left[free], -score[free]))].tolist():
            take = int(min(left[t], room))
            made.append((t, int(used[t]), take))
            used[t] += take
            left[t] -= take
            room -= take
            if not room:
                break
        total -= window - room
        out.append(made)
    return out, used


def pack_shard(docs: list[np.ndarray], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, window number, offset) of each piece of documents that one task holds."""
    whole = [len(d) // window * window for d in docs]
    out = [(d, k, window) for d, n in enumerate(whole) for k in range(0, n, window)]
    windows: list[list[tuple[int, int, int]]] = [[x] for x in out]
    rest = [d for d, n in enumerate(whole) if len(docs[d]) > n]
    if rest:
        windows += [[(rest[t], whole[rest[t]] + a, n) for t, a, n in w] for w in fill([docs[d][whole[d] :] for d in rest], window)[0]]
    return [(d, a, n, w, sum(x[2] for x in pieces[:i])) for w, pieces in enumerate(windows) for i, (d, a, n) in enumerate(pieces)]


def _rows(pieces: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*pieces, strict=True)) if pieces else [()] * len(COLUMNS)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(COLUMNS, columns, strict=True)], COLUMNS)


def _tail(raw: bytes, width: int, window: int) -> np.ndarray:
    ids = np.frombuffer(raw, f"<u{width}")
    return ids[len(ids) // window * window :]


def _encoded(docs: DataFrame, path: str, end: int, window: int) -> DataFrame:
    """(number, doc_id, ids, width, tokens), and a row for each task with df: how many of its tails hold each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        names = ["number", "doc_id", "ids", "width", "tokens", "df"]
        enc, number, df = encoder(path), TaskContext.get().partitionId() << 40, np.zeros(0, np.int64)
        for b in batches:
            ids = enc.encode(b.column(1), end)
            n = len(ids)
            if not len(df):
                df = np.zeros(len(enc.ends), np.int64)
            tails = [x[len(x) // window * window :] for x in ids]
            for k in range(0, n, BLOCK):
                df += np.bincount(distinct(tails[k : k + BLOCK])[1], minlength=len(df))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(number, number + n)), b.column(0), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([np.dtype(enc.dtype).itemsize] * n, pa.int32()), pa.array([len(x) for x in ids], pa.int64()), pa.nulls(n, pa.binary())], names)
            number += n
        if len(df):
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())), pa.array([df.astype("<i8").tobytes()], pa.binary())], names)

    return docs.mapInArrow(run, "number long, doc_id long, ids binary, width int, tokens long, df binary")


def _document_counts(made: DataFrame) -> np.ndarray:
    """df of each token id: as many numbers as the tokenizer has tokens, summed by task and then by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for raw in b.column(0).to_pylist():
                one = np.frombuffer(raw, "<i8")
                total = one.copy() if not len(total) else total + one
        term = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(total[term])], ["term", "df"])

    known = made.where("df is not null").select("df").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    term = known.column("term").to_numpy()
    out = np.zeros(int(term.max(initial=0)) + 1, np.int64)
    out[term] = known.column("df").to_numpy()
    return out


def signatures(tails: list[np.ndarray], mean: float, rare: np.ndarray, terms: int = SIGNATURE) -> np.ndarray:
    """Of each tail the terms of greatest weight, 20 bits each, greatest first. rare: idf of terms that other tails hold too, else 0."""
    doc, term, counts = distinct(tails)
    w, out = saturated(counts, np.array([len(t) for t in tails], float)[doc], mean) * rare[term], np.zeros(len(tails), np.int64)
    first = np.searchsorted(doc, np.arange(len(tails)))  # no tail is empty
    for _ in range(terms):
        most = np.maximum.reduceat(w, first)
        at = np.flatnonzero(w == most[doc])
        at = at[np.searchsorted(at, first)]  # the least of equal ones
        out = out << 20 | np.where(most > 0, term[at], 0)
        w[at] = 0
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, end: int = END, window: int = WINDOW, group: int = GROUP, shard_documents: int = SHARD_DOCUMENTS) -> DataFrame:
    """Pieces of docs (doc_id, text): SCHEMA, ids as little-endian uint32."""
    spark, path = docs.sparkSession, tokenizer or tokenizer_path()
    common.ship(spark)
    common.small_batches(spark)
    made = common.written(_encoded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), path, end, window))
    table = made.where("number is not null").select("number", "doc_id", "ids", "width", "tokens")
    bounds = np.zeros((0, 2), np.int64)
    n, total = table.where(f"tokens % {window} > 0").agg(F.count("*"), F.sum(F.col("tokens") % window)).first()
    corpus = spark.sparkContext.broadcast((n, (total or 0) / max(1, n), _document_counts(made)))  # one number for each token id

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # Numbers of windows: the task's, then the window's in it; those of tails are negative.
        sequence = TaskContext.get().partitionId() << 40
        for b in batches:
            for d, raw, w, tokens in zip(*(b.column(k).to_pylist() for k in range(1, 5)), strict=True):
                ids, many = np.frombuffer(raw, f"<u{w}").astype("<u4"), tokens // window
                for at in range(0, many, 512):
                    yield _rows([(d, k * window, window, tokens, sequence + k, 0, ids[k * window : (k + 1) * window].tobytes()) for k in range(at, min(at + 512, many))])
                sequence += many

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, shared = corpus.value[1], np.where(corpus.value[2] > 1, idf(corpus.value), 0)
        for b in batches:
            tails = [_tail(raw, w, window) for raw, w in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            sign = np.concatenate([signatures(tails[k : k + BLOCK], mean, shared) for k in range(0, max(1, len(tails)), BLOCK)])
            number = b.column(0).to_numpy()
            low, high = np.searchsorted(bounds[:, 0], sign), np.searchsorted(bounds[:, 0], sign, "right")
            part = [a if a == z else a + int(np.searchsorted(bounds[a:z, 1], k, "right")) for a, z, k in zip(low.tolist(), high.tolist(), number.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(sign), b.column(0), b.column(1), pa.array([t.tobytes() for t in tails], pa.binary()), b.column(3), b.column(4)],
                ["part", "signature", "number", "doc_id", "tail", "width", "tokens"],
            )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence, rows = -1 - (TaskContext.get().partitionId() << 32), []

        def windows(rows: list[tuple], last: bool) -> tuple[list[tuple], list[tuple]]:
            """Pieces of the windows made, and what stays free. rows: (doc_id, tokens, start, ids)."""
            nonlocal sequence
            found, used = fill([r[3] for r in rows], window, corpus.value, last, shard_documents)
            out = []
            for w in found:
                offset = 0
                for t, a, n in w:
                    d, tokens, start, ids = rows[t]
                    out.append((d, start + a, n, tokens, sequence, offset, ids[a : a + n].astype("<u4").tobytes()))
                    offset += n
                sequence -= 1
            return out, [(d, tokens, start + u, ids[u:]) for (d, tokens, start, ids), u in zip(rows, used.tolist(), strict=True) if u < len(ids)]

        for b in batches:
            for d, raw, w, tokens in zip(*(b.column(k).to_pylist() for k in range(3, 7)), strict=True):
                ids = np.frombuffer(raw, f"<u{w}")
                rows.append((d, tokens, tokens - len(ids), ids))
                if len(rows) >= group:
                    out, rows = windows(rows, False)
                    yield _rows(out)
        if rows:
            yield _rows(windows(rows, True)[0])

    tails = table.where(f"tokens % {window} > 0")
    parts = max(1, min(common.parts(spark), n // group))
    # Bounds of the ranges come from a bounded sample: at most about BOUNDS keys reach the driver.
    some = tails.where(F.pmod(F.xxhash64("number"), F.lit(max(1, n // BOUNDS))) == 0) if parts > 1 else tails.limit(0)
    keys = sorted((r.signature, r.number) for r in some.mapInArrow(named, NAMED).select("signature", "number").collect())
    bounds = np.array([keys[k * len(keys) // parts] for k in range(1, parts)] if keys else [], np.int64).reshape(-1, 2)
    dealt = tails.mapInArrow(named, NAMED).repartitionById(parts, "part").sortWithinPartitions("signature", "number")
    long = table.where(f"tokens >= {window}").mapInArrow(whole, SCHEMA)
    return long.unionByName(dealt.mapInArrow(packed, SCHEMA))
