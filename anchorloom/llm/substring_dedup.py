"""Substring dedup: words in any passage of 20 or more words that also starts earlier in the corpus are removed.

No tree is built: of prefix-partitioned suffix trees only the nodes at depth 20 matter here, and they are found by grouping
fingerprints of 20-word windows:
1. Anchors. Of each 20-word window's eight-word grams the one of least hash is its anchor; equal windows have equal
   anchors, and about one gram in seven is one. Windows can only repeat where the anchor occurs twice, so others are never
   shuffled. Anchor counts are summed in Spark.
2. Nodes. A window that has a repeated anchor is a suffix's prefix; its key is a fingerprint of its first eight words
   followed by one of all twenty, and a second fingerprint of all twenty from other hashes, 64 bits more, tells apart windows
   that share a key. Windows of one key are a node; one with two windows is a repeat, and what is kept of it is its first
   window. Windows of a node combine before the shuffle, so a passage in a third of all documents sends one row from each
   batch. Nodes are range-partitioned by key into files.
3. Texts. Each window looks its node up in the memory-mapped nodes; where the first window starts earlier, its words go.
   Overlapping windows make up the maximal repeats. Texts are never shuffled.

Defined cases: null text has no words; texts under 20 words keep all; null doc_id counts as larger than any; rows that
share a doc_id count as the same document (of two equal passages at the same place neither starts earlier); kept words
keep their bytes; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorloom.llm import common, sorted_files

LAST = (1 << 63) - 1
#: Hashes whose places share a number with their upper bits; longer texts are taken in stretches of that many.
PLACES = 1 << 20
OTHER = 0x5851F42D4C957F2D
ANCHORS, NODES = {"anchor": "<i8"}, {"node": "<i8", "check": "<i8", "doc": "<i8", "at": "<i4"}


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of each `width` hashes in a row, the first of equal ones; at most PLACES hashes.

    The place in the low bits breaks ties to the left and comes out with the minimum."""
    a = (h & ~np.uint64(PLACES - 1)) | np.arange(len(h), dtype=np.uint64)
    n, step = len(h) - width + 1, 1
    while 2 * step <= width:
        a = np.minimum(a[:-step], a[step:])
        step *= 2
    if step < width:
        a = np.minimum(a[:n], a[width - step : width - step + n])
    return (a[:n] & np.uint64(PLACES - 1)).astype(np.int64)


class Windows:
    """A text's windows of `size` words and their anchors of `gram` words."""

    def __init__(self, hashes: np.ndarray, size: int, gram: int):
        self.n = max(0, len(hashes) - size + 1)
        self.hashes, self.size, self.gram = hashes, size, gram
        if not self.n:
            self.prefix = self.anchors = self.many = np.empty(0, np.int64)
            return
        h = common.grams(hashes, gram)
        self.prefix = h
        width, at = size - gram + 1, []
        for a in range(0, self.n, PLACES - width):
            part = h[a : min(a + PLACES - width, self.n) + width - 1]
            at.append(a + _least(part, width))
        at = np.concatenate(at)
        # Windows of one anchor follow each other: each anchor once, and how many windows it has.
        first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        self.anchors = h[at[first]].astype(np.int64)
        self.many = np.diff(np.concatenate([first, [self.n]]))

    def nodes(self, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the windows that start at these places: 24 bits of the prefix and 40 of the whole window, of which the
        first `bits` are kept, and a fingerprint of 64 more bits from other hashes of the words."""
        if not len(at):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        whole = common.grams(self.hashes, self.size)
        node = (self.prefix[: self.n] & ~np.uint64((1 << 40) - 1)) | (whole >> np.uint64(24))
        check = common.grams(common.mix(self.hashes ^ np.uint64(OTHER)), self.size)
        return (node[at] & ~np.uint64((1 << (64 - bits)) - 1)).astype(np.int64), check[at].astype(np.int64)


def _keys(found: list[Windows], at: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    made = [w.nodes(a, bits) for w, a in zip(found, at, strict=True)]
    return np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made])


def _batches(batches: Iterator[pa.RecordBatch], size: int, gram: int) -> Iterator[tuple[list, list[list[bytes]], list[Windows]]]:
    hashes = common.WordHashes()
    for b in batches:
        for at in range(0, b.num_rows, 500):
            block = b.slice(at, 500)
            split = [common.words(t) for t in block.column(1).to_pylist()]
            yield block.column(0).to_pylist(), split, [Windows(hashes.of(ws), size, gram) for ws in split]


def _flagged(found: list[Windows], index: sorted_files.Index) -> list[np.ndarray]:
    """For each text the starts of windows with a repeated anchor."""
    there, _ = sorted_files.lookup(index, ANCHORS).find(np.concatenate([w.anchors for w in found]))
    ends = np.cumsum([len(w.anchors) for w in found])
    return [np.flatnonzero(np.repeat(there[e - len(w.anchors) : e], w.many)) for w, e in zip(found, ends, strict=True)]


def remove(docs: DataFrame, size: int = 20, gram: int = 8, bits: int = 64) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of each row of docs: kept is the text that stays, words joined by spaces.

    bits of the nodes' keys are kept; with few, different windows share a key and only their checks part them."""
    spark = docs.sparkSession
    common.ship(spark)
    common.small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occurring = (np.concatenate([w.anchors for w in found]) for _, _, found in _batches(batches, size, gram))
        for value, many in sorted_files.summed(occurring):
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(many)], ["anchor", "many"])

    counts = docs.mapInArrow(anchors, "anchor long, many long").groupBy("anchor").agg(F.sum("many").alias("many"))
    index = sorted_files.write(counts.where("many > 1"), common.scratch(spark), ANCHORS)
    common.free_shuffles(spark)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, found in _batches(batches, size, gram):
            at = _flagged(found, index)
            node, check = _keys(found, at, bits)
            doc = np.repeat(np.array([LAST if d is None else d for d in ids], np.int64), [len(a) for a in at])
            place = np.concatenate(at).astype(np.int32)
            order = np.lexsort((place, doc, check, node))
            node, check, doc, place = node[order], check[order], doc[order], place[order]
            first = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (check[1:] != check[:-1])])[: len(node)])
            many = np.diff(np.append(first, len(node)))
            yield pa.RecordBatch.from_arrays([pa.array(node[first]), pa.array(check[first]), pa.array(doc[first]), pa.array(place[first]), pa.array(many, pa.int64())], ["node", "check", "doc", "at", "many"])

    suffixes = docs.mapInArrow(leaves, "node long, check long, doc long, at int, many long")
    # The least place of the least document, also where rows share a doc_id.
    nodes = suffixes.groupBy("node", "check").agg(F.min(F.struct("doc", "at")).alias("first"), F.sum("many").alias("many")).where("many > 1").select("node", "check", "first.doc", "first.at")
    firsts = sorted_files.write(nodes, common.scratch(spark), NODES)
    common.free_shuffles(spark)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, split, found in _batches(batches, size, gram):
            at = _flagged(found, index)
            node, check = _keys(found, at, bits)
            there, first = sorted_files.find_checked(sorted_files.lookup(firsts, NODES), node, check)
            doc = np.repeat(np.array([LAST if d is None else d for d in ids], np.int64), [len(a) for a in at])
            gone = there & ((first["doc"] < doc) | ((first["doc"] == doc) & (first["at"] < np.concatenate(at))))
            removed, kept, end = [], [], 0
            for ws, a in zip(split, at, strict=True):
                start = a[gone[end : end + len(a)]]
                end += len(a)
                cover = np.zeros(len(ws) + 1, np.int64)
                cover[start] += 1  # starts are distinct
                cover[start + size] -= 1
                stays = np.cumsum(cover[:-1]) == 0
                removed.append(len(ws) - int(stays.sum()))
                kept.append(b" ".join(compress(ws, stays.tolist()) if removed[-1] else ws).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(list(map(len, split)), pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return docs.mapInArrow(texts, "doc_id long, n_words long, n_removed long, kept string")
