"""Tables as sorted flat arrays in the shared folder, range-partitioned by a 64-bit key and memory-mapped by workers.

Range bounds are found from the data, so parts stay of a size however dense a stretch of keys is. Neither the driver nor
a broadcast holds rows: the driver keeps each part's first key and length, workers map what they look up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from anchorloom.llm import common

Index = list[tuple[str, int, int]]


def write(df: DataFrame, to: str, types: dict[str, str]) -> Index:
    """Write columns of df (key first, a long, distinct; no nulls): (stem, first key, rows) of each part, in order.

    A type such as "<f8*64" stands for a binary column whose values are that many numbers in a row."""
    names = list(types)
    ordered = df.select(*names).repartitionByRange(common.parts(df.sparkSession), names[0]).sortWithinPartitions(names[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        stem, n, first, files = f"{to}/part-{TaskContext.get().partitionId():06d}", 0, 0, None
        for b in batches:
            if not b.num_rows:
                continue
            if files is None:
                files, first = {k: common.SharedFile(f"{stem}.{k}") for k in names}, b.column(0)[0].as_py()
            for k in names:
                column = b.column(names.index(k))
                files[k].write(b"".join(column.to_pylist()) if "*" in types[k] else column.to_numpy(zero_copy_only=False).astype(types[k]).tobytes())
            n += b.num_rows
        if files:
            for f in files.values():
                f.done()
            yield pa.RecordBatch.from_pylist([{"stem": stem, "first": first, "n": n}])

    found = ordered.mapInArrow(run, "stem string, first long, n long").collect()
    return sorted(((r.stem, r.first, r.n) for r in found), key=lambda r: r[0])


class Lookup:
    """Finds rows by key in a worker; types as for write()."""

    def __init__(self, index: Index, types: dict[str, str]):
        self.index, self.types, self.key = index, types, next(iter(types))
        self.bases = np.cumsum([0, *(n for _, _, n in index)])
        self.firsts = np.array([first for _, first, _ in index], np.int64)
        self.parts: dict[int, dict[str, np.ndarray]] = {}

    def _part(self, i: int) -> dict[str, np.ndarray]:
        if i not in self.parts:
            self.parts[i] = {k: self._shaped(common.mapped(f"{self.index[i][0]}.{k}", t.partition("*")[0]), t) for k, t in self.types.items()}
        return self.parts[i]

    @staticmethod
    def _shaped(a: np.ndarray, kind: str) -> np.ndarray:
        return a.reshape(-1, int(kind.partition("*")[2])) if "*" in kind else a

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Which of the keys are there, and the other columns' values and row numbers, "row" (0 where not)."""
        distinct, back = np.unique(keys.astype(np.int64, copy=False), return_inverse=True)
        there = np.zeros(len(distinct), bool)
        values = {k: self._shaped(np.zeros(len(distinct) * int(t.partition("*")[2] or 1), t.partition("*")[0]), t) for k, t in self.types.items() if k != self.key}
        values["row"] = np.zeros(len(distinct), np.int64)
        if len(self.firsts) and len(distinct):
            part = np.searchsorted(self.firsts, distinct, "right") - 1
            cut = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if part[a] < 0:
                    continue
                columns = self._part(int(part[a]))
                at = np.minimum(np.searchsorted(columns[self.key], distinct[a:b]), len(columns[self.key]) - 1)
                hit = columns[self.key][at] == distinct[a:b]
                there[a:b] = hit
                for k in values:
                    values[k][a:b][hit] = at[hit] + self.bases[part[a]] if k == "row" else columns[k][at[hit]]
        return there[back], {k: v[back] for k, v in values.items()}


def find_checked(look: Lookup, keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """As Lookup.find() for files whose keys may repeat: the row whose "check" agrees too. Rows of one key are in one part."""
    there = np.zeros(len(keys), bool)
    values = {k: np.zeros(len(keys), t) for k, t in look.types.items() if k not in (look.key, "check")}
    if not len(look.firsts) or not len(keys):
        return there, values
    order = np.argsort(keys, kind="stable")
    part = np.searchsorted(look.firsts, keys[order], "right") - 1
    for i in np.unique(part[part >= 0]).tolist():
        own, columns = order[part == i], look._part(i)
        at, size = np.searchsorted(columns[look.key], keys[own]), len(columns[look.key])
        while len(own):
            same = at < size
            own, at = own[same], at[same]
            same = columns[look.key][at] == keys[own]
            own, at = own[same], at[same]
            hit = columns["check"][at] == checks[own]
            there[own[hit]] = True
            for k in values:
                values[k][own[hit]] = columns[k][at[hit]]
            own, at = own[~hit], at[~hit] + 1
    return there, values


def summed(keys: Iterator[np.ndarray], hold: int = 4_000_000, rows: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct keys and how often they occur, summed over up to `hold` keys: combined before any shuffle."""
    held, n = [], 0

    def out() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if held:
            value, many = np.unique(np.concatenate(held), return_counts=True)
            for a in range(0, len(value), rows):
                yield value[a : a + rows], many[a : a + rows]

    for k in keys:
        held.append(k)
        n += len(k)
        if n >= hold:
            yield from out()
            held, n = [], 0
    yield from out()


_open: dict[str, Lookup] = {}


def lookup(index: Index, types: dict[str, str]) -> Lookup:
    """This worker's lookup for the files; only the last few stay mapped."""
    if not index:
        return Lookup(index, types)
    name = index[0][0]
    if name not in _open:
        while len(_open) > 3:
            _open.pop(next(iter(_open)))
        _open[name] = Lookup(index, types)
    return _open[name]
