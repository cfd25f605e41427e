"""bigWig as a Spark data source: spark.read.format("bigwig").load(path) gives (chr, start, end, value, track) runs.

The format is public: a header, a B+ tree of chromosomes, an R-tree over data blocks, and zlib-compressed blocks of
bedGraph, variable-step or fixed-step items. Blocks are independent, so ranges of the R-tree's leaves are partitions.

path: one file, or several with commas between; track is a file's name. Files are read in pieces, from local disk or any store
that Arrow knows. Filters on chr, start and end reach the R-tree: nodes that cannot overlap are not entered and their
blocks not read (spark.sql.python.filterPushdown.enabled must be set, as register() does). Spark applies all filters again.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from anchorloom.sources.files import opened
from anchorloom.sources.settled import ship

MAGIC, TREE_MAGIC, INDEX_MAGIC = 0x888FFC26, 0x78CA8C91, 0x2468ACE0


@dataclass
class Wanted:
    """What filters ask for: chromosomes (None: all), runs that end beyond `above` and start before `below`."""

    chromosomes: set[str] | None = None
    above: int = -1
    below: int = 1 << 62

    def take(self, f: Filter) -> None:
        """Narrow by one filter; those of other kinds change nothing."""
        column = getattr(f, "attribute", None)
        if column == ("chr",) and isinstance(f, EqualTo | In):
            names = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.chromosomes = names if self.chromosomes is None else self.chromosomes & names
        elif column == ("end",) and isinstance(f, GreaterThan | GreaterThanOrEqual | EqualTo):
            self.above = max(self.above, f.value - (not isinstance(f, GreaterThan)))
        elif column == ("start",) and isinstance(f, LessThan | LessThanOrEqual | EqualTo):
            self.below = min(self.below, f.value + (not isinstance(f, LessThan)))
        # A run lies within its block: what holds for its start holds for the block's end too, and the other way round.
        if column == ("start",) and isinstance(f, GreaterThan | GreaterThanOrEqual | EqualTo):
            self.above = max(self.above, f.value - (not isinstance(f, GreaterThan)))
        elif column == ("end",) and isinstance(f, LessThan | LessThanOrEqual | EqualTo):
            self.below = min(self.below, f.value + (not isinstance(f, LessThan)))

    def overlaps(self, span: tuple[int, int, int, int], numbers: list[int] | None) -> bool:
        """Whether a node of the R-tree (first chromosome and start, last chromosome and end) may hold wanted runs."""
        first, start, last, end = span
        if numbers is not None and not any(first <= n <= last for n in numbers):
            return False
        return first != last or (end > self.above and start < self.below)


class File:
    def __init__(self, path: str):
        self.f = opened(path)
        head = self.f.read(64)
        self.e = "<" if struct.unpack("<I", head[:4])[0] == MAGIC else ">"
        if self._un("I", head[:4])[0] != MAGIC:
            raise ValueError(f"{path} is no bigWig file")
        _, _, _, self.tree, _, self.index, _, _, _, _, self.buffer, _ = self._un("IHHQQQHHQQIQ", head)

    def _un(self, form: str, data: bytes) -> tuple:
        return struct.unpack(self.e + form, data)

    def _at(self, place: int, form: str) -> tuple:
        self.f.seek(place)
        return self._un(form, self.f.read(struct.calcsize(self.e + form)))

    def chromosomes(self) -> dict[int, str]:
        magic, _, key, _, _, _ = self._at(self.tree, "IIIIQQ")
        if magic != TREE_MAGIC:
            raise ValueError("the chromosome tree is damaged")
        out, todo = {}, [self.tree + 32]
        while todo:
            place = todo.pop()
            leaf, _, count = self._at(place, "BBH")
            for i in range(count):
                at = place + 4 + i * (key + 8)
                if leaf:
                    name, number, _ = self._at(at, f"{key}sII")
                    out[number] = name.rstrip(b"\0").decode()
                else:
                    todo.append(self._at(at + key, "Q")[0])
        return out

    def blocks(self, wanted: Wanted) -> list[tuple[int, int]]:
        """(place, bytes) of every data block that may hold wanted runs."""
        if self._at(self.index, "I")[0] != INDEX_MAGIC:
            raise ValueError("the index is damaged")
        numbers = None if wanted.chromosomes is None else [n for n, name in self.chromosomes().items() if name in wanted.chromosomes]
        out, todo = [], [self.index + 48]
        while todo:
            place = todo.pop()
            leaf, _, count = self._at(place, "BBH")
            size = 32 if leaf else 24
            self.f.seek(place + 4)
            data = self.f.read(count * size)
            for i in range(count):
                span = self._un("IIII", data[i * size : i * size + 16])
                if not wanted.overlaps(span, numbers):
                    continue
                if leaf:
                    out.append(self._un("QQ", data[i * size + 16 : i * size + 32]))
                else:
                    todo.append(self._un("Q", data[i * size + 16 : i * size + 24])[0])
        return sorted(out)

    def runs(self, place: int, size: int, names: dict[int, str]) -> Iterator[tuple[str, int, int, float]]:
        self.f.seek(place)
        data = self.f.read(size)
        if self.buffer:
            data = zlib.decompress(data)
        number, start, _, step, span, kind, _, count = self._un("IIIIIBBH", data[:24])
        for i in range(count):
            if kind == 1:
                a, b, v = self._un("IIf", data[24 + 12 * i : 36 + 12 * i])
            elif kind == 2:
                a, v = self._un("If", data[24 + 8 * i : 32 + 8 * i])
                b = a + span
            else:
                a, v = start + step * i, self._un("f", data[24 + 4 * i : 28 + 4 * i])[0]
                b = a + span
            yield names[number], a, b, v


class Range(InputPartition):
    def __init__(self, path: str, blocks: list[tuple[int, int]]):
        self.path, self.blocks = path, blocks


class BigWigReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.each, self.wanted = [p.strip() for p in options["path"].split(",")], int(options.get("blocks", 2000)), Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            self.wanted.take(f)
            yield f  # a block holds other runs too

    def partitions(self) -> list[Range]:
        out = []
        for path in self.paths:
            found = File(path).blocks(self.wanted)
            out += [Range(path, found[i : i + self.each]) for i in range(0, len(found), self.each)]
        return out or [Range(self.paths[0], [])]

    def read(self, partition: Range) -> Iterator[tuple]:
        if partition.blocks:
            file, track = File(partition.path), partition.path.rsplit("/", 1)[-1]
            names = file.chromosomes()
            for place, size in partition.blocks:
                for run in file.runs(place, size, names):
                    yield (*run, track)


class BigWigSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bigwig"

    def schema(self) -> str:
        return "chr string, start long, end long, value double, track string"

    def reader(self, schema) -> BigWigReader:
        return BigWigReader(self.options)


def register(spark) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BigWigSource)
