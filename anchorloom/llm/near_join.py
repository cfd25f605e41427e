"""N-gram Jaccard join: documents whose sets of word shingles have a Jaccard similarity of at least 0.75.

1. Blocks. In a global order of shingles, rarest first, linked documents share one of their first
   n - ceil(0.75 n) + 1 shingles. How often a shingle occurs is counted over a half of all shingles, chosen by hash
   (the others come last in the order), and shingles of one document only can link nothing: most documents end here.
   Documents that share such a shingle form blocks (connected components over one star for each shingle).
2. Count-vector R-tree. In each block shingles are hashed into groups; a document is the point of its group counts.
   A packed R-tree keeps coordinate maxima; sums of coordinate minima bound the overlap of nodes and of documents.
   Surviving pairs that are not yet connected are verified on the sets.
3. Blocks beyond BLOCK documents are dealt in chunks; then one document of each component stands for it. What is still
   apart is compared by shingle: a link not made yet joins two components that share a shingle of step 1, so only shingles
   whose documents are in several components are taken, each set of documents once. Their points meet in trees, chunk by
   chunk, but for those of one component; documents that no bound parts from one of another component are sent on with
   their sets and verified. So no task holds more than two chunks and no link is lost.

Equal sets are one class from the start. Only components are wanted, so of a class of n linked texts n - 1 links do.

Defined cases: a text without words has an empty set and links with nothing; with fewer than five words the whole
sequence is its one shingle; null doc_id never links (component null); rows that share a doc_id are one node whose links
are those of all its texts; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorloom.llm import common
from anchorloom.llm.graph import components

SHINGLE, PERCENT, GROUPS, LEAF, BLOCK, SALTS = 5, 75, 256, 16, 512, 16


def shingles(text: str | None, hashes: common.WordHashes, k: int = SHINGLE) -> np.ndarray:
    """The sorted set of a text's shingle hashes."""
    ws = common.words(text, lower=True)
    if not ws:
        return np.empty(0, np.uint64)
    return np.unique(common.grams(hashes.of(ws), min(k, len(ws))))


def prefix(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n, k1, k2, counted): set size, a 128-bit key of the set, and how many of its shingles _pieces() counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = common.WordHashes()
        for b in batches:
            sets = [shingles(t, hashes) for t in b.column(1).to_pylist()]
            columns = [[len(s) for s in sets], *([_key(s, salt) for s in sets] for salt in (0x5BD1E995, 0x27D4EB2F165667C5)), [len(counted(s)) for s in sets]]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "n", "k1", "k2", "counted"])

    return _texts(docs).mapInArrow(run, "doc_id long, n long, k1 long, k2 long, counted long")


def _key(s: np.ndarray, salt: int) -> int:
    return int(common.mix(s ^ np.uint64(salt)).sum(dtype=np.uint64).astype(np.int64))


def counted(s: np.ndarray) -> np.ndarray:
    """The half of a set that is counted, and as many of the others as its prefix lacks, least hash first."""
    half = (s & np.uint64(1)) == 0
    lack = prefix(len(s)) - int(half.sum())
    return s[half] if lack <= 0 else np.concatenate([s[half], s[~half][:lack]])


def _pieces(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, base, width, shingle, doc): for each batch and bucket, 32 bits of each counted shingle and its document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = common.WordHashes()
        for b in batches:
            ids, all_h, all_d = b.column(0).to_pylist(), [], []
            for d, t in zip(ids, b.column(1).to_pylist(), strict=True):
                if d is None:
                    continue
                h = counted(shingles(t, hashes))
                all_h.append(h)
                all_d.append(np.full(len(h), d, np.int64))
            if not all_h:
                continue
            h, d = np.concatenate(all_h), np.concatenate(all_d)
            if not len(h):
                continue
            bucket = ((h >> np.uint64(1)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, low, d = bucket[order], (h[order] >> np.uint64(32)).astype("<u4"), d[order]
            base = int(d.min())
            width = 4 if int(d.max()) - base < 1 << 32 else 8
            d = (d - base).astype(f"<u{width}")
            cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            spans = list(zip(cut[:-1], cut[1:], strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket[cut[:-1]], pa.int64()),
                    pa.array([base] * len(spans), pa.int64()),
                    pa.array([width] * len(spans), pa.int32()),
                    pa.array([low[x:y].tobytes() for x, y in spans], pa.binary()),
                    pa.array([d[x:y].tobytes() for x, y in spans], pa.binary()),
                ],
                ["bucket", "base", "width", "shingle", "doc"],
            )

    return _texts(docs).mapInArrow(run, "bucket long, base long, width int, shingle binary, doc binary")


def _shared(pieces: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, shingle, df) of shingles that several rows hold."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        bucket, cols = key[0].as_py(), {c: group.column(c).to_pylist() for c in ("base", "width", "shingle", "doc")}
        h = np.concatenate([np.frombuffer(x, "<u4") for x in cols["shingle"]])
        d = np.concatenate([np.frombuffer(x, f"<u{w}").astype(np.int64) + b for x, w, b in zip(cols["doc"], cols["width"], cols["base"], strict=True)])
        order = np.argsort(h, kind="stable")
        h, d = h[order], d[order]
        first = np.concatenate([[True], h[1:] != h[:-1]])
        run_of = np.cumsum(first) - 1
        df = np.bincount(run_of)[run_of]
        keep = df > 1
        return pa.table([pa.array(d[keep]), pa.array(h[keep].astype(np.int64) * buckets + bucket), pa.array(df[keep].astype(np.int32))], ["doc_id", "shingle", "df"])

    return pieces.groupBy("bucket").applyInArrow(run, "doc_id long, shingle long, df int")


def prefixes(docs: DataFrame, table: DataFrame) -> DataFrame:
    """(doc_id, prefix), written: shingles by which class representatives may link. table: classes() with rep."""
    buckets = 16 * common.parts(docs.sparkSession)
    shared = _shared(_pieces(docs, buckets), buckets).groupBy("doc_id").agg(F.collect_list(F.struct("df", "shingle")).alias("shared"))
    reps = table.where("doc_id = rep").groupBy("doc_id").agg(F.max("n").alias("n"), F.max("counted").alias("counted"), F.count("*").alias("texts"))
    # Shingles of this document alone come first in the order; what they leave of the prefix is taken, rarest first.
    left = F.expr("n - cast(ceil(75 * n / 100) as bigint) + 1 - (counted - size(shared))")
    take = F.when(F.col("texts") > 1, F.size("shared")).otherwise(F.greatest(left, F.lit(0))).cast("int")
    first = F.slice(F.array_sort("shared"), F.lit(1), take)
    return common.written(shared.join(reps, "doc_id").select("doc_id", F.transform(first, lambda x: x.shingle).alias("prefix")))


def blocks(docs: DataFrame, table: DataFrame) -> DataFrame:
    """(doc_id, block, prefix), written: documents that share shingles of their prefixes, directly or by others."""
    placed = prefixes(docs, table)
    common.free_shuffles(docs.sparkSession)
    rows = placed.select("doc_id", F.explode("prefix").alias("shingle"))
    star = rows.groupBy("shingle").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).where("hub < last").drop("last")
    grown = components(rows.join(star, "shingle").where("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")))
    out = common.written(placed.join(grown, placed.doc_id == grown.node).select("doc_id", F.col("component").alias("block"), "prefix"))
    common.forget(placed)
    return out


def point(s: np.ndarray) -> np.ndarray:
    """Counts of a set's shingles by group of hashes."""
    return np.bincount((s >> np.uint64(20)).astype(np.int64) % GROUPS, minlength=GROUPS)


class CountTree:
    """A packed R-tree over group counts: leaves of LEAF points in order of size and then of the fullest groups."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        self.counts, self.sizes = counts, sizes
        self.order = np.lexsort((*np.argsort(-counts, axis=1, kind="stable")[:, :2].T, sizes // 8))
        self.levels = []
        top, low, high = counts[self.order], sizes[self.order], sizes[self.order]
        while len(top) > 1 or not self.levels:
            cut = np.arange(0, len(top), LEAF)
            top, low, high = np.maximum.reduceat(top, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            self.levels.append((top, low, high))

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(i, j, bound) of points that may link: no pair whose overlap could reach the threshold is left out."""
        todo = [(len(self.levels) - 1, 0, 0)]
        while todo:
            level, a, b = todo.pop()
            top, low, high = self.levels[level]
            if not may_link(np.minimum(top[a], top[b]).sum(), low[a], high[a], low[b], high[b]):
                continue
            if level:
                inside = lambda x: range(x * LEAF, min((x + 1) * LEAF, len(self.levels[level - 1][0])))  # noqa: B023, E731
                todo += [(level - 1, x, y) for x in inside(a) for y in inside(b) if x <= y]
                continue
            i, j = self.order[a * LEAF : (a + 1) * LEAF], self.order[b * LEAF : (b + 1) * LEAF]
            bound = np.minimum(self.counts[i][:, None], self.counts[j][None]).sum(2)
            ok = (100 + PERCENT) * bound >= PERCENT * (self.sizes[i][:, None] + self.sizes[j][None])
            if a == b:
                ok = np.triu(ok, 1)
            x, y = np.nonzero(ok)
            if len(x):
                yield i[x], j[y], bound[x, y]


def may_link(bound: int, low_a: int, high_a: int, low_b: int, high_b: int) -> bool:
    """Whether documents of these sizes with at most this overlap can have 100 I >= 75 U."""
    return 100 * min(high_a, high_b) >= PERCENT * max(low_a, low_b) and (100 + PERCENT) * bound >= PERCENT * (low_a + low_b)


def forest(sets: list[np.ndarray], known: np.ndarray) -> list[tuple[int, int]]:
    """Verified links that join what is not yet joined; known: component numbers of what is."""
    parent = list(range(len(sets)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for same in np.split(np.argsort(known, kind="stable"), np.flatnonzero(np.diff(np.sort(known))) + 1):
        for x in same[1:]:
            parent[find(int(x))] = find(int(same[0]))
    sizes, out = np.array([len(s) for s in sets]), []
    for i, j, bound in CountTree(np.array([point(s) for s in sets]), sizes).pairs():
        for k in np.argsort(-bound, kind="stable"):
            x, y = int(i[k]), int(j[k])
            if find(x) == find(y):
                continue
            common_size = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if 100 * common_size >= PERCENT * (len(sets[x]) + len(sets[y]) - common_size):
                parent[find(x)] = find(y)
                out.append((x, y))
    return out


def _linked(rows: DataFrame) -> DataFrame:
    """Links (a, b) within each task of rows (task, doc_id, known, shingles)."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        ids, known = group.column("doc_id").to_numpy(), group.column("known").to_numpy()
        sets = [np.frombuffer(x, "<u8") for x in group.column("shingles").to_pylist()]
        order = np.argsort(ids, kind="stable")
        found = forest([sets[i] for i in order], known[order]) if len(ids) > 1 else []
        ids = ids[order]
        return pa.table([pa.array([ids[x] for x, _ in found], pa.int64()), pa.array([ids[y] for _, y in found], pa.int64())], ["a", "b"])

    return rows.select("task", "doc_id", "known", "shingles").groupBy("task").applyInArrow(run, "a long, b long")


def _sets(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """(doc_id, shingles, point), written; the counts of a point take 1, 2 or 4 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = common.WordHashes()
        for b in batches:
            sets = [shingles(t, hashes) for t in b.column(1).to_pylist()]
            points = [p.astype("<u1" if p.max() < 1 << 8 else "<u2" if p.max() < 1 << 16 else "<u4") for p in map(point, sets)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x.tobytes() for x in c], pa.binary()) for c in ([s.astype("<u8") for s in sets], points))], ["doc_id", "shingles", "point"])

    near = common.semi(_texts(docs), placed.select("doc_id"), "doc_id")
    return common.written(near.mapInArrow(run, "doc_id long, shingles binary, point binary").where("length(shingles) > 0"))


def _unparted(rows: DataFrame) -> DataFrame:
    """Of rows (task, doc_id, known, n, point) those whose bound with one of another component of the task reaches the threshold."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        points = [np.frombuffer(p, f"<u{len(p) // GROUPS}").astype(np.int64) for p in group.column("point").to_pylist()]
        known, near = group.column("known").to_numpy(), np.zeros(len(points), bool)
        for i, j, _ in CountTree(np.array(points), group.column("n").to_numpy()).pairs():
            apart = known[i] != known[j]
            near[i[apart]] = near[j[apart]] = True
        return group.select(["task", "doc_id", "known"]).filter(pa.array(near))

    kind = rows.select("task").schema["task"].dataType.simpleString()
    return rows.select("task", "doc_id", "known", "n", "point").groupBy("task").applyInArrow(run, f"task {kind}, doc_id long, known long")


def links(docs: DataFrame, placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b), written: verified links that connect exactly what all links connect. placed: blocks()."""
    sets = _sets(docs, placed)
    many = common.written(placed.groupBy("block").count().withColumnRenamed("block", "many_block"))
    chunk = F.pmod(F.xxhash64("doc_id"), F.greatest(F.ceil(F.col("count") / block), F.lit(1)))
    dealt = placed.join(many, placed.block == many.many_block).select("doc_id", F.struct("block", chunk.alias("chunk")).alias("task"), F.col("doc_id").alias("known"))
    found = common.written(_linked(sets.join(dealt, "doc_id")))
    large = common.written(placed.join(many.where(F.col("count") > block), placed.block == F.col("many_block"), "left_semi"))
    if large.limit(1).count():
        found = _more(found, _linked(sets.join(_heads(large, found, block), "doc_id")))
        points = sets.select("doc_id", (F.length("shingles") / 8).cast("long").alias("n"), "point")
        near = common.written(_unparted(points.join(_apart(large, found, block), "doc_id")))
        found = _more(found, _linked(sets.join(near, "doc_id")))
        common.forget(near)
    common.forget(sets, many, large)
    return found


def _more(found: DataFrame, met: DataFrame) -> DataFrame:
    out = common.written(found.union(met))
    common.forget(found)
    return out


def _known(large: DataFrame, found: DataFrame) -> DataFrame:
    """large with known, the component so far."""
    grown = components(found).withColumnRenamed("node", "known_id")
    return common.written(large.join(grown, large.doc_id == grown.known_id, "left").select("doc_id", "block", "prefix", F.coalesce("component", "doc_id").alias("known")))


def _heads(large: DataFrame, found: DataFrame, block: int) -> DataFrame:
    """(doc_id, known, task): of each component of a block one document, dealt in chunks."""
    heads = common.written(_known(large, found).where("doc_id = known").drop("prefix"))
    each = heads.groupBy("block").agg(F.count("*").alias("parts")).withColumnRenamed("block", "each_block")
    chunk = F.pmod(F.xxhash64("known", F.lit(1)), F.ceil(F.col("parts") / block))
    return heads.join(each, heads.block == each.each_block).select("doc_id", "known", F.struct("block", chunk.alias("chunk")).alias("task"))


def _apart(large: DataFrame, found: DataFrame, block: int) -> DataFrame:
    """(doc_id, known, task): two chunks of a block meet with those documents that share a shingle with another component's.

    A component of half a block or more has chunks of its own, which need not meet each other."""
    now = _known(large, found)
    size = now.groupBy("block", "known").count()
    whole = common.written(size.where(F.col("count") >= block // 2).select(F.col("known").alias("big"), F.ceil(2 * F.col("count") / block).alias("slices")))
    mixed = now.join(whole, now.known == whole.big, "left")
    rest = common.written(mixed.where("big is null").groupBy("block").count().select(F.col("block").alias("rest_block"), F.ceil(2 * F.col("count") / block).alias("rest_slices")))
    mixed = mixed.join(rest, mixed.block == rest.rest_block, "left")
    own = F.coalesce("big", F.lit(-1)).alias("own")
    part = F.pmod(F.xxhash64("doc_id"), F.coalesce("slices", "rest_slices")).alias("part")
    placed = mixed.select("doc_id", "known", "block", own, part, "prefix")
    held = common.written(placed.select("doc_id", "known", F.struct("block", "own", "part").alias("chunk"), F.explode("prefix").alias("shingle")))
    # Each set of documents once, if it is in several components.
    alike = held.groupBy("shingle").agg(F.count("*").alias("n"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("key"), F.min("known").alias("k0"), F.max("known").alias("k1"))
    alike = alike.where("k0 < k1").groupBy("n", "key").agg(F.min("shingle").alias("group"))
    held = common.written(held.join(alike.select("group"), F.col("shingle") == F.col("group")).select("doc_id", "known", "chunk", "group"))
    names = held.select("group", "chunk").distinct()
    a, b = names.select("group", F.col("chunk").alias("x")), names.select("group", F.col("chunk").alias("y"))
    meet = a.join(b, "group").where("x <= y and (x.own <> y.own or x.own = -1)")
    ends = meet.select("group", F.explode(F.array_distinct(F.array("x", "y"))).alias("chunk"), F.struct("x", "y").alias("task"))
    return held.join(ends, ["group", "chunk"]).select("doc_id", "known", "task").distinct()


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of docs."""
    spark = docs.sparkSession
    common.ship(spark)
    common.small_batches(spark)
    table = common.written(classes(docs))
    # Sets that several rows hold; salted, so that no set's copies are one task's.
    copies = table.where("n > 0 and doc_id is not null").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("least"), F.count("*").alias("many")).where("many > 1")
    copies = copies.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select("n", "k1", "k2", "salt", "least")
    salted = table.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    rep = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.coalesce("least", "doc_id"))
    named = common.written(salted.join(copies, ["n", "k1", "k2", "salt"], "left").select("doc_id", "n", "counted", rep.alias("rep")))
    common.forget(table)
    placed = blocks(docs, named)
    common.free_shuffles(spark)
    found = links(docs, placed)
    same = named.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    grown = components(found.union(same))
    common.forget(placed, found)
    out = named.join(grown, named.doc_id == grown.node, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without those that link, directly or by others, to one of smaller doc_id; rows without doc_id or words stay.

    Of rows that share the smallest doc_id one stays for each text: the least by all its columns."""
    made = common.written(join(docs))
    gone = common.written(made.where("component_id < doc_id").select("doc_id").distinct().withColumnRenamed("doc_id", "_near_id"))
    far = F.broadcast(gone) if gone.count() <= 1_000_000 else gone
    kept = docs.join(far, F.col("doc_id") == F.col("_near_id"), "left_anti")
    twice = common.written(made.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_near_id")))
    common.forget(made)
    many = twice.count()
    if not many:
        return kept
    at = F.broadcast(twice) if many <= 1_000_000 else twice
    same = F.col("doc_id") == F.col("_near_id")
    worded = F.coalesce(F.col("text").cast("string").rlike("[^ \\t-\\r]"), F.lit(False))
    shared = kept.where(worded).join(at, same, "left_semi")
    # Copies combine before the shuffle, so many copies of one row are no hot task.
    one = shared.groupBy("doc_id", F.sha2(F.col("text").cast("binary"), 256)).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("_near_row"))
    return kept.where(~worded).unionByName(kept.where(worded).join(at, same, "left_anti")).unionByName(one.select("_near_row.*"))
