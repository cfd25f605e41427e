"""Embedding near-dedup over a robust-pruned flat graph.

Vectors of one label and length are a space; equal vectors are one class, represented by the smallest vec_id. Centroids
are fitted on a bounded sample (SAMPLE rows and SAMPLE_BYTES); every class goes to its OVERLAP nearest clusters, clusters
beyond SHARD vectors to slices. Each shard builds a graph: nearest candidates, pruned robustly (a candidate goes if a kept
neighbour is ALPHA times nearer to it than the node is); then edges run both ways and what a node has is pruned again.
Adjacency lists of a node's shards are united and written, with the vectors, as flat sorted files that workers memory-map.
Every class is a query: neighbouring queries search together, greedily from their shards' medoids; nodes in any query's
beam, and all in range of the threshold whatever the beam, are expanded once for the block, and a round's new nodes meet
the block's queries in one matrix product. Pairs are verified in double precision. An audit compares a sample of queries
with all vectors; while their average recall is below RECALL the beam doubles, up to MOST_BEAM. Where that does not do, all
pairs of a space are compared in blocks, which is exact and quadratic.

Defined cases: vectors that are null, empty or zero, hold null or non-finite components, have a squared length outside
1e-150 to 1e150 (cosines then overflow or vanish in double precision), or have a null label or vec_id link with nothing
(n_links 0, component themselves, kept); rows that share a vec_id are one node, and each counts; equal vectors link
(cosine 1); a row without vec_id has no component and is kept; an empty table gives an empty result; extra columns are
not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorloom.llm import common, sorted_files
from anchorloom.llm.graph import components

THRESHOLD, SAMPLE, SAMPLE_BYTES, CLUSTER, SHARD, OVERLAP = 0.93, 50_000, 64 << 20, 1000, 3000, 3
CANDIDATES, DEGREE, ALPHA, BEAM, SLACK = 48, 16, 1.2, 12, 0.05
AUDIT, RECALL, MOST_BEAM, MOST_CLUSTERS = 256, 0.95, 48, 20_000


def prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, space, k1, k2, v): usable vectors as float64 bytes with a 128-bit key of their values."""
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"), F.col("label").cast("string").alias("label"))
    good = good.where("vec_id is not null and label is not null and size(e) > 0 and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    good = good.where("aggregate(e, 0D, (a, x) -> a + x * x) between 1e-150 and 1e150").select("vec_id", F.concat_ws("|", F.size("e"), "label").alias("space"), "e")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            raw = [(np.array(x, "<f8") + 0.0).tobytes() for x in b.column(2).to_pylist()]
            keys = np.array([[k & 0xFFFFFFFFFFFFFFFF, k >> 64] for k in map(xxhash.xxh3_128_intdigest, raw)], np.uint64).reshape(-1, 2).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(raw, pa.binary())], ["vec_id", "space", "k1", "k2", "v"])

    return good.mapInArrow(run, "vec_id long, space string, k1 long, k2 long, v binary")


def unit(rows: list[bytes], width: int) -> np.ndarray:
    """Unit vectors; shorter ones (of another space) are filled with zeros. Scaled first, so no square overflows."""
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        x = np.frombuffer(r, "<f8")
        out[i, : len(x)] = x / np.abs(x).max()
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def centroids(sample: list[tuple[str, bytes]], share: float, width: int, seed: int = 7) -> dict[str, np.ndarray]:
    """Spherical k-means in each space of the sample, which holds this share of all vectors."""
    by = defaultdict(list)
    for space, v in sorted(sample):
        by[space].append(v)
    out = {}
    for space, rows in by.items():
        x = unit(rows, width)
        k = min(max(1, round(len(rows) / share / CLUSTER)), max(1, len(rows) // 8), MOST_CLUSTERS)
        c = x[np.random.default_rng(seed).permutation(len(x))[:k]]
        for _ in range(8 if k > 1 else 1):
            own = np.concatenate([(x[a : a + 4096] @ c.T).argmax(1) for a in range(0, len(x), 4096)])
            c = np.array([x[own == j].sum(0) if (own == j).any() else c[j] for j in range(k)])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        out[space] = c
    return out


def _robust(sims: np.ndarray, near: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Of each row's candidates (-1: none) those that no kept one covers, nearest first; -1 fills the rest."""
    rows = np.arange(len(sims))
    mine = np.where(near >= 0, sims[rows[:, None], near], -2)
    order = np.argsort(-mine, axis=1, kind="stable")
    near, mine = np.take_along_axis(near, order, 1), np.take_along_axis(mine, order, 1)
    alive, kept = near >= 0, np.full((len(sims), degree), -1)
    for d in range(degree):
        first = alive.argmax(1)
        any_left = alive[rows, first]
        if not any_left.any():
            break
        pick = near[rows, first]
        kept[any_left, d] = pick[any_left]
        apart = 1 - sims[pick[:, None], near]  # squared distances, but for a factor
        alive &= alpha**2 * apart > 1 - mine
        alive[rows, first] = False
    return kept


def prune(x: np.ndarray, candidates: int = CANDIDATES, degree: int = DEGREE, alpha: float = ALPHA) -> list[np.ndarray]:
    """Robustly pruned neighbours of each row among its nearest candidates and the rows that kept it, nearest first."""
    n = len(x)
    if n < 2:
        return [np.empty(0, np.int64)] * n
    sims = (x @ x.T).astype(np.float32)
    np.fill_diagonal(sims, -2)
    k = min(candidates, n - 1)
    kept = _robust(sims, np.argpartition(-sims, k - 1, axis=1)[:, :k], degree, alpha)
    # Both ways: of those that kept a row the nearest, with its own, are pruned again.
    a, b = np.repeat(np.arange(n), (kept >= 0).sum(1)), kept[kept >= 0]
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    edge = np.unique(a * n + b)
    a, b = edge // n, edge % n
    order = np.lexsort((-sims[a, b], a))
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, a, "left")
    both = np.full((n, candidates), -1)
    both[a[place < candidates], place[place < candidates]] = b[place < candidates]
    return [r[r >= 0] for r in _robust(sims, both, degree, alpha)]


def _assigned(reps: DataFrame, centers: dict[str, np.ndarray], width: int) -> DataFrame:
    """(rep, space, cluster, rank, v): OVERLAP rows for each class."""
    shared = reps.sparkSession.sparkContext.broadcast(centers)  # at most MOST_CLUSTERS a space, fitted on SAMPLE rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spaces, raw = b.column(1).to_pylist(), b.column(2).to_pylist()
            x, out = unit(raw, width), []
            for s in sorted(set(spaces)):
                rows = np.array([i for i, t in enumerate(spaces) if t == s])
                c = shared.value.get(s)
                best = np.argsort(-(x[rows] @ c.T), axis=1, kind="stable")[:, :OVERLAP] if c is not None else np.zeros((len(rows), 1), int)
                out += [(i, int(k), r) for i, ks in zip(rows.tolist(), best, strict=True) for r, k in enumerate(ks)]
            at = pa.array([o[0] for o in out], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64()), b.column(2).take(at)], ["rep", "space", "cluster", "rank", "v"])

    return reps.select("rep", "space", "v").mapInArrow(run, "rep long, space string, cluster long, rank long, v binary")


def _graph(assigned: DataFrame, width: int) -> DataFrame:
    """(rep, space, cluster, near, medoid): neighbours in each shard as int64 bytes; medoid is not null for its medoid."""

    def run(group: pa.Table) -> pa.Table:
        ids = group.column("rep").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, raw = ids[order], group.column("v").to_pylist()
        x = unit([raw[i] for i in order], width)
        near, medoid = prune(x), int((x @ x.mean(0)).argmax())
        space, cluster = ([group.column(c)[0].as_py()] * len(ids) for c in ("space", "cluster"))
        return pa.table([pa.array(ids), pa.array(space, pa.string()), pa.array(cluster, pa.int64()), pa.array([ids[k].astype("<i8").tobytes() for k in near], pa.binary()), pa.array([True if i == medoid else None for i in range(len(ids))], pa.bool_())], ["rep", "space", "cluster", "near", "medoid"])

    return assigned.groupBy("space", "cluster", "slice").applyInArrow(run, "rep long, space string, cluster long, near binary, medoid boolean")


def search(queries: np.ndarray, starts: np.ndarray, index: sorted_files.Lookup, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, node, cosine) of all nodes found in range. queries: unit vectors of one space; starts: entry nodes.

    A node's rank in a query's beam only falls as more nodes are met, so only a round's new nodes need be tested."""
    new, met = np.unique(starts), np.empty(0, np.int64)
    best = np.full((len(queries), beam), -2.0)
    out = []
    while len(new):
        there, rows = index.find(new)
        new, v = new[there], rows["v"][there]
        v = v / np.abs(v).max(1, keepdims=True)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        sims = queries @ v.T
        met = np.union1d(met, new)
        best = np.partition(np.concatenate([best, sims], axis=1), -beam, axis=1)[:, -beam:]
        q, k = np.nonzero(sims >= threshold - 1e-9)
        out.append((q, new[k], sims[q, k]))
        turn = (sims >= np.minimum(best.min(1), threshold - SLACK)[:, None]).any(0)
        near = np.unique(rows["near"][there][turn])
        new = np.setdiff1d(near[near >= 0], met, assume_unique=True)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows, in double precision, by the plain formula."""
    return np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))


def links(reps: DataFrame, threshold: float = THRESHOLD, beam: int = BEAM, report: dict | None = None) -> DataFrame:
    """(a, b), a < b: pairs of classes found with a cosine of at least threshold. reps: (rep, space, v), written.

    report gets the audited recall and the beam (0: compared exactly)."""
    spark, report = reps.sparkSession, {} if report is None else report
    total, longest = reps.agg(F.count("*"), F.max(F.length("v"))).first()
    if not total:
        return spark.createDataFrame([], "a long, b long")
    width, rows = longest // 8, min(SAMPLE, SAMPLE_BYTES // longest)
    share = min(1.0, rows / total)
    sample = reps.where((F.xxhash64("rep", F.lit(11)) % (1 << 20) + (1 << 20)) / float(1 << 21) < share) if share < 1 else reps
    centers = centroids([(r.space, bytes(r.v)) for r in sample.select("space", "v").limit(2 * rows).collect()], share, width)
    assigned = common.written(_assigned(reps, centers, width))
    sizes = assigned.groupBy("space", "cluster").count().select("space", "cluster", F.ceil(F.col("count") / SHARD).alias("slices"))
    sliced = assigned.join(sizes, ["space", "cluster"]).withColumn("slice", F.pmod(F.xxhash64("rep"), F.col("slices")))
    graph = common.written(_graph(sliced, width))
    degree = OVERLAP * DEGREE
    united = graph.groupBy("rep").agg(F.collect_list("near").alias("lists"))

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = []
            for lists in b.column(2).to_pylist():
                ids = np.unique(np.frombuffer(b"".join(lists), "<i8"))[:degree]
                near.append(np.concatenate([ids, np.full(degree - len(ids), -1)]).astype("<i8").tobytes())
            v = [r + bytes(8 * width - len(r)) for r in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(v, pa.binary()), pa.array(near, pa.binary())], ["rep", "v", "near"])

    types = {"rep": "<i8", "v": f"<f8*{width}", "near": f"<i8*{degree}"}
    whole = reps.select("rep", "v").join(united, "rep").mapInArrow(flat, "rep long, v binary, near binary")
    index = sorted_files.write(whole, common.scratch(spark), types)
    # The medoids of a class's shards; classes of one nearest cluster lie together, however large it is.
    medoids = graph.where("medoid is not null").select("space", "cluster", F.col("rep").alias("start"))
    medoids = medoids.groupBy("space", "cluster").agg(F.collect_list("start").alias("starts"))
    places = assigned.select("rep", "space", "cluster", "rank").join(medoids, ["space", "cluster"])
    places = places.groupBy("rep").agg(F.min_by("cluster", "rank").alias("home"), F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))
    homes = common.written(reps.join(places, "rep").select("rep", "space", "home", "starts", "v"))
    dealt = homes.repartitionByRange(common.parts(spark), "space", "home", "rep").sortWithinPartitions("space", "home", "rep")
    common.forget(graph, assigned)

    def run_with(wide: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files = sorted_files.lookup(index, types)
            for b in batches:
                spaces = b.column(1).to_pylist()
                cuts = sorted({0, *(i for i in range(1, len(spaces)) if spaces[i] != spaces[i - 1]), len(spaces)})
                for at, end in ((k, min(k + 256, z)) for a, z in zip(cuts[:-1], cuts[1:], strict=True) for k in range(a, z, 256)):
                    block = b.slice(at, end - at)
                    ids, raw = block.column(0).to_numpy(), block.column(4).to_pylist()
                    starts = np.array(list({s for x in block.column(3).to_pylist() for s in x}), np.int64)
                    q, node, sim = search(unit(raw, width), starts, files, threshold, wide)
                    other = ids[q] != node
                    q, node, sim = q[other], node[other], sim[other]
                    near = np.flatnonzero(np.abs(sim - threshold) < 1e-6)  # only there can rounding matter
                    sure = sim >= threshold
                    for k in range(0, len(near), 4096):
                        some = near[k : k + 4096]
                        own = np.stack([np.frombuffer(raw[i] + bytes(8 * width - len(raw[i])), "<f8") for i in q[some]])
                        sure[some] = cosine(own, files.find(node[some])[1]["v"]) >= threshold
                    a, z = ids[q[sure]], node[sure]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, z)), pa.array(np.maximum(a, z))], ["a", "b"])

        return run

    while True:
        found = common.written(dealt.mapInArrow(run_with(beam), "a long, b long").distinct())
        report |= {"recall": audit(reps, found, total, width, threshold), "beam": beam}
        if report["recall"] >= RECALL:
            common.forget(homes)
            return found
        common.forget(found)
        if beam >= MOST_BEAM:
            common.forget(homes)
            report |= {"recall": 1.0, "beam": 0}
            return exact(reps, width, threshold)
        beam *= 2


def exact(reps: DataFrame, width: int, threshold: float) -> DataFrame:
    """(a, b), a < b: all links, by comparing every two vectors of a space in blocks."""
    spark = reps.sparkSession
    types = {"rep": "<i8", "v": f"<f8*{width}", "space": "<i8"}

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = [r + bytes(8 * width - len(r)) for r in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(v, pa.binary()), b.column(2)], ["rep", "v", "space"])

    table = reps.select("rep", "v", F.xxhash64("space").alias("space"))
    index = sorted_files.write(table.mapInArrow(flat, "rep long, v binary, space long"), common.scratch(spark), types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = sorted_files.lookup(index, types)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                ids, space = (b.column(c).slice(at, 256).to_numpy() for c in (0, 2))
                raw = b.column(1).slice(at, 256).to_pylist()
                own, x = np.stack([np.frombuffer(r + bytes(8 * width - len(r)), "<f8") for r in raw]), unit(raw, width)
                for part in range(len(index)):
                    columns = files._part(part)
                    for k in range(0, len(columns["rep"]), 4096):
                        node, v, other = (np.asarray(columns[c][k : k + 4096]) for c in ("rep", "v", "space"))
                        y = v / np.abs(v).max(1, keepdims=True)
                        y /= np.linalg.norm(y, axis=1, keepdims=True)
                        i, j = np.nonzero((x @ y.T >= threshold - 1e-9) & (space[:, None] == other[None]) & (ids[:, None] < node[None]))
                        sure = cosine(own[i], v[j]) >= threshold if len(i) else np.empty(0, bool)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[i[sure]]), pa.array(node[j[sure]])], ["a", "b"])

    return common.written(table.mapInArrow(run, "a long, b long"))


def audit(reps: DataFrame, found: DataFrame, total: int, width: int, threshold: float) -> float:
    """Recall of found links, averaged over AUDIT queries that have any, so that no large group outweighs the others."""
    spark = reps.sparkSession
    chosen = reps.where(F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(max(1, total // AUDIT))) == 0).limit(2 * AUDIT).collect()
    ids, spaces = np.array([r.rep for r in chosen], np.int64), np.array([r.space for r in chosen])
    x = unit([bytes(r.v) for r in chosen], width)
    if not len(ids):
        return 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = (unit(b.column(2).to_pylist(), width) @ x.T >= threshold) & (np.array(b.column(1).to_pylist())[:, None] == spaces[None])
            i, j = np.nonzero(near)
            a, z = b.column(0).to_numpy()[i], ids[j]
            other = a != z
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, z)[other]), pa.array(np.maximum(a, z)[other]), pa.array(z[other])], ["a", "b", "query"])

    true = reps.select("rep", "space", "v").mapInArrow(run, "a long, b long, query long")
    hits = true.join(found.withColumn("hit", F.lit(1.0)), ["a", "b"], "left")
    each = hits.groupBy("query").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))
    recall = each.agg(F.avg("recall")).first()[0]
    return 1.0 if recall is None else recall


def dedup(vectors: DataFrame, threshold: float = THRESHOLD, beam: int = BEAM, report: dict | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of vectors (vec_id, embedding, label).

    report gets what links() found in its audit."""
    spark = vectors.sparkSession
    common.ship(spark)
    common.small_batches(spark)
    rows = common.written(prepared(vectors))
    keys = ["space", "k1", "k2"]
    reps = common.written(rows.groupBy(*keys).agg(F.min("vec_id").alias("rep"), F.count("*").alias("many"), F.min("v").alias("v")))
    # A vec_id in several rows may represent several classes; the node's vector is then the one of least key.
    nodes = common.written(reps.groupBy("rep").agg(F.min(F.struct(*keys, "v")).alias("x")).select("rep", "x.space", "x.v"))
    found = links(nodes, threshold, beam, report)
    size = reps.groupBy("rep").agg(F.max("many").alias("many"))
    both = found.select("a", "b").union(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(size, F.col("b") == F.col("rep")).groupBy("a").agg(F.sum("many").alias("linked"))
    known = reps.drop("v").join(linked, F.col("rep") == F.col("a"), "left").select(*keys, "rep", (F.coalesce("linked", F.lit(0)) + F.col("many") - 1).alias("n_links"))
    grown = components(found)
    known = known.join(grown, F.col("rep") == F.col("node"), "left").select(*keys, "n_links", F.coalesce("component", "rep").alias("component_id"))
    placed = rows.drop("v").join(known, keys).select("vec_id", "n_links", "component_id")
    placed = placed.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    out = ids.join(placed, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
