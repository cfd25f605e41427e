"""Merkle manifest of a dataset: every row's digest, the tree over them by group, one root, and a proof for each row.

1. Leaves. A row's leaf is the SHA-256 of its fields, each with its length, so that no two rows share an encoding. Leaves
   are ranked within their group (lang) by range partitions and prefix sums: no group is sorted in one task.
2. Levels. Nodes of a level are partitioned by group and parent's number (place div FAN); an ordered collect_list over the
   full frame of this window gives the parent's preimage and the siblings alike. Parents, one for each run of at most FAN
   nodes, are the next level, a table of its own. A group of n rows has log(n) levels, of n / FAN rows and fewer.
3. Subroots are the leaves of one more such tree, in order of their group.
4. Proofs go down: a node's proof is its siblings, followed by its parent's proof, which a join by parent fetches. Only
   parents' proofs are shuffled; a row's own is put together where its run is.

Defined cases: null fields are written as "-"; a null group comes first; null doc_ids come first in their group, and rows
that share a doc_id in order of their leaves; repeated rows are leaves each; a group of one row has its leaf as subroot,
and a single group's subroot is the root; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anchorloom.llm import common
from anchorloom.llm.ranks import ranked

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def leaf(**replaced: Column) -> Column:
    """The digest of a row's FIELDS; replaced: other values for some of them."""

    def one(name: str) -> Column:
        value = replaced.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return digest(F.concat(*map(one, FIELDS)))


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and a proof (before, after by level) lead to."""
    return F.aggregate(proof, start, lambda h, s: digest(F.concat(s["before"], h, s["after"])))


def siblings(proof: Column) -> Column:
    """All digests of a proof in a row, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), "")


def _runs(nodes: DataFrame, fan: int) -> DataFrame:
    """nodes (g, i, n, hash) with up, their parent's number, run, the digests below it in order, and step, their siblings."""
    own = (F.col("i") % fan).cast("int")
    line = W.partitionBy("g", "up").orderBy("i").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    out = nodes.withColumn("up", F.floor(F.col("i") / fan).cast("long")).withColumn("run", F.collect_list("hash").over(line))
    after = F.array_join(F.slice("run", own + 2, F.lit(fan)), "")
    return out.withColumn("step", F.struct(F.array_join(F.slice("run", F.lit(1), own), "").alias("before"), after.alias("after")))


def _levels(nodes: DataFrame, fan: int) -> list[DataFrame]:
    """nodes (g, i, n, hash, ...), a table, and the tables above them; a group is in each until one node of it is left."""
    out, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        found = _runs(out[-1].where("n > 1").select("g", "i", "n", "hash"), fan).where(f"i % {fan} = 0")
        up = found.select("g", F.col("up").alias("i"), F.ceil(F.col("n") / fan).cast("long").alias("n"), digest(F.array_join("run", "")).alias("hash"))
        out.append(common.written(up))
        most = -(-most // fan)
    return out


def _tops(levels: list[DataFrame]) -> DataFrame:
    """(g, hash): the node that is left of each group."""
    out = levels[0].where("n = 1").select("g", "hash")
    for level in levels[1:]:
        out = out.unionByName(level.where("n = 1").select("g", "hash"))
    return out


def _proofs(levels: list[DataFrame], tops: DataFrame, fan: int) -> DataFrame:
    """The lowest level's nodes with proof and what tops (g, proof, ...) holds beside: tops' proof follows the group's."""
    rest = [c for c in tops.columns if c not in ("g", "proof")]
    down = None
    for level in reversed(levels):
        # What is left of a group takes up its proof from above.
        made = level.where("n = 1").join(tops, "g").select(*level.columns, "proof", *rest)
        if down is not None:
            grown = _runs(level.where("n > 1"), fan).join(down.select("g", F.col("i").alias("up"), F.col("proof").alias("above"), *rest), ["g", "up"])
            made = made.unionByName(grown.select(*level.columns, F.concat(F.array("step"), "above").alias("proof"), *rest))
        down = made
    return down


def manifest(docs: DataFrame, carry: dict[str, Column] | None = None, fan: int = FAN) -> DataFrame:
    """(doc_id, lang, leaf, subroot, root, proof) of each row of docs, and the columns of carry, computed from docs.

    proof: the siblings before and after the row's node by level, from the leaves to the root."""
    spread = F.monotonically_increasing_id()  # parts equal rows between tasks
    group = F.coalesce(F.concat(F.lit("+"), F.col("lang").cast("string")), F.lit(""))
    made = docs.select(group.alias("g"), "doc_id", leaf().alias("hash"), spread.alias("spread"), *[c.alias(k) for k, c in (carry or {}).items()])
    leaves = ranked(common.written(made), ["g"], ["doc_id", "hash", "spread"])
    nodes = common.written(leaves.withColumnsRenamed({"_rank": "i", "_size": "n"}).drop("spread"))
    levels = _levels(nodes, fan)
    below = _tops(levels).select(F.lit("").alias("all"), F.col("g").alias("key"), "hash")
    above = ranked(below, ["all"], ["key"]).select(F.col("all").alias("g"), F.col("_rank").alias("i"), F.col("_size").alias("n"), "hash", "key")
    upper = _levels(common.written(above), fan)
    start = _tops(upper).select("g", F.col("hash").alias("root"), F.expr("cast(array() as array<struct<before: string, after: string>>)").alias("proof"))
    subroots = _proofs(upper, start, fan).select(F.col("key").alias("g"), F.col("hash").alias("subroot"), "root", "proof")
    out = _proofs(levels, common.written(subroots), fan)
    lang = F.when(F.col("g") != "", F.expr("substring(g, 2)"))
    return out.select("doc_id", lang.alias("lang"), F.col("hash").alias("leaf"), "subroot", "root", "proof", *(carry or {}))
