"""Registered queries over the driver's tables and their SQL for DuckDB."""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorloom.functions.genomic import CELL, anchor_name, apart, chromosome_rank, log10p1, row_sum, zero_if_missing
from anchorloom.operators import evaluation as ev
from anchorloom.operators import density, features, intervals, motifs, pairs, sampling, signal
from anchorloom.plans.fixtures import _chr, load, with_clause
from anchorloom.sources import chains, readers, writers
from anchorloom.sources import settled as settled_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *names: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = (with_clause(*names) + (", " if sql.lstrip().startswith("--cte") else " ") if names else "") + sql.replace("--cte", "")
        return f

    return add


ANCHORS = """anchors as (select distinct cell_type, chr, x as center, x_start as start, x_end as "end" from loops
    union select distinct cell_type, chr, y, y_start, y_end from loops)"""
PAIRS = "chr, x, x_start, x_end, y, y_start, y_end, cell_type"


def _loops(spark, d):
    return load(spark, d, "loops")


def _peaks(spark, d):
    return load(spark, d, "peaks")


def _spots(spark, d):
    return pairs.anchors(_loops(spark, d))


# Readers, projections, sorts.


def _read_loops(spark, d, organism):
    raw = load(spark, d, "raw_loops").withColumns({"chr1": F.col("chr"), "chr2": F.col("chr")})
    out = readers.loops(raw, 2500, organism)
    return out.select("chr", CELL, *[F.col(c).cast("long").alias(c) for c in ("x", "x_start", "x_end", "y", "y_start", "y_end")])


@query("select chr, cast(round_even((x1 + x2) / 2, 0) as bigint) x, cast(round_even((y1 + y2) / 2, 0) as bigint) y, cell_type, cast(round_even((x1 + x2) / 2, 0) as bigint) - 2500 x_start, cast(round_even((x1 + x2) / 2, 0) as bigint) + 2500 x_end, cast(round_even((y1 + y2) / 2, 0) as bigint) - 2500 y_start, cast(round_even((y1 + y2) / 2, 0) as bigint) + 2500 y_end from raw_loops", "raw_loops")
def read_loops_human(spark, d):
    return _read_loops(spark, d, "human")


@query("select chr, cast((x1 + x2) // 2 as bigint) x, cast((y1 + y2) // 2 as bigint) y, cell_type, cast((x1 + x2) // 2 - 2500 as bigint) x_start, cast((x1 + x2) // 2 + 2500 as bigint) x_end, cast((y1 + y2) // 2 - 2500 as bigint) y_start, cast((y1 + y2) // 2 + 2500 as bigint) y_end from raw_loops", "raw_loops")
def read_loops_fly(spark, d):
    return _read_loops(spark, d, "fly")


@query("""select cell_type, regexp_extract('chr' || chr, '.*chr(.*)', 1) chr, start, "end" from peaks where cell_type in ('A', 'B')""", "peaks")
def read_peaks_norm(spark, d):
    raw = _peaks(spark, d).withColumn("chr", F.concat(F.lit("chr"), "chr"))
    return readers.peaks(raw, ["A", "B"])


@query(f"--cte {ANCHORS} select * from anchors", "loops")
def anchors_unpivot(spark, d):
    return _spots(spark, d)


@query(f"""--cte {ANCHORS} select cell_type, chr, center, row_number() over (partition by cell_type order by case when chr = 'X' then 100 when chr = 'Y' then 200 else cast(chr as int) end, start) rn from anchors""", "loops")
def genomic_order(spark, d):
    return pairs.genomic_rank(_spots(spark, d), "start").select(CELL, "chr", "center", "rn")


@query("select chr, x, y, cell_type, y - x distance, round(log10(y - x), 6) log_distance, round(log10(y - x + 1), 6) log_distance1 from loops", "loops")
def distance_features(spark, d):
    p = features.with_distance(_loops(spark, d))
    return p.select("chr", "x", "y", CELL, F.col("distance").cast("long").alias("distance"), F.round(F.log10("distance"), 6).alias("log_distance"), F.round(log10p1("distance"), 6).alias("log_distance1"))


@query("select cell_type, chr, x, y from loops where x < y and x + 400000 < y - 400000", "loops")
def pair_filters(spark, d):
    return _loops(spark, d).where((F.col("x") < F.col("y")) & apart(400000)).select(CELL, "chr", "x", "y")


@query("""select cell_type, chr, count(*) n from peaks p where exists (select 1 from loops l where l.chr = p.chr and l.cell_type = p.cell_type and l.x < 100000) group by 1, 2""", "loops", "peaks")
def chr_semi(spark, d):
    near = _loops(spark, d).where("x < 100000").select(CELL, "chr").distinct()
    return _peaks(spark, d).join(near, [CELL, "chr"], "left_semi").groupBy(CELL, "chr").agg(F.count("*").alias("n"))


# Interval joins.


@query(f"""--cte {ANCHORS} select a.cell_type, a.chr, a.start, a."end", count(p.start) cnt from anchors a left join peaks p
    on a.cell_type = p.cell_type and a.chr = p.chr and a.start < p."end" and p.start < a."end" group by 1, 2, 3, 4""", "loops", "peaks")
def overlap_count(spark, d):
    return intervals.overlap_count(_spots(spark, d), _peaks(spark, d))


@query(f"""--cte {ANCHORS} select a.cell_type, a.chr, a.start a_start, a."end" a_end, p.start b_start, p."end" b_end from anchors a join peaks p
    on a.cell_type = p.cell_type and a.chr = p.chr and a.start < p."end" and p.start < a."end" """, "loops", "peaks")
def overlap_pairs(spark, d):
    return intervals.overlap_join(_spots(spark, d).drop("center"), _peaks(spark, d))


@query(f"""--cte {ANCHORS} select a.chr, greatest(a.start, p.start) as start, least(a."end", p."end") as "end", concat_ws(':', a.chr, greatest(a.start, p.start), least(a."end", p."end"), a.cell_type) as name
    from anchors a join peaks p on a.cell_type = p.cell_type and a.chr = p.chr and a.start < p."end" and p.start < a."end" """, "loops", "peaks")
def overlap_segments(spark, d):
    return intervals.overlap_segments(_spots(spark, d), _peaks(spark, d)).select("chr", "start", "end", anchor_name().alias("name"))


@query(f"""--cte {ANCHORS} select a.cell_type, a.chr, a.center p, min(greatest(0, p.start - a.center, a.center - p."end")) dist from (select distinct cell_type, chr, center from anchors) a
    join peaks p on a.cell_type = p.cell_type and a.chr = p.chr group by 1, 2, 3""", "loops", "peaks")
def nearest_distance(spark, d):
    points = _spots(spark, d).select(CELL, "chr", F.col("center").alias("p"))
    return intervals.nearest_distance(points, _peaks(spark, d)).where("dist is not null")


@query(f"""--cte {ANCHORS} select distinct a.chr, a.start, a."end" from anchors a where cell_type <> 'A' and not exists (select 1 from anchors b where b.cell_type = 'A' and a.chr = b.chr and a.start < b."end" and b.start < a."end")""", "loops")
def neg_anchor_anti(spark, d):
    spots = _spots(spark, d).drop("center")
    others = spots.where(F.col(CELL) != "A").select("chr", "start", "end").distinct()
    return intervals.overlap_anti(others, spots.where(F.col(CELL) == "A").drop(CELL), ("chr",))


@query(f"""--cte {ANCHORS}, p as (select a.cell_type, a.chr, a.center x, b.center y from anchors a join anchors b on a.cell_type = b.cell_type and a.chr = b.chr and a.center < b.center)
    select cell_type, chr, count(*) n, cast(sum(y - x) as bigint) s from p where not exists (select 1 from loops l where l.cell_type = p.cell_type and l.chr = p.chr and l.x = p.x and l.y = p.y) group by 1, 2""", "loops")
def pair_anti_exact(spark, d):
    free = pairs.without_known(pairs.ordered_pairs(_spots(spark, d), radius=None), _loops(spark, d))
    return free.groupBy(CELL, "chr").agg(F.count("*").alias("n"), F.sum(F.col("y") - F.col("x")).alias("s"))


@query(f"""--cte {ANCHORS} select a.cell_type, a.chr, count(*) n, cast(sum(b.center - a.center) as bigint) s from anchors a join anchors b on a.cell_type = b.cell_type and a.chr = b.chr and a.center < b.center
    where a.center + 2500 < b.center - 2500 group by 1, 2""", "loops")
def all_pairs(spark, d):
    return pairs.ordered_pairs(_spots(spark, d)).groupBy(CELL, "chr").agg(F.count("*").alias("n"), F.sum(F.col("y") - F.col("x")).alias("s"))


LABELLED = f"labelled as (select {PAIRS}, case when y - x > 1000000 then 1 else 0 end as label from loops)"


@query(f"""--cte {LABELLED} select n.* from labelled n where label = 1 or not exists (select 1 from labelled p where p.label = 1 and p.cell_type = n.cell_type and p.chr = n.chr
    and n.x_start < p.x_end and p.x_start < n.x_end and n.y_start < p.y_end and p.y_start < n.y_end)""", "loops")
def pair_anti_2d(spark, d):
    out = pairs.short_loops(_loops(spark, d))
    return out.withColumns({c: F.col(c).cast("long") for c in ("x", "x_start", "x_end", "y", "y_start", "y_end")} | {"label": F.col("label").cast("int")})


@query(f"""--cte {LABELLED}, cut as (select r.chr, r.cell_type, r.value, greatest(r.start, c.start) s, least(r."end", c."end") e, c.start cs, c."end" ce, to_chr, to_start, strand from runs r join chain c on r.chr = c.chr and r.start < c."end" and c.start < r."end")
    select to_chr as chr, cast(case when strand = '-' then to_start + ce - e else to_start + s - cs end as bigint) as start, cast(case when strand = '-' then to_start + ce - s else to_start + e - cs end as bigint) as "end", cell_type, value from cut""", "loops", "runs", "chain")
def liftover(spark, d):
    return intervals.liftover(load(spark, d, "runs"), load(spark, d, "chain"))


# Negative examples.

HASH = "md5(concat_ws('|', '42', {}))"
NEG_TAIL = f"select chr, x, x - 2500 x_start, x + 2500 x_end, y, y - 2500 y_start, y + 2500 y_end, cell_type, 0 as label from"
POS = f"select {PAIRS}, 1 as label from loops"
CAND2 = """cand as (select a.cell_type, a.chr, a.center x, b.center y from {0} a join {0} b on a.cell_type = b.cell_type and a.chr = b.chr and a.center < b.center where a.center + 2500 < b.center - 2500)"""


def _draw(tag: str, cand: str, want: str, keys: str = "cell_type", known: str | None = None) -> str:
    """CTE picked<tag>: a sample of cand as the operator draws it. All pairs are numbered outright, the permutation is written out."""
    on = lambda a, b: " and ".join(f"{a}.{k.strip()} = {b}.{k.strip()}" for k in keys.split(","))
    key = f"concat_ws(',', {keys})"
    steps, own = [], ", ".join(f"s.{k.strip()}" for k in keys.split(","))
    steps.append(f"nums{tag} as (select *, row_number() over (partition by {keys} order by chr, x, y) - 1 r from {cand})")
    steps.append(f"sized{tag} as (select {own}, n, w, cast(floor(sqrt(n)) + 1 as bigint) side, {'coalesce(kn, 0)' if known else '0'} kn from (select {keys}, count(*) n from {cand} group by {keys}) s join {want} w on {on('s', 'w')}"
                 + (f" left join (select {keys}, count(*) kn from (select distinct cell_type, chr, x, y from {known}) q group by {keys}) k on {on('s', 'k')})" if known else ")"))
    steps.append(f"f{tag}0 as (select {keys}, n, w, side, k, k // side l, k % side r from (select *, unnest(range(cast(least(side * side, w + kn + side * side - n) as bigint))) k from sized{tag} where w > 0))")
    for i in range(4):
        mix = f"cast('0x' || substr(md5(concat_ws('|', '42', {key}, '{i}', r)), 1, 8) as bigint)"
        steps.append(f"f{tag}{i + 1} as (select {keys}, n, w, side, k, r l, (l + {mix}) % side r from f{tag}{i})")
    free = f" where not exists (select 1 from {known} p where p.cell_type = c.cell_type and p.chr = c.chr and p.x = c.x and p.y = c.y)" if known else ""
    steps.append(f"picked{tag} as (select c.*, s.w, row_number() over (partition by {own} order by s.k) rn from (select {keys}, w, k, l * side + r number from f{tag}4 where l * side + r < n) s join nums{tag} c on {on('s', 'c')} and c.r = s.number{free})")
    return ", ".join(steps)



def _plain(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in ("x", "x_start", "x_end", "y", "y_start", "y_end")} | {"label": F.col("label").cast("int")})


@query(f"""--cte {ANCHORS}, cells as (select distinct cell_type from loops), others as (select distinct c.cell_type, a.chr, a.center, a.start, a."end" from cells c join anchors a on a.cell_type <> c.cell_type),
    free as (select * from others o where not exists (select 1 from anchors b where b.cell_type = o.cell_type and b.chr = o.chr and o.start < b."end" and b.start < o."end")),
    ranked as (select *, row_number() over (partition by cell_type order by {HASH.format('cell_type, chr, center')}, cell_type, chr, center) rk, count(*) over (partition by cell_type) n from free),
    half as (select * from ranked where rk <= round_even(n * 0.5, 0)), {CAND2.format('half')}, want as (select cell_type, cast(floor(count(*) * 5) as bigint) w from loops group by 1), {_draw('', 'cand', 'want')}
    {POS} union all {NEG_TAIL} picked where rn <= w""", "loops")
def neg_n1(spark, d):
    return _plain(pairs.add_labels(_unique_pairs(spark, d), pairs.MODES[0]))


def _unique_pairs(spark, d):
    return _loops(spark, d)


@query(f"""--cte {ANCHORS}, {CAND2.format('anchors')}, want as (select cell_type, cast(floor(count(*) * 5) as bigint) w from loops group by 1), {_draw('', 'cand', 'want', known='loops')}
    {POS} union all {NEG_TAIL} picked where rn <= w""", "loops")
def neg_n2(spark, d):
    return _plain(pairs.add_labels(_loops(spark, d), pairs.MODES[1]))


REGIONS = f"""centers as (select cell_type, chr, cast((start + "end") // 2 as bigint) center, start, "end" from peaks),
    capped as (select * from (select *, row_number() over (partition by cell_type, chr order by {HASH.format('cell_type, chr, start, "end"')}, cell_type, chr, start, "end") rk from centers c
        where exists (select 1 from loops l where l.cell_type = c.cell_type and l.chr = c.chr)) q where rk <= 1000),
    spots as (select distinct cell_type, chr, center from capped), """


def _open(ratio: str) -> str:
    return f"""{REGIONS} {CAND2.format('spots')}, want as (select cell_type, chr, cast(round_even(count(*) * {ratio}, 0) as bigint) w from loops group by 1, 2),
    {_draw('', 'cand', 'want', 'cell_type, chr')},
    opened as ({NEG_TAIL} picked where rn <= w)"""


@query(f"--cte {_open('5')} {POS} union all select * from opened", "loops", "peaks")
def neg_n3(spark, d):
    return _plain(pairs.add_labels(_loops(spark, d), pairs.MODES[2], _peaks(spark, d)))


@query(f"""--cte {LABELLED} select n.* from labelled n where label = 1 or not exists (select 1 from labelled p where p.label = 1 and p.cell_type = n.cell_type and p.chr = n.chr
    and n.x_start < p.x_end and p.x_start < n.x_end and n.y_start < p.y_end and p.y_start < n.y_end)""", "loops")
def neg_n4(spark, d):
    return _plain(pairs.add_labels(_loops(spark, d), pairs.MODES[4]))


@query(f"""--cte {_open('2.5')}, both_ as (select {PAIRS} from loops union select {PAIRS} from opened), spots2 as (select distinct cell_type, chr, x center from both_ union select distinct cell_type, chr, y from both_),
    {CAND2.format('spots2').replace('cand as', 'cand2 as')}, want2 as (select cell_type, cast(floor(count(*) * 2.5) as bigint) w from both_ group by 1), {_draw('2', 'cand2', 'want2', known='both_')}
    {POS} union all select * from opened union all {NEG_TAIL} picked2 where rn <= w""", "loops", "peaks")
def neg_combined(spark, d):
    return _plain(pairs.add_labels(_loops(spark, d), pairs.MODES[3], _peaks(spark, d)))


@query(f"""--cte {LABELLED}, one as (select * from labelled n where label = 0 and not exists (select 1 from labelled p where p.label = 1 and p.cell_type = n.cell_type and p.chr = n.chr and p.x = n.x))
    select * from labelled where label = 1 union all select * from one n where not exists (select 1 from labelled p where p.label = 1 and p.cell_type = n.cell_type and p.chr = n.chr and p.y = n.y)""", "loops")
def neg_drop_shared(spark, d):
    return pairs.drop_shared_anchors(_labelled(spark, d)).select(*pairs.PAIR, "label")


def _labelled(spark, d):
    return _loops(spark, d).select(*pairs.PAIR, (F.col("y") - F.col("x") > pairs.LONG).cast("int").alias("label"))


@query(f"""--cte {LABELLED}, want as (select cell_type, count(*) w from labelled where label = 1 group by 1),
    picked as (select l.*, w.w, row_number() over (partition by l.cell_type order by {HASH.format('l.cell_type, l.x, l.y')}, l.x, l.y, l.chr) rn from labelled l join want w on l.cell_type = w.cell_type where label = 0)
    select {PAIRS}, label from labelled where label = 1 union all select {PAIRS}, label from picked where rn <= w""", "loops")
def neg_random(spark, d):
    return pairs.random_negatives(_labelled(spark, d))


@query(f"""--cte {LABELLED}, away as (select * from labelled where label = 0), {ANCHORS.replace('loops', 'away')}, {CAND2.format('anchors')},
    want as (select cell_type, cast(floor(count(*) * 5) as bigint) w from labelled where label = 1 group by 1), {_draw('', 'cand', 'want')} {NEG_TAIL} picked where rn <= w""", "loops")
def neg_random_pairing(spark, d):
    """New pairs of the negatives' centres, five for each positive of the cell."""
    return _plain(pairs.random_pairing(_labelled(spark, d)))


# Sampling.


@query(f"select o_orderkey from (select o_orderkey, row_number() over (order by {HASH.format('o_orderkey')}, o_orderkey) rn from orders) q where rn <= 1000")
def sample_exact_n(spark, d):
    return sampling.sample_exact(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey"), ["o_orderkey"], 42, 1000)


@query(f"select chr, cell_type, x, y from (select *, row_number() over (partition by chr order by {HASH.format('cell_type, x, y')}, cell_type, x, y) rn from loops) q where rn <= 20", "loops")
def sample_per_chr(spark, d):
    return sampling.sample_exact(_loops(spark, d).select("chr", CELL, "x", "y"), [CELL, "x", "y"], 42, 20, ["chr"])


@query(f"select o_orderkey from (select o_orderkey, row_number() over (order by {HASH.format('o_orderkey')}, o_orderkey) rn, count(*) over () n from orders) q where rn <= round_even(n * 0.5, 0)")
def sample_fraction(spark, d):
    return sampling.sample_fraction(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey"), ["o_orderkey"], 42, 0.5)


@query(f"""select o_orderkey, o_orderpriority, case when rn <= round_even(n * 0.3, 0) then 'test' else 'train' end split from
    (select o_orderkey, o_orderpriority, row_number() over (partition by o_orderpriority order by {HASH.format('o_orderkey')}, o_orderkey) rn, count(*) over (partition by o_orderpriority) n from orders) q""")
def stratified_split(spark, d):
    return sampling.train_test(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderpriority"), ["o_orderkey"], 42, 0.3, ["o_orderpriority"])


@query(f"""select o_orderkey, o_orderpriority, cast((row_number() over (partition by o_orderpriority order by {HASH.format('o_orderkey')}, o_orderkey) - 1) % 10 as int) fold from orders""")
def kfold(spark, d):
    return sampling.folds(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderpriority"), ["o_orderkey"], 42, 10, ["o_orderpriority"])


# Signal.

DENSE = f"""{ANCHORS}, spots as (select distinct cell_type, chr, start, "end" from anchors),
    met as (select a.cell_type, a.chr, a.start, a."end", r.value v, greatest(a.start, r.start) - a.start o0, least(a."end", r."end") - a.start o1 from spots a join runs r on a.cell_type = r.cell_type and a.chr = r.chr and a.start < r."end" and r.start < a."end"),
    blocks as (select m.cell_type, m.chr, m.start, m."end", b.i, sum(m.v * (least(m.o1, (b.i + 1) * 20) - greatest(m.o0, b.i * 20))) / 20.0 m from met m join range(250) b(i) on m.o0 < (b.i + 1) * 20 and b.i * 20 < m.o1 group by 1, 2, 3, 4, 5),
    ext as (select cell_type, chr, start, "end", min(m) lo, max(m) hi, count(*) c from blocks group by 1, 2, 3, 4),
    sums as (select cell_type, chr, start, "end", sum(v * (o1 - o0)) / 5000.0 mean,
        sum(v * ((case when o1 <= 2500 then o1 * (o1 + 1) / 2.0 else 6252500 - 0 - (5000 - o1) * (5000 - o1 + 1) / 2.0 end) - (case when o0 <= 2500 then o0 * (o0 + 1) / 2.0 else 6252500 - 0 - (5000 - o0) * (5000 - o0 + 1) / 2.0 end)) / 6252500.0) weighted_mean from met group by 1, 2, 3, 4),
    stats as (select s.cell_type, s.chr, s.start, s."end", coalesce(mean, 0) mean, coalesce(weighted_mean, 0) weighted_mean,
        coalesce(case when c < 250 then least(lo, 0) else lo end, 0) "min", coalesce(case when c < 250 then greatest(hi, 0) else hi end, 0) "max"
        from spots s left join sums u on s.cell_type = u.cell_type and s.chr = u.chr and s.start = u.start left join ext e on s.cell_type = e.cell_type and s.chr = e.chr and s.start = e.start)"""


@query(f"""--cte {DENSE} select cell_type, chr, start, "end", round(mean, 6) mean, round(weighted_mean, 6) weighted_mean, round("min", 6) "min", round("max", 6) "max" from stats""", "loops", "runs")
def signal_stats(spark, d):
    out = signal.signal_stats(_spots(spark, d), load(spark, d, "runs"))
    return out.select(CELL, "chr", "start", "end", *[F.round(c, 6).alias(c) for c in signal.STATS])


@query(f"""--cte {DENSE}, level as (select cell_type, avg(mean) l from stats group by 1), n as (select s.cell_type, s.chr, s.start, mean / l mean, "max" / l mx from stats s join level v on s.cell_type = v.cell_type)
    select p.cell_type, p.chr, p.x, p.y, round(a.mean, 6) x_mean, round(b.mean, 6) y_mean, round(a.mx, 6) x_max, round(b.mx, 6) y_max from loops p left join n a on a.cell_type = p.cell_type and a.chr = p.chr and a.start = p.x_start left join n b on b.cell_type = p.cell_type and b.chr = p.chr and b.start = p.y_start""", "loops", "runs")
def signal_normalised(spark, d):
    loops = _loops(spark, d)
    out = signal.normalised(loops, signal.signal_stats(pairs.anchors(loops), load(spark, d, "runs")), "S")
    return out.select(CELL, "chr", "x", "y", *[F.round(f"{s}_S_{m}", 6).alias(f"{s}_{m}") for m in ("mean", "max") for s in "xy"])


TRACKS = ["even", "odd"]
_TRACK = "case when (start {div} 25200) % 2 = 0 then 'even' else 'odd' end"
# A cell and a track in one name stand for the cell, so the SQL of one track does for all.
_EACH = f"""loops_t as (select l.* replace (l.cell_type || '|' || t.track as cell_type) from loops l, (values ('even'), ('odd')) t(track)),
    runs_t as (select r.* replace (cell_type || '|' || {_TRACK.format(div='//')} as cell_type) from runs r), {DENSE.replace('from loops', 'from loops_t').replace('join runs', 'join runs_t')},
    level as (select cell_type, avg(mean) l from stats group by 1), n as (select s.*, v.l from stats s join level v on s.cell_type = v.cell_type)"""
_WIDE = ", ".join(f"""round({s}{t}."{m}" / {s}{t}.l, 6) {s}_{t}_{m}""" for t in TRACKS for m in signal.STATS for s in "xy")
_MEET = " ".join(f"left join n {s}{t} on {s}{t}.cell_type = p.cell_type || '|{t}' and {s}{t}.chr = p.chr and {s}{t}.start = p.{s}_start" for t in TRACKS for s in "xy")


@query(f"--cte {_EACH} select p.cell_type, p.chr, p.x, p.y, {_WIDE} from loops p {_MEET}", "loops", "runs")
def tracks_wide(spark, d):
    """All statistics of several tracks on both sides of each loop: one aggregation and one pivot for all tracks."""
    loops = _loops(spark, d)
    runs = load(spark, d, "runs").withColumn("track", F.expr(_TRACK.format(div="div")))
    out = signal.tracks_wide(loops, signal.signal_stats(pairs.anchors(loops), runs, extra=("track",)), TRACKS)
    return out.select(CELL, "chr", "x", "y", *[F.round(f"{s}_{t}_{m}", 6).alias(f"{s}_{t}_{m}") for t in TRACKS for m in signal.STATS for s in "xy"])


# Motifs.

COUNTS = {"M1": np.array([[9, 0, 0, 0], [0, 9, 0, 9], [0, 0, 9, 0], [0, 0, 0, 0]]), "M2": np.array([[0, 9, 0, 4, 0], [0, 0, 0, 4, 9], [9, 0, 0, 0, 0], [0, 0, 9, 1, 0]])}
WEIGHTS = {m: motifs.weights(c) for m, c in COUNTS.items()}
CUTS = {"M1": 500, "M2": 600}
_WORDS = [(m, strand, "".join(word), int(sum(w["ACGT".index(x), k] for k, x in enumerate(word)))) for m, both in WEIGHTS.items() for strand, w in (("+", both), ("-", both[::-1, ::-1])) for word in product("ACGT", repeat=both.shape[1])]
_KMERS = ", ".join(str(x) for x in _WORDS if x[3] >= CUTS[x[0]])
_CUT = " union all ".join(f"select doc_id, {o} o, {n} l, regexp_extract_all(substr(seq, {o + 1}), '.{{{n}}}') parts from seqs" for n in sorted({w.shape[1] for w in WEIGHTS.values()}) for o in range(n))
# The words that reach the cutoff are listed, and all words of the texts are met with them.
HITS = f"""kmers(motif_id, strand, word, score) as (values {_KMERS}), cut_ as ({_CUT}), placed as (select doc_id, o, l, unnest(parts) word, generate_subscripts(parts, 1) - 1 j from cut_),
    hits as (select doc_id name, motif_id, strand, cast(o + l * j as bigint) pos, cast(score as bigint) score from placed join kmers using (word))"""


def _hits(spark, d):
    return motifs.scan(load(spark, d, "seqs"), WEIGHTS, CUTS, "doc_id", "seq")


@query(f"--cte {HITS} select * from hits", "seqs")
def motif_scan(spark, d):
    return _hits(spark, d)


@query(f"""--cte {HITS} select name, {', '.join(f"count(*) filter (motif_id = '{m}' and strand = '{s}') as {m}_{t}" for m in COUNTS for s, t in (('+', 'f'), ('-', 'r')))} from hits group by 1""", "seqs")
def motif_pivot(spark, d):
    return motifs.motif_pivot(_hits(spark, d), list(COUNTS), ["name"])


def _documents(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").count()


_SPOT = "((center {div} 1000) * 131 + ascii(chr) * 17 + ascii(cell_type)) % {n}"


def _spot_counts(spark, d):
    """Anchors with the motif counts of the document whose id follows from their place."""
    wide = motifs.motif_pivot(_hits(spark, d), list(COUNTS), ["name"])
    spots = _spots(spark, d).withColumn("name", F.expr(_SPOT.format(div="div", n=_documents(spark, d))))
    return spots.join(wide, "name").select(CELL, "chr", "start", "end", *motifs.names(list(COUNTS)))


_W = ", ".join(f"count(*) filter (motif_id = '{m}' and strand = '{s}') as {m}_{t}" for m in COUNTS for s, t in (("+", "f"), ("-", "r")))
_XY = ", ".join(f"case when a.chr is null or b.chr is null then 0 else {q}.{m}_{t if q == 'a' else {'f': 'r', 'r': 'f'}[t]} end as {p}_{m}_{t}" for q, p in (("a", "x"), ("b", "y")) for m in COUNTS for t in "fr")


_SC = f"""wide as (select name, {_W} from hits group by 1), sc as (select a.cell_type, a.chr, a.start, w.* from {{0}} a join wide w on {_SPOT.format(div='//', n='(select count(*) from documents)')} = w.name)"""


@query(f"""--cte {ANCHORS}, {HITS}, {_SC.format('anchors')}
    select p.cell_type, p.chr, p.x, p.y, {_XY} from loops p left join sc a on a.cell_type = p.cell_type and a.chr = p.chr and a.start = p.x_start left join sc b on b.cell_type = p.cell_type and b.chr = p.chr and b.start = p.y_start""", "loops", "seqs")
def motif_merge(spark, d):
    return motifs.motif_merge(_loops(spark, d).select(CELL, "chr", "x", "y", "x_start", "x_end", "y_start", "y_end"), _spot_counts(spark, d), list(COUNTS)).drop("x_start", "x_end", "y_start", "y_end")


@query("""select 's' || s.doc_id chr, o_orderkey % greatest(length(seq) - 19, 1) as start, o_orderkey % greatest(length(seq) - 19, 1) + 20 as "end", 'n' || o_orderkey as name,
    substr(s.seq, cast(o_orderkey % greatest(length(seq) - 19, 1) + 1 as bigint), 20) seq from orders o join seqs s on s.doc_id = o.o_orderkey % (select count(*) from documents)""", "seqs")
def sequence_slice(spark, d):
    seqs = load(spark, d, "seqs")
    o = spark.read.parquet(f"{d}/orders.parquet").withColumn("doc_id", F.col("o_orderkey") % _documents(spark, d))
    start = F.col("o_orderkey") % F.greatest(F.col("letters") - 19, F.lit(1))
    o = o.join(seqs.select("doc_id", F.length("seq").alias("letters")), "doc_id")
    parts = o.select(F.concat(F.lit("s"), "doc_id").alias("chr"), start.alias("start"), (start + 20).alias("end"), F.concat(F.lit("n"), F.col("o_orderkey").cast("string")).alias("name"))
    return motifs.slices(parts, seqs.select(F.concat(F.lit("s"), "doc_id").alias("chr"), "seq"))


# Sets and columns.


def _genome(spark, d):
    """The documents' sequences as FASTA files in lines of 60 letters, written anew; every name is that of a chromosome."""
    path = settled_files.scratch(spark)
    seq = F.regexp_replace("seq", "(.{60})", "$1\n")
    writers.fasta(load(spark, d, "seqs").select(F.concat(F.lit("NC_1 chromosome s"), "doc_id", F.lit(", whole")).alias("name"), seq.alias("seq")), path)
    return path


@query("""select 'chrs' || doc_id chr, cast(c as int) chunk, md5(substr(seq, c * 512 + 1, 532)) letters from (select doc_id, seq, unnest(range(greatest(1, (length(seq) + 511) // 512))) c from seqs) q""", "seqs")
def fasta_chunks(spark, d):
    made = readers.fasta_chunks(spark, _genome(spark, d), reach=20, width=512, size=1 << 18)
    return made.select("chr", "chunk", F.md5("seq").alias("letters"))


@query("""select 'chrs' || s.doc_id chr, o_orderkey % greatest(length(seq) - 19, 1) as start, o_orderkey % greatest(length(seq) - 19, 1) + 20 as "end", 'n' || o_orderkey as name,
    substr(s.seq, cast(o_orderkey % greatest(length(seq) - 19, 1) + 1 as bigint), 20) seq from orders o join seqs s on s.doc_id = o.o_orderkey % (select count(*) from documents) where seq <> ''""", "seqs")
def fasta_slice(spark, d):
    seqs = load(spark, d, "seqs").where("seq != ''").select("doc_id", F.length("seq").alias("letters"))
    o = spark.read.parquet(f"{d}/orders.parquet").withColumn("doc_id", F.col("o_orderkey") % _documents(spark, d)).join(seqs, "doc_id")
    start = F.col("o_orderkey") % F.greatest(F.col("letters") - 19, F.lit(1))
    parts = o.select(F.concat(F.lit("chrs"), "doc_id").alias("chr"), start.alias("start"), (start + 20).alias("end"), F.concat(F.lit("n"), F.col("o_orderkey").cast("string")).alias("name"))
    return motifs.slices_of_chunks(parts, readers.fasta_chunks(spark, _genome(spark, d), reach=20, width=4096, size=1 << 20), 4096)


CHAINS = f"""c as (select c_custkey k, {_chr('c_custkey')} chr, (c_custkey * 7919) % 3000 * 1000 s, 1000 + c_custkey % 700 a, 500 + c_custkey % 311 b, 2000 + c_custkey % 97 c, c_custkey % 5 * 100 g, c_custkey % 7 * 50 h, c_custkey % 3 * 70 i, c_custkey % 4 * 30 j,
        {_chr('(c_custkey * 5)')} to_chr, 10000000 size, case when c_custkey % 2 = 1 then '-' else '+' end strand, (c_custkey * 104729) % 5000 * 1000 q, 1000 + (c_custkey * 31) % 997 score from {{customer}})"""
# Every place's best chain, by pieces between all edges of blocks and runs; pieces of one block in a row are put together.
LIFTED = """blocks as (select k, chr, s as start, s + a as "end", to_chr, q, a as len, strand, size, score from c union all select k, chr, s + a + g, s + a + g + b, to_chr, q + a + h, b, strand, size, score from c
        union all select k, chr, s + a + g + b + i, s + a + g + b + i + c, to_chr, q + a + h + b + j, c, strand, size, score from c),
    forward as (select *, case when strand = '-' then size - q - len else q end to_start from blocks),
    met as (select r.cell_type, r.value, r.start rs, r.chr, f.k, f.score, f.start fs, f."end" fe, to_chr, to_start, strand, greatest(r.start, f.start) a, least(r."end", f."end") z from runs r join forward f on r.chr = f.chr and r.start < f."end" and f.start < r."end"),
    edges as (select distinct chr, rs, cell_type, value, e from (select chr, rs, cell_type, value, unnest([a, z]) e from met) q),
    pieces as (select chr, rs, cell_type, value, e p, lead(e) over (partition by chr, rs, cell_type, value order by e) n from edges),
    won as (select p.p, p.n, m.*, row_number() over (partition by p.chr, p.rs, p.cell_type, p.value, p.p order by m.score desc, m.k) w from pieces p join met m on m.chr = p.chr and m.rs = p.rs and m.cell_type = p.cell_type and m.value = p.value and m.a <= p.p and p.n <= m.z),
    rows_ as (select *, coalesce(p <> lag(n) over (partition by chr, rs, cell_type, value, k, fs order by p), true) fresh from won where w = 1),
    whole as (select *, sum(fresh::int) over (partition by chr, rs, cell_type, value, k, fs order by p) island from rows_),
    parts as (select chr, rs, cell_type, value, k, fs, any_value(fe) fe, any_value(to_chr) to_chr, any_value(to_start) to_start, any_value(strand) strand, min(p) p, max(n) n from whole group by chr, rs, cell_type, value, k, fs, island)"""


@query(f"""--cte {CHAINS.format(customer='customer')}, {LIFTED} select to_chr as chr, cast(case when strand = '-' then to_start + fe - n else to_start + p - fs end as bigint) as start, cast(case when strand = '-' then to_start + fe - p else to_start + n - fs end as bigint) as "end", cell_type, value from parts""", "runs")
def chain_liftover(spark, d):
    """Runs through chains that are written as a chain file and read back: three blocks a chain, the best chain at each place."""
    path = settled_files.scratch(spark)
    c = spark.sql(f"with {CHAINS} select * from c", customer=spark.read.parquet(f"{d}/customer.parquet"))
    head = F.concat_ws(" ", F.lit("chain"), "score", F.concat(F.lit("chr"), "chr"), F.lit("99999999"), F.lit("+"), "s", F.expr("s + a + g + b + i + c"), F.concat(F.lit("chr"), "to_chr"), "size", "strand", "q", F.expr("q + a + h + b + j + c"), "k")
    lines = [F.concat_ws(" ", "a", "g", "h"), F.concat_ws(" ", "b", "i", "j"), F.col("c").cast("string")]
    c.select(F.concat_ws("\n", head, *lines, F.lit("")).alias("value")).write.text(path)
    return intervals.liftover(load(spark, d, "runs"), chains.best(chains.blocks(spark, path)))


@query("select chr, x, y, cell_type, null as extra from loops union all select chr, start, null, cell_type, \"end\" from peaks", "loops", "peaks")
def concat_aligned(spark, d):
    return features.concat_aligned([_loops(spark, d).select("chr", "x", "y", CELL), _peaks(spark, d).select("chr", F.col("start").alias("x"), CELL, F.col("end").alias("extra"))])


@query(f"--cte {LABELLED} select x, y, label, cell_type from labelled", "loops")
def feature_select(spark, d):
    return features.select_features(_labelled(spark, d), ["x", "y"])


@query(f"""--cte {ANCHORS}, named as (select concat_ws(':', chr, start, "end", cell_type) as name from anchors)
    select name, split_part(name, ':', 1) chr, cast(split_part(name, ':', 2) as bigint) as start, cast(split_part(name, ':', 3) as bigint) as "end", split_part(name, ':', 4) cell_type from named""", "loops")
def anchor_names(spark, d):
    """Names of anchors, and the columns that they are split back into."""
    named = intervals.name_segments(_spots(spark, d).withColumnsRenamed({"start": "a_start", "end": "a_end"}).select("*", F.col("a_start").alias("start"), F.col("a_end").alias("end")), CELL)
    return named.select("name", *intervals.split_name())


@query("""--cte seen as (select cell_type, chr, avg(case when value > 50 then value end) high from runs group by 1, 2)
    select p.cell_type, p.chr, p.start, p."end", round(coalesce(s.high, 0), 6) high from peaks p left join seen s on s.cell_type = p.cell_type and s.chr = p.chr""", "peaks", "runs")
def missing_as_zero(spark, d):
    """Peaks with the mean of their chromosome's high runs: 0 where there are none, be that null or NaN."""
    high = F.sum(F.when(F.col("value") > 50, F.col("value")).otherwise(0.0)) / F.nullif(F.count_if(F.col("value") > 50), F.lit(0))
    seen = load(spark, d, "runs").groupBy(CELL, "chr").agg(F.coalesce(high, F.lit(float("nan"))).alias("high"))
    return _peaks(spark, d).join(seen, [CELL, "chr"], "left").select(CELL, "chr", "start", "end", F.round(zero_if_missing("high"), 6).alias("high"))


@query("select cell_type, cast(y - x as int) distance, label from labelled_".replace("labelled_", f"(select cell_type, x, y, case when y - x > 1000000 then 1 else 0 end as label from loops) q"), "loops")
def training_columns(spark, d):
    return features.training(features.with_distance(_labelled(spark, d)))


@query(f"--cte {HITS} select name, count(*) total, count(*) filter (strand = '+') forward from hits group by 1", "seqs")
def motif_totals(spark, d):
    """Each sequence's hits of all motifs and strands, as sums over the wide table's columns."""
    wide = motifs.motif_pivot(_hits(spark, d), list(COUNTS), ["name"])
    every = motifs.names(list(COUNTS))
    return wide.select("name", row_sum(every).cast("long").alias("total"), row_sum([c for c in every if c.endswith("_f")]).cast("long").alias("forward"))


@query(f"""--cte {LABELLED}, shown as (select case when label = 1 and x % 3 = 0 then null else x end x, case when y % 5 = 0 then null else y end y, case when y % 7 = 0 then null when label = 1 and y % 11 = 0 then 'NaN'::double else y - x end d from labelled)
    select count(*) n, count(*) filter (x is null or y is null or d is null or isnan(d)) dropped, count(*) filter (x is null) no_x, count(*) filter (y is null) no_y, count(*) filter (d is null or isnan(d)) no_d from shown""", "loops")
def null_report(spark, d):
    lacking = lambda where, c: F.when(~where, c)
    label, x, y = F.col("label") == 1, F.col("x"), F.col("y")
    far = F.when(y % 7 == 0, None).when(label & (y % 11 == 0), float("nan")).otherwise((y - x).cast("double"))
    shown = _labelled(spark, d).select(lacking(label & (x % 3 == 0), x).alias("x"), lacking(y % 5 == 0, y).alias("y"), far.alias("d"))
    return features.drop_nulls(shown)[1].withColumnsRenamed({"_rows": "n", "_dropped": "dropped", "x": "no_x", "y": "no_y", "d": "no_d"})


# Evaluation.

_CM = "cm as (select grp, count(*) filter (label = 1 and pred = 1) tp, count(*) filter (label = 0 and pred = 1) fp, count(*) filter (label = 1 and pred = 0) fn, count(*) filter (label = 0 and pred = 0) tn from preds group by 1)"
_OVER = "case when {1} = 0 then 0.0 else cast({0} as double) / ({1}) end"
_MET = f"""met as (select grp, {_OVER.format('(tp + tn)', '(tp + fp + fn + tn)')} accuracy, {_OVER.format('tp', '(tp + fp)')} as precision_, {_OVER.format('tp', '(tp + fn)')} recall, {_OVER.format('2 * tp', '(2 * tp + fp + fn)')} f1,
    ({_OVER.format('tp', '(tp + fn)')} + {_OVER.format('tn', '(tn + fp)')}) / 2 roc_auc, case when (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 then 0.0 else (cast(tp as double) * tn - cast(fp as double) * fn) / sqrt(cast(tp + fp as double) * (tp + fn) * (tn + fp) * (tn + fn)) end mcc from cm)"""


def _rounded(df: DataFrame, *first: str) -> DataFrame:
    return df.select(*first, *[F.round(m, 6).alias(m) for m in ev.METRICS])


_R = ", ".join(f"round({'precision_' if m == 'precision' else m}, 6) as \"{m}\"" for m in ev.METRICS)


@query(f"--cte {_CM} select * from cm", "preds")
def confusion(spark, d):
    return ev.confusion(load(spark, d, "preds"))


@query(f"--cte {_CM}, {_MET} select grp, {_R} from met", "preds")
def metrics_binary(spark, d):
    return _rounded(ev.binary_metrics(load(spark, d, "preds")), "grp")


_AVG = ", ".join(f"round(avg({'precision_' if m == 'precision' else m}), 6) as \"{m}\"" for m in ev.METRICS)


@query(f"--cte {_CM}, {_MET} select {_AVG} from met", "preds")
def metrics_mean(spark, d):
    return _rounded(ev.mean_metrics(ev.binary_metrics(load(spark, d, "preds"))))


@query("""--cte per as (select grp, pred score, count(*) filter (label = 1) p, count(*) filter (label = 0) n from preds group by 1, 2), cum as (select grp, score, sum(p) over w p, sum(n) over w n, sum(p) over (partition by grp) tp, sum(n) over (partition by grp) tn from per window w as (partition by grp order by score desc))
    select grp, score, round(case when tp = 0 then 0 else cast(p as double) / tp end, 6) tpr, round(case when tn = 0 then 0 else cast(n as double) / tn end, 6) fpr from cum""", "preds")
def roc_points(spark, d):
    return ev.roc_points(load(spark, d, "preds")).select("grp", "score", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


_C = ["l_quantity", "l_extendedprice", "l_discount"]


@query(" union all ".join(f"select '{a}' a, '{b}' b, round(corr({a}, {b}), 6) corr from lineitem" for i, a in enumerate(_C) for b in _C[i:]))
def corr_matrix(spark, d):
    return ev.correlations(spark.read.parquet(f"{d}/lineitem.parquet"), _C).withColumn("corr", F.round("corr", 6))


@query("select event_type grp, min(value) lowest, round(quantile_cont(value, 0.25), 6) q25, round(quantile_cont(value, 0.5), 6) q50, round(quantile_cont(value, 0.75), 6) q75, max(value) highest from events group by 1")
def group_quantiles(spark, d):
    out = ev.quantiles(spark.read.parquet(f"{d}/events.parquet").withColumnRenamed("event_type", "grp"), "grp", "value")
    return out.select("grp", "lowest", *[F.round(q, 6).alias(q) for q in ("q25", "q50", "q75")], "highest")


@query(f"""--cte {LABELLED}, v as (select cell_type, label, log10(y - x) v from labelled),
    st as (select *, bw / 16 fine, (hi - lo + 6 * bw) / 199 step, lo - 3 * bw low from (select cell_type, label, count(*) n, min(v) lo, max(v) hi, stddev_samp(v) * pow(count(*), -0.2) bw from v group by 1, 2) q where lo < hi),
    cells as (select cell_type, label, c, count(*) m, sum(w - c) f from (select v.cell_type, v.label, (v - lo) / fine w, floor((v - lo) / fine) c from v join st on v.cell_type = st.cell_type and v.label = st.label) q group by 1, 2, 3),
    nodes as (select cell_type, label, c, m - f as mass from cells union all select cell_type, label, c + 1, f from cells),
    points as (select *, low + point * step as x from (select *, unnest(range(0, 200)) point from st) q)
    select p.cell_type, p.label, cast(p.point as int) point, round(p.x, 6) as "at", round(coalesce(sum(mass * exp(-pow((p.x - lo - c * fine) / bw, 2) / 2)) / (n * bw * sqrt(2 * pi())), 0), 6) density
    from points p left join nodes k on k.cell_type = p.cell_type and k.label = p.label and abs(p.x - lo - c * fine) <= 6 * bw group by p.cell_type, p.label, p.point, p.x, n, bw""", "loops")
def density_by_group(spark, d):
    """Densities of the pairs' log distances by cell and label."""
    df = _labelled(spark, d).select(CELL, "label", F.log10(F.col("y") - F.col("x")).alias("v"))
    return density.densities(df, [CELL, "label"], "v").select(CELL, "label", "point", F.round("at", 6).alias("at"), F.round("density", 6).alias("density"))


@query("select cell_type, count(*) n, count(*) filter (y - x > 1000000) far, count(*) filter (chr = 'X') on_x from loops group by 1", "loops")
def count_by_predicate(spark, d):
    return _loops(spark, d).groupBy(CELL).agg(F.count("*").alias("n"), F.count_if(F.col("y") - F.col("x") > 1_000_000).alias("far"), F.count_if(F.col("chr") == "X").alias("on_x"))


@query("select p_partkey, p_retailprice from part order by p_retailprice desc, p_partkey limit 20")
def top_features(spark, d):
    return ev.top(spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_retailprice"), "p_retailprice", 20, ["p_partkey"])


# Whole tables and models.


def _assembled(spark, d, mode):
    from anchorloom.plans import workflow

    out = workflow.assemble(_loops(spark, d), mode, {"CTCF": _peaks(spark, d)}, {"DNase": load(spark, d, "runs")}, _spot_counts(spark, d), list(COUNTS))
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) if t == "string" else F.col(c).cast("long").alias(c) for c, t in out.dtypes])


_AT = "{0}.cell_type = p.cell_type and {0}.chr = p.chr and {0}."
_SIDES = ", ".join(f"c{s}.n {s}_CTCF_counts, n{s}.dist {s}_CTCF_distance, " + ", ".join(f"""round(s{s}."{m}" / v.l, 6) "{s}_DNase_{m}\"""" for m in signal.STATS) for s in "xy")
_JOINS = " ".join(f"""join cnt c{s} on {_AT.format(f'c{s}')}start = p.{s}_start join near n{s} on {_AT.format(f'n{s}')}center = p.{s} join stats s{s} on {_AT.format(f's{s}')}start = p.{s}_start""" for s in "xy")
FEATURES = f"""lab as materialized (select {PAIRS}, max(label) as label from lab0 group by {PAIRS}), {DENSE.replace(ANCHORS, ANCHORS.replace('loops', 'lab'))},
    cnt as (select a.cell_type, a.chr, a.start, count(p.start) n from (select distinct cell_type, chr, start, "end" from anchors) a left join peaks p on a.cell_type = p.cell_type and a.chr = p.chr and a.start < p."end" and p.start < a."end" group by 1, 2, 3),
    near as (select a.cell_type, a.chr, a.center, min(greatest(0, p.start - a.center, a.center - p."end")) dist from (select distinct cell_type, chr, center from anchors) a join peaks p on a.cell_type = p.cell_type and a.chr = p.chr group by 1, 2, 3),
    level as (select cell_type, avg(mean) l from stats group by 1), {ANCHORS.replace('anchors', 'own')}, {HITS}, {_SC.format('own')},
    hit as materialized (select distinct p.cell_type, p.chr, p.x, p.y from lab p join lab q on q.cell_type = p.cell_type and q.chr = p.chr and p.x_start < q.x_end and q.x_start < p.x_end and p.y_start < q.y_end and q.y_start < p.y_end
        where p.label = 0 and q.label = 1)
    select p.*, p.y - p.x distance, {_SIDES}, {_XY} from lab p join level v on v.cell_type = p.cell_type {_JOINS}
    left join sc a on {_AT.format('a')}start = p.x_start left join sc b on {_AT.format('b')}start = p.y_start
    where not exists (select 1 from hit h where h.cell_type = p.cell_type and h.chr = p.chr and h.x = p.x and h.y = p.y)"""

for _name, _mode in (("human_n1", 0), ("human_n2", 1), ("human_n3", 2), ("fly_n4", 4)):
    QUERIES[f"features_{_name}"] = lambda spark, d, m=_mode: _assembled(spark, d, pairs.MODES[m])
    _labels = ORACLE_SQL[f"neg_{_name.rpartition('_')[2]}"]
    ORACLE_SQL[f"features_{_name}"] = f"{with_clause('loops', 'peaks', 'runs', 'seqs')}, lab0 as ({_labels}), {FEATURES}"


def _model_input(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("lang").alias(CELL), "n_chars", F.length(F.regexp_replace("text", "[^*#$%&|!]+", "")).alias("marks"), F.size(F.split("text", "\n")).alias("rows"))
    return docs.join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", F.col("quality").alias("label")), "doc_id")


for _kind in ("logistic_regression", "random_forest", "gradient_boosting", "decision_tree"):

    def _train(spark, d, kind=_kind):
        from anchorloom.ml import training

        return training.within(_model_input(spark, d), kind, ["doc_id"])

    QUERIES[f"train_{_kind}"] = _train


@query()
def train_leafwise(spark, d):
    """Metrics of each cell's leaf-wise trees on the cell's own test rows."""
    from anchorloom.ml import boosting, training

    df = _model_input(spark, d)
    data = settled_files.settled(sampling.train_test(df, ["doc_id"], training.SEED, 0.3, [CELL, "label"]))
    parts = []
    for cell in training.cells_of(data):
        own = data.where(F.col(CELL) == cell)
        model = boosting.fit(own.where("split = 'train'"), training.inputs(df, ["doc_id"]), trees=10, leaves=15, bins=64)
        parts.append(boosting.predict(own.where("split = 'test'"), model).select(F.col(CELL).alias("grp"), "label", F.col("prediction").alias("pred")))
    return ev.binary_metrics(training._union(parts))


@query()
def tree_shap(spark, d):
    """Every labelled document's contributions by column to the margin of leaf-wise trees fitted on all of them."""
    from anchorloom.ml import boosting, shap, training

    df = _model_input(spark, d)
    model = boosting.fit(df, training.inputs(df, ["doc_id"]), trees=10, leaves=15, bins=64)
    return shap.tree_shap(df.select("doc_id", *model.columns), model)


@query()
def loco_eval(spark, d):
    from anchorloom.ml import training

    return training.across(_model_input(spark, d), "decision_tree")


def _newton(steps: int, learnt: str = "z.cell <> t.cell") -> str:
    """Regressions on two columns, each of the rows of z that are learnt from for its cell, by written-out Newton steps from 0."""
    out = "it0 as (select distinct cell, 0::double a1, 0::double a2, 0::double a0 from z)"
    for i in range(steps):
        out += f""", s{i} as materialized (select cell, a1, a2, a0, s1, s2, sum(e * z1) + a1 * s1 g1, sum(e * z2) + a2 * s2 g2, sum(e) g0, sum(q * z1 * z1) + s1 h11, sum(q * z1 * z2) h12, sum(q * z1) h10, sum(q * z2 * z2) + s2 h22, sum(q * z2) h20, sum(q) h00
            from (select t.cell, a1, a2, a0, z1, z2, 1 / pow(d1, 2) s1, 1 / pow(d2, 2) s2, 1 / (1 + exp(-(a1 * z1 + a2 * z2 + a0))) - label e, 1 / (1 + exp(-(a1 * z1 + a2 * z2 + a0))) / (1 + exp(a1 * z1 + a2 * z2 + a0)) q from it{i} t join z on {learnt}) r group by cell, a1, a2, a0, s1, s2),
            it{i + 1} as materialized (select cell, a1 - (g1 * (h22 * h00 - h20 * h20) - h12 * (g2 * h00 - g0 * h20) + h10 * (g2 * h20 - g0 * h22)) / det a1, a2 - (h11 * (g2 * h00 - g0 * h20) - g1 * (h12 * h00 - h10 * h20) + h10 * (h12 * g0 - h10 * g2)) / det a2,
            a0 - (h11 * (h22 * g0 - h20 * g2) - h12 * (h12 * g0 - h10 * g2) + g1 * (h12 * h20 - h10 * h22)) / det a0 from (select *, h11 * (h22 * h00 - h20 * h20) - h12 * (h12 * h00 - h20 * h10) + h10 * (h12 * h20 - h22 * h10) det from s{i}) r)"""
    return out


@query(f"""with x as (select lang cell, quality label, length(regexp_replace(text, '[^*#$%&|!]', '', 'g'))::double x1, len(string_split(text, chr(10)))::double x2 from documents d join labels l on l.doc_id = d.doc_id where lang is not null and quality is not null and text is not null),
    z as materialized (select cell, label, (x1 - m1) / d1 z1, (x2 - m2) / d2 z2, d1, d2 from x, (select avg(x1) m1, avg(x2) m2, stddev_pop(x1) d1, stddev_pop(x2) d2 from x) q), {_newton(20)}
    select z.cell grp, round(a1 / d1, 6) w_marks, round(a2 / d2, 6) w_rows, {', '.join(f"count(*) filter (label = {a} and (a1 * z1 + a2 * z2 + a0 > 0) = {bool(b)}) {n}" for n, a, b in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0)))}
    from z join it20 t on t.cell = z.cell group by z.cell, a1, a2, d1, d2""")
def loco_shared(spark, d):
    """Confusion counts of regressions on two columns, each fitted without its cell, all in the same scans."""
    from anchorloom.ml import leave_out

    df, columns = settled_files.settled(_model_input(spark, d)), ["marks", "rows"]
    model = leave_out.fit(df, columns)
    made = leave_out.predict(df, model).where("prediction is not null and label is not null").select(F.col(CELL).alias("grp"), "label", F.col("prediction").alias("pred"))
    weights = spark.createDataFrame([(n, *map(float, w)) for n, w in zip(model.cells, model.weights, strict=True)], "grp string, w_marks double, w_rows double")
    return ev.confusion(made).join(F.broadcast(weights), "grp").select("grp", F.round("w_marks", 6).alias("w_marks"), F.round("w_rows", 6).alias("w_rows"), "tp", "fp", "fn", "tn")


def _experiment_sql(more: str, learnt: str, judged: str, grp: str) -> str:
    """Metrics of regressions on two columns; more: columns (cell, split) of x, learnt and judged: which rows z of t's cell."""
    return f"""with x as (select {more}, quality label, length(regexp_replace(text, '[^*#$%&|!]', '', 'g'))::double x1, len(string_split(text, chr(10)))::double x2 from documents d join labels l on l.doc_id = d.doc_id where lang is not null and quality is not null and text is not null),
    z as materialized (select cell, split, label, (x1 - m1) / d1 z1, (x2 - m2) / d2 z2, d1, d2 from x, (select avg(x1) m1, avg(x2) m2, stddev_pop(x1) d1, stddev_pop(x2) d2 from x) q), {_newton(20, learnt)},
    preds as (select {grp} grp, label, cast(a1 * z1 + a2 * z2 + a0 > 0 as int) pred from z join it20 t on {judged}), {_CM}, {_MET}
    select cm.*, {_R} from cm join met using (grp)"""


_RANKED = "row_number() over (partition by {0} order by " + HASH.format("d.doc_id") + ", d.doc_id)"
_HELD = f"case when {_RANKED.format('lang, quality')} <= round_even(count(*) over (partition by lang, quality) * 0.2, 0) then 'test' else 'train' end"


def _experiment(spark, d, run, **how):
    df = _model_input(spark, d).select("doc_id", CELL, "label", "marks", "rows")
    out = run(df, "logistic_regression", ["doc_id"], **how)
    return out.confusion.join(_rounded(out.metrics, "grp"), "grp")


@query(_experiment_sql(f"lang cell, {_HELD} split", "z.cell = t.cell and z.split = 'train'", "z.cell = t.cell and z.split = 'test'", "z.cell"))
def experiment_within(spark, d):
    """Each cell's regression on its own test rows: confusion counts and metrics."""
    from anchorloom.ml import experiment

    return _experiment(spark, d, experiment.within_cells)


@query(_experiment_sql("lang cell, '' split", "z.cell <> t.cell", "z.cell = t.cell", "z.cell"))
def experiment_across(spark, d):
    """Each cell's rows by the regression of all other cells."""
    from anchorloom.ml import experiment

    return _experiment(spark, d, experiment.across_cells)


@query(_experiment_sql(f"({_RANKED.format('quality')} - 1) % 5 cell, '' split", "z.cell <> t.cell", "z.cell = t.cell", "'all'"))
def experiment_folds(spark, d):
    """All rows by the regression that did not see their fold, five folds."""
    from anchorloom.ml import experiment

    return _experiment(spark, d, experiment.by_folds)


@query()
def experiment_tuned(spark, d):
    """Trees with settings searched for each cell: metrics on test rows, the setting found and the column of most weight."""
    from anchorloom.ml import experiment

    out = experiment.within_cells(_model_input(spark, d), "decision_tree", ["doc_id"], tuning=experiment.Tuning())
    first = {}
    for cell, feature, _ in out.weights:
        first.setdefault(cell, feature)
    found = [(c, json.dumps(out.settings.get(c, {}), sort_keys=True), first.get(c)) for c in out.models]
    return out.metrics.join(spark.createDataFrame(found, "grp string, setting string, first string"), "grp")


@query()
def cv_eval(spark, d):
    from anchorloom.ml import training

    return ev.binary_metrics(training.cross_predicted(_model_input(spark, d), "decision_tree", ["doc_id"]).withColumn("grp", F.lit("all")), label="label", pred="prediction")


@query()
def tune(spark, d):
    from anchorloom.ml import training

    best, score = training.optimise(_model_input(spark, d), "decision_tree", ["doc_id"])
    return spark.createDataFrame([(k, str(v), score) for k, v in sorted(best.items())] or [("default", "", score)], "parameter string, value string, score double")
