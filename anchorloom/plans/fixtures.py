"""Genomic-like tables derived from the driver's tables, as SQL that runs in Spark and, with sql(duckdb=True), in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _chr(k: str) -> str:
    return f"case when {k} % 24 = 22 then 'X' when {k} % 24 = 23 then 'Y' else cast({k} % 24 + 1 as varchar(2)) end"


def _cell(k: str) -> str:
    return f"case when {k} % 3 = 0 then 'A' when {k} % 3 = 1 then 'B' else 'C' end"


def sql(duckdb: bool = False) -> dict[str, str]:
    div, all_ = ("//", ", 'g'") if duckdb else ("div", "")
    end = '"end"' if duckdb else "`end`"
    return {
        "raw_loops": f"""select distinct {_chr('o_custkey')} chr, {_cell('o_orderkey')} cell_type, x - 2400 + o_custkey % 2 x1, x + 2601 x2, y - 2400 y1, y + 2600 + o_custkey % 4 y2
            from (select o_custkey, o_orderkey, ((o_orderkey*7919) % 2000)*1000 + 5000 as x,
                ((o_orderkey*7919) % 2000)*1000 + 5000 + 6000 + ((o_custkey*104729 + o_orderkey) % 1500)*1000 as y from orders) q""",
        "loops": f"""select distinct {_chr('o_custkey')} chr, x, x-2500 x_start, x+2500 x_end, y, y-2500 y_start, y+2500 y_end, {_cell('o_orderkey')} cell_type
            from (select o_custkey, o_orderkey, ((o_orderkey*7919) % 2000)*1000 + 5000 as x,
                ((o_orderkey*7919) % 2000)*1000 + 5000 + 6000 + ((o_custkey*104729 + o_orderkey) % 1500)*1000 as y from orders) q""",
        "peaks": f"""select distinct {_cell('l_suppkey')} cell_type, {_chr('l_partkey')} chr, (l_orderkey*6101 + l_partkey*37) % 3500000 as start,
            (l_orderkey*6101 + l_partkey*37) % 3500000 + 150 + (l_suppkey*13) % 900 as {end} from lineitem""",
        "runs": f"""select {_cell(f'(event_id {div} 24)')} cell_type, {_chr('event_id')} chr, (event_id {div} 72)*25200 as start,
            (event_id {div} 72)*25200 + 12000 + (event_id*37) % 12000 as {end}, value from events""",
        "seqs": f"""select doc_id, translate(regexp_replace(text,'[^a-z]',''{all_}),'abcdefghijklmnopqrstuvwxyz','ACGTACGTACGTACGTACGTACGTAC') seq from documents""",
        "preds": """select d.lang grp, l.quality label, case when d.n_chars > 800 then 1 else 0 end pred from labels l join documents d on d.doc_id = l.doc_id""",
        "chain": f"""select * from (values ('1', 0, 400000, '2', 1000000, '+'), ('1', 400000, 900000, '2', 0, '-'), ('2', 100000, 700000, 'X', 5000, '+'), ('3', 0, 3000000, '3', 77, '-'))
            v(chr, start, {end}, to_chr, to_start, strand)""",
    }


NEEDS = {"raw_loops": "orders", "loops": "orders", "peaks": "lineitem", "runs": "events", "seqs": "documents", "preds": "labels documents", "chain": ""}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture over the tables of sf_dir."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in NEEDS[name].split()}
    text = sql()[name]
    for t in tables:
        for before in ("from ", "join "):
            text = text.replace(f"{before}{t}", f"{before}{{{t}}}")
    return spark.sql(text, **tables)


def with_clause(*names: str) -> str:
    made = sql(duckdb=True)
    return "with " + ", ".join(f"{n} as ({made[n]})" for n in names)
