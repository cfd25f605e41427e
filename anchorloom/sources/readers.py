"""Readers of loop tables, peaks, signal, sequences and motifs: one DataFrame each, cells and tracks as columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorloom.functions.genomic import CELL, bare_chr, middle_even, middle_floor, windowed
from anchorloom.sources.fasta import CHUNK, RANGE, chunks

BED = "chr string, start int, end int"
LOOPS = "chr1 string, x1 long, x2 long, chr2 string, y1 long, y2 long"
MOST_MOTIFS = 10_000
FLY_CHROMOSOMES = ["chr2L", "chr2R", "chr3L", "chr3R", "chr4", "chrX", "chrY"]


def tsv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Tab-separated with a header; gz is read as it is. schema picks columns by name; without it types are inferred."""
    if schema is None:
        return spark.read.csv(path, sep="\t", header=True, inferSchema=True)
    raw = spark.read.csv(path, sep="\t", header=True)
    return raw.select(*[F.col(n).cast(t).alias(n) for n, t in (f.split() for f in schema.split(", "))])


def bed(spark: SparkSession, path: str, suffix: str = "*.bed*") -> DataFrame:
    """The first three columns of headerless BED files, and file, the name of each row's file."""
    raw = spark.read.csv(path, sep="\t", schema=BED, pathGlobFilter=suffix, mode="PERMISSIVE", enforceSchema=True)
    return raw.select("chr", "start", "end", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"))


def name_map(spark: SparkSession, names: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(sorted(names.items()), f"file string, {CELL} string")


def read_name_map(path: str) -> dict[str, dict[str, str]]:
    """{dataset: {file: cell}} from the two-level YAML subset that such maps use, or from JSON."""
    import json

    with open(path) as f:
        text = f.read()
    if text.lstrip().startswith("{"):
        return json.loads(text)
    out: dict[str, dict[str, str]] = {}
    for line in text.splitlines():
        key, _, value = line.partition(":")
        key, value = key.strip().strip("'\""), value.strip().strip("'\"")
        if not key or key.startswith("#"):
            continue
        if line[0] not in " \t":
            out[key] = current = {}
        else:
            current[key] = value
    return out


def with_cells(df: DataFrame, names: dict[str, str], strict: bool = True) -> DataFrame:
    """df (file, ...) with cell_type instead of file; strict: a file without a name fails, otherwise its rows are left out."""
    mapped = df.join(F.broadcast(name_map(df.sparkSession, names)), "file", "left" if strict else "inner")
    if strict:
        mapped = mapped.withColumn(CELL, F.when(F.col(CELL).isNull(), F.raise_error(F.concat(F.lit("no cell for "), "file"))).otherwise(F.col(CELL)))
    return mapped.drop("file")


def only_cells(df: DataFrame, cells: list[str] | None) -> DataFrame:
    return df if cells is None else df.where(F.col(CELL).isin(cells))


def check_cells(names: dict[str, str], cells: list[str] | None) -> None:
    if cells is not None and (missing := set(cells) - set(names.values())):
        raise ValueError(f"no data for cells {sorted(missing)}")


def loops(raw: DataFrame, radius: int, organism: str = "human", cells: list[str] | None = None) -> DataFrame:
    """Pairs from LOOPS columns and cell_type: centres (half-even for human, floor for fly) and windows around them.

    A row whose chromosomes differ fails."""
    middle = middle_even if organism == "human" else middle_floor
    same = F.when(F.col("chr1") == F.col("chr2"), F.col("chr1")).otherwise(F.raise_error(F.lit("a loop joins two chromosomes")))
    name = bare_chr(same) if organism == "human" else F.regexp_replace(same, "^chr", "")
    out = only_cells(raw, cells).select(name.alias("chr"), middle("x1", "x2").alias("x"), middle("y1", "y2").alias("y"), CELL)
    out = out.withColumns(windowed(radius))
    return out.select("chr", *[F.col(c).cast("int").alias(c) for c in ("x", "x_start", "x_end", "y", "y_start", "y_end")], CELL)


def peaks(raw: DataFrame, cells: list[str] | None = None) -> DataFrame:
    return only_cells(raw, cells).select(CELL, bare_chr("chr").alias("chr"), "start", "end")


def bedgraph(spark: SparkSession, path: str) -> DataFrame:
    """Runs (chr, start, end, value, file) of bedGraph files; track and comment lines are left out."""
    lines = spark.read.text(path).select("value", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"))
    bits = F.split("value", r"\s+")
    data = lines.where(~F.col("value").rlike(r"^(track|browser|#|\s*$)"))
    return data.select(bare_chr(bits[0]).alias("chr"), bits[1].cast("long").alias("start"), bits[2].cast("long").alias("end"), bits[3].cast("double").alias("value"), "file")


def fasta(spark: SparkSession, path: str, organism: str = "human") -> DataFrame:
    """(chr, seq) of whole chromosomes, a row each; fasta_chunks() gives them in pieces. Human: NC records that name a chromosome, called chr<name>; fly: a fixed list."""
    records = spark.read.text(path, lineSep=">").where(F.length(F.trim("value")) > 0)
    head = F.regexp_extract("value", r"^([^\n\r]*)", 1)
    seq = F.regexp_replace(F.regexp_replace("value", r"^[^\n\r]*", ""), r"\s+", "")
    return _chromosomes(records.select(head.alias("head"), seq.alias("seq")), organism)


def _chromosomes(named: DataFrame, organism: str) -> DataFrame:
    """named (head, ...) with chr instead of head, for the records that are chromosomes."""
    rest = [c for c in named.columns if c != "head"]
    if organism == "human":
        found = named.where(F.col("head").startswith("NC") & F.col("head").contains("chromosome"))
        return found.select(F.concat(F.lit("chr"), F.regexp_extract("head", "chromosome ([^,]*),", 1)).alias("chr"), *rest)
    return named.where(F.trim("head").isin(FLY_CHROMOSOMES)).select(F.trim("head").alias("chr"), *rest)


def fasta_chunks(spark: SparkSession, path: str, organism: str = "human", reach: int = 0, width: int = CHUNK, size: int = RANGE) -> DataFrame:
    """(chr, chunk, seq) of the chromosomes that fasta() gives whole: `width` letters a row and the first `reach` of the next."""
    return _chromosomes(chunks(spark, path, reach, width, size), organism)


def jaspar(spark: SparkSession, path: str) -> DataFrame:
    """(motif_id, name, pfm): counts of A, C, G and T at each place."""
    records = spark.read.text(path, lineSep=">").where(F.length(F.trim("value")) > 0)
    head = F.split(F.regexp_extract("value", r"^([^\n\r]*)", 1), r"\s+")
    row = lambda letter: F.transform(F.regexp_extract_all(F.regexp_extract("value", letter + r"\s*\[([^\]]*)\]", 1), F.lit(r"([0-9.]+)")), lambda x: x.cast("double"))
    return records.select(head[0].alias("motif_id"), F.get(head, F.lit(1)).alias("name"), F.array(*[row(x) for x in "ACGT"]).alias("pfm"))


def matrices(motifs: DataFrame) -> dict[str, np.ndarray]:
    """Count matrices by motif; more than MOST_MOTIFS fail, as they go along with the code."""
    found = motifs.limit(MOST_MOTIFS + 1).collect()
    if len(found) > MOST_MOTIFS:
        raise ValueError(f"more than {MOST_MOTIFS} motifs")
    return {r.motif_id: np.array(r.pfm) for r in found}


def manifest(spark: SparkSession, sources: dict[str, dict[str, dict[str, str]]]) -> DataFrame:
    """(organism, experiment, cell_type, url) of what would be fetched; fetching is left to the platform."""
    rows = [(o, e, c, u) for o, es in sources.items() for e, cs in es.items() for c, u in cs.items()]
    return spark.createDataFrame(rows, f"organism string, experiment string, {CELL} string, url string")
