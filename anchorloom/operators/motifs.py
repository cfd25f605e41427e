"""Sequence slices, motif scanning on both strands, and motif counts for both anchors of a pair."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorloom.functions.genomic import CELL, strand_suffix

PSEUDO, P_VALUE, SCALE = 0.1, 1e-4, 100
#: Letters of a genome that a row holds, and places that are scored at once.
CHUNK, STRETCH = 1 << 16, 1 << 20


def weights(counts: np.ndarray, pseudo: float = PSEUDO, scale: int = SCALE) -> np.ndarray:
    """Scaled integer log-odds (4 x L) of a count matrix in order A, C, G, T against a uniform background."""
    c = np.asarray(counts, float)
    p = (c + pseudo / 4) / (c.sum(0) + pseudo)
    return np.rint(scale * np.log2(p / 0.25)).astype(np.int64)


def threshold(w: np.ndarray, p_value: float = P_VALUE) -> int:
    """Least score whose exact probability under a uniform background is below p_value."""
    low, size = w.min(0).sum(), int(w.max(0).sum() - w.min(0).sum()) + 1
    mass = np.zeros(size)
    mass[0] = 1
    for column in w.T - w.min(0)[:, None]:
        mass = sum(np.concatenate([np.zeros(s), mass[: size - s]]) for s in column.tolist()) / 4
    tail = mass[::-1].cumsum()[::-1]
    at = np.flatnonzero(tail < p_value)
    return int(low + (at[0] if len(at) else size))


def stretches(b: pa.RecordBatch, most: int = STRETCH) -> Iterator[pa.RecordBatch]:
    """b in runs of rows with at most `most` bytes of text in column 1, or one row: what a task copies does not grow with rows or batches."""
    through = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < b.num_rows:
        high = max(low + 1, int(np.searchsorted(through, most + (through[low - 1] if low else 0), "right")))
        yield b.slice(low, high - low)
        low = high


def scan(sequences: DataFrame, motifs: dict[str, np.ndarray], cutoffs: dict[str, int] | None = None, id_col: str = "name", seq_col: str = "seq") -> DataFrame:
    """(name, motif_id, strand, pos, score) of hits: integer weights summed over every place, score >= cutoff.

    pos counts from 0 on the forward strand; letters other than A, C, G, T are in no hit. motifs: weights by id; they go
    along with the code, being a few hundred numbers each."""
    table = {m: (w, (cutoffs or {}).get(m, threshold(w))) for m, w in motifs.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = np.full(256, 4, np.uint8)
        for i, letter in enumerate(b"ACGT"):
            code[letter] = code[letter + 32] = i
        for b in (part for whole in batches for part in stretches(whole)):
            # Sequences in a row, each followed by a letter that no hit holds; STRETCH places are scored at once.
            texts = [(x or "").encode("ascii", "replace") + b"|" for x in b.column(1).to_pylist()]
            ends = np.cumsum([len(x) for x in texts])
            begins = np.concatenate([[0], ends[:-1]])
            s = code[np.frombuffer(b"".join(texts), np.uint8)]
            found = []
            for motif, (w, cut) in table.items():
                for strand, m in (("+", w), ("-", w[::-1, ::-1])):
                    length = m.shape[1]
                    full = np.vstack([m, np.full(length, -(1 << 40))])
                    for low in range(0, len(s) - length + 1, STRETCH):
                        part = s[low : low + STRETCH + length - 1]
                        n = len(part) - length + 1
                        score = full[part[:n], 0]
                        for k in range(1, length):
                            score += full[part[k : k + n], k]
                        at = np.flatnonzero(score >= cut)
                        if len(at):
                            row = np.searchsorted(ends, at + low, "right")
                            found.append((b.column(0).take(pa.array(row)), pa.repeat(motif, len(at)), pa.repeat(strand, len(at)), pa.array(at + low - begins[row]), pa.array(score[at])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*found, strict=True)], ["name", "motif_id", "strand", "pos", "score"])

    kind = dict(sequences.dtypes)[id_col]
    return sequences.select(F.col(id_col), F.col(seq_col)).mapInArrow(run, f"name {kind}, motif_id string, strand string, pos long, score long")


def chunks(genome: DataFrame, reach: int, width: int = CHUNK) -> DataFrame:
    """genome (chr, seq) as (chr, chunk, seq): width letters each and the first `reach` (at most width) of the next."""
    cut = F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{width}}}"), F.lit(0))
    cut = genome.select("chr", F.when(F.size(cut) > 0, cut).otherwise(F.array("seq")).alias("cut"))  # an empty or null one is a chunk
    whole = F.expr(f"transform(cut, (x, i) -> concat(x, coalesce(substring(get(cut, i + 1), 1, {reach}), '')))")
    return cut.select("chr", F.posexplode(whole).alias("chunk", "seq"))


def slices(parts: DataFrame, genome: DataFrame, width: int = CHUNK) -> DataFrame:
    """parts (chr, start, end, name) with seq, their piece of genome (chr, seq).

    A part meets the chunk its start lies in, not the whole chromosome; chunks overlap by the longest part. A part that
    begins outside its chromosome is left out (or empty, where its chunk exists), one that ends outside is cut."""
    reach = longest(parts)
    width = max(width, reach)
    return slices_of_chunks(parts, chunks(genome, reach, width), width)


def longest(parts: DataFrame) -> int:
    return parts.agg(F.max(F.col("end") - F.col("start"))).first()[0] or 0


def slices_of_chunks(parts: DataFrame, cut: DataFrame, width: int) -> DataFrame:
    """slices() of a genome that is cut (chr, chunk, seq) into `width` letters and as many more as the longest part has.

    A merge join: chunks that tasks read from a few byte ranges count as few in estimates, and a broadcast would bring the
    whole genome to the driver."""
    placed = parts.withColumn("chunk", F.floor(F.col("start") / width).cast("int"))
    piece = F.expr(f"substring(seq, cast(start - chunk * {width}L + 1 as int), cast(end - start as int))")
    return placed.join(cut.hint("merge"), ["chr", "chunk"]).select("chr", "start", "end", "name", piece.alias("seq"))


def names(motifs: list[str]) -> list[str]:
    return [f"{m}{s}" for m in motifs for s in ("_f", "_r")]


def motif_pivot(hits: DataFrame, motifs: list[str], keys: list[str]) -> DataFrame:
    """Counts of hits by motif and strand, a column each, 0 where none."""
    named = hits.withColumn("_m", F.concat("motif_id", strand_suffix()))
    out = named.groupBy(*keys).pivot("_m", names(motifs)).agg(F.count(F.lit(1)))
    return out.select(*keys, *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("long").alias(c) for c in names(motifs)])


def motif_merge(pairs: DataFrame, counts: DataFrame, motifs: list[str], strict: bool = True) -> DataFrame:
    """pairs with x_<motif>_<strand> and y_..., strands of y exchanged. counts: motif_pivot() by cell, chr, start, end.

    strict: a pair of which only one anchor has a row in counts gets 0 throughout."""
    out = pairs
    for side in "xy":
        one = counts.select(CELL, "chr", F.col("start").alias(f"{side}_start"), F.col("end").alias(f"{side}_end"), F.lit(True).alias(f"_{side}"), *[F.col(f"`{_source(m, side)}`").alias(f"{side}_{m}") for m in names(motifs)])
        out = out.join(one, [CELL, "chr", f"{side}_start", f"{side}_end"], "left")
    both = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    value = lambda c: F.when(both, F.col(f"`{c}`")).otherwise(F.lit(0)) if strict else F.coalesce(F.col(f"`{c}`"), F.lit(0))
    return out.select(*pairs.columns, *[value(f"{s}_{m}").cast("long").alias(f"{s}_{m}") for s in "xy" for m in names(motifs)])


def _source(name: str, side: str) -> str:
    return name if side == "x" else name[:-1] + {"f": "r", "r": "f"}[name[-1]]


def motif_total(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumn("motifs", reduce(lambda a, b: a + b, [F.col(f"`{c}`") for c in columns]))
