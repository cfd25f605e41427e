"""The feature workflow: labelled pairs, peaks, signal and motifs, cleaned and in one wide table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorloom.operators import features, motifs, pairs, signal
from anchorloom.sources.settled import settled


def assemble(loops: DataFrame, mode: str, peaks: dict[str, DataFrame], tracks: dict[str, DataFrame], motif_counts: DataFrame | None = None, motif_ids: list[str] | None = None, res: int = 20, **labelling) -> DataFrame:
    """One row for each labelled pair with all features, over whole tables, all cells at once; labelled pairs are settled when this is called.

    Peaks of the first experiment that covers open chromatin feed the modes that need them."""
    made = pairs.add_labels(loops, mode, next(iter(peaks.values()), None), **labelling)
    labelled = made.groupBy(*pairs.PAIR).agg(F.max("label").alias("label"))
    labelled = settled(labelled)  # every branch starts from it; a pair with both labels is a loop
    out = features.with_distance(labelled)
    spots = pairs.anchors(labelled)
    for name, table in peaks.items():
        out = features.peaks_features(out, table, name)
    for name, runs in tracks.items():
        out = signal.normalised(out, signal.signal_stats(spots, runs, res), name)
    if motif_counts is not None:
        out = motifs.motif_merge(out, motif_counts, motif_ids or [])
    return pairs.remove_overlapping(out)


def sequences(loops: DataFrame, peaks: DataFrame, genome: DataFrame) -> DataFrame:
    """(chr, start, end, name, seq) of the parts of anchors under peaks: what the motif scan reads."""
    from anchorloom.functions.genomic import CELL, KEYS, with_chr
    from anchorloom.operators.intervals import name_segments, overlap_segments

    parts = name_segments(overlap_segments(pairs.anchors(loops), peaks, KEYS), F.col(CELL)).distinct()
    return motifs.slices(parts.withColumn("chr", with_chr("chr")), genome)
