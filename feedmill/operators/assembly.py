"""Ordered text assembly of transcripts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Column, functions as F

from feedmill import fixed_values as fv

SEGMENTS_PER_PART = 1000


def assemble(
    segments: DataFrame, keys: Sequence[str], order: str = "seq", text: str = "text", per_part: int = SEGMENTS_PER_PART
) -> DataFrame:
    """Segments joined by one blank in order, as (keys, part, n_segments, content) [A12].

    A part holds the segments of one stretch of ``per_part`` positions.  Ordinary transcripts are a
    single part 0; an endless one becomes several ordered parts, so no task ever gathers more than
    ``per_part`` segments and no text is lost.
    """
    part = F.floor(F.col(order) / F.lit(per_part)).cast("long")
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return (
        segments.groupBy(*keys, part.alias("part"))
        .agg(F.count("*").alias("n_segments"), ordered.alias("_ordered"))
        .select(
            *keys, "part", "n_segments",
            F.array_join(F.transform("_ordered", lambda s: s["t"]), " ").alias("content"),
        )
    )


def language_rank(language: Column, preferred: Sequence[str] = fv.TRANSCRIPT_LANGUAGES) -> Column:
    """Position in the preference list; every other language comes after it."""
    rank = F.lit(len(preferred))
    for position in reversed(range(len(preferred))):
        rank = F.when(language == preferred[position], F.lit(position)).otherwise(rank)
    return rank


def choose_language(
    segments: DataFrame, key: str = "video_id", preferred: Sequence[str] = fv.TRANSCRIPT_LANGUAGES
) -> DataFrame:
    """Segments of the preferred language per video, of any language when none is preferred [A13].

    Ties go to the first language by name.  Only the choice is aggregated; the segments are
    filtered through a semi join on (video, language), not collected.
    """
    choice = segments.groupBy(key).agg(
        F.min(F.struct(language_rank(F.col("language"), preferred).alias("r"), F.col("language").alias("l"))).alias("_c")
    )
    chosen = choice.select(key, F.col("_c.l").alias("language"))
    return segments.join(chosen, [key, "language"], "left_semi")
