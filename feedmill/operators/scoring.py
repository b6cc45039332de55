"""Batch scoring and embedding with pluggable callables, and the outcome rows of each stage.

A scorer maps one prompt to one answer text.  An encoder maps a list of texts to a list of vectors.
Both run inside tasks on Arrow batches.  Without them an offline scorer and Spark ML's hashed term
vectors are used, so every job runs without network access.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F, types as T

from feedmill import fixed_values as fv
from feedmill.functions.responses import read_response
from feedmill.functions.text import truncated
from feedmill.operators.gates import embeddable

OFFLINE_MODEL = "longest-sentences"
HASHED_MODEL = "hashed-terms"

Scorer = Callable[[str], str]
Encoder = Callable[[list[str]], Sequence[Sequence[float]]]

SCORED = T.StructType(
    [
        T.StructField("article_id", T.LongType()),
        T.StructField("model", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("key_points", T.ArrayType(T.StringType())),
        T.StructField("attempts", T.IntegerType()),
        T.StructField("error", T.StringType()),
    ]
)


def longest_sentences(content: str, n: int = 3) -> str:
    """Offline answer: the ``n`` longest sentences, in reading order, in the JSON a model returns."""
    sentences = [s.strip() for s in re.findall(r"[^.!?]+[.!?]*", content)]
    ranked = sorted(range(len(sentences)), key=lambda i: (-len(sentences[i]), i))[:n]
    picked = [sentences[i] for i in sorted(ranked)]
    return json.dumps({"summary": " ".join(picked), "key_points": picked}, ensure_ascii=False)


longest_sentences.reads_content = True


def call_with_retry(
    call: Callable[[str], str],
    prompt: str,
    attempts: int = fv.SCORER_ATTEMPTS,
    wait: tuple[float, float] = fv.SCORER_WAIT_SECONDS,
    sleep: Callable[[float], None] = time.sleep,
) -> tuple[str | None, int, str | None]:
    """(answer, attempts used, error); waits double between the two bounds and never raise [F5]."""
    shortest, longest = wait
    for used in range(1, attempts + 1):
        try:
            return call(prompt), used, None
        except Exception as failure:  # noqa: BLE001 - any scorer failure becomes a row
            error = f"{type(failure).__name__}: {failure}"
            if used < attempts:
                sleep(min(longest, max(shortest, 2.0 ** (used - 1))))
    return None, attempts, error


def score(
    rows: DataFrame,
    prompt: Column,
    scorer: Scorer = longest_sentences,
    model: str = OFFLINE_MODEL,
    key: str = "id",
    attempts: int = fv.SCORER_ATTEMPTS,
    wait: tuple[float, float] = fv.SCORER_WAIT_SECONDS,
    spread: int | None = None,
    content: Column | None = None,
) -> DataFrame:
    """One row per input row: summary and key points, or NULLs and the error [F1, F2].

    Only the key and the prompt reach Python.  Scorers that follow no instructions, such as the offline one, say so by an
    attribute ``reads_content`` and read ``content`` instead, where that is given.  ``spread`` repartitions the rows first, for slow
    remote scorers whose calls should be in flight on many tasks.
    """
    read = content if getattr(scorer, "reads_content", False) and content is not None else prompt
    prompts = rows.select(F.col(key).cast("long").alias("article_id"), read.alias("prompt"))
    if spread is not None:
        prompts = prompts.repartition(spread, "article_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for article_id, text in zip(batch["article_id"], batch["prompt"]):
                answer, used, error = call_with_retry(scorer, text or "", attempts, wait)
                summary, points = (None, None) if answer is None else read_response(answer)
                out.append((article_id, model, summary, points, used, error))
            yield pd.DataFrame(out, columns=SCORED.names).astype({"attempts": "int32"})

    return prompts.mapInPandas(run, SCORED)


def _limited(text: Column, limit: int | None) -> Column:
    return embeddable(text) if limit is None else truncated(embeddable(text), limit)


def encode(text: Column, encoder: Encoder, limit: int | None = None) -> Column:
    """Vectors of a text column by ``encoder``; blank texts and failed batches are NULL [F3, F4].

    Whole texts are read; ``limit`` cuts them for encoders that take no more.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            filled = [i for i, t in enumerate(texts) if t is not None]
            out: list[np.ndarray | None] = [None] * len(texts)
            try:
                found = encoder([texts.iloc[i] for i in filled]) if filled else []
                for i, vector in zip(filled, found):
                    out[i] = np.asarray(vector, dtype="float32")
            except Exception:  # noqa: BLE001 - a failed batch yields NULL vectors
                out = [None] * len(texts)
            yield pd.Series(out, dtype=object)

    return vectors(_limited(text, limit))


def hashed_vectors(
    rows: DataFrame, text: str, key: str = "id", dimension: int = fv.EMBEDDING_DIM, out: str = "embedding",
    limit: int | None = None,
) -> DataFrame:
    """(key, vector) by hashed term counts of unit length, computed by Spark ML in the JVM [F3, F4].

    Whole texts are read unless a ``limit`` is given.  Blank texts have a NULL vector.
    """
    prepared = rows.select(key, _limited(F.col(text), limit).alias("_text"))
    filled = prepared.withColumn("_filled", F.coalesce("_text", F.lit("")))
    words = RegexTokenizer(inputCol="_filled", outputCol="_words", pattern=r"\s+", gaps=True)
    counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dimension)
    scaled = Normalizer(inputCol="_counts", outputCol="_unit", p=2.0)
    vectors = scaled.transform(counts.transform(words.transform(filled)))
    return vectors.select(
        key, F.when(F.col("_text").isNotNull(), vector_to_array("_unit", "float32")).alias(out)
    )


def embed(rows: DataFrame, text: str, encoder: Encoder | None = None, model: str = HASHED_MODEL, key: str = "id") -> DataFrame:
    """(article_id, model, embedding) with the given encoder or the built-in hashed vectors [F3, F4]."""
    vectors = (
        hashed_vectors(rows, text, key)
        if encoder is None
        else rows.select(key, encode(F.col(text), encoder).alias("embedding"))
    )
    return vectors.select(F.col(key).cast("long").alias("article_id"), F.lit(model).alias("model"), "embedding")


def stage_rows(rows: DataFrame, stage: str, skipped: Column, failed: Column, error: Column) -> DataFrame:
    """(article_id, stage, outcome, error_message) of one stage [F6]."""
    return rows.select(
        "article_id",
        F.lit(stage).alias("stage"),
        F.when(skipped, F.lit("skipped")).when(failed, F.lit("failed")).otherwise(F.lit("success")).alias("outcome"),
        F.when(~skipped & failed, error).alias("error_message"),
    )


def outcome_events(outcomes: DataFrame, first_event_id: int, ts: Column) -> DataFrame:
    """Outcome rows -> processing events: success and skip move on, failures keep their stage [F6, T2].

    Event ids follow the article id, which is unique within one stage run.  A ``model`` of the outcomes goes along.
    """
    model = F.col("model") if "model" in outcomes.columns else F.lit(None).cast("string")
    following = (
        F.when(F.col("stage") == "extraction", F.lit("summarization"))
        .when(F.col("stage") == "summarization", F.lit("embedding"))
    )
    failed = F.col("outcome") == "failed"
    done = ~failed & (F.col("stage") == "embedding")
    return outcomes.select(
        (F.lit(first_event_id) + F.col("article_id")).alias("event_id"),
        ts.alias("ts"),
        "article_id",
        F.when(failed, F.lit("failed")).when(done, F.lit("completed")).otherwise(F.lit("pending")).alias("status"),
        F.when(failed | done, F.col("stage")).otherwise(following).alias("stage"),
        F.col("error_message").alias("error"),
        F.when(failed, F.col("stage")).alias("queue_name"),
        model.alias("model"),
    )
