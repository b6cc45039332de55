"""The three chained feature stages as incremental jobs: land -> extract -> summarise -> embed [T1].

Each stage reads what the stage before has written since its last run and keeps its own
checkpoint.  Every stage keeps one row per article, and per model where a model makes the rows, so
running it again adds nothing.

Every article a stage has worked on is a row of ``outcomes``, also one without enough text, summary or vector.
They become processing events, from which state and dead letters follow, and orders to try failed calls again (see
``retries``): at most ``RetryRule.max_retries`` times, then the work rests until its dead letter is replayed.  Texts that are too
short are not tried again by themselves: what has landed does not change.
"""

from __future__ import annotations

import datetime
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from feedmill import fixed_values as fv
from feedmill.functions.text import summary_prompt
from feedmill.functions.urls import canonical_url
from feedmill.operators.gates import embeddable
from feedmill.operators.scoring import HASHED_MODEL, OFFLINE_MODEL, Encoder, Scorer, embed, longest_sentences, outcome_events, score, stage_rows
from feedmill.operators.dedup import absent_keys
from feedmill.session import staged
from feedmill.sources.pages import read_page_features
from feedmill.streaming import state
from feedmill.streaming.batches import read_batches, write_batch
from feedmill.streaming.retries import RetryBook, RetryRule
from feedmill.streaming.tables import file_stream, insert_if_absent, key_index, run_available

LANDED = "page_id long, url string, html string"
_L, _S = T.LongType(), T.StringType()
BRONZE = T.StructType([T.StructField("id", _L), T.StructField("url", _S), T.StructField("html", _S), T.StructField("canonical", _S)])
SILVER = T.StructType([T.StructField("id", _L), T.StructField("url", _S), T.StructField("title", _S), T.StructField("content", _S)])
GOLD = T.StructType(
    [T.StructField("id", _L), T.StructField("model", _S), T.StructField("summary", _S), T.StructField("key_points", T.ArrayType(_S))]
)
FAILED = T.StructType([T.StructField("id", _L), T.StructField("model", _S), T.StructField("attempts", T.IntegerType()), T.StructField("error", _S)])
VECTORS = T.StructType([T.StructField("id", _L), T.StructField("model", _S), T.StructField("embedding", T.ArrayType(T.FloatType()))])
OUTCOMES = T.StructType(
    [T.StructField("article_id", _L), T.StructField("stage", _S), T.StructField("outcome", _S), T.StructField("error_message", _S), T.StructField("ts", T.TimestampNTZType()), T.StructField("model", _S)]
)
#: Stages in the order in which a run works on an article.
STAGES = ("extraction", "summarization", "embedding")
NO_VECTOR = fv.EMBEDDING_FAILED
NO_SUMMARY = fv.SUMMARIZATION_FAILED


@dataclass(frozen=True)
class Layout:
    """Where the stage tables and checkpoints live."""

    root: str

    def table(self, name: str) -> str:
        return f"{self.root}/tables/{name}"

    def checkpoint(self, name: str) -> str:
        return f"{self.root}/checkpoints/{name}"

    def book(self, rule: RetryRule = RetryRule()) -> RetryBook:
        return RetryBook(self.root, rule)


def ingest_pages(spark: SparkSession, landed: str, layout: Layout, files_per_batch: int | None = None, glob: str | None = None) -> None:
    """Landed pages -> bronze, one row per canonical URL, the first to land wins [T7]."""
    pages = file_stream(spark, landed, LANDED, files_per_batch, glob)
    rows = pages.select(F.col("page_id").alias("id"), "url", "html", canonical_url(F.col("url")).alias("canonical"))
    run_available(rows, insert_if_absent(layout.table("bronze"), "canonical", "id"), layout.checkpoint("bronze"))


def _next_time(spark: SparkSession, layout: Layout) -> datetime.datetime:
    """A second after the last recorded outcome: runs follow one another without reading the clock."""
    last = read_stage(spark, layout, "outcomes").agg(F.max("ts")).first()[0] or datetime.datetime(1970, 1, 1)
    return last.replace(microsecond=0) + datetime.timedelta(seconds=1)


def _record(layout: Layout, rows: DataFrame, number: int, stage: str, error: Column, at: datetime.datetime, model: str | None = None) -> None:
    """One outcome for each row of (id, done); a stage of a run is a microsecond after the stage before."""
    ts = F.lit(at + datetime.timedelta(microseconds=STAGES.index(stage))).cast("timestamp_ntz")
    done = F.coalesce("done", F.lit(False))
    found = stage_rows(rows.withColumnRenamed("id", "article_id"), stage, F.lit(False), ~done, error)
    named = found.withColumn("ts", ts).withColumn("model", F.lit(model).cast("string"))
    write_batch(named.select(*OUTCOMES.names), layout.table("outcomes"), number)


def _with_done(rows: DataFrame, absent: DataFrame) -> DataFrame:
    """``rows`` with ``done``: whether their id was written.  The index of the table says which are absent."""
    missing = absent.select("id").distinct().withColumn("_missing", F.lit(True))
    return rows.join(missing, "id", "left").withColumn("done", F.col("_missing").isNull()).drop("_missing")


def _texts(bronze: DataFrame) -> DataFrame:
    return read_page_features(bronze.select("id", "url", "html")).select("id", "url", "title", F.col("page_text").alias("content"))


def _extracted(layout: Layout, at: datetime.datetime):
    """The sink of extracted texts: those that are long enough go to silver, all have an outcome."""
    insert, index = insert_if_absent(layout.table("silver"), "id"), key_index(layout.table("silver"), ["id"])

    def sink(batch: DataFrame, number: int) -> None:
        texts = staged(batch, "texts")
        insert(texts.filter(F.length("content") >= fv.SUMMARY_MIN_CHARS), number)
        ids = texts.select("id").distinct()
        rows = _with_done(ids, index.absent(ids, before=number + 1 if number >= 0 else None))
        _record(layout, rows, _model_number(number, "extraction"), "extraction", F.lit(fv.EXTRACTION_FAILED), at)

    return sink


def extract_stage(spark: SparkSession, layout: Layout, at: datetime.datetime | None = None) -> None:
    """Bronze -> silver: title and main text; pages without enough text stop here with a failed outcome."""
    sink = _extracted(layout, at or _next_time(spark, layout))
    run_available(_texts(file_stream(spark, layout.table("bronze"), BRONZE)), sink, layout.checkpoint("silver"))


def retry_extraction(
    spark: SparkSession, layout: Layout, at: datetime.datetime | None = None, rule: RetryRule = RetryRule(), update: bool = True
) -> None:
    """Extract the pages of replayed letters again."""
    at = at or _next_time(spark, layout)

    def work(ids: DataFrame, number: int) -> None:
        pages = read_stage(spark, layout, "bronze").join(ids, "id", "left_semi")
        _extracted(layout, at)(_texts(pages), -number)

    _retry(spark, layout, "extraction", None, at, rule, update, work)


def _retry(spark, layout: Layout, stage: str, model: str | None, at: datetime.datetime, rule: RetryRule, update: bool, work) -> None:
    """Take the due orders of a stage, let ``work(ids, number)`` do them and note them as taken."""
    book = layout.book(rule)
    if update:
        book.update(spark)
    orders = staged(book.due(spark, stage, at, model), "orders")
    if orders.isEmpty():
        return
    number = book.next_try(spark)
    work(orders.select(F.col("article_id").alias("id")).distinct(), number)
    book.note(orders, number)


def _model_number(batch: int, model: str) -> int:
    """The folder number of one model's batch: models never share one, and a model's numbers ascend."""
    return (batch << 32) + zlib.crc32(model.encode())


def _summarise(
    layout: Layout, work: DataFrame, number: int, scorer: Scorer, model: str, at: datetime.datetime, attempts: int = fv.SCORER_ATTEMPTS
) -> None:
    """Score articles once; summaries go to gold, failed calls with their error to ``failed``."""
    prompt = summary_prompt(F.col("title"), F.col("content"), limit=None)
    scored = score(work, prompt, scorer, model, attempts=attempts, content=F.col("content"))
    scored = staged(scored.withColumnRenamed("article_id", "id"), "scored")
    done = F.col("summary").isNotNull()
    write_batch(scored.filter(done).select(*GOLD.names), layout.table("gold"), number)
    write_batch(scored.filter(~done).select(*FAILED.names), layout.table("failed"), number)
    error = F.coalesce(F.nullif("error", F.lit("")), F.lit(NO_SUMMARY))
    rows = scored.select("id", "error", done.alias("done"))
    _record(layout, rows, _model_number(number >> 32, f"summarization {model}"), "summarization", error, at, model)


def summary_stage(
    spark: SparkSession, layout: Layout, scorer: Scorer = longest_sentences, model: str = OFFLINE_MODEL, at: datetime.datetime | None = None,
    attempts: int = fv.SCORER_ATTEMPTS,
) -> None:
    """Silver -> gold: one summary per article and model; silver holds each article once, so none is scored twice.

    ``attempts`` are calls within one try; tries of later runs are bounded by the retry rule.
    """
    at = at or _next_time(spark, layout)

    def sink(batch: DataFrame, batch_id: int) -> None:
        _summarise(layout, batch, _model_number(batch_id, model), scorer, model, at, attempts)

    run_available(file_stream(spark, layout.table("silver"), SILVER), sink, layout.checkpoint(f"gold-{zlib.crc32(model.encode())}"))


def retry_summaries(
    spark: SparkSession, layout: Layout, scorer: Scorer = longest_sentences, model: str = OFFLINE_MODEL, at: datetime.datetime | None = None,
    rule: RetryRule = RetryRule(), attempts: int = fv.SCORER_ATTEMPTS, update: bool = True,
) -> None:
    """Score the articles again whose calls failed or whose letters were replayed, and that still have no summary of the model.

    Their batches are numbered downwards from -1, apart from the batches of the stream.
    """
    at = at or _next_time(spark, layout)

    def work(ids: DataFrame, number: int) -> None:
        own = _model_number(-number, model)
        gold = read_batches(spark, layout.table("gold"), GOLD).filter((F.col("model") == model) & (F.col("batch_id") != own))
        rows = read_stage(spark, layout, "silver").join(absent_keys(ids, gold, "id"), "id", "left_semi")
        _summarise(layout, rows, own, scorer, model, at, attempts)

    _retry(spark, layout, "summarization", model, at, rule, update, work)


def _vectors(rows: DataFrame, encoder: Encoder | None) -> DataFrame:
    vectors = embed(rows, "summary", encoder).filter(F.col("embedding").isNotNull())
    return vectors.select(F.col("article_id").alias("id"), "model", "embedding")


def _long_enough() -> Column:
    return F.coalesce(F.length(embeddable(F.col("summary"))) >= fv.EMBEDDING_MIN_CHARS, F.lit(False))


def _embedded(layout: Layout, encoder: Encoder | None, summary_model: str, at: datetime.datetime):
    """The sink of summaries: vectors are written once per article, all summaries have an outcome."""
    keys = ["id", "model"]
    insert, index = insert_if_absent(layout.table("vectors"), keys), key_index(layout.table("vectors"), keys)

    def sink(batch: DataFrame, number: int) -> None:
        insert(_vectors(batch.filter(_long_enough()), encoder), number)
        ids = batch.select("id", _long_enough().alias("long"), F.lit(HASHED_MODEL).alias("model")).dropDuplicates(["id"])
        rows = _with_done(ids, index.absent(ids, before=number + 1 if number >= 0 else None))
        error = F.when(F.col("long"), F.lit(NO_VECTOR)).otherwise(F.lit(fv.INSUFFICIENT_TEXT))
        _record(layout, rows, _model_number(number, "embedding"), "embedding", error, at, summary_model)

    return sink


def embedding_stage(
    spark: SparkSession, layout: Layout, encoder: Encoder | None = None, summary_model: str = OFFLINE_MODEL, at: datetime.datetime | None = None
) -> None:
    """Gold -> vectors of one model's summaries; summaries that are too short and failed calls are failed outcomes."""
    gold = file_stream(spark, layout.table("gold"), GOLD).filter(F.col("model") == summary_model)
    sink = _embedded(layout, encoder, summary_model, at or _next_time(spark, layout))
    run_available(gold, sink, layout.checkpoint("vectors"))


def retry_vectors(
    spark: SparkSession, layout: Layout, encoder: Encoder | None = None, summary_model: str = OFFLINE_MODEL, at: datetime.datetime | None = None,
    rule: RetryRule = RetryRule(), update: bool = True,
) -> None:
    """Embed the summaries again whose calls failed or whose letters were replayed; numbered like ``retry_summaries``."""
    at = at or _next_time(spark, layout)

    def work(ids: DataFrame, number: int) -> None:
        gold = read_stage(spark, layout, "gold").filter(F.col("model") == summary_model)
        _embedded(layout, encoder, summary_model, at)(staged(gold.join(ids, "id", "left_semi"), "retries"), -number)

    _retry(spark, layout, "embedding", summary_model, at, rule, update, work)


def replay(spark: SparkSession, layout: Layout, letters: DataFrame, at: datetime.datetime | None = None) -> DataFrame:
    """Send dead letters back to the stage they failed in, each once; the retries of the next run take them [T4]."""
    return layout.book().replay(letters, at or _next_time(spark, layout))


def outcome_stage(spark: SparkSession, layout: Layout) -> None:
    """Outcomes -> processing events -> the state of every article, and dead letters past the retry limit [F6, T2, T3]."""
    def events() -> DataFrame:
        found = outcome_events(file_stream(spark, layout.table("outcomes"), OUTCOMES), 0, F.col("ts"))
        return found.withColumn("event_id", F.xxhash64("article_id", "ts"))  # one id per article and stage of a run

    state.update_state(events(), layout.table("state"), layout.checkpoint("state"))
    state.update_dead_letters(events(), layout.table("letters"), layout.checkpoint("letters"))


def run_stages(
    spark: SparkSession, landed: str, root: str, files_per_batch: int | None = None, glob: str | None = None,
    scorer: Scorer = longest_sentences, encoder: Encoder | None = None, at: datetime.datetime | None = None, rule: RetryRule = RetryRule(),
) -> Layout:
    """Bring all stages up to date with what has landed, and try again what is due at the time ``at`` of the run."""
    layout = Layout(root)
    ingest_pages(spark, landed, layout, files_per_batch, glob)
    at = at or _next_time(spark, layout)
    layout.book(rule).update(spark)
    retry_extraction(spark, layout, at, rule, update=False)
    extract_stage(spark, layout, at)
    retry_summaries(spark, layout, scorer, at=at, rule=rule, update=False)
    summary_stage(spark, layout, scorer, at=at)
    retry_vectors(spark, layout, encoder, at=at, rule=rule, update=False)
    embedding_stage(spark, layout, encoder, at=at)
    outcome_stage(spark, layout)
    return layout


def read_stage(spark: SparkSession, layout: Layout, name: str) -> DataFrame:
    """The current rows of one stage table."""
    schema = {"bronze": BRONZE, "silver": SILVER, "gold": GOLD, "failed": FAILED, "vectors": VECTORS, "outcomes": OUTCOMES}[name]
    return read_batches(spark, layout.table(name), schema).drop("batch_id")
