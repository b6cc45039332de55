"""Incremental jobs over the given tables; their results must equal the batch results."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, functions as F

from feedmill.operators.scoring import longest_sentences
from feedmill.plans.catalog import query
from feedmill.plans.queries_ingest import ARTICLE_TEXT
from feedmill.plans.queries_serve import STATE_SQL
from feedmill.plans.queries_state import DEAD_SQL
from feedmill.plans.views import VIEWS
from feedmill.session import scratch_path
from feedmill.streaming import stages, state
from feedmill.streaming.tables import file_stream, table_files


def _event_stream(t):
    raw = file_stream(t.spark, table_files(t.sf_dir, "events"), t.events.schema)
    return t.spark.sql(VIEWS["processing_events"], events=raw)


def _landings(rows: DataFrame, order: str, path: str, parts: int = 5) -> None:
    """The rows landed one part after another, as a log or a crawl lands them; parts are stretches of ``order``."""
    low, high = rows.select(F.col(order).alias("o")).agg(F.min("o"), F.max("o")).first()
    if low is None:
        rows.limit(0).write.parquet(path)
        return
    for part in range(parts):
        start, stop = low + (high - low) * part / parts, low + (high - low) * (part + 1) / parts
        own = rows if part == 0 else rows.filter(F.col(order) >= F.lit(start).cast(rows.schema[order].dataType))
        own = own if part == parts - 1 else own.filter(F.col(order) < F.lit(stop).cast(rows.schema[order].dataType))
        own.coalesce(1).write.mode("append").parquet(path)


def _landed_events(t, path: str):
    """The event stream over five landings, one file to a micro-batch."""
    _landings(t.events, "ts", path)
    return t.spark.sql(VIEWS["processing_events"], events=file_stream(t.spark, path, t.events.schema, files_per_batch=1))


_FIRST_PAGES = r"""select page_id as id, url, html, c as canonical from (
  select *, row_number() over (partition by c order by page_id) as r from (
    select *, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*[^?#]*'), '/+$', '') as c from pages) p) q where r = 1"""


@query("stream_ingest", "T7 D2", f"select id, url, canonical from ({_FIRST_PAGES}) b")
def stream_ingest(t):
    """Five landings; each asks the key index which of its URLs are stored."""
    root = scratch_path(t.spark, "stream")
    layout = stages.Layout(root)
    _landings(t.pages.withColumn("page_id", F.col("page_id").cast("long")), "page_id", f"{root}/landed")
    stages.ingest_pages(t.spark, f"{root}/landed", layout, files_per_batch=1)
    return stages.read_stage(t.spark, layout, "bronze").select("id", "url", "canonical")


@query(
    "stream_stages", "T1 T7",
    f"select * from (select id, url, {ARTICLE_TEXT} as content from ({_FIRST_PAGES}) b) s where length(content) >= 50",
)
def stream_stages(t):
    """Texts of the articles that went through all stages, joined with what the last stage wrote."""
    layout = stages.run_stages(t.spark, table_files(t.sf_dir, "pages"), scratch_path(t.spark, "stream"))
    done = stages.read_stage(t.spark, layout, "vectors").select("id")
    return stages.read_stage(t.spark, layout, "silver").join(done, "id", "left_semi").select("id", "url", "content")


@query("stream_state", "T2", STATE_SQL, "processing_events")
def stream_state(t):
    root = scratch_path(t.spark, "stream")
    state.update_state(_event_stream(t), f"{root}/state", f"{root}/checkpoint")
    return state.current_state(t.spark, f"{root}/state")


@query("stream_state_compacted", "T2 D4", STATE_SQL, "processing_events")
def stream_state_compacted(t):
    """Five micro-batches, folded into a snapshot after every second."""
    root = scratch_path(t.spark, "stream")
    state.update_state(_landed_events(t, f"{root}/landed"), f"{root}/state", f"{root}/checkpoint", compact_every=2)
    return state.current_state(t.spark, f"{root}/state")


@query("stream_dead_letters", "T3", DEAD_SQL, "processing_events")
def stream_dead_letters(t):
    """Five micro-batches; numbers go on from the totals of the earlier ones."""
    root = scratch_path(t.spark, "stream")
    state.update_dead_letters(_landed_events(t, f"{root}/landed"), f"{root}/letters", f"{root}/checkpoint", compact_every=2)
    letters = state.read_dead_letters(t.spark, f"{root}/letters")
    return letters.select(
        "id", "article_id", "queue_name", F.col("payload.model").alias("payload_model"), "error_message",
        "retry_count", "failed_at",
    )


# --- retries and replay -------------------------------------------------------------------

START = datetime.datetime(2024, 1, 31)


def picky(content):
    """A scorer that fails on the texts whose length divides by seven."""
    if len(content) % 7 == 0:
        raise RuntimeError("no answer")
    return longest_sentences(content)


picky.reads_content = True

_SILVER = f"(select * from (select id, {ARTICLE_TEXT} as content from ({_FIRST_PAGES}) b) s where length(content) >= 50)"


def _hours(n: float) -> datetime.datetime:
    return START + datetime.timedelta(hours=n)


def _scored(t, rule: stages.RetryRule, hours: list[float]) -> stages.Layout:
    """All pages through extraction and a failing scorer, and runs that try again at the given hours."""
    layout = stages.Layout(scratch_path(t.spark, "stream"))
    stages.ingest_pages(t.spark, table_files(t.sf_dir, "pages"), layout)
    stages.extract_stage(t.spark, layout, START)
    stages.summary_stage(t.spark, layout, picky, "m", START, attempts=1)
    for n in hours:
        stages.retry_summaries(t.spark, layout, picky, "m", _hours(n), rule, attempts=1)
    return layout


def _tries(t, layout: stages.Layout) -> DataFrame:
    outcomes = stages.read_stage(t.spark, layout, "outcomes").filter("stage = 'summarization'")
    return outcomes.groupBy(F.col("article_id").alias("id")).agg(
        F.count("*").alias("tries"), F.count_if(F.col("outcome") == "failed").alias("failures"), F.max("ts").alias("last_try")
    )


@query(
    "stage_retries", "T1 P7 F5",
    f"""select id, case when length(content) % 7 = 0 then 3 else 1 end::bigint as tries,
      case when length(content) % 7 = 0 then 3 else 0 end::bigint as failures,
      case when length(content) % 7 = 0 then timestamp '2024-01-31 03:12:00.000001' else timestamp '2024-01-31 00:00:00.000001' end as last_try,
      length(content) % 7 = 0 as gave_up from {_SILVER} s""",
)
def stage_retries(t):
    """Failed calls wait one hour, then two; the third failure is the last, however many runs follow."""
    rule = stages.RetryRule(first_wait=3600.0)
    layout = _scored(t, rule, [0.5, 1.1, 2.0, 3.2, 9.0])
    book = layout.book(rule)
    book.update(t.spark)
    given_up = book.orders(t.spark).filter("action = 'give up'").select(F.col("article_id").alias("id"), F.lit(True).alias("_up"))
    return _tries(t, layout).join(given_up, "id", "left").select("id", "tries", "failures", "last_try", F.coalesce("_up", F.lit(False)).alias("gave_up"))


@query(
    "stage_replayed", "T4 T1",
    f"""select id, case when length(content) % 7 = 0 then 4 else 1 end::bigint as tries,
      case when length(content) % 7 = 0 then 3 else 0 end::bigint as failures,
      case when length(content) % 7 = 0 then 1 else 0 end::bigint as replays, true as summarised from {_SILVER} s""",
)
def stage_replayed(t):
    """Dead letters are replayed twice after the scorer is mended; each reaches its stage once."""
    layout = _scored(t, stages.RetryRule(), [1, 2, 3])
    stages.outcome_stage(t.spark, layout)
    letters = state.read_dead_letters(t.spark, layout.table("letters")).filter("queue_name = 'summarization'")
    for n in (4, 5):
        stages.replay(t.spark, layout, letters, _hours(n))
        stages.retry_summaries(t.spark, layout, longest_sentences, "m", _hours(n + 0.5), attempts=1)
    replays = layout.book().orders(t.spark).filter("action = 'replay'").groupBy(F.col("article_id").alias("id")).agg(F.count("*").alias("replays"))
    gold = stages.read_stage(t.spark, layout, "gold").select("id", F.lit(True).alias("_done"))
    found = _tries(t, layout).join(replays, "id", "left").join(gold, "id", "left")
    return found.select("id", "tries", "failures", F.coalesce("replays", F.lit(0).cast("long")).alias("replays"), F.coalesce("_done", F.lit(False)).alias("summarised"))
