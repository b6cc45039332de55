"""The scheduled run: ingest, stop when nothing is new, score the digest, deliver, audit [T8].

A ledger of intents and steps makes it resumable: whatever it was doing when it stopped, the next call finishes.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from feedmill import fixed_values as fv
from feedmill.functions.dates import literal_time, moment
from feedmill.operators.scoring import Scorer, longest_sentences
from feedmill.plans import digests, ingest
from feedmill.schemas import ARTICLES
from feedmill.sources.tables import append_articles, read_articles
from feedmill.streaming.batches import write_batch
from feedmill.streaming.snapshots import Folder


@dataclass(frozen=True)
class Store:
    """Folders of the tables a run reads and appends to."""

    root: str

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"


def recent_window(articles: DataFrame, as_of: datetime | str, hours: float) -> DataFrame:
    """Articles whose scrape date can lie in the window, so that older folders are not read."""
    first_day = (moment(as_of) - timedelta(hours=hours)).date().isoformat()
    return articles.filter(F.col("scraped_date") >= F.lit(first_day).cast("date"))


class Ledger:
    """What runs intend and what they have done, one small file for each step of a numbered run.

    A step's effect comes first and its entry after it, and every effect replaces what an earlier try of the same run
    and step left, so a run that stopped anywhere is finished by doing the steps without an entry again.
    """

    def __init__(self, spark: SparkSession, store: Store):
        self.folder = Folder(spark, store.path("run_ledger"))

    def _entries(self) -> dict[int, set[str]]:
        found: dict[int, set[str]] = {}
        for name in self.folder.names():
            number, _, step = name.partition("-")
            if number.isdigit():
                found.setdefault(int(number), set()).add(step)
        return found

    def open_run(self) -> int | None:
        """The run that has an intent and no end."""
        unfinished = [n for n, steps in self._entries().items() if "intent" in steps and LAST_STEP not in steps]
        return min(unfinished, default=None)

    def next_run(self) -> int:
        return max(self._entries(), default=0) + 1

    def intent(self, run: int) -> dict:
        return json.loads(self.folder.read(f"{run}-intent"))

    def has(self, run: int, step: str) -> bool:
        return step in self._entries().get(run, set())

    def enter(self, run: int, step: str, content: dict | None = None) -> None:
        self.folder.publish(f"{run}-{step}", json.dumps(content or {}))


#: Steps of a run after its intent, in order.
STEPS = ("articles", "items", "sections", "deliveries", "audit")
LAST_STEP = STEPS[-1]


def _written(rows: DataFrame, path: str) -> DataFrame:
    """Rows of one run and step in a folder of their own, replaced by a repeated try."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def daily_run(
    spark: SparkSession,
    store: Store,
    sources: DataFrame,
    landed_feeds: DataFrame,
    landed_pages: DataFrame,
    subscribers: DataFrame,
    as_of: datetime | str,
    hours: float = fv.DEFAULT_HOURS_BACK,
    scorer: Scorer = longest_sentences,
    trigger: str = "scheduled",
    dry_run: bool = False,
    ledger: Ledger | None = None,
) -> dict[str, int]:
    """One run; returns its statistics.  ``dry_run`` computes them and writes nothing [S17].

    The run first writes down what it intends: the new articles and the statistics.  Then it stores the articles, makes
    the digest, writes its sections and deliveries and the audit row, and notes each step in the ledger.  After a
    stop at any point the next call finishes that run from its intent, with its own time, and only then starts another,
    unless it was called for the same time.
    """
    ledger = ledger or Ledger(spark, store)
    unfinished = None if dry_run else ledger.open_run()
    if unfinished is not None:
        intent = ledger.intent(unfinished)
        stats = _finish(spark, store, ledger, unfinished, sources, subscribers, scorer)
        if moment(intent["as_of"]) == moment(as_of):
            return stats
    held = read_articles(spark, store.path("articles"))
    labelled = ingest.ingest(sources, landed_feeds, landed_pages, held.select("url"), as_of, hours)
    stats = ingest.stats(labelled, sources).first().asDict()
    if dry_run:
        return stats
    run = ledger.next_run()
    if stats["articles_new"] > 0:
        last_id = held.agg(F.max("id")).first()[0]
        _written(ingest.new_articles(labelled, as_of, 0 if last_id is None else last_id + 1), store.path(f"runs/{run}/articles"))
    ledger.enter(run, "intent", {"as_of": moment(as_of).isoformat(sep=" "), "hours": hours, "trigger": trigger, "stats": stats})
    return _finish(spark, store, ledger, run, sources, subscribers, scorer)


def _finish(spark: SparkSession, store: Store, ledger: Ledger, run: int, sources: DataFrame, subscribers: DataFrame, scorer: Scorer) -> dict[str, int]:
    """Do the steps of a run that its ledger lacks."""
    intent = ledger.intent(run)
    as_of, hours, stats = intent["as_of"], intent["hours"], intent["stats"]

    def own(name: str) -> str:
        return store.path(f"runs/{run}/{name}")

    def articles() -> None:
        new = spark.read.schema(ARTICLES).parquet(own("articles"))
        day = F.lit(moment(as_of).date().isoformat()).cast("date")
        stored = read_articles(spark, store.path("articles")).filter(F.col("scraped_date") == day)  # one folder
        append_articles(new.join(stored.select("id"), "id", "left_anti").select(*new.columns), store.path("articles"))

    def items() -> None:
        window = recent_window(read_articles(spark, store.path("articles")), as_of, hours)
        _written(digests.scored_digest(window, sources, as_of, hours, scorer=scorer), own("items"))

    def sections() -> None:
        bodies = digests.section_bodies(digests.sections(spark.read.parquet(own("items"))))
        write_batch(bodies.select(literal_time(as_of).alias("run_at"), "*"), store.path("digest_sections"), run)

    def deliveries() -> None:
        chosen = spark.read.parquet(own("items"))
        ids = chosen.agg(F.array_sort(F.collect_set("id")).alias("ids")).scalar()  # a few articles per source
        sent = digests.deliveries(subscribers, chosen, as_of)
        logged = sent.select(
            F.xxhash64("subscription_id", "sent_at").alias("id"), "*", ids.alias("articles_ids"), literal_time(as_of).alias("created_at")
        )
        write_batch(logged, store.path("email_deliveries"), run)

    def audit() -> None:
        failed = 0
        if stats["articles_new"] > 0:
            failed = spark.read.parquet(f"{store.path('email_deliveries')}/batch_id={run}").filter("status = 'failed'").count()
        row = spark.range(1).select(
            F.lit(run).cast("long").alias("id"),
            literal_time(as_of).alias("started_at"),
            literal_time(as_of).alias("completed_at"),
            F.lit(stats["articles_new"]).cast("long").alias("articles_processed"),
            F.lit(failed).cast("long").alias("articles_failed"),
            F.lit(stats["articles_duplicate"]).cast("long").alias("articles_skipped"),
            F.lit(intent["trigger"]).alias("trigger"),
        )
        write_batch(row, store.path("pipeline_runs"), run)

    effects = dict(zip(STEPS, (articles, items, sections, deliveries, audit)))
    wanted = STEPS if stats["articles_new"] > 0 else (LAST_STEP,)
    for step in wanted:
        if not ledger.has(run, step):
            effects[step]()
            ledger.enter(run, step)
    return stats
