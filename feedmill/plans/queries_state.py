"""Processing state, dead letters, replay, backfill and keyed changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedmill import fixed_values as fv
from feedmill.functions.dates import literal_time
from feedmill.operators import aggregates, changes, filters, joins, scoring, state
from feedmill.operators.gates import embedding_gate, extraction_gate, summary_gate
from feedmill.plans import reports
from feedmill.plans.catalog import query
from feedmill.plans.queries_serve import STATE_SQL
from feedmill.plans.views import AS_OF
from feedmill.schemas import normalise_enum

DEAD_SQL = """
select event_id as id, article_id, coalesce(queue_name, stage, 'unknown') as queue_name, model as payload_model,
  error as error_message, retry_count, ts as failed_at
from (select *, row_number() over (partition by article_id order by ts, event_id) as retry_count
  from processing_events where error is not null) e where retry_count >= 3"""


def _letters(t, **options):
    return state.dead_letters(t.processing_events, **options)


def _flat(letters):
    return letters.select(
        "id", "article_id", "queue_name", F.col("payload.model").alias("payload_model"), "error_message",
        "retry_count", "failed_at",
    )


@query("article_state", "T2 W7 W5", STATE_SQL, "processing_events")
def article_state(t):
    return state.article_state(t.processing_events)


@query(
    "running_retries", "W5",
    """select event_id, article_id, ts, row_number() over (partition by article_id order by ts, event_id) as retry_count
       from processing_events where error is not null""",
    "processing_events",
)
def running_retries(t):
    failures = t.processing_events.filter(state.IS_ERROR).select("event_id", "article_id", "ts")
    return state.running_count(failures, "article_id", "ts", "event_id", "retry_count")


@query("dead_letters", "T3", DEAD_SQL, "processing_events")
def dead_letters(t):
    return _flat(_letters(t))


@query("dead_letters_first", "T3", f"select * from ({DEAD_SQL}) d where retry_count = 3", "processing_events")
def dead_letters_first(t):
    return _flat(_letters(t, first_only=True))


@query(
    "dead_letter_search", "P8 K4 M8",
    f"""select * from ({DEAD_SQL}) d where queue_name = 'summarization' and failed_at >= timestamp '2024-01-15 00:00:00'
        order by failed_at desc, id""",
    "processing_events",
)
def dead_letter_search(t):
    return _flat(state.search_dead_letters(_letters(t), queue="summarization", since="2024-01-15"))


_PLAN_SQL = f"""
select id, article_id,
  case when alive is not null and queue_name in ('extraction', 'summarization', 'embedding') then queue_name end as target_queue,
  case when alive is not null and queue_name = 'summarization' then payload_model end as model,
  case when alive is null then 'article deleted'
       when queue_name not in ('extraction', 'summarization', 'embedding') then 'unknown queue' end as skip_reason
from (select d.id, a.id as article_id, a.id as alive, d.queue_name, d.payload_model
  from ({DEAD_SQL}) d left join (select id from articles where processing_status <> 'failed') a on a.id = d.article_id) x"""


def _surviving(t):
    return t.articles.filter(F.col("processing_status") != "failed")


def _replay(t):
    return state.replay_plan(changes.set_null(_letters(t), _surviving(t)))


@query("replay_plan", "T4 J13", _PLAN_SQL, "processing_events articles")
def replay_plan(t):
    return _replay(t)


@query(
    "mark_replayed", "D10 T4",
    f"""select d.id, p.skip_reason is null as replayed,
      case when p.skip_reason is null then timestamp '{AS_OF}' end as replayed_at
    from ({DEAD_SQL}) d join ({_PLAN_SQL}) p on p.id = d.id""",
    "processing_events articles",
)
def mark_replayed(t):
    marked = changes.mark_replayed(changes.set_null(_letters(t), _surviving(t)), _replay(t), AS_OF)
    return marked.select("id", "replayed", "replayed_at")


@query(
    "retryable", "P7",
    f"select article_id, retry_count from ({STATE_SQL}) s where status = 'failed' and retry_count < 20",
    "processing_events",
)
def retryable(t):
    return filters.retryable(state.article_state(t.processing_events), 20).select("article_id", "retry_count")


@query("status_counts", "A1", f"select status, count(*) as n from ({STATE_SQL}) s group by status", "processing_events")
def status_counts(t):
    return aggregates.count_by(state.article_state(t.processing_events), "status")


_DEPTH = f"""select current_stage, count(*) filter (where status = 'pending') as pending,
  count(*) filter (where status = 'failed') as failed from ({STATE_SQL}) s group by current_stage"""


@query("queue_depth", "A7", _DEPTH, "processing_events")
def queue_depth(t):
    return aggregates.queue_depth(state.article_state(t.processing_events))


@query(
    "queue_totals", "A7",
    f"select cast(sum(pending) as bigint) as pending, cast(sum(failed) as bigint) as failed from ({_DEPTH}) d",
    "processing_events",
)
def queue_totals(t):
    return aggregates.queue_totals(aggregates.queue_depth(state.article_state(t.processing_events)))


@query(
    "status_report", "M9 A1 A7",
    f"""select 'status' as section, status as label, cast(null as bigint) as pending, cast(null as bigint) as failed,
      count(*) as n from ({STATE_SQL}) s group by status
    union all select 'queue', current_stage, pending, failed, cast(null as bigint) from ({_DEPTH}) d""",
    "processing_events",
)
def status_report(t):
    return reports.pipeline_status(state.article_state(t.processing_events))


_BEFORE = "timestamp '2024-01-15 00:00:00'"


@query("folded_state", "D4 T2", STATE_SQL, "processing_events")
def folded_state(t):
    """State of the first half of the log folded with the second half equals the whole."""
    halfway = literal_time("2024-01-15")
    earlier = state.article_state(t.processing_events.filter(F.col("ts") < halfway))
    return state.fold_state(earlier, t.processing_events.filter(F.col("ts") >= halfway))


_RESET = f"""
with_reset as (
  select s.article_id, s.status, s.current_stage, s.retry_count, s.error_message from ({STATE_SQL}) s
  where s.article_id not in (select article_id from article_summaries where model = 'model-a')
  union all
  select distinct article_id, 'pending', 'summarization', cast(0 as bigint), cast(null as varchar)
  from article_summaries where model = 'model-a')"""


@query(
    "backfill_reset", "D5 T5 J8",
    f"select * from (with {_RESET} select * from with_reset) x", "processing_events article_summaries",
)
def backfill_reset(t):
    current = state.article_state(t.processing_events).drop("updated_at")
    plan = state.backfill_plan(t.articles, t.article_summaries, model="model-a")
    return changes.reset_for_stage(current, plan, "summarization")


@query(
    "backfill_plan", "T5 U2 X12",
    """select id as article_id, 'extraction' as stage,
      case when id in (select article_id from article_summaries where model = 'model-b') then 'model' else 'since' end as selected_by
    from articles where id in (select article_id from article_summaries where model = 'model-b')
      or scraped_at >= timestamp '2024-01-20 00:00:00'""",
    "articles article_summaries",
)
def backfill_plan(t):
    return state.backfill_plan(t.articles, t.article_summaries, "model-b", "2024-01-20T00:00:00+00:00")


@query(
    "articles_by_model", "J8",
    "select id, title from articles where id in (select article_id from article_summaries where model = 'model-c')",
    "articles article_summaries",
)
def articles_by_model(t):
    return state.summarised_by(t.articles.select("id", "title"), t.article_summaries, "model-c")


@query(
    "missing_features", "U3 D6",
    """select id, 'summary' as feature from articles where id not in (select article_id from article_summaries)
       union all select id, 'embedding' from articles where id not in (select article_id from article_embeddings)""",
    "articles article_summaries article_embeddings",
)
def missing_features(t):
    return joins.missing_features(t.articles, t.article_summaries, t.article_embeddings)


@query(
    "without_model_summary", "D6",
    "select id from articles where id not in (select article_id from article_summaries where model = 'model-b')",
    "articles article_summaries",
)
def without_model_summary(t):
    return joins.without_feature(t.articles.select("id"), t.article_summaries, "model-b")


@query(
    "enqueue_counts", "T6 P6",
    """select count(*) as found, count(*) as enqueued, cast(0 as bigint) as failed from articles
       where scraped_at >= timestamp '2024-01-24 00:00:00' and processing_status in ('pending', 'failed')""",
    "articles",
)
def enqueue_counts(t):
    return state.enqueue_counts(state.enqueue_plan(filters.needing_work(t.articles, AS_OF, 168)))


@query(
    "clear_failed", "T9",
    f"select * from ({STATE_SQL}) s where not (status = 'failed' and current_stage is not distinct from 'embedding')",
    "processing_events",
)
def clear_failed(t):
    return state.clear_failed(state.article_state(t.processing_events), "embedding")


# --- referential actions ------------------------------------------------------------------

_GONE = "select id from articles where processing_status <> 'failed'"


@query(
    "cascade_summaries", "J13", f"select id, article_id from article_summaries where article_id in ({_GONE})",
    "articles article_summaries",
)
def cascade_summaries(t):
    return changes.cascade(t.article_summaries, _surviving(t)).select("id", "article_id")


@query(
    "unlink_dead_letters", "J13",
    f"select d.id, a.id as article_id from ({DEAD_SQL}) d left join ({_GONE}) a on a.id = d.article_id",
    "articles processing_events",
)
def unlink_dead_letters(t):
    return changes.set_null(_letters(t), _surviving(t)).select("id", "article_id")


@query(
    "orphan_embeddings", "J13", f"select id, article_id from article_embeddings where article_id not in ({_GONE})",
    "articles article_embeddings",
)
def orphan_embeddings(t):
    return changes.orphans(t.article_embeddings, _surviving(t)).select("id", "article_id")


# --- keyed changes ------------------------------------------------------------------------


@query(
    "toggle_sources", "D7",
    "select id, name, case when source_type = 'blog' then not active else active end as active from sources", "sources",
)
def toggle_sources(t):
    keys = t.sources.filter(F.col("source_type") == "blog").select("id")
    return changes.toggle(t.sources.select("id", "name", "active"), keys, "id", "active")


@query(
    "set_source_status", "D7",
    """select s.id, s.name, coalesce(c.active, s.active) as active from sources s
       left join (select source_id as id, bool_or(processing_status = 'completed') as active from articles
         where category = 'fr' group by source_id) c on c.id = s.id""",
    "sources articles",
)
def set_source_status(t):
    wanted = t.articles.filter(F.col("category") == "fr").groupBy(F.col("source_id").alias("id")).agg(
        F.bool_or(F.col("processing_status") == "completed").alias("active")
    )
    return changes.apply_changes(t.sources.select("id", "name", "active"), wanted, "id", "active")


_MAPPING = "select concat('https://', source, '.example.com/feed') as old, concat('https://feeds.example.org/', source) as new from (select distinct source from documents) m"


def _mapping(t):
    return t.documents.select("source").distinct().select(
        F.concat(F.lit("https://"), "source", F.lit(".example.com/feed")).alias("old"),
        F.concat(F.lit("https://feeds.example.org/"), "source").alias("new"),
    )


@query(
    "remap_source_urls", "D8",
    f"select s.id, coalesce(m.new, s.url) as url from sources s left join ({_MAPPING}) m on m.old = s.url", "sources",
)
def remap_source_urls(t):
    return changes.remap(t.sources.select("id", "url"), _mapping(t), "url")


@query(
    "remap_report", "D8",
    f"select m.old, m.new, count(s.id) as rows_updated from ({_MAPPING}) m left join sources s on s.url = m.old group by 1, 2",
    "sources",
)
def remap_report(t):
    return changes.remap_report(t.sources, _mapping(t), "url")


@query(
    "subscription_changes", "D9",
    """select s.id, s.email, coalesce(f.frequency, s.frequency) as frequency, coalesce(a.is_active, s.is_active) as is_active
    from subscribers s
      left join (select id, arg_max(frequency, seq) as frequency from subscription_log where action = 'frequency' group by id) f on f.id = s.id
      left join (select id, arg_max(action = 'reactivate', seq) as is_active from subscription_log
        where action in ('unsubscribe', 'reactivate') group by id) a on a.id = s.id""",
    "subscribers subscription_log",
)
def subscription_changes(t):
    return changes.apply_subscription_log(t.subscribers, t.subscription_log).select(
        "id", "email", "frequency", "is_active"
    )


@query(
    "new_subscriptions", "D9 P15 J9",
    f"""select request_seq, email, case when not regexp_matches(email, '{fv.EMAIL_PATTERN}') then 'invalid'
        when not taken and request_seq = first_seq then 'created' else 'exists' end as outcome
    from (select r.*, min(request_seq) over (partition by email) as first_seq,
        email in (select email from subscribers where is_active) as taken
      from (select o.o_orderkey as request_seq, s.email from orders o join subscribers s on s.id = o.o_custkey) r) x""",
    "subscribers",
)
def new_subscriptions(t):
    requests = t.orders.select(F.col("o_orderkey").alias("request_seq"), F.col("o_custkey").alias("id")).join(
        t.subscribers.select("id", "email"), "id"
    )
    existing = t.subscribers.filter("is_active")
    return changes.new_subscriptions(requests, existing).select("request_seq", "email", "outcome")


@query(
    "normalised_status", "D11",
    """select o_orderkey as id, lower(trim(o_orderpriority)) as status,
      lower(trim(o_orderpriority)) in ('1-urgent', '2-high', '3-medium') as status_ok from orders""",
)
def normalised_status(t):
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("status"))
    return normalise_enum(rows, "status", ["1-urgent", "2-high", "3-medium"])


# --- gates and stage outcomes -------------------------------------------------------------


@query(
    "gate_extract", "P9",
    """select id, coalesce(length(full_content) > 100, false) as already_extracted,
      case when coalesce(length(full_content) > 100, false) then 'summarization' else 'extraction' end as next_stage
    from articles""",
    "articles",
)
def gate_extract(t):
    return extraction_gate(t.articles).select("id", "already_extracted", "next_stage")


_SUMMARY_GATE = """select id, gate_text, not (gate_text is null or length(gate_text) < 50) as accepted,
  case when gate_text is null or length(gate_text) < 50 then 'Insufficient content' end as reason
from (select id, coalesce(nullif(full_content, ''), content) as gate_text from articles) g"""


@query("gate_summarize", "P10", _SUMMARY_GATE, "articles")
def gate_summarize(t):
    return summary_gate(t.articles).select("id", "gate_text", "accepted", "reason")


_EMBED_GATE = """select id, has_summary, gate_text, not (gate_text is null or length(gate_text) < 10) as accepted,
  case when gate_text is null or length(gate_text) < 10 then 'Insufficient text' end as reason
from (select a.id, m.article_id is not null as has_summary,
    case when m.article_id is not null then m.summary else coalesce(nullif(a.full_content, ''), a.content) end as gate_text
  from articles a left join (select article_id, arg_min(summary, id) as summary from article_summaries group by 1) m
    on m.article_id = a.id) g"""


@query("gate_embed", "P11 W6", _EMBED_GATE, "articles article_summaries")
def gate_embed(t):
    gated = embedding_gate(t.articles, joins.one_summary(t.article_summaries))
    return gated.select("id", "has_summary", "gate_text", "accepted", "reason")


_OUTCOMES = f"""
select g.id as article_id, 'summarization' as stage,
  case when g.id in (select article_id from article_summaries) then 'skipped' when not accepted then 'failed' else 'success' end as outcome,
  case when g.id not in (select article_id from article_summaries) then reason end as error_message
from ({_SUMMARY_GATE}) g
union all
select g.id, 'embedding',
  case when g.id in (select article_id from article_embeddings) then 'skipped' when not accepted then 'failed' else 'success' end,
  case when g.id not in (select article_id from article_embeddings) then reason end
from ({_EMBED_GATE}) g"""


def _outcomes(t):
    summarised = joins.one_summary(t.article_summaries)
    embedded = t.article_embeddings.select(F.col("article_id").alias("id"), F.lit(True).alias("_done")).distinct()
    done = F.coalesce(F.col("_done"), F.lit(False))
    first = summary_gate(t.articles).join(
        summarised.select(F.col("article_id").alias("id"), F.lit(True).alias("_done")), "id", "left"
    )
    second = embedding_gate(t.articles, summarised).join(embedded, "id", "left")
    parts = [
        scoring.stage_rows(
            gated.withColumnRenamed("id", "article_id"), stage, done, ~F.col("accepted"), F.col("reason")
        )
        for gated, stage in ((first, "summarization"), (second, "embedding"))
    ]
    return parts[0].unionByName(parts[1])


@query("stage_outcomes", "F6 D6", _OUTCOMES, "articles article_summaries article_embeddings")
def stage_outcomes(t):
    return _outcomes(t)


@query(
    "run_audit", "A11",
    f"""select timestamp '2024-01-31 00:00:00' as started_at, timestamp '2024-01-31 01:00:00' as completed_at,
      count(*) filter (where outcome = 'success') as articles_processed,
      count(*) filter (where outcome = 'failed') as articles_failed,
      count(*) filter (where outcome = 'skipped') as articles_skipped, 'scheduled' as "trigger" from ({_OUTCOMES}) o""",
    "articles article_summaries article_embeddings",
)
def run_audit(t):
    return aggregates.run_audit(_outcomes(t), literal_time(AS_OF), literal_time("2024-01-31 01:00:00"))
