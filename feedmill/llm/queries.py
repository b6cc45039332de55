"""The registered queries of the operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedmill.llm import bpe, chat, crosstoken, decontaminate, licenses, lm, merkle, packing, quality, repeats, shards, simhash, topk


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(plan: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = Query(plan, sql)
        return plan

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_bpe")
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and round trip of every document."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, ranks).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query("op4_interleave")
def op4_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of equal row counts and equal mixture."""
    placed = shards.interleave(table(spark, sf_dir, "documents"), 40, ["doc_id"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


#: Words, windows and occurrences as in the operator, by a hash join of every run of words.
OP5_SQL = r"""
with d as (
  select doc_id, row_number() over () as rid,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as ws
  from documents),
i as (
  select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as ws
  from benchmark),
w as (
  select distinct item_id, least(13, len(ws)) as m, array_to_string(ws[s:s + least(13, len(ws)) - 1], ' ') as win
  from (select item_id, ws, unnest(generate_series(1, len(ws) - least(13, len(ws)) + 1)) as s from i where len(ws) > 0)),
runs as (
  select rid, s, m, array_to_string(ws[s:s + m - 1], ' ') as win
  from (select rid, ws, m, unnest(generate_series(1, len(ws) - m + 1)) as s from d, (select distinct m from w) where len(ws) >= m)),
hits as (select rid, s, r.m, item_id from runs r join w on r.win = w.win and r.m = w.m),
covered as (select rid, count(distinct p) as n_hit from (select rid, unnest(generate_series(s, s + m - 1)) as p from hits) group by rid),
found as (select rid, count(distinct item_id) as n_items, array_to_string(list_sort(list(distinct item_id::varchar)), ',') as items from hits group by rid)
select doc_id, len(ws) as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from d left join covered using (rid) left join found using (rid)
"""


@query("op5_decontaminate", OP5_SQL)
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    items = F.coalesce("item_ids", F.array().cast("array<string>"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), "contaminated",
    )


@query("op8_simhash")
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    found = simhash.membership(table(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


@query("op7_repeats")
def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of 200 bytes that occur more than once."""
    found = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


OP10_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as c
  from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, d.vec_id, list_inner_product(q.c, d.c)::bigint as score
  from v q join v d on q.vec_id <> d.vec_id where q.vec_id % 50 = 0)
select query_id, rank, vec_id, score from (
  select *, (row_number() over (partition by query_id order by score desc, vec_id))::integer as rank from s)
where rank <= 5
"""


@query("op10_topk", OP10_SQL)
def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows for each vector whose id is divisible by 50."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


@query("op2_lm")
def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every document; the target is what the labels call good and not toxic."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0").select("doc_id")
    return lm.score(docs, good, key="doc_id")


@query("op6_licenses")
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License families of every document."""
    found = licenses.license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_notices", F.array_join("families", ",").alias("families"), F.array_join("confirmed", ",").alias("confirmed"))


#: Tool traffic read off the turns of ``conversations``: an assistant turn calls a tool and the next turn of a user
#: is its result.  The arguments hold the whole text of the turn.  Every third call names the call two turns before;
#: some arguments break their schema.
CALLS = """
select conv_id, turn, concat('c', turn) as call_id,
  case when length(text) % 3 = 0 then 'search' when length(text) % 3 = 1 then 'measure' else 'open' end as name,
  case when text is not null then to_json(named_struct('text', text,
    'size', parse_json(case when length(text) % 7 = 0 then '"many"' else cast(length(text) as string) end),
    'after', case when turn >= 3 and length(text) % 3 = 0 then concat('$c', turn - 2) end)) end as arguments
from conversations where role = 'assistant'
"""
RESULTS = "select conv_id, turn, concat('c', turn - 1) as call_id, text as content from conversations where role = 'user' and turn > 0"
SCHEMAS = """
select * from values ('search', 'text', 'string', true), ('search', 'size', 'integer', true), ('search', 'after', 'string', false),
  ('measure', 'text', 'string', true), ('measure', 'size', 'number', false), ('measure', 'unit', 'string', true) as t(tool, field, type, required)
"""


@query("op9_chat")
def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked, ordered and validated calls and results of every conversation."""
    turns = table(spark, sf_dir, "conversations")
    read = lambda sql: spark.sql(sql.replace("{", "{{").replace("}", "}}").replace("from conversations", "from {turns}"), turns=turns)
    found = chat.linked(read(CALLS), read(RESULTS), spark.sql(SCHEMAS))
    return found.withColumn("errors", F.array_join("errors", "; "))


@query("op12_packing")
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces in sequences of at most 2,048 tokens."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        tokenizer = file.read()
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer)


@query("op13_merkle")
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of all documents; a fifth of them is verified against lower-cased texts."""
    docs = table(spark, sf_dir, "documents")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = merkle.leaf_digest([*values, F.translate("text", upper, lower)])
    found = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, tampered)
    made = merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], found=found)
    return made.withColumnRenamed("proof", "proof_sha256")


@query("op11_crosstoken")
def op11_crosstoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment numbers of every document under a byte-level and a word-piece tokenizer."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        tokenizer = file.read()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model = file.read()
    return crosstoken.link_statistics(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer, model)
