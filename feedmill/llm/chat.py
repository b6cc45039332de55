"""Chat formatting: linking tool calls with their results [op9].

Calls and results meet in a hash join by (conversation, identifier).  Calls are put in topological order: a call
stands after every call of its conversation whose result it names as ``$identifier`` in its arguments.  The
arguments are validated against the schema of the tool, and calls and results become canonical JSON
(sorted keys, no blanks), one line each.

DataFrame functions only.  No conversation is gathered: lines carry their place (level, turn, identifier), so
a conversation of any length is many rows.  Levels are found in rounds, one per step of the longest
chain; each round's frontier is one join, written to the shared folder.

* Of several calls (results) with one identifier in a conversation the smallest (turn, text) counts; the others
  come back with status ``repeated``, and equal rows come back once.
* A call without result is ``unanswered``; a result without call is ``orphan`` and has level 0.
* Names of calls that do not exist are no dependency, a call's own name neither.  Calls on or behind a
  cycle have status ``cycle`` and no level.
* Rows without conversation or identifier are dropped: nothing can be linked to them.
* Arguments that are not a JSON object, calls of unknown tools, missing or null required fields, fields
  of another type and fields the schema does not have make a call invalid, with the errors sorted.
* Null arguments are not JSON and are written as null.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedmill.session import staged

#: Types of JSON values as schemas name them, by the type names of variants (fixed values).
KINDS = {"BIGINT": "integer", "STRING": "string", "BOOLEAN": "boolean", "DOUBLE": "number", "FLOAT": "number", "VOID": "null"}


def _kind(value: Column) -> Column:
    """The JSON type of a variant."""
    name = F.schema_of_variant(value)
    out = F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name.startswith("DECIMAL"), "number")
    for variant, kind in KINDS.items():
        out = out.when(name == variant, kind)
    return out.otherwise("other")


def _first(rows: DataFrame, text: list[str]) -> DataFrame:
    """Different rows with ``_again``: whether an earlier one has the same identifier."""
    rows = rows.filter("conv_id IS NOT NULL AND call_id IS NOT NULL").distinct()
    place = F.row_number().over(W.partitionBy("conv_id", "call_id").orderBy("turn", *text))
    return rows.withColumn("_again", place > 1)


def validated(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """(conv_id, call_id, errors) of each different call; ``schemas`` has (tool, field, type, required)."""
    parsed = F.try_parse_json("arguments")
    one = calls.select("conv_id", "call_id", "name", parsed.alias("_json"))
    kind = F.coalesce(_kind(F.col("_json")), F.lit("none"))
    known = schemas.select(F.col("tool").alias("name")).distinct().withColumn("_known", F.lit(True))
    whole = one.join(known, "name", "left").select(
        "conv_id", "call_id", F.when(F.col("_known").isNull(), "unknown tool").when(kind != "object", "arguments are not an object").alias("error")
    )
    objects = one.filter(kind == "object").select("conv_id", "call_id", "name", F.to_json("_json").alias("_text"))
    fields = objects.select("*", F.explode_outer(F.json_object_keys("_text")).alias("field"))
    raw = F.from_json("_text", "map<string,variant>")
    typed = fields.filter("field IS NOT NULL").select("conv_id", "call_id", "name", "field", _kind(F.element_at(raw, F.col("field"))).alias("_is"))
    wanted = schemas.select(F.col("tool").alias("name"), "field", F.col("type").alias("_type"), F.col("required").alias("_required"))
    fits = (F.col("_is") == F.col("_type")) | ((F.col("_type") == "number") & (F.col("_is") == "integer"))
    empty = (F.col("_is") == "null") & ~F.coalesce("_required", F.lit(False))
    wrong = typed.join(known, "name", "left_semi").join(wanted, ["name", "field"], "left").select(
        "conv_id", "call_id",
        F.when(F.col("_type").isNull(), F.concat(F.lit("unexpected "), F.col("field")))
        .when(~fits & ~empty, F.concat(F.col("field"), F.lit(" is not "), F.col("_type"))).alias("error"),
    )
    needed = objects.join(wanted.filter("_required"), "name").select("conv_id", "call_id", "field")
    missing = needed.join(typed.select("conv_id", "call_id", "field"), ["conv_id", "call_id", "field"], "left_anti").select(
        "conv_id", "call_id", F.concat(F.lit("missing "), F.col("field")).alias("error")
    )
    errors = whole.union(wrong).union(missing).groupBy("conv_id", "call_id")
    return errors.agg(F.array_sort(F.collect_set("error")).alias("errors"))


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of each call that is not on or behind a cycle; level 0 depends on nothing."""
    named = F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("arguments", F.lit("")), F.lit(r"\$([A-Za-z0-9_-]+)"), F.lit(1))))
    nodes = calls.select("conv_id", "call_id")
    edges = calls.select("conv_id", "call_id", named.alias("on")).filter("on != call_id")
    edges = staged(edges.join(nodes.withColumnRenamed("call_id", "on"), ["conv_id", "on"], "left_semi"), "edges")
    placed = staged(nodes.join(edges, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0)), "levels")
    done, level = placed, 0
    while not placed.isEmpty() and not edges.isEmpty():
        level += 1
        before = done.select("conv_id", F.col("call_id").alias("on"))
        left = staged(edges.join(before, ["conv_id", "on"], "left_anti"), "edges")
        ready = edges.select("conv_id", "call_id").distinct().join(left, ["conv_id", "call_id"], "left_anti")
        placed = staged(ready.withColumn("level", F.lit(level)), "levels")
        done, edges = done.union(placed), left
    return done


def linked(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """(conv_id, level, turn, call_id, kind, status, errors, line): one canonical line per call and result.

    ``calls`` has (conv_id, turn, call_id, name, arguments), ``results`` (conv_id, turn, call_id, content).
    """
    calls = staged(_first(calls.select("conv_id", "turn", "call_id", "name", "arguments"), ["name", "arguments"]), "calls")
    results = _first(results.select("conv_id", "turn", "call_id", "content"), ["content"])
    own = calls.filter("NOT _again").drop("_again")
    answers = results.select("conv_id", "call_id").distinct().withColumn("_answered", F.lit(True))
    keys = ["conv_id", "call_id"]
    order = staged(levels(own), "order")
    rows = calls.join(validated(own, schemas), keys, "left").join(order, keys, "left").join(answers, keys, "left")
    parsed = F.coalesce(F.to_json(F.try_parse_json("arguments")), F.to_json(F.try_parse_json(F.to_json(F.struct("arguments")))))
    body = F.when(F.col("arguments").isNull(), "null").when(F.try_parse_json("arguments").isNotNull(), parsed).otherwise(
        F.regexp_extract(F.to_json(F.struct("arguments")), r'^\{"arguments":(.*)\}$', 1)
    )
    quoted = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(F.col(c).alias("x"))), r'^(?s)\{"x":(.*)\}$', 1), F.lit("null"))
    line = F.concat(F.lit('{"arguments":'), body, F.lit(',"call_id":'), quoted("call_id"), F.lit(',"name":'), F.when(F.col("name").isNull(), "null").otherwise(quoted("name")), F.lit("}"))
    status = F.when(F.col("_again"), "repeated").when(F.col("level").isNull(), "cycle").when(F.col("_answered"), "linked").otherwise("unanswered")
    nothing = F.array().cast("array<string>")
    made = rows.select(
        "conv_id", F.when(~F.col("_again"), F.col("level")).alias("level"), "turn", "call_id", F.lit("call").alias("kind"), status.alias("status"),
        F.when(F.col("_again"), nothing).otherwise(F.coalesce("errors", nothing)).alias("errors"), line.alias("line"),
    )
    called = order.select(*keys, "level", F.lit(True).alias("_called"))
    known = own.select(*keys).withColumn("_exists", F.lit(True))
    got = results.join(called, keys, "left").join(known, keys, "left")
    state = F.when(F.col("_again"), "repeated").when(F.col("_exists").isNull(), "orphan").when(F.col("_called").isNull(), "cycle").otherwise("linked")
    text = F.concat(F.lit('{"call_id":'), quoted("call_id"), F.lit(',"content":'), F.when(F.col("content").isNull(), "null").otherwise(quoted("content")), F.lit("}"))
    place = F.when(F.col("_again"), F.lit(None)).when(F.col("_exists").isNull(), 0).otherwise(F.col("level"))
    taken = got.select("conv_id", place.cast("int").alias("level"), "turn", "call_id", F.lit("result").alias("kind"), state.alias("status"), nothing.alias("errors"), text.alias("line"))
    return made.union(taken)
