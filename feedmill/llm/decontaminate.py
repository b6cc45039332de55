"""Benchmark decontamination by a prefix-filtered set join [op5].

A window is 13 consecutive words of a benchmark item (all words of a shorter item).  A document holds a
window if it holds all its shingles (runs of three words) in place.  The shingles of a window are
ordered by rarity, counted over all documents; since every one of them must occur, the necessary prefix
is the rarest shingle alone.  Documents are joined with these prefix shingles; position and length
bounds place the window in the document, and its words are then compared exactly.  A window with a
shingle that occurs nowhere is dropped before the join.

DataFrame functions only, no UDF.  The texts are read three times (counts, join, word counts) and never
shuffled.  The windows are broadcast only if their measured size is below ``BROADCAST_BYTES``;
beyond it both joins are shuffle joins on the shingle's 64-bit key, which AQE may split.

* Words: A-Z become a-z, then runs of digits, a-z and everything beyond ASCII.  Null texts have none.
* Results belong to a (document id, text) pair, so repeated rows and repeated or null ids are safe: every
  input row comes back once, with the result of its own text.
* Items without words, and null texts of items, have no windows; a repeated item id counts once.
* An empty benchmark hits nothing.  Columns of the input that are named like added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedmill.session import staged

WINDOW = 13
SHINGLE = 3
BROADCAST_BYTES = 16 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BETWEEN_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ADDED = ["n_words", "n_hit", "item_ids", "contaminated"]


def words(text: Column) -> Column:
    """The words of a text as an array; ``lower`` does only ASCII where there is nothing else."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(lowered, _BETWEEN), "")


def word_count(text: Column) -> Column:
    parts = F.split(text, _BETWEEN_ANY_CASE)
    empty = F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0) + F.when(
        (F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1
    ).otherwise(0)
    return F.coalesce((F.size(parts) - empty).cast("long"), F.lit(0).cast("long"))


def _shingle_key(parts: list[Column]) -> Column:
    return F.xxhash64(F.lit(len(parts)), *parts)


def item_windows(items: DataFrame, window: int, item_id: str, text: str) -> DataFrame:
    """(item, window as space-joined words, number of words), one row for each item and different window."""
    parts = items.select(F.col(item_id).alias("_item"), words(F.col(text)).alias("_words")).filter(F.size("_words") > 0)
    length = F.least(F.lit(window), F.size("_words"))
    starts = parts.withColumn("_m", length).withColumn("_at", F.explode(F.sequence(F.lit(1), F.size("_words") - F.col("_m") + 1)))
    return starts.select("_item", F.array_join(F.slice("_words", F.col("_at"), F.col("_m")), " ").alias("_window"), "_m").distinct()


def _window_shingles(windows: DataFrame, lengths: list[int]) -> DataFrame:
    """(window, words, offset, key) of every shingle of every window."""
    parts = windows.withColumn("_words", F.split("_window", " ")).withColumn("_k", F.least(F.lit(SHINGLE), F.col("_m")))
    parts = parts.withColumn("_off", F.explode(F.sequence(F.lit(0), F.col("_m") - F.col("_k"))))
    key = None
    for k in lengths:
        own = _shingle_key([F.get("_words", F.col("_off") + i) for i in range(k)])
        key = F.when(F.col("_k") == k, own) if key is None else key.when(F.col("_k") == k, own)
    return parts.select("_window", "_m", "_off", key.alias("_shingle"))


def _document_shingles(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """Each position of each document with the key of the shingle that begins there."""
    at = docs.select("*", F.posexplode("_words").alias("_pos", "_word"))
    keys = [_shingle_key([F.col("_word")] + [F.get("_words", F.col("_pos") + i) for i in range(1, k)]) for k in lengths]
    return at.withColumn("_shingle", keys[0] if len(keys) == 1 else F.explode(F.array(*keys))).drop("_word")


def find_windows(
    docs: DataFrame, windows: DataFrame, doc_id: str, text: str, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """(document id, text key, position, words, window) of every occurrence of a window in a document."""
    size = windows.agg(
        F.sum(F.octet_length("_window") + 64).alias("bytes"), F.collect_set(F.least(F.lit(SHINGLE), F.col("_m"))).alias("k")
    ).head()
    lengths = sorted(size["k"]) or [SHINGLE]
    small = (size["bytes"] or 0) * WINDOW <= broadcast_bytes
    sized = F.broadcast if small else (lambda df: df)

    keyed = docs.select(F.col(doc_id).alias("_doc"), F.xxhash64(text).alias("_text"), words(F.col(text)).alias("_words"))
    shingles = _window_shingles(windows, lengths)
    wanted = shingles.select("_shingle").distinct()
    counts = (
        _document_shingles(keyed.select("_words"), lengths)
        .select("_shingle")
        .join(sized(wanted), "_shingle", "left_semi")
        .groupBy("_shingle")
        .agg(F.count("*").alias("_n"))
    )
    rarity = F.coalesce("_n", F.lit(0))
    prefix = (
        shingles.join(counts, "_shingle", "left")
        .groupBy("_window", "_m")
        .agg(F.min(F.struct(rarity.alias("n"), F.col("_off").alias("off"), F.col("_shingle").alias("key"))).alias("_first"))
        .filter("_first.n > 0")
        .select("_window", "_m", F.col("_first.off").alias("_off"), F.col("_first.key").alias("_shingle"))
    )
    start = F.col("_pos") - F.col("_off")
    placed = (start >= 0) & (start + F.col("_m") <= F.size("_words"))
    if small:
        same = F.array_join(F.slice("_words", start + 1, F.col("_m")), " ") == F.col("_window")
        found = _document_shingles(keyed, lengths).alias("d").join(
            sized(prefix).alias("p"), (F.col("d._shingle") == F.col("p._shingle")) & placed & same
        )
    else:  # the words stay where they are: slim candidates first, then exact comparison by document
        slim = _document_shingles(keyed.withColumn("_size", F.size("_words")), lengths).drop("_words")
        candidates = slim.alias("d").join(prefix.alias("p"), F.col("d._shingle") == F.col("p._shingle"))
        candidates = candidates.filter((start >= 0) & (start + F.col("_m") <= F.col("_size")))
        candidates = candidates.select("_doc", "_text", "_window", "_m", start.alias("_pos"), F.lit(0).alias("_off"))
        same = F.array_join(F.slice("_words", F.col("_pos") + 1, F.col("_m")), " ") == F.col("_window")
        found = candidates.alias("c").join(
            keyed.dropDuplicates(["_doc", "_text"]).alias("k"),
            F.col("c._doc").eqNullSafe(F.col("k._doc")) & F.col("c._text").eqNullSafe(F.col("k._text")) & same,
        ).select("c._doc", "c._text", "c._window", "c._m", "c._pos", "c._off")
    return found.select("_doc", "_text", (F.col("_pos") - F.col("_off")).alias("_at"), "_m", "_window").distinct()


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    one_in: int = 20,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``docs`` with n_words, n_hit (words inside occurring windows), item_ids and contaminated.

    ``item_ids`` holds the items with occurring windows as sorted strings, or null.  A document is
    contaminated if at least one word in ``one_in`` is hit.
    """
    windows = staged(item_windows(items, window, item_id, item_text), "windows")
    different = windows.select("_window", "_m").distinct()
    hits = staged(find_windows(docs, different, doc_id, text, broadcast_bytes), "hits")

    end = F.col("_at") + F.col("_m")
    reached = F.max(end).over(W.partitionBy("_doc", "_text").orderBy("_at", "_m", "_window").rowsBetween(W.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), end - F.greatest(F.col("_at"), F.coalesce(reached, F.lit(0))))
    covered = hits.select("_doc", "_text", fresh.alias("_fresh")).groupBy("_doc", "_text").agg(F.sum("_fresh").alias("_hit"))
    by_item = (
        hits.select("_doc", "_text", "_window").distinct()
        .join(windows.select("_window", "_item"), "_window")
        .groupBy("_doc", "_text")
        .agg(F.array_sort(F.collect_set(F.col("_item").cast("string"))).alias("_items"))
    )
    pair = ["_doc", "_text"]
    found = covered.alias("a").join(
        by_item.alias("b"), F.col("a._doc").eqNullSafe(F.col("b._doc")) & F.col("a._text").eqNullSafe(F.col("b._text")), "left"
    ).select(*[F.col(f"a.{c}") for c in pair], "_hit", "_items")

    kept = [c for c in docs.columns if c not in ADDED]
    own = [F.col(c).alias(f"_in{i}") for i, c in enumerate(kept)]  # no column of the input can clash with the ones joined to it
    rows = docs.select(*own, F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_key"), word_count(F.col(text)).alias("n_words"))
    hit = F.coalesce("_hit", F.lit(0).cast("long"))
    return rows.join(
        found, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_text")), "left"
    ).select(
        *[F.col(f"_in{i}").alias(c) for i, c in enumerate(kept)], "n_words", hit.alias("n_hit"), F.col("_items").alias("item_ids"),
        ((hit > 0) & (hit * one_in >= F.col("n_words"))).alias("contaminated"),
    )
