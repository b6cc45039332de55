"""License scans by a trained paragraph classifier [op6].

Paragraphs (lines of a text) are classified by a multinomial logistic regression on the presence of word
bigrams and trigrams.  Classes are none, unknown (a licence notice of no known family) and the families.  It
is trained here: the cue patterns below label paragraphs of a bounded sample of documents, and the standard
notices of each family are added.  Every fifth example is held out of training; a temperature fitted on them
calibrates the probabilities.  A notice whose best family stays below ``CERTAIN`` is called unknown.
All n-grams that occur in more notices than other paragraphs of the training set have weights, the templates'
among them.  N-grams of exactly the same training paragraphs cannot be told apart, so they are learned as one feature
whose weight they share evenly; the number of features follows the paragraphs and not the length of their texts.

A predicted family is confirmed if its notice template and the paragraph share at least ``CONFIRMED``
of the template's bigrams.

DataFrame functions only: n-grams with a weight are found by a join on their 64-bit hash and summed by paragraph;
paragraphs without such n-grams are none.  Up to ``MOST_BROADCAST`` weights are broadcast (so that has a proven
bound), more are joined by shuffle.  The training set is limited by ``MOST_DOCUMENTS`` documents without and as many
with cues, those of all documents whose hashes are smallest.

* Null and empty texts have no paragraphs.  n-grams count once per paragraph, whatever the length of the paragraph.
* Results belong to a (document id, text) pair, so repeated rows and ids are safe; every row comes back once.
* Without any notice in the sample the templates alone are learned.  Empty tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedmill.session import staged

# The standard notices of public licences, and cues that label paragraphs for training.
NOTICES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "cc0": "To the extent possible under law, the author has waived all copyright under CC0 1.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "lgpl": "Licensed under the GNU Lesser General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mpl-2.0": "This file is subject to the terms of the Mozilla Public License, v. 2.0.",
    "proprietary": "All rights reserved.",
}
CUES = {
    "apache-2.0": r"apache license",
    "bsd": r"redistribution and use in source|bsd license",
    "cc-by": r"creative commons attribution|cc by 4",
    "cc-by-nc": r"cc by-nc",
    "cc-by-sa": r"cc by-sa",
    "cc0": r"cc0",
    "gpl-3.0": r"gnu general public license",
    "lgpl": r"gnu lesser general public",
    "mit": r"mit license",
    "mpl-2.0": r"mozilla public license",
    "proprietary": r"all rights reserved",
}
ANY_CUE = r"licen[cs]e|copyright|all rights reserved|redistribution and use"

FAMILIES = sorted(NOTICES)
CLASSES = ["none", "unknown", *FAMILIES]
MOST_DOCUMENTS = 2_000
MOST_BROADCAST = 1 << 16
CERTAIN = 0.5
CONFIRMED = 0.6


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}.\-]+|[.](?=\s|$)"), "")


def bigrams(parts: Column) -> Column:
    """Neighbouring words; the lambda sees only its arguments, so ``parts`` is not evaluated for each element."""
    rest = F.greatest(F.size(parts) - 1, F.lit(0))
    return F.zip_with(F.slice(parts, F.lit(1), rest), F.slice(parts, F.lit(2), rest), lambda a, b: F.concat_ws(" ", a, b))


def _grams(parts: Column) -> Column:
    rest = F.greatest(F.size(parts) - 2, F.lit(0))
    three = F.zip_with(F.slice(bigrams(parts), F.lit(1), rest), F.slice(parts, F.lit(3), rest), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(bigrams(parts), three))


def _label(paragraph: Column) -> Column:
    out = F.when(~F.lower(paragraph).rlike(ANY_CUE + "|" + "|".join(CUES.values())), CLASSES.index("none"))
    for family in FAMILIES:
        out = out.when(F.lower(paragraph).rlike(CUES[family]), CLASSES.index(family))
    return out.otherwise(CLASSES.index("unknown")).cast("double")


def _paragraphs(text: Column) -> Column:
    return F.split(text, r"\r?\n")


def _notices(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(f).alias("family"), F.lit(NOTICES[f]).alias("notice")) for f in FAMILIES]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _sample(docs: DataFrame, text: str, most: int) -> DataFrame:
    """(_t) of at most ``most`` different texts with cues and as many without; only hashes are dealt and sorted."""
    own = F.col(text)
    mark = F.xxhash64(F.lit(6), own)
    marks = docs.filter(own.isNotNull()).select(mark.alias("_mark"), F.lower(own).rlike(ANY_CUE).alias("_cued")).distinct()
    marks = staged(marks, "marks")
    chosen = [marks.filter(F.col("_cued") == cued).orderBy("_mark").limit(most).select("_mark") for cued in (True, False)]
    return docs.select(own.alias("_t"), mark.alias("_mark")).join(F.broadcast(chosen[0].union(chosen[1])), "_mark", "left_semi").select("_t").distinct()


def fit(docs: DataFrame, text: str = "text", most: int = MOST_DOCUMENTS) -> tuple[DataFrame, list[float], float]:
    """(gram, w: a weight per class), the intercepts, and the temperature."""
    spark = docs.sparkSession
    sample = _sample(docs, text, most).select(F.explode(_paragraphs(F.col("_t"))).alias("p")).union(_notices(spark).select(F.col("notice").alias("p")))
    examples = sample.filter("p != ''").distinct().select("p", _label(F.col("p")).alias("label"), _grams(words(F.col("p"))).alias("grams"))
    examples = examples.withColumn("fold", F.pmod(F.xxhash64("p"), F.lit(5)))
    template = F.col("p").isin(list(NOTICES.values()))
    examples = staged(examples.filter(F.size("grams") > 0).withColumn("training", (F.col("fold") != 0) | template).withColumn("row", F.xxhash64("p")), "examples")
    seen = examples.filter("training").select("row", F.explode("grams").alias("gram"), (F.col("label") > 0).alias("notice"))
    counts = seen.groupBy("gram").agg(F.count_if("notice").alias("n"), F.count_if(~F.col("notice")).alias("other")).filter("n > other")
    # n-grams of the same rows have the same two sums of row hashes, which are added without gathering the rows
    rows_of = seen.join(counts.select("gram"), "gram").groupBy("gram").agg(
        F.bit_xor(F.xxhash64("row")).alias("one"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("two"), F.count("*").alias("n")
    )
    telling = staged(rows_of.select("gram", F.concat_ws(".", "one", "two", "n").alias("feature")), "telling")
    features = {r.feature: r.k for r in telling.groupBy("feature").agg(F.count("*").alias("k")).orderBy("feature").collect()}
    held = examples.select("row", F.explode("grams").alias("gram")).join(telling, "gram").groupBy("row").agg(F.collect_set("feature").alias("features"))
    inputs = examples.filter("training").select("row", "label").join(held, "row", "left")
    inputs = inputs.select("label", F.coalesce("features", F.array().cast("array<string>")).alias("features"))
    vectors = CountVectorizerModel.from_vocabulary(list(features), inputCol="features", outputCol="x").setBinary(True).transform(inputs)
    learner = LogisticRegression(featuresCol="x", labelCol="label", family="multinomial", regParam=1e-4, maxIter=30)
    model = learner.fit(vectors.coalesce(4))  # a bounded sample
    weights, intercepts = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    classes = len(CLASSES)  # absent last classes have no row
    rows = [(f, [float(weights[c][j]) / k if c < len(weights) else 0.0 for c in range(classes)]) for j, (f, k) in enumerate(features.items())]
    biases = [float(intercepts[c]) if c < len(intercepts) else -50.0 for c in range(classes)]
    table = staged(telling.join(spark.createDataFrame(rows, "feature string, w array<double>"), "feature").select("gram", "w"), "weights")
    temperature = _temperature(examples.filter("fold = 0"), table, biases)
    return table, biases, temperature


def _scores(biases: list[float]) -> Column:
    """The class scores of one group of weights."""
    return F.array(*[F.coalesce(F.sum(F.get("w", F.lit(c))), F.lit(0.0)) + F.lit(b) for c, b in enumerate(biases)])


def _chance(scores: Column, one: Column, temperature: float) -> Column:
    """The softmax of ``one`` among the scores."""
    parts = F.transform(scores, lambda x: F.exp((x - one) / F.lit(temperature)))
    return 1 / F.aggregate(parts, F.lit(0.0), lambda total, x: total + x)


def _temperature(held: DataFrame, table: DataFrame, biases: list[float]) -> float:
    """The temperature with the least log loss on held-out examples, from a grid."""
    rows = held.withColumn("_row", F.xxhash64("p")).select("_row", "label", F.explode("grams").alias("gram")).join(table, "gram", "left")
    scored = rows.groupBy("_row", "label").agg(_scores(biases).alias("s"))
    own = F.get("s", F.col("label").cast("int"))
    grid = [2 ** (e / 2) for e in range(-4, 7)]
    loss = [F.avg(-F.log(F.greatest(_chance(F.col("s"), own, t), F.lit(1e-12)))).alias(f"t{i}") for i, t in enumerate(grid)]
    found = scored.agg(*loss).head()
    return min((x if x is not None else math.inf, abs(math.log(t)), t) for x, t in zip(found, grid))[2]


def scan(docs: DataFrame, model: tuple[DataFrame, list[float], float], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, text_key, paragraph, family, probability, confirmed) of every paragraph that is not none."""
    table, biases, temperature = model
    spark = docs.sparkSession
    grams = table.select(F.xxhash64(F.split("gram", " ")).alias("_key"), "w")
    if table.count() <= MOST_BROADCAST:
        grams = F.broadcast(grams)
    lines = docs.select(F.col(doc_id).alias("_doc"), F.xxhash64(text).alias("_text"), F.posexplode(_paragraphs(F.col(text))).alias("_line", "_p"))
    parts = lines.withColumn("_words", words(F.col("_p"))).filter(F.size("_words") > 1)
    at = parts.select("*", F.posexplode("_words").alias("_at", "_word"))
    key = lambda n: F.xxhash64(F.slice("_words", F.col("_at") + 1, n))
    both = at.withColumn("_key", F.explode(F.array(key(2), key(3))))
    found = both.join(grams, "_key").select("_doc", "_text", "_line", "_p", "_key", "w").distinct()
    scored = found.groupBy("_doc", "_text", "_line", "_p").agg(_scores(biases).alias("_scores"))
    families = F.slice("_scores", 3, len(FAMILIES))
    scored = scored.withColumn("_none", _chance(F.col("_scores"), F.get("_scores", F.lit(0)), temperature)).filter("_none < 0.5")
    scored = scored.withColumn("_best", _chance(F.col("_scores"), F.array_max(families), temperature))
    known = F.col("_best") >= CERTAIN
    name = F.element_at(F.array(*map(F.lit, FAMILIES)), F.array_position(families, F.array_max(families)).cast("int"))
    named = scored.withColumn("family", F.when(known, name).otherwise("unknown"))
    named = named.withColumn("probability", F.when(known, F.col("_best")).otherwise(1 - F.col("_none")))
    templates = _notices(spark).select("family", bigrams(words(F.col("notice"))).alias("_notice"))
    shared = F.size(F.array_intersect(bigrams(words(F.col("_p"))), F.col("_notice"))) / F.size("_notice")
    return named.join(F.broadcast(templates), "family", "left").select(
        "_doc", "_text", "_line", "family", "probability", F.coalesce(shared >= CONFIRMED, F.lit(False)).alias("confirmed")
    )


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MOST_DOCUMENTS) -> DataFrame:
    """``docs`` with families (sorted), confirmed (those confirmed by a template) and n_notices."""
    found = scan(docs, fit(docs, text, most), doc_id, text)
    nothing = F.array().cast("array<string>")
    by_doc = found.groupBy("_doc", "_text").agg(
        F.array_sort(F.collect_set("family")).alias("_families"),
        F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))).alias("_confirmed"),
        F.count("*").alias("_notices"),
    )
    kept = [c for c in docs.columns if c not in ("families", "confirmed", "n_notices")]
    own = [F.col(c).alias(f"_in{i}") for i, c in enumerate(kept)]  # no column of the input can clash with the ones joined to it
    same = F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_text"))
    return docs.select(*own, F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_key")).join(by_doc, same, "left").select(
        *[F.col(f"_in{i}").alias(c) for i, c in enumerate(kept)], F.coalesce("_families", nothing).alias("families"), F.coalesce("_confirmed", nothing).alias("confirmed"),
        F.coalesce("_notices", F.lit(0)).cast("long").alias("n_notices"),
    )
