import re

from feedmill.llm import licenses, queries

ROWS = [
    (1, "Some text of a page.\nLicensed under the Apache License, Version 2.0.\nMore text here."),
    (1, "Some text of a page.\nLicensed under the Apache License, Version 2.0.\nMore text here."),
    (2, "RELEASED UNDER THE MIT LICENSE."), (3, None), (4, ""), (None, "All rights reserved.\r\nReleased under the MIT License."),
    (5, "nothing to see, and the rest of it\n" * 50), (6, "x"), (1, "another text of this id"), (7, "word " * 20000 + "\nThis work is licensed under the GNU General Public License, version 3."),
]


def test_rows(spark):
    more = [(100 + i, f"page {i} is about topic {i % 7} and more words\nsecond line {i}") for i in range(200)]
    df = spark.createDataFrame([(*r, 1) for r in ROWS + more], "doc_id long, text string, n_notices int").repartition(3)
    out = licenses.license_scan(df).collect()
    assert len(out) == len(ROWS) + len(more)
    got = sorted((str(r.doc_id), ",".join(r.families), ",".join(r.confirmed), r.n_notices) for r in out if r.doc_id is None or r.doc_id < 100)
    gpl = ("7", "gpl-3.0", "gpl-3.0", 1)
    assert got == sorted([("1", "apache-2.0", "apache-2.0", 1)] * 2 + [("2", "mit", "mit", 1), ("3", "", "", 0), ("4", "", "", 0), ("None", "mit,proprietary", "mit,proprietary", 2), ("5", "", "", 0), ("6", "", "", 0), ("1", "", "", 0), gpl])
    assert not any(r.families for r in out if r.doc_id and r.doc_id >= 100)
    assert licenses.license_scan(df.limit(0)).count() == 0


def test_query_agrees_with_the_notices_in_the_texts(spark, medium):
    frame = queries.QUERIES["op6_licenses"].run(spark, medium)
    assert "Python" not in frame._jdf.queryExecution().executedPlan().toString()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{medium}/documents.parquet").collect()}
    wrong = 0
    for r in frame.collect():
        lines = re.split(r"\r?\n", texts[r.doc_id])
        want = sorted({f for f in licenses.FAMILIES for p in lines if re.search(licenses.CUES[f], p.lower())})
        wrong += ",".join(want) != r.families
    assert len(texts) > 900 and wrong <= 0.01 * len(texts)


def test_a_rare_family_among_thousands_of_cue_lines(spark):
    mpl = licenses.NOTICES["mpl-2.0"]
    lines = [f"copyright a{i} b{i} c{i} d{i} e{i} f{i}" for i in range(4000)]
    rows = [(i, "\n".join([f"page {i} is about topic {i % 7}", *lines[4 * i : 4 * i + 4]])) for i in range(1000)]
    rows += [(5000 + i, f"plain words {i} of a page and nothing else {i}") for i in range(300)]
    rows += [(9000, f"page of code\n{mpl}"), (9001, mpl.upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    table, *_ = model = licenses.fit(df)
    assert table.count() > 4096 and {"mozilla public", "mozilla public license"} <= {r.gram for r in table.collect()}
    got = {r._doc: (r.family, r.confirmed) for r in licenses.scan(df, model).filter("_doc >= 5000").collect()}
    assert got == {9000: ("mpl-2.0", True), 9001: ("mpl-2.0", True)}
    most = licenses.MOST_BROADCAST
    try:
        licenses.MOST_BROADCAST = 0
        again = {r._doc: (r.family, r.confirmed) for r in licenses.scan(df, model).filter("_doc >= 5000").collect()}
    finally:
        licenses.MOST_BROADCAST = most
    assert again == got


def test_columns_of_the_input_may_have_any_name(spark):
    odd = ["_key", "_text", "_doc", "_families", "_id", "_in0"]
    df = spark.createDataFrame([(1, "some plain words")], "doc_id long, text string")
    for name in odd:
        df = df.withColumn(name, licenses.F.lit(name))
    row = licenses.license_scan(df).collect()[0].asDict()
    assert [row[c] for c in odd] == odd and row["n_notices"] == 0
