import datetime

import pytest
from pyspark.sql import functions as F

from feedmill.functions import dates, responses, text, urls, vectors

CHANNEL = "UCbfYPyITQ-7l4upoX8nvctg"


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_channel_ids(spark):
    given = [
        CHANNEL, f"https://www.youtube.com/channel/{CHANNEL}", f"https://www.youtube.com/channel/{CHANNEL}/videos?x=1",
        f"https://www.youtube.com/feeds/videos.xml?channel_id={CHANNEL}", f"https://e.com/?channel_id={CHANNEL}&a=/channel/no",
        "https://www.youtube.com/@handle",
    ]
    assert column(spark, given, urls.channel_id) == [CHANNEL] * 5 + [None]


def test_channel_id_in_pages(spark):
    pages = [
        f'<meta itemprop="channelId" content="{CHANNEL}"><script>"channelId":"UCother"</script>',
        f'"externalId":"UCno" "channelId":"{CHANNEL}"', f'"externalId":"{CHANNEL}"', "nothing",
    ]
    assert column(spark, pages, urls.channel_id_from_page) == [CHANNEL] * 3 + [None]


def test_video_ids(spark):
    given = [
        "https://www.youtube.com/watch?v=dQw4w9WgXcQ", "https://youtu.be/dQw4w9WgXcQ?t=3",
        "https://www.youtube.com/embed/dQw4w9WgXcQ", "https://e.com/short",
    ]
    assert column(spark, given, urls.video_id) == ["dQw4w9WgXcQ"] * 3 + [None]


def test_feed_urls(spark):
    given = ["https://a/x.xml", "https://a/x.rss", "https://a/feed", "https://a/rss", "https://a/feed/", "https://a/xml"]
    assert column(spark, given, urls.is_feed_url) == [True] * 4 + [False] * 2


def test_canonical_urls(spark):
    given = ["https://a.com/x/?q=1#f", "HTTP://A.com", "https://a.com//", "https://a.com/p;v=1?x", "/only/path/"]
    assert column(spark, given, urls.canonical_url) == ["https://a.com/x", "http://A.com", "https://a.com", "https://a.com/p", ":///only/path"]


def test_emails(spark):
    given = ["a.b+c@example.com", "a@b", "a b@example.com", "a@example.c", None, "x@y.co"]
    assert column(spark, given, urls.valid_email) == [True, False, False, False, False, True]
    assert column(spark, ["a@b.co", "", None], lambda c: urls.subscriber_link(c, "unsubscribe", "http://h")) == [
        "http://h/unsubscribe?email=a@b.co", "#", "#",
    ]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_feed_dates_do_not_depend_on_the_session_zone(spark, zone):
    given = [
        "Tue, 02 Jan 2024 03:04:05 +0200", "Tue, 2 Jan 2024 03:04:05 GMT", "02 Jan 2024 03:04 EST", "02 Jan 2024",
        "2024-01-02T03:04:05Z", "2024-01-02T03:04:05.5+01:00", "2024-01-02", "2024-07-02 03:04:05",
        "Sun, 10 Mar 2024 02:30:00", "Tue, 02 Jan 2024 03:04:05", "soon", "", None,
    ]
    at = datetime.datetime
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = column(spark, given, dates.feed_date)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == [
        at(2024, 1, 2, 1, 4, 5), at(2024, 1, 2, 3, 4, 5), at(2024, 1, 2, 8, 4), at(2024, 1, 2),
        at(2024, 1, 2, 3, 4, 5), at(2024, 1, 2, 2, 4, 5, 500000), at(2024, 1, 2), at(2024, 7, 2, 3, 4, 5),
        at(2024, 3, 10, 2, 30), at(2024, 1, 2, 3, 4, 5), None, None, None,
    ]


def test_wall_time_drops_the_zone(spark):
    assert column(spark, ["2024-01-02T03:04:05+05:00", "2024-01-02", "x"], dates.iso_wall_time) == [
        datetime.datetime(2024, 1, 2, 3, 4, 5), datetime.datetime(2024, 1, 2), None,
    ]
    assert dates.moment("2024-01-02T03:04:05+05:00") == datetime.datetime(2024, 1, 2, 3, 4, 5)


def test_text(spark):
    assert column(spark, ["ab", "abc", "abcd", None], lambda c: text.truncated(c, 3, "...")) == ["ab", "abc", "abc...", None]
    assert column(spark, ["ab"], lambda c: text.truncated(c, 3, "...", always=True)) == ["ab..."]
    assert column(spark, ["john.DOE@x.org", "é@x"], text.display_name) == ["John.doe", "É"]
    assert column(spark, [" a  b\nc ", "", "  "], text.word_count) == [3, 0, 0]
    assert column(spark, ["<a href='x'>&\"</a>"], text.escape_html) == ["&lt;a href=&#39;x&#39;&gt;&amp;&#34;&lt;/a&gt;"]
    one = spark.range(1)
    assert one.select(text.subject_line("2025-12-04", "News")).first()[0] == "News - December 04, 2025"
    prompt = one.select(text.summary_prompt(F.lit(None).cast("string"), F.lit("x" * 25001))).first()[0]
    assert "Title: N/A\n" in prompt and "x" * 25000 + "...\n" in prompt
    assert "Content: T\n" in one.select(text.short_prompt(F.lit("T"), F.lit(""), "S")).first()[0]


RESPONSES = [
    ('{"summary": "S.", "key_points": ["A", "B"]}', ("S.", ["A", "B"])),
    ('```json\n{"summary": "F.", "key_points": ["p"]}\n```', ("F.", ["p"])),
    (" plain words ", ("plain words", [])),
    ('{"summary": "only"}', ("only", [])),
    ('{"key_points": ["k"]}', ('{"key_points": ["k"]}', ["k"])),
    ('{"summary": "a", "summary": "b"}', ("b", [])),
    ('{"summary": "a"} trailing', ("a", [])),
    ('{"summary": "a"} and {"x": 1}', ('{"summary": "a"} and {"x": 1}', [])),
    ('{"summary": "open', ('{"summary": "open', [])),
    ("} before {", ("} before {", [])),
    ('{"summary": null, "key_points": null}', (None, None)),
    ('{"summary": "n", "key_points": [NaN, "x"]}', ("n", ["NaN", "x"])),
    (None, (None, None)),
]


def test_responses(spark):
    got = column(spark, [r for r, _ in RESPONSES], responses.parse_response)
    assert [(None, None) if r is None else (r.summary, r.key_points) for r in got] == [want for _, want in RESPONSES]


def test_vectors(spark):
    df = spark.createDataFrame(
        [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0])],
        "a array<float>, b array<float>",
    )
    got = [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == [1.0, 0.0, 0.0, None, None]
    assert df.select(vectors.vector_text(F.col("b"))).first()[0] == "[1.0,0.0]"
