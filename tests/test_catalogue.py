import math
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wavemill.functions import intervals, labels
from wavemill.operators import clips, lookup, paging, search, sessions
from wavemill.plans import oracle, queries
from wavemill.sources import envelopes

SF = "/root/testdata/sf0.001"
TABLES = "part events documents pages conversations"

#: Interval texts and seconds; None is an error.
TIMES = {
    "90": 90, "01:20": 80, "1:02:03": 3723, "1H 2M 3S": 3723, "1h30s": 3630, "0s": 0, " 1 : 20 ": 80, "1m30": 60, "1m30s junk": 90, "30s1m": 30, "1m:30": 60, "99:99": 6039,
    "1:+3": 63, "2:-3": 117, "5m 10s": 310, "2h": 7200, "1m30s": 90, "90 s": None, "10 m": None, "1:30m": None, "1.5": None, "a:b": None, "1:": None, "": None, "1:2:3:4": None, "1:1_0": None,
    "99999999999999999999": None, "9999999999999999h": None,
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _rows(frame):
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return None
        return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)

    columns = sorted(frame.columns)
    return columns, sorted((tuple(map(plain, r)) for r in frame[columns].itertuples(index=False)), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, duck, name):
    assert _rows(queries.QUERIES[name](spark, SF).toPandas()) == _rows(duck.sql(oracle.SQL[name]).df())


def test_seconds(spark):
    df = spark.createDataFrame(list(TIMES.items()), "t string, want long")
    assert [r.t for r in df.where(~intervals.seconds(F.col("t")).eqNullSafe(F.col("want"))).collect()] == []


def test_clip_status(spark):
    texts = ["0-900", "0-901", "10-10", "20-10", "x-5", "5", None, " 00:10 - 00:20 "]
    r = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "request_id long, episode_id long, interval_text string")
    e = spark.createDataFrame([(1, "t", "u", 0)], "id long, title string, enclosure_url string, pos long")
    got = [x.status for x in clips.validate(r, e).orderBy("request_id").collect()]
    assert got == ["ok", "too_long", "not_after", "not_after", "bad_interval", "bad_interval", "bad_interval", "ok"]
    assert {x.status for x in clips.validate(r, e.where("false")).collect()} == {"no_url"}


def test_labels(spark):
    row = spark.createDataFrame([("a b/c", "d\\e", " 1:2 - 3 ", None)], "f string, t string, i string, n string")
    got = row.select(labels.clip_filename(F.col("f"), F.col("t"), F.col("i")), labels.clip_filename(F.col("n"), F.col("n"), F.col("i")), labels.global_result(F.col("n"), F.col("t"))).first()
    assert tuple(got) == ("a_b_c-d_e-1-2-3.mp3", "Podcast-Episode-1-2-3.mp3", "Podcast: d\\e")


@pytest.mark.parametrize("n", [0, 1, 5, 6, 7, 10, 11, 16])
def test_pages(spark, n):
    df = spark.createDataFrame([(1, i) for i in range(n)], "g long, i long")
    seen = []
    for page in (0, 1, 2, 3):
        got = sorted((r.i, r.has_next, r.has_prev) for r in paging.pages(df, ["g"], ["i"], F.lit(page), 3).collect())
        want = list(range(n))[max(0, (page - 1) * 5) : max(0, page * 5)]
        assert got == [(i, page * 5 < n, page > 1) for i in want]
        seen += want
        if page:
            tail = sorted(r.i for r in paging.tail_pages(df, ["g"], ["i"], F.lit(page), 3).collect())
            assert tail == list(range(n))[: 5 * page + 1][-5:]
    assert seen == list(range(min(n, 15)))


def test_lookups_first_and_last(spark):
    results = spark.createDataFrame([(7, "a", "u1", 0), (7, "b", None, 1)], "id long, title string, enclosure_url string, pos long")
    asked = spark.createDataFrame([("7",), ("8",)], "chosen string")
    assert {r.chosen: (r.title, r.enclosure_url) for r in lookup.select_first(asked, results).collect()} == {"7": ("a", "u1"), "8": (None, None)}
    assert {r.chosen: r.title for r in lookup.titles(asked, results).collect()} == {"7": "b", "8": "Podcast"}


def test_search_join_is_containment(spark):
    rows = [(0, "A 50% off_er"), (1, "a_b"), (2, None), (3, ""), (4, "ab🎧cd"), (5, "xxabxx"), (6, "Éa")]
    asked = [(0, "%"), (1, "_"), (2, "ab"), (3, "🎧c"), (4, "zzz"), (5, None), (6, ""), (7, "A"), (8, "0% OFF"), (8, "éa")]
    c, r = spark.createDataFrame(rows, "id long, title string"), spark.createDataFrame(asked, "request_id long, q string")
    want = sorted((k, i) for k, q in asked if q for i, t in rows if t and q.lower() in t.lower())
    assert sorted(map(tuple, search.search_join(r, c).collect())) == want


def test_search_join_of_long_texts_and_ids_that_repeat(spark):
    long = " ".join(f"w{i % 977}x{i}" for i in range(20_000))
    rows = [(1, long), (1, "w5x5 alone"), (2, long.upper()), (3, "none")]
    asked = [(0, "w5x5"), (1, "w976x1953 w0x1954"), (2, "w976x1953w"), (3, "o")]
    c, r = spark.createDataFrame(rows, "id long, title string"), spark.createDataFrame(asked, "request_id long, q string")
    want = sorted((k, i) for k, q in asked for i, t in rows if q in t.lower())
    assert sorted(map(tuple, search.search_join(r, c).collect())) == want


def test_a_repeated_episode_names_a_clip_once(spark):
    e = spark.createDataFrame([(1, "first", "f", "u", 0), (1, "second", "g", "v", 1)], "id long, title string, feed_title string, enclosure_url string, pos long")
    r = spark.createDataFrame([(9, 1, "0-10")], "request_id long, episode_id long, interval_text string")
    assert [x.clip_title for x in clips.named(clips.validate(r, e)).collect()] == ["f - first (0-10)"]


def test_slices_equal_plain_join(spark):
    import random

    rand = random.Random(3)
    r = [(i, rand.randrange(4), a := rand.randrange(3000), a + rand.randrange(1, 900)) for i in range(60)]
    s = [(rand.randrange(4), i, a := rand.randrange(3000), a + rand.randrange(1, 2000)) for i in range(60)]
    got = clips.slices(spark.createDataFrame(r, "request_id long, episode_id long, start_sec long, end_sec long"), spark.createDataFrame(s, "episode_id long, turn long, seg_start long, seg_end long"))
    want = sorted((i, e, t, max(a, c) - a, min(b, d) - a) for i, e, a, b in r for f, t, c, d in s if e == f and c < b and d > a)
    assert sorted(map(tuple, got.collect())) == want


def _fold(symbols):
    now, mask, done = 0, 0, 0
    for s in symbols:
        to = sessions.next_state(now, s)
        done += sessions.STATES[now] == "CUT_INTERVAL" and s == "interval_ok"
        now, mask = to, mask | 1 << to
    return sessions.STATES[now], mask, done


def test_session_fold_in_any_grouping(spark, monkeypatch):
    import random

    rand = random.Random(1)
    monkeypatch.setattr(sessions, "CHUNK", 3)
    log = [(i, i % 2, rand.choice(sessions.SYMBOLS + ("odd",))) for i in range(200)]
    got = {r.user_id: (r.final_state, r.reached, r.finished) for r in sessions.fold(spark.createDataFrame(log, "update_id long, user_id long, symbol string").repartition(3)).collect()}
    assert got == {u: _fold([s for _, v, s in log if v == u]) for u in (0, 1)}


#: Where each state goes, by hand: symbol and end, as a user sees the steps. All else stays.
WANT = {
    "END": "cut ENTER_PODCAST_NAME search ENTER_GLOBAL_SEARCH trending PODCAST_CHOICE surprise CUT_INTERVAL",
    "ENTER_PODCAST_NAME": "text_many PODCAST_CHOICE text_one EPISODE_CHOICE text_one_empty ENTER_EPISODE_NAME cancel END",
    "PODCAST_CHOICE": "text_one EPISODE_CHOICE text_one_empty ENTER_EPISODE_NAME text_none ENTER_PODCAST_NAME page_one EPISODE_CHOICE "
    "page_one_empty ENTER_EPISODE_NAME page_none ENTER_PODCAST_NAME id EPISODE_CHOICE id_empty ENTER_EPISODE_NAME cancel END",
    "ENTER_EPISODE_NAME": "cancel END",
    "EPISODE_CHOICE": "text_one CUT_INTERVAL page_none ENTER_EPISODE_NAME id CUT_INTERVAL cancel END",
    "ENTER_GLOBAL_SEARCH": "text_many GLOBAL_EPISODE_CHOICE text_one GLOBAL_EPISODE_CHOICE cancel END",
    "GLOBAL_EPISODE_CHOICE": "text_none ENTER_GLOBAL_SEARCH page_none ENTER_GLOBAL_SEARCH id CUT_INTERVAL cancel END",
    "CUT_INTERVAL": "interval_ok END interval_no_url END interval_too_long END interval_failed END cancel END",
}
SYMBOLS = "cut search trending surprise cancel help text_many text_one text_one_empty text_none page_many page_one page_one_empty page_none id id_empty interval_ok interval_bad interval_no_url interval_too_long interval_failed odd"


@pytest.mark.parametrize("start", WANT)
def test_transitions(start):
    words = WANT[start].split()
    want = dict(zip(words[::2], words[1::2]))
    for symbol in SYMBOLS.split():
        assert sessions.STATES[sessions.next_state(sessions.STATES.index(start), symbol)] == want.get(symbol, start), symbol


def test_envelopes(spark):
    body = ['{"count": 2, "items": [{"id": 1, "title": "a", "x": 9}, {"id": 2}]}', '{"count": 0, "items": []}', '{"items": []}', "bad", None]
    df = envelopes.decode(spark.createDataFrame([(i, 200 if i else 500, b) for i, b in enumerate([None, *body])], "r long, http_status int, body string"), "items")
    assert [x.status for x in df.withColumn("status", envelopes.status()).orderBy("r").collect()] == ["http_500", "ok", "empty", "empty", "empty", "empty"]
    assert [(x.r, x.pos, x.id, x.title) for x in envelopes.rows(df, "items").orderBy("r", "pos").collect()] == [(1, 0, 1, "a"), (1, 1, 2, None)]
    good, bad = envelopes.split(df)
    assert (good.count(), bad.count()) == (1, 5)


def test_sample_is_stable(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    assert [r.k for r in paging.sample(df, "k", 3).collect()] == [r.k for r in paging.sample(df.repartition(7), "k", 3).collect()]


def test_pages_limit_groups_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 7 as g", "id as i")
    for out in (paging.pages(df, ["g"], ["i"], F.col("g") % 3 + 1, 3), paging.tail_pages(df, ["g"], ["i"], F.lit(2), 3), paging.first(df, ["g"], ["i"])):
        assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_search_join_has_no_nested_loop(spark):
    r, c = spark.createDataFrame([(1, "ab")], "request_id long, q string"), spark.createDataFrame([(1, "cab")], "id long, title string")
    plan = search.search_join(r, c)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
