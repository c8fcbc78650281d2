"""Sessions from the raw log, by hand and in any grouping."""

import pytest
from pyspark.sql import functions as F

from wavemill.operators import outcomes, replay, sessions

FEEDS = [(1, "Alpha talks", "ann"), (2, "Beta talks", "bob"), (3, "Gamma", "cy"), (4, "Empty one", "dee")]
#: Twelve episodes of feed 1, one of feed 2, two of feed 3.
EPISODES = [(100 + i, 1, f"part {i}.", "long text", "ann", "x", f"u{i}" if i % 2 else None, i) for i in range(12)]
EPISODES += [(200, 2, "single", "deep sea", "bob", "y", "v", 0), (300, 3, "first", "words", "cy", "sea", "w", 0), (301, 3, "second", None, None, None, "", 1)]


@pytest.fixture(scope="module")
def catalogue(spark):
    feeds = spark.createDataFrame(FEEDS, "id long, title string, author string")
    return feeds, spark.createDataFrame(EPISODES, "id long, feed_id long, title string, description string, author string, tags string, enclosure_url string, pos long")


def run(spark, catalogue, script, **args):
    """script: (user, payload) in order; payloads with ! are callbacks."""
    rows = [(i, u, "callback" if p.startswith("!") else "text", p.lstrip("!")) for i, (u, p) in enumerate(script)]
    log = spark.createDataFrame(rows, "update_id long, user_id long, kind string, payload string").repartition(3)
    return replay.transitions(outcomes.with_outcomes(log, *catalogue, **args))


SCRIPTS = [
    # (payload, outcome, state after, registers that are set after)
    [("hello", "same", "END", {}), ("/cut_podcast", "start", "ENTER_PODCAST_NAME", {}), ("TALKS", "many", "PODCAST_CHOICE", {"q": "TALKS", "page": 1}), ("!next_page", "page", "PODCAST_CHOICE", {"q": "TALKS", "page": 2}),
     ("!prev_page", "page", "PODCAST_CHOICE", {"q": "TALKS", "page": 1}), ("!1", "id", "EPISODE_CHOICE", {"q": "TALKS", "page": 1, "feed": "1"}), ("!next_page", "page", "EPISODE_CHOICE", {"q": "TALKS", "page": 2, "feed": "1"}),
     ("part 1", "many", "EPISODE_CHOICE", {"q": "TALKS", "page": 2, "feed": "1"}), ("Part 11", "one", "CUT_INTERVAL", {"q": "TALKS", "page": 2, "feed": "1", "episode": "111", "url": "u11", "title": "part 11."}),
     ("x", "bad", "CUT_INTERVAL", {"q": "TALKS", "page": 2, "feed": "1", "episode": "111", "url": "u11", "title": "part 11."}), ("Trending Podcasts", "bad", "CUT_INTERVAL", {"q": "TALKS", "page": 2, "feed": "1", "episode": "111", "url": "u11", "title": "part 11."}),
     ("0-10", "ok", "END", {}), ("0-10", "same", "END", {})],
    [("Search Podcast by Name", "start", "ENTER_PODCAST_NAME", {}), ("nothing", "none", "ENTER_PODCAST_NAME", {"q": "nothing", "page": 1}), ("!1", "same", "ENTER_PODCAST_NAME", {"q": "nothing", "page": 1}), ("/trending", "same", "ENTER_PODCAST_NAME", {"q": "nothing", "page": 1}),
     ("beta", "one", "EPISODE_CHOICE", {"q": "beta", "page": 1, "feed": "2"}), ("!next_page", "page_none", "ENTER_EPISODE_NAME", {"q": "beta", "page": 2, "feed": "2"}), ("beta", "same", "ENTER_EPISODE_NAME", {"q": "beta", "page": 2, "feed": "2"}), ("/cancel", "cancel", "END", {}),
     ("/trending", "start", "PODCAST_CHOICE", {"page": 1}), ("!next_page", "page_none", "ENTER_PODCAST_NAME", {"page": 1}), ("empty", "one_empty", "ENTER_EPISODE_NAME", {"q": "empty", "page": 1, "feed": "4"}), ("/cancel", "cancel", "END", {}), ("/cancel", "same", "END", {})],
    [("/search_episodes", "start", "ENTER_GLOBAL_SEARCH", {}), ("Help", "same", "ENTER_GLOBAL_SEARCH", {}), ("zzz", "none", "ENTER_GLOBAL_SEARCH", {"q": "zzz", "page": 1}), ("sea", "many", "GLOBAL_EPISODE_CHOICE", {"q": "sea", "page": 1}), ("!prev_page", "page_none", "ENTER_GLOBAL_SEARCH", {"q": "sea", "page": 0}),
     ("sea", "many", "GLOBAL_EPISODE_CHOICE", {"q": "sea", "page": 1}), ("!200", "id", "CUT_INTERVAL", {"q": "sea", "page": 1, "episode": "200", "url": "v", "title": "single"}), ("0-1000", "too_long", "END", {}),
     ("/search_episodes", "start", "ENTER_GLOBAL_SEARCH", {}), ("first", "many", "GLOBAL_EPISODE_CHOICE", {"q": "first", "page": 1}), ("!301", "id", "CUT_INTERVAL", {"q": "first", "page": 1, "episode": "301"}), ("0-10", "no_url", "END", {}),
     ("Surprise Me", "start", "CUT_INTERVAL", None), ("/start", "same", "CUT_INTERVAL", None)],
    [("/cut_podcast", "start", "ENTER_PODCAST_NAME", {}), ("gamma", "one", "EPISODE_CHOICE", {"q": "gamma", "page": 1, "feed": "3"}), ("second", "one", "CUT_INTERVAL", {"q": "gamma", "page": 1, "feed": "3", "episode": "301", "url": "", "title": "second"}), ("1-2", "no_url", "END", {}),
     ("/cut_podcast", "start", "ENTER_PODCAST_NAME", {}), ("beta", "one", "EPISODE_CHOICE", {"q": "beta", "page": 1, "feed": "2"}), ("gamma", "none", "EPISODE_CHOICE", {"q": "beta", "page": 1, "feed": "2"}), ("first", "none", "EPISODE_CHOICE", {"q": "beta", "page": 1, "feed": "2"}),
     ("SINGLE", "one", "CUT_INTERVAL", {"q": "beta", "page": 1, "feed": "2", "episode": "200", "url": "v", "title": "single"}), ("1m-1m30s", "ok", "END", {}), ("/trending", "start", "PODCAST_CHOICE", {"page": 1}), ("!4", "id_empty", "ENTER_EPISODE_NAME", {"page": 1, "feed": "4"})],
]


def test_scripts(spark, catalogue):
    """Four users at once, their updates dealt among one another."""
    most = max(map(len, SCRIPTS))
    order = [(u, i) for i in range(most) for u in range(len(SCRIPTS)) if i < len(SCRIPTS[u])]
    got = {}
    for r in run(spark, catalogue, [(u, SCRIPTS[u][i][0]) for u, i in order]).orderBy("update_id").collect():
        got.setdefault(r.user_id, []).append(r)
    for u, script in enumerate(SCRIPTS):
        assert len(got[u]) == len(script)
        for r, (payload, outcome, after, registers) in zip(got[u], script, strict=True):
            assert (payload, r.outcome, r.after) == (payload, outcome, after)
            if registers is not None:
                assert {x: r[x] for x in replay.REGISTERS if r[x] is not None} == registers, payload


def test_any_chunk_gives_the_same_and_hot_users_are_dealt(spark, catalogue):
    import random

    rand = random.Random(4)
    words = [p for s in SCRIPTS for p, *_ in s]
    script = [(rand.choice([7, 7, 7, 8]), rand.choice(words)) for _ in range(400)]
    one, other = (sorted(map(tuple, run(spark, catalogue, script, chunk=c).collect()), key=repr) for c in (3, 4096))
    assert one == other
    rows = [(i, u, "callback" if p.startswith("!") else "text", p.lstrip("!")) for i, (u, p) in enumerate(script)]
    cut = outcomes.segmented(spark.createDataFrame(rows, "update_id long, user_id long, kind string, payload string"), 5)
    want, last = {}, {}
    for i, u, _, p in rows:
        want[i] = last.get(u, -1)
        last[u] = i if p == "/cancel" else last.get(u, -1)
    assert {r.update_id: r.segment for r in cut.collect()} == want


def test_summaries(spark, catalogue):
    log = run(spark, catalogue, [(1, "/cut_podcast"), (1, "beta"), (1, "single"), (1, "0-10"), (2, "/cut_podcast"), (2, "zzz"), (2, "/cancel"), (3, "x")])
    states = {r.user_id: tuple(r)[1:] for r in replay.states(log).collect()}
    bits = lambda *s: sum(1 << sessions.STATES.index(x) for x in s)
    assert states == {1: (4, "END", bits("END", "ENTER_PODCAST_NAME", "EPISODE_CHOICE", "CUT_INTERVAL"), 1), 2: (3, "END", bits("END", "ENTER_PODCAST_NAME"), 0), 3: (1, "END", 1, 0)}
    rates = {r.step: (r.updates, r.users, r.errors, r.cancels, r.finished, r.errors_permille) for r in replay.rates(log).collect()}
    assert rates["ENTER_PODCAST_NAME"] == (3, 2, 1, 1, 0, 333) and rates["CUT_INTERVAL"] == (1, 1, 0, 0, 1, 0)
    assert {r.user_id: r.state for r in replay.contexts(log.where("update_id < 3")).collect()} == {1: "CUT_INTERVAL"}
    assert replay.transitions(outcomes.with_outcomes(spark.createDataFrame([], "update_id long, user_id long, kind string, payload string"), *catalogue)).count() == 0


def test_replay_of_an_empty_catalogue_and_null_payloads(spark, catalogue):
    feeds, episodes = catalogue
    rows = [(0, 1, "text", "/trending"), (1, 1, "text", "Surprise Me"), (2, 1, "text", None), (3, 1, "callback", None), (4, 1, "text", "/cut_podcast"), (5, 1, "text", "a")]
    log = spark.createDataFrame(rows, "update_id long, user_id long, kind string, payload string")
    out = replay.transitions(outcomes.with_outcomes(log, feeds.where("false"), episodes.where(F.lit(False))))
    assert [(r.outcome, r.after) for r in out.orderBy("update_id").collect()] == [("none", "END"), ("none", "END"), ("same", "END"), ("same", "END"), ("start", "ENTER_PODCAST_NAME"), ("none", "ENTER_PODCAST_NAME")]
