"""Streams in several batches: late rows, restarts, initial state."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from wavemill.operators import sessions
from wavemill.streaming import jobs

DAY = datetime(2024, 1, 1)


def write(spark, rows, kind, path):
    spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(path)


def stream(spark, kind, path):
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(path)


def test_first_feeds_of_each_window_and_late_rows(spark, tmp_path):
    kind, path = "ts timestamp, props string", str(tmp_path / "events")
    rand = random.Random(1)
    at = lambda day, k: (DAY + timedelta(days=day), f'{{"k": {k}}}')
    files = [[at(rand.random() * 10, rand.randrange(9)) for _ in range(200)] + [at(10, 0)]]
    late = [at(1.5, 5), at(0.5, 7)]  # all their windows end before day 9
    files += [[at(10.1, 1)], late + [at(9.5, 3)] * 40, [at(19 + rand.random(), rand.randrange(4)) for _ in range(60)], [at(20, 0)], [at(10.5, 8)] * 3 + [at(40, 2)]]
    for f in files[:3]:
        write(spark, f, kind, path)
    out = str(tmp_path / "out")
    jobs.trending(stream(spark, kind, path), out, k=3)
    for f in files[3:]:  # a restart
        write(spark, f, kind, path)
    jobs.trending(stream(spark, kind, path), out, k=3)
    count = Counter()
    for ts, props in (x for i, f in enumerate(files) for x in f if not (i == 2 and x in late) and not (i == 5 and ts_is(x, 10.5))):
        first = datetime(ts.year, ts.month, ts.day)
        for d in range(7):
            count[first - timedelta(days=d), int(props[6:-1])] += 1
    want = {}
    for (day, k), n in count.items():
        want.setdefault(day, []).append((-n, k))
    want = sorted((day, i + 1, k, -n) for day, found in want.items() for i, (n, k) in enumerate(sorted(found)[:3]))
    assert sorted((r.window_start, r.rank, r.feed_id, r.n) for r in jobs.top_feeds(spark, out).collect()) == want
    closed = spark.read.parquet(f"{out}/closed")
    assert closed.where("window_end > timestamp'2024-02-08'").count() == 0 and closed.groupBy("window_start", "feed_id").count().where("count > 1").count() == 0


def ts_is(row, day):
    return row[0] == DAY + timedelta(days=day)


@pytest.mark.parametrize("initial", [False, True])
def test_a_restart_in_mid_log_equals_the_batch(spark, tmp_path, initial):
    kind, path, out = "update_id long, user_id long, symbol string", str(tmp_path / "log"), str(tmp_path / "out")
    rand = random.Random(5)
    log = [(i, rand.choice([1, 1, 2, 3]), rand.choice([*sessions.SYMBOLS, "odd", None])) for i in range(600)]
    parts = [log[:250], log[250:400], log[400:]]
    for p in parts:
        rand.shuffle(p)
    started = None
    if initial:
        started = sessions.fold(spark.createDataFrame(parts[0], kind))
    else:
        write(spark, parts[0], kind, path)
    write(spark, parts[1], kind, path)
    jobs.session_states(stream(spark, kind, path), out, started)
    write(spark, parts[2], kind, path)
    jobs.session_states(stream(spark, kind, path), out, started)
    got = sorted(map(tuple, jobs.latest_sessions(spark, out).drop("last_clip").collect()))
    assert got == sorted(map(tuple, sessions.fold(spark.createDataFrame(log, kind)).collect()))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")
