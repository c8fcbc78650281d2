"""Interval join of a hot episode, layout of manifest and segments."""

import random

import pyarrow.parquet as pq
import pytest

from wavemill.operators import clips

REQUEST = "request_id long, episode_id long, start_sec long, end_sec long"
SEGMENT = "episode_id long, turn long, seg_start long, seg_end long"


@pytest.fixture(scope="module")
def hot():
    """Half of all requests and segments are episode 7's, most of them in one bucket."""
    rand = random.Random(6)

    def start(e):
        return rand.randrange(900) if e == 7 else rand.randrange(5000)

    pick = lambda: 7 if rand.random() < 0.5 else rand.randrange(40)
    requests = [(i, e := pick(), a := start(e), a + rand.randrange(1, 40)) for i in range(900)]
    segments = [(e := pick(), i, a := start(e), a + (rand.randrange(1, 20) if i % 50 else 1200)) for i in range(900)]
    return requests, segments


@pytest.mark.parametrize("most", [4096, 20])
def test_a_hot_episode_equals_brute_force(spark, hot, most):
    requests, segments = hot
    got = clips.slices(spark.createDataFrame(requests, REQUEST), spark.createDataFrame(segments, SEGMENT), most=most)
    want = sorted((i, e, t, max(a, c) - a, min(b, d) - a) for i, e, a, b in requests for f, t, c, d in segments if e == f and c < b and d > a)
    assert sorted(map(tuple, got.collect())) == want


def test_a_hot_episode_is_many_keys_of_one_size(spark, hot):
    r, s = clips.dealt(spark.createDataFrame(hot[0], REQUEST), spark.createDataFrame(hot[1], SEGMENT), most=20)
    for side in (r, s):
        sizes = [x["count"] for x in side.where("episode_id = 7 and b = 0").groupBy("salt", "part").count().collect()]
        assert len(sizes) > 50 and max(sizes) <= 2 * 20
    assert r.count() < 900 * 15  # of over twenty salts a request goes only to those whose segments reach into its span


def test_a_batch_replaces_its_own_part(spark, tmp_path):
    kind = "request_id long, filename string, status string"
    path = str(tmp_path / "manifest")
    one = [(i, f"f{i}", "ok" if i % 3 else "no_url") for i in range(50)]
    clips.write_manifest(spark.createDataFrame(one, kind), path, 1)
    for _ in range(2):
        out = clips.write_manifest(spark.createDataFrame([(99, "g", "ok")], kind), path, 2)
    assert sorted((r.request_id, r.filename, r.status) for r in out.collect()) == sorted([*one, (99, "g", "ok")])


def test_a_read_of_one_episode_skips_other_files(spark, tmp_path, hot):
    path = str(tmp_path / "segments")
    clips.write_segments(spark.createDataFrame(hot[1], SEGMENT), path, 3)
    clips.write_segments(spark.createDataFrame(hot[1], SEGMENT), path, 3)
    spans = []
    for f in (tmp_path / "segments" / "batch=3").glob("*.parquet"):
        meta = pq.ParquetFile(f).metadata
        column = meta.row_group(0).column(0)
        assert column.path_in_schema == "episode_id"
        spans.append((column.statistics.min, column.statistics.max))
    spans.sort()
    assert len(spans) == 8 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    df = spark.read.parquet(path)
    assert df.count() == len(hot[1])
    assert "PushedFilters: [IsNotNull(episode_id), EqualTo(episode_id,30)]" in df.where("episode_id = 30")._jdf.queryExecution().executedPlan().toString()
    assert df.where("episode_id = 30").count() == sum(s[0] == 30 for s in hot[1])
