"""Landed files: explicit schema, corrupt lines, source file, counts of the same pass."""

import json

import pytest

from wavemill.sources import landed

LINES = {
    "a.json": [{"request": "r1", "http_status": 200, "response": {"count": 2, "items": [{"id": 1, "title": "x", "new": [1]}, {"id": 2}], "status": "true"}}, {"request": "r2", "http_status": 200, "response": {"count": 0, "items": []}}],
    "b.json": ['{"request": "r3", "http_sta', "", {"request": "r4", "http_status": 500}, {"request": "r5", "http_status": "many", "response": 7}],
    "c.json": [{"request": "r6", "http_status": 200, "response": {"count": 1, "items": [{"id": 9, "enclosureUrl": "u"}]}}],
}
WANT = {"lines": 6, "good": 2, "rejected": 4, "corrupt": 2}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    return tmp_path / "in"


def land(folder, names):
    for n in names:
        (folder / n).write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in LINES[n]))


def entries(df):
    return sorted((r.request, r.file.rsplit("/", 1)[-1], r.pos, r.id, r.title, r.enclosureUrl) for r in landed.rows(df, "items").collect())


GOOD = [("r1", "a.json", 0, 1, "x", None), ("r1", "a.json", 1, 2, None, None), ("r6", "c.json", 0, 9, None, "u")]


def test_files(spark, folder, tmp_path):
    land(folder, LINES)
    df = landed.read(spark, str(folder), "items")
    assert {(r.request, r.status) for r in df.collect() if r.status != "corrupt"} == {("r1", "ok"), ("r2", "empty"), ("r4", "http_500"), ("r6", "ok")}
    assert entries(df) == GOOD
    out = str(tmp_path / "out")
    assert landed.write(df, out) == WANT
    back = spark.read.parquet(out)
    assert (back.where("rejected = 'false'").count(), back.where("rejected = 'true'").count()) == (2, 4)
    assert sorted(r[landed.CORRUPT][:14] for r in back.where("status = 'corrupt'").collect()) == ['{"request": "r', '{"request": "r']
    assert all(r.file.endswith("b.json") for r in back.where("status = 'corrupt'").collect())
    (tmp_path / "none").mkdir()
    assert landed.read(spark, str(tmp_path / "none"), "feeds").count() == 0


def test_stream_with_a_limit_of_files_and_a_restart(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    land(folder, ["a.json"])
    one = landed.write_stream(landed.stream(spark, str(folder), "items", 1), out)
    land(folder, ["b.json", "c.json"])
    two = landed.write_stream(landed.stream(spark, str(folder), "items", 1), out)
    assert {k: one[k] + two[k] for k in WANT} == WANT and one["lines"] == 2
    back = spark.read.parquet(f"{out}/out")
    assert back.select("batch").distinct().count() == 3 and back.count() == 6
    assert entries(back) == GOOD
