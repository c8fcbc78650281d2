"""Pages at any depth against a plain sort."""

import random

import pytest

from wavemill.operators import paging

GROUPS = {"big": 5000, "small": 3, "five": 5, "eleven": 11, "ties": 400}


@pytest.fixture(scope="module")
def rows(spark):
    rand = random.Random(2)
    made = [(g, rand.randrange(3) if g == "ties" else i * i - 7 * i if i % 50 else None, i) for g, n in GROUPS.items() for i in range(n)]
    rand.shuffle(made)
    return made, spark.createDataFrame(made, "g string, k long, id long").repartition(5)


PAGES = [None, -1, 0, 1, 2, 3, 400, 1000, 1001]


@pytest.mark.parametrize("tail", [False, True])
def test_any_page_equals_a_sort(spark, rows, tail):
    made, df = rows
    asked = [(i, g, p) for i, (g, p) in enumerate((g, p) for g in [*GROUPS, "none"] for p in PAGES)]
    requests = spark.createDataFrame(asked, "r long, g string, page long")
    got = sorted((x.r, x.id, x.rn, x.has_next, x.has_prev) for x in paging.any_pages(requests, df, ["g"], ["k", "id"], tail=tail, buckets=8).collect())
    want = []
    for r, g, p in asked:
        inside = [i for _, k, i in sorted((x for x in made if x[0] == g), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))]
        if p is None or p < 1 or 5 * (p - 1) >= len(inside) and not tail:
            continue
        last = min(len(inside), 5 * p + tail)
        for rn in range(max(0, last - 5) + 1 if tail else 5 * (p - 1) + 1, last + 1):
            want.append((r, inside[rn - 1], rn, 5 * p < len(inside), p > 1))
    assert got == sorted(want)


def test_status(spark, rows):
    requests = spark.createDataFrame([(g, p) for g in ("big", "five", "none") for p in PAGES], "g string, page long")
    got = {(r.g, r.page): r.status for r in paging.page_status(requests, rows[1], ["g"]).collect()}
    assert {p for (_, p), s in got.items() if s == "bad_page"} == {None, -1, 0}
    assert got["big", 1000] == "ok" and got["big", 1001] == "empty" and got["five", 1] == "ok" and got["five", 2] == "empty" and got["none", 1] == "empty"


def test_only_buckets_with_a_wanted_rank_are_sorted(spark, rows):
    requests = spark.createDataFrame([("big", 400)], "g string, page long")
    out = paging.any_pages(requests, rows[1], ["g"], ["k", "id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    # the rank is taken after the join with the buckets that are asked for
    window = plan.index("row_number()")
    assert plan.index("Join", window) > window
