"""Pages and samples of ranked rows. Every bound on a rank is literal, so that Spark limits groups before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import shared

#: Fixed value: rows on a page.
SIZE = 5


def first(df: DataFrame, by: list[str], order: list, n: int = SIZE) -> DataFrame:
    """The first n rows of each group."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn("rn", rank).where(F.col("rn") <= n).withColumn("rn", F.col("rn").cast("bigint"))


def pages(df: DataFrame, by: list[str], order: list, page: Column, most: int, size: int = SIZE) -> DataFrame:
    """Rows of each group's page, with rn, has_prev and has_next; a page under 1 or over ``most`` has no rows.

    One row more than the page is looked at instead of a count of the group.
    """
    seen = first(df.withColumn("_page", page), by, order, size * most + 1)
    seen = seen.where((F.col("_page").between(1, most)) & (F.col("rn") > size * (F.col("_page") - 1)) & (F.col("rn") <= size * F.col("_page") + 1))
    last = F.max("rn").over(W.partitionBy(*by))
    return seen.withColumns({"has_next": last > size * F.col("_page"), "has_prev": F.col("_page") > 1}).where(F.col("rn") <= size * F.col("_page")).drop("_page")


def tail_pages(df: DataFrame, by: list[str], order: list, page: Column, most: int, size: int = SIZE) -> DataFrame:
    """The last ``size`` of the first size * page + 1 rows: what a client sees that asks for one more and shows the end."""
    seen = first(df.withColumn("_page", page), by, order, size * most + 1).where((F.col("_page").between(1, most)) & (F.col("rn") <= size * F.col("_page") + 1))
    n = F.max("rn").over(W.partitionBy(*by))
    return seen.withColumns({"_n": n, "has_next": n > size * F.col("_page"), "has_prev": F.col("_page") > 1}).where(F.col("rn") > F.col("_n") - size).drop("_n", "_page")


def sample(df: DataFrame, key: str, k: int = 1, seed: str = "7") -> DataFrame:
    """k rows, pseudo-random by hash of seed and key: the same however the rows are partitioned."""
    return df.orderBy(F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string"))), key).limit(k)


def at_ranks(rows: DataFrame, wanted: DataFrame, by: list[str], order: list[str], buckets: int = 64) -> DataFrame:
    """The rows at the ``wanted`` (``by``, rn) ranks of their group, with the columns of wanted. ``order``: columns, ascending; the first is numeric.

    Ranked selection by counts: quantiles of the first column deal a group to buckets along its order, counts of buckets say in
    which one a rank lies, and only those buckets are sorted. So page 400 of a group of any size costs a count and a sort
    of a few buckets. Rows that agree in the first column share a bucket; nulls come first. ``rows`` is read three times.
    """
    parts = [k / buckets for k in range(1, buckets)]
    bounds = rows.groupBy(*by).agg(F.percentile_approx(order[0], parts, 10 * buckets).alias("_bounds"))
    bounds = shared.written(bounds, "bounds")  # approximate ones can differ from run to run, but counts and ranks must have the same
    placed = rows.join(bounds, by).withColumn("_b", F.coalesce(F.size(F.filter("_bounds", lambda x: x < F.col(order[0]))), F.lit(0))).drop("_bounds")
    before = F.sum("_n").over(W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    counts = placed.groupBy(*by, "_b").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(before, F.lit(0)))
    inside = (F.col("rn") > F.col("_before")) & (F.col("rn") <= F.col("_before") + F.col("_n"))
    asked = wanted.select(*by, "rn").distinct().join(counts, by).where(inside).select(*by, "_b", "_before").distinct()
    rank = F.row_number().over(W.partitionBy(*by, "_b").orderBy(*order))
    ranked = placed.join(asked, [*by, "_b"]).withColumn("rn", (F.col("_before") + rank).cast("bigint")).drop("_b", "_before")
    return ranked.join(wanted, [*by, "rn"])


def page_status(requests: DataFrame, rows: DataFrame, by: list[str], size: int = SIZE) -> DataFrame:
    """``requests`` (page and ``by`` among others) with total, status, has_next and has_prev.

    bad_page: no page, or one under 1, whatever there is; empty: a page beyond the last; else ok.
    """
    total = F.coalesce("total", F.lit(0))
    out = requests.join(rows.groupBy(*by).agg(F.count("*").alias("total")), by, "left").withColumn("total", total)
    page = F.col("page")
    status = F.when(F.coalesce(page < 1, F.lit(True)), "bad_page").when(size * (page - 1) >= total, "empty").otherwise("ok")
    return out.withColumns({"status": status, "has_next": size * page < total, "has_prev": page > 1})


def any_pages(requests: DataFrame, rows: DataFrame, by: list[str], order: list[str], size: int = SIZE, tail: bool = False, buckets: int = 64) -> DataFrame:
    """Rows of each request's page, at any depth, with rn, has_next and has_prev; only requests of status ok have some.

    ``tail``: the last ``size`` of the first size * page + 1 rows, as a client sees them that asks for one more and shows the end; so a
    page beyond the last shows the last rows there are.
    """
    good = page_status(requests, rows, by, size).where("status <> 'bad_page' and total > 0" if tail else "status = 'ok'")
    last = F.least(size * F.col("page") + int(tail), F.col("total"))
    first = F.greatest(last - size, F.lit(0)) + 1 if tail else size * (F.col("page") - 1) + 1
    wanted = good.withColumn("rn", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint")))).drop("total", "status")
    return at_ranks(rows, wanted, by, order, buckets)
