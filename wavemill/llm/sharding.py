"""Shards of near equal bytes from indivisible groups: best-fit decreasing over size classes."""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spread import hot_keys, numbered, salted_join, written

SHARDS = 24
_BITS = 9


def _fit(classes: list[tuple[int, float, int]], capacity: float, shards: int) -> list[tuple[int, int, int, int]] | None:
    """Rows (class, first rank, n, shard), or None if more than ``shards`` would be needed.

    ``left`` holds (remaining capacity, shard) in order, which is what best fit asks of its tree:
    the tightest shard with room is the first that isn't too small.
    """
    left: list[tuple[float, int]] = []
    opened, rows = 0, []
    for name, size, count in classes:
        rank = 0
        while rank < count:
            i = bisect_left(left, (size, -1))
            if i < len(left):
                rest, shard = left.pop(i)
            elif opened < shards:
                rest, shard, opened = capacity, opened, opened + 1
            else:
                return None
            n = min(count - rank, max(1, int(rest // size)))
            rows.append((name, rank, n, shard))
            rank += n
            insort(left, (rest - n * size, shard))
    return rows


def plan(classes: list[tuple[int, int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """Rows (class, first rank, n, shard) for classes (name, bytes, groups).

    Groups over a fair share get a shard each; the rest is packed with the least capacity, found by
    halving, for which best fit decreasing needs no more than the shards that are left. A class has
    a row per shard at most.
    """
    todo = sorted(((name, total / n, n) for name, total, n in classes), key=lambda c: (-c[1], c[0]))
    rows, shard, skip = [], 0, 0
    whole = sum(s * n for _, s, n in todo)
    while todo and shards - shard > 1 and todo[0][1] > whole / (shards - shard):
        name, size, n = todo[0]
        rows.append((name, skip, 1, shard))
        shard, whole = shard + 1, whole - size
        todo[0], skip = (name, size, n - 1), skip + 1
        if n == 1:
            todo, skip = todo[1:], 0
    if not todo:
        return rows
    shift = {todo[0][0]: skip}
    low = max(whole / (shards - shard), todo[0][1])
    high, found = low, None
    while found is None:
        high *= 1.0001 if high == low else 1 + 2 * (high / low - 1)
        found = _fit(todo, high, shards - shard)
    for _ in range(30):
        middle = (low + high) / 2
        if (better := _fit(todo, middle, shards - shard)) is None:
            low = middle
        else:
            high, found = middle, better
    return rows + [(name, rank + shift.get(name, 0), n, shard + s) for name, rank, n, s in found]


def shard_groups(rows: DataFrame, group: str, size: str, key: list[str], shards: int = SHARDS) -> DataFrame:
    """``rows`` with shard and slot: rows of one group share a shard, shards have near equal bytes.

    Groups are met by classes: sizes that share their leading nine bits, so at most 512 classes for
    each doubling of the size, whatever the data. Only the classes' counts and sums pass the
    driver (under 30,000 rows for sizes to 2**63) and a class has a plan row per shard at most. Groups take the
    plan's places by their rank within their class. ``rows`` should be a written table. Null groups
    count as one group; rows that repeat stay, each with its slot; a group over a fair share has a shard
    of its own; an empty table gives an empty one. Other columns pass; shard and slot replace ones of those names.
    """
    rows = rows.drop("shard", "slot")
    spark = rows.sparkSession
    total = rows.count()
    key_of = F.coalesce(F.col(group).cast("string"), F.lit("\0null"))
    rows = rows.withColumn("_group", key_of if dict(rows.dtypes)[group] != "binary" else F.coalesce(F.hex(group), F.lit("null")))
    groups = rows.groupBy("_group").agg(F.sum(size).alias("_bytes"), F.count("*").alias("_n"))
    drop = F.greatest(F.length(F.bin("_bytes")) - _BITS, F.lit(0))
    named = F.call_function("shiftleft", F.call_function("shiftright", F.col("_bytes"), drop), drop)
    groups = written(groups.withColumn("_class", named), "groups")
    classes = [tuple(r) for r in groups.groupBy("_class").agg(F.sum("_bytes"), F.count("*")).collect()]
    places = spark.createDataFrame(plan(classes, shards), "_in long, _from long, _many long, shard int")
    ranked = numbered(groups, ["_class"], ["_group"], "_at", sum(n for *_, n in classes))
    inside = (F.col("_class") == F.col("_in")) & (F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_from") + F.col("_many"))
    home = ranked.join(F.broadcast(places), inside).select("_group", "shard")
    placed = salted_join(rows, home, ["_group"], hot_keys(groups, ["_group"], "_n", total), F.struct(*key))
    return numbered(written(placed.drop("_group"), "placed"), ["shard"], key, "slot", total)


def digest(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: its shard by the law ``bytes``; equal texts (null counts as empty) stay together."""
    text = F.coalesce("text", F.lit(""))
    table = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("_text"))
    out = shard_groups(written(table, "sizes"), "_text", "size", ["doc_id"], shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
