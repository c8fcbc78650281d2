"""What an update can lead to: catalogue outcomes joined to the raw log, for every state in which it may meet its user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import intervals
from . import index, paging, sessions, shared

#: Fields in which feeds and episodes are searched.
FEED_FIELDS, EPISODE_FIELDS = ("title", "author"), ("title", "description", "author", "tags")


def segmented(updates: DataFrame, chunk: int = sessions.CHUNK) -> DataFrame:
    """``updates`` (update_id, user_id, kind, payload) with symbol, typed and ``segment``: the user's last cancel before, or -1.

    After a cancel no session is active whatever came before, so segments can be replayed apart. The last cancel is an exclusive
    scan: a maximum for each range of ``chunk`` update ids, a scan over the ranges, then one within each range; no task sees all of a user's log.
    """
    kinds = F.struct(sessions.symbol(F.col("kind"), F.col("payload")).alias("symbol"), sessions.typed(F.col("kind"), F.col("payload")).alias("typed"))
    df = updates.select("*", F.inline(F.array(kinds)))  # a generator, so that what reads the symbol doesn't repeat its expression
    df = df.withColumns({"_c": F.floor(F.col("update_id") / chunk), "_cancel": F.when(F.col("symbol") == "cancel", F.col("update_id"))})
    before = W.orderBy("_c").rowsBetween(W.unboundedPreceding, -1)
    ranges = df.groupBy("user_id", "_c").agg(F.max("_cancel").alias("_most"))
    ranges = ranges.select("user_id", "_c", F.max("_most").over(before.partitionBy("user_id")).alias("_carry"))
    inside = F.max("_cancel").over(W.partitionBy("user_id", "_c").orderBy("update_id").rowsBetween(W.unboundedPreceding, -1))
    scanned = df.withColumn("_inside", inside).join(ranges, ["user_id", "_c"])
    return scanned.withColumn("segment", F.coalesce("_inside", "_carry", F.lit(-1))).drop("_c", "_cancel", "_inside", "_carry")


def _of_texts(texts: DataFrame, feeds: DataFrame, episodes: DataFrame) -> DataFrame:
    """Of each different text (payload): the feeds that hold it (n_feeds, and the one if it is one), how many episodes do (n_global)."""
    asked = shared.written(texts.select("payload", F.lower("payload").alias("_q")).distinct(), "texts")
    in_feeds = index.matches(asked, feeds, FEED_FIELDS, q="payload").groupBy("_q").agg(F.count("*").alias("n_feeds"), F.min("id").alias("one_feed"))
    in_all = index.matches(asked, episodes, EPISODE_FIELDS, q="payload").groupBy("_q").agg(F.count("*").alias("n_global"))
    found = asked.join(in_feeds, "_q", "left").join(in_all, "_q", "left")
    return found.select("payload", F.coalesce("n_feeds", F.lit(0)).alias("n_feeds"), F.when(F.col("n_feeds") == 1, F.col("one_feed")).alias("one_feed"), F.coalesce("n_global", F.lit(0)).alias("n_global"))


def _in_feed(texts: DataFrame, episodes: DataFrame) -> DataFrame:
    """Of each text and each feed that may be open (``open``) the episodes that hold it: n, and if it is one its id, url and title."""
    pairs = texts.select("user_id", "update_id", F.lower("payload").alias("_q"), F.explode("open").alias("feed_id"))
    found = index.matches(shared.written(pairs.select("_q", "feed_id").distinct(), "pairs"), episodes, ["title"], ["feed_id"], "_q")
    found = shared.written(found.groupBy("_q", "feed_id").agg(F.count("*").alias("n"), F.min("id").alias("id")), "inside")
    rows = episodes.select("id", "feed_id", "enclosure_url", "title").join(found.where("n = 1"), ["id", "feed_id"]).where(F.contains(F.lower("title"), F.col("_q")))
    alone = rows.select("_q", "feed_id", F.struct("id", "enclosure_url", "title").alias("one"))
    named = pairs.join(shared.written(found.select("_q", "feed_id", "n").join(alone, ["_q", "feed_id"], "left"), "named"), ["_q", "feed_id"])
    return named.groupBy("user_id", "update_id").agg(F.collect_list(F.struct("feed_id", "n", "one")).alias("inside"))


def _listed(log: DataFrame, once: DataFrame) -> DataFrame:
    """``log`` with whether the episode of its id holds the text that came last. Each different pair is looked at once, and no update carries an episode's texts."""
    pairs = log.where("_id is not null and _last_text <> ''").select("_id", "_last_text").distinct()
    holds = F.lit(False)
    for f in EPISODE_FIELDS:
        holds = holds | F.coalesce(F.contains(F.lower(f), F.lower("_last_text")), F.lit(False))
    held = pairs.join(once, "_id").where(holds).select("_id", "_last_text", F.lit(True).alias("_held"))
    return log.join(shared.written(held, "listed"), ["_id", "_last_text"], "left").withColumn("listed", F.coalesce("_held", F.lit(False)))


def with_outcomes(updates: DataFrame, feeds: DataFrame, episodes: DataFrame, chunk: int = sessions.CHUNK) -> DataFrame:
    """The raw log with everything that replay needs to know of each update, whatever state it meets.

    A text is a feed search, a search in the open feed, a search of all episodes or an interval; an id is a feed or an
    episode. So each gets the outcome of all of these by equi joins: of each different text once, of each id once. Which feed is open isn't known
    here, so a text is sought in those that may be: the one whose id came last, and those that the first text after it, or after a start, alone names.
    ``feeds``: id, title, author; ``episodes``: id, feed_id, title, description, author, tags (a string), enclosure_url, pos.
    """
    log = shared.written(segmented(updates, chunk), "log")
    sizes = shared.written(episodes.groupBy(F.col("feed_id").alias("_feed")).agg(F.count("*").alias("_n")), "sizes")
    texts = _of_texts(log.where("typed"), feeds, episodes).join(sizes, F.col("one_feed") == F.col("_feed"), "left")
    texts = texts.select(F.col("payload").alias("_text"), "n_feeds", "one_feed", "n_global", F.coalesce("_n", F.lit(0)).alias("one_n"))
    log = log.join(shared.written(texts, "found"), F.col("typed") & (F.col("payload") == F.col("_text")), "left").drop("_text")

    number = F.when(F.col("symbol") == "id", F.col("payload").try_cast("bigint"))
    log = log.withColumn("_id", number)
    log = log.join(sizes.select(F.col("_feed").alias("_id"), F.col("_n").alias("feed_n")), "_id", "left")
    ids = shared.written(log.where("_id is not null").select(F.col("_id").alias("id")).distinct(), "ids")
    chosen = episodes.join(ids, "id", "left_semi").groupBy(F.col("id").alias("_id")).agg(F.min_by(F.struct("feed_id", "enclosure_url", *EPISODE_FIELDS), "pos").alias("_e"))
    once = shared.written(chosen.select("_id", "_e.*"), "chosen")
    log = log.join(once.select("_id", F.struct("feed_id", "enclosure_url", "title").alias("episode")), "_id", "left")

    mine = W.partitionBy("user_id", "segment").orderBy("update_id").rowsBetween(W.unboundedPreceding, -1)
    log = log.withColumns({"_last_text": F.last(F.when(F.col("typed"), F.col("payload")), True).over(mine), "_last_id": F.last("_id", True).over(mine), "_ids": F.count("_id").over(mine)})

    starts = F.count(F.when(F.col("symbol").isin("cut", "trending"), 1)).over(mine)
    log = log.withColumn("_starts", starts)
    one = F.when(F.col("one_n") > 0, F.col("one_feed"))
    first = F.row_number().over(W.partitionBy("user_id", "segment", "_ids", "_starts").orderBy(one.isNull(), "update_id")) == 1
    log = log.withColumn("_lead", F.when(first, one))
    run = W.partitionBy("user_id", "segment", "_ids").orderBy("update_id").rowsBetween(W.unboundedPreceding, -1)
    log = log.withColumn("open", F.array_compact(F.array_union(F.collect_set("_lead").over(run), F.array("_last_id"))))
    log = shared.written(log, "opened")
    log = _listed(log, once)
    inside = _in_feed(log.where("typed and size(open) > 0"), episodes)
    log = log.join(inside, ["user_id", "update_id"], "left")

    log = intervals.parsed(log, "payload")
    long = F.col("end_sec") - F.col("start_sec") > intervals.LONGEST
    timed = F.when(F.col("typed"), F.when(intervals.status(F.col("start_sec"), F.col("end_sec")) != "ok", "bad").when(long, "too_long").otherwise("ok"))
    picked = paging.sample(episodes, "id").select(F.lit("surprise").alias("symbol"), F.struct(F.col("id").cast("string").alias("id"), "enclosure_url", "title").alias("surprise"))
    some = feeds.limit(1).select(F.lit("trending").alias("symbol"), F.lit(True).alias("trending"))
    log = log.join(F.broadcast(picked), "symbol", "left").join(F.broadcast(some), "symbol", "left")  # a row each
    return log.select("user_id", "update_id", "segment", "symbol", "typed", "payload", "n_feeds", "one_feed", "one_n", "n_global", F.coalesce("feed_n", F.lit(0)).alias("feed_n"), "episode", "listed", "inside", timed.alias("timed"), "surprise", F.coalesce("trending", F.lit(False)).alias("trending"))
