"""Replay of raw logs with their outcomes: the transition log, each user's context, rates per step."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import paging, sessions

#: What a session remembers.
REGISTERS = ("q", "page", "feed", "episode", "url", "title")
_LOG = [("user_id", pa.int64()), ("update_id", pa.int64()), ("before", pa.string()), ("outcome", pa.string()), ("after", pa.string()), *((r, pa.int64() if r == "page" else pa.string()) for r in REGISTERS)]
_KIND = "user_id long, update_id long, before string, outcome string, after string, q string, page long, feed string, episode string, url string, title string"
_ERRORS = ("none", "page_none", "one_empty", "id_empty", "no_url", "bad", "too_long")


class Session:
    """One user's state and registers; ``step`` takes an update and gives its outcome."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.state, self.size = "END", 0
        self.q = self.page = self.feed = self.episode = self.url = self.title = None

    def step(self, u: dict) -> str:
        symbol = u["symbol"]
        if symbol == "help" or symbol == "command_other":
            return "same"
        if self.state == "END":
            return self._start(u)
        if symbol == "cancel":
            self.clear()
            return "cancel"
        if u["typed"]:
            return self._text(u)
        if symbol in ("next", "prev", "id"):
            return self._button(symbol, u)
        return "same"

    def _start(self, u: dict) -> str:
        symbol = u["symbol"]
        if symbol not in ("cut", "search", "trending", "surprise"):
            return "same"
        self.clear()
        if symbol == "cut":
            self.state = "ENTER_PODCAST_NAME"
        elif symbol == "search":
            self.state = "ENTER_GLOBAL_SEARCH"
        elif symbol == "trending":
            if not u["trending"]:
                return "none"
            self.page, self.state = 1, "PODCAST_CHOICE"
        else:
            if not u["surprise"]:
                return "none"
            self.episode, self.url, self.title = u["surprise"]["id"], u["surprise"]["enclosure_url"], u["surprise"]["title"]
            self.state = "CUT_INTERVAL"
        return "start"

    def _open(self, feed: str, n: int) -> bool:
        self.feed, self.page, self.size = feed, 1, n
        self.state = "EPISODE_CHOICE" if n else "ENTER_EPISODE_NAME"
        return n > 0

    def _text(self, u: dict) -> str:
        state = self.state
        if state in ("ENTER_PODCAST_NAME", "PODCAST_CHOICE"):
            self.q, self.page = u["payload"], 1
            if u["n_feeds"] == 1:
                return "one" if self._open(str(u["one_feed"]), u["one_n"]) else "one_empty"
            self.state = "PODCAST_CHOICE" if u["n_feeds"] else "ENTER_PODCAST_NAME"
            return "many" if u["n_feeds"] else "none"
        if state in ("ENTER_GLOBAL_SEARCH", "GLOBAL_EPISODE_CHOICE"):
            self.q, self.page, self.size = u["payload"], 1, u["n_global"]
            self.state = "GLOBAL_EPISODE_CHOICE" if self.size else "ENTER_GLOBAL_SEARCH"
            return "many" if self.size else "none"
        if state == "EPISODE_CHOICE":
            found = next((x for x in u["inside"] or () if str(x["feed_id"]) == self.feed), None)
            if found is None:
                return "none"
            if found["n"] > 1:
                return "many"
            self.episode, self.url, self.title = str(found["one"]["id"]), found["one"]["enclosure_url"], found["one"]["title"]
            self.state = "CUT_INTERVAL"
            return "one"
        if state == "CUT_INTERVAL":
            outcome = u["timed"] if self.url else "no_url"
            if outcome != "bad":
                self.clear()
            return outcome
        return "same"

    def _button(self, symbol: str, u: dict) -> str:
        state = self.state
        if state not in ("PODCAST_CHOICE", "EPISODE_CHOICE", "GLOBAL_EPISODE_CHOICE"):
            return "same"
        if symbol == "id":
            if state == "PODCAST_CHOICE":
                return "id" if self._open(u["payload"], u["feed_n"]) else "id_empty"
            found = u["episode"]
            self.episode, self.state = u["payload"], "CUT_INTERVAL"
            if found and (u["listed"] if state == "GLOBAL_EPISODE_CHOICE" else str(found["feed_id"]) == self.feed):
                self.url, self.title = found["enclosure_url"], found["title"]
            return "id"
        self.page += 1 if symbol == "next" else -1
        if state == "PODCAST_CHOICE":
            # the service shows the last rows it has, so every page from 1 on has some
            if self.q is not None and self.page >= 1:
                return "page"
            self.page, self.state = 1, "ENTER_PODCAST_NAME"
        elif self.page >= 1 and paging.SIZE * (self.page - 1) < self.size:
            return "page"
        else:
            self.state = "ENTER_EPISODE_NAME" if state == "EPISODE_CHOICE" else "ENTER_GLOBAL_SEARCH"
        return "page_none"


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of user, segment and update, one at a time: a segment of any length takes the memory of one row."""
    key, session = None, Session()
    for batch in batches:
        out = []
        for u in batch.to_pylist():
            if (u["user_id"], u["segment"]) != key:
                key, session = (u["user_id"], u["segment"]), Session()
            before = session.state
            outcome = session.step(u)
            out.append((u["user_id"], u["update_id"], before, outcome, session.state, *(getattr(session, r) for r in REGISTERS)))
        columns = zip(*out, strict=True) if out else [()] * len(_LOG)
        yield pa.record_batch([pa.array(c, t) for c, (_, t) in zip(columns, _LOG, strict=True)], schema=pa.schema(_LOG))


def transitions(log: DataFrame) -> DataFrame:
    """user_id, update_id, before, outcome, after and the registers after each update, from outcomes.with_outcomes.

    Segments (see outcomes.segmented) start without a session, so each is replayed apart, in order, and a user with a third of
    the log is dealt over as many tasks as the cancels allow; only the updates between two cancels must follow one another. A trending list
    begins on page 1 like others. Callbacks and texts that a state doesn't read leave all as it is.
    """
    log = log.repartition("user_id", "segment").sortWithinPartitions("user_id", "segment", "update_id")
    return log.mapInArrow(_replayed, _KIND)


def contexts(log: DataFrame) -> DataFrame:
    """Each user's state and registers after the last update (of transitions). Registers are null where the session didn't set them, and all of them where none is active."""
    last = log.groupBy("user_id").agg(F.max(F.struct("update_id", F.col("after").alias("state"), *REGISTERS)).alias("l"))
    return last.select("user_id", "l.state", *(F.col(f"l.{r}").alias(r) for r in REGISTERS))


def states(log: DataFrame) -> DataFrame:
    """user_id, n_updates, final_state, reached (bit i: sessions.STATES[i]) and finished clips, as sessions.fold, from transitions."""
    number = F.array_position(F.array(*map(F.lit, sessions.STATES)), F.col("after")).cast("int") - 1
    bit = F.call_function("shiftleft", F.lit(1), number)
    finished = F.sum(((F.col("before") == "CUT_INTERVAL") & (F.col("outcome") == "ok")).cast("bigint"))
    return log.groupBy("user_id").agg(F.count("*").alias("n_updates"), F.max(F.struct("update_id", "after"))["after"].alias("final_state"), F.bit_or(bit).cast("bigint").alias("reached"), finished.alias("finished"))


def rates(log: DataFrame) -> DataFrame:
    """Of each step (state before): its updates and users, errors, cancels and finished clips, the last three also in thousandths of the updates."""
    count = lambda c: F.sum(c.cast("bigint"))
    out = log.groupBy(F.col("before").alias("step")).agg(
        F.count("*").alias("updates"),
        F.count_distinct("user_id").alias("users"),
        count(F.col("outcome").isin(*_ERRORS)).alias("errors"),
        count(F.col("outcome") == "cancel").alias("cancels"),
        count((F.col("before") == "CUT_INTERVAL") & (F.col("outcome") == "ok")).alias("finished"),
    )
    return out.withColumns({f"{c}_permille": F.floor(1000 * F.col(c) / F.col("updates")) for c in ("errors", "cancels", "finished")})
