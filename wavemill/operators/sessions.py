"""Update logs: symbols, the session fold, the funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States of a session (END: none is active), by number.
STATES = ("END", "ENTER_PODCAST_NAME", "PODCAST_CHOICE", "ENTER_EPISODE_NAME", "EPISODE_CHOICE", "ENTER_GLOBAL_SEARCH", "GLOBAL_EPISODE_CHOICE", "CUT_INTERVAL")
#: Button texts and commands, and the symbol of each.
BUTTONS = {"Trending Podcasts": "trending", "Surprise Me": "surprise", "Search Podcast by Name": "cut", "Search Episodes Globally": "search", "Help": "help"}
COMMANDS = {"cut_podcast": "cut", "search_episodes": "search", "trending": "trending", "surprise": "surprise", "cancel": "cancel", "start": "help", "help": "help"}
#: Fixed values: (from, symbol, to). What isn't listed leaves the state as it is.
TRANSITIONS = (
    ("END", "cut", "ENTER_PODCAST_NAME"),
    ("END", "search", "ENTER_GLOBAL_SEARCH"),
    ("END", "trending", "PODCAST_CHOICE"),
    ("END", "surprise", "CUT_INTERVAL"),
    ("ENTER_PODCAST_NAME", "text_many", "PODCAST_CHOICE"),
    ("ENTER_PODCAST_NAME", "text_one", "EPISODE_CHOICE"),
    ("ENTER_PODCAST_NAME", "text_one_empty", "ENTER_EPISODE_NAME"),
    ("PODCAST_CHOICE", "text_one", "EPISODE_CHOICE"),
    ("PODCAST_CHOICE", "text_one_empty", "ENTER_EPISODE_NAME"),
    ("PODCAST_CHOICE", "text_none", "ENTER_PODCAST_NAME"),
    ("PODCAST_CHOICE", "page_one", "EPISODE_CHOICE"),
    ("PODCAST_CHOICE", "page_one_empty", "ENTER_EPISODE_NAME"),
    ("PODCAST_CHOICE", "page_none", "ENTER_PODCAST_NAME"),
    ("PODCAST_CHOICE", "id", "EPISODE_CHOICE"),
    ("PODCAST_CHOICE", "id_empty", "ENTER_EPISODE_NAME"),
    ("EPISODE_CHOICE", "text_one", "CUT_INTERVAL"),
    ("EPISODE_CHOICE", "page_none", "ENTER_EPISODE_NAME"),
    ("EPISODE_CHOICE", "id", "CUT_INTERVAL"),
    ("ENTER_GLOBAL_SEARCH", "text_many", "GLOBAL_EPISODE_CHOICE"),
    ("ENTER_GLOBAL_SEARCH", "text_one", "GLOBAL_EPISODE_CHOICE"),
    ("GLOBAL_EPISODE_CHOICE", "text_none", "ENTER_GLOBAL_SEARCH"),
    ("GLOBAL_EPISODE_CHOICE", "page_none", "ENTER_GLOBAL_SEARCH"),
    ("GLOBAL_EPISODE_CHOICE", "id", "CUT_INTERVAL"),
    ("CUT_INTERVAL", "interval_ok", "END"),
    ("CUT_INTERVAL", "interval_no_url", "END"),
    ("CUT_INTERVAL", "interval_too_long", "END"),
    ("CUT_INTERVAL", "interval_failed", "END"),
    *((state, "cancel", "END") for state in STATES[1:]),
)
#: Updates of a user that are folded at once at most (by update_id), and partial folds that are put together at once.
CHUNK = 4096


def symbol(kind: Column, payload: Column) -> Column:
    """``next``, ``prev`` or ``id`` for a callback; a button's or a command's symbol; ``command_other``; else ``text``."""
    name = F.regexp_extract(payload, r"^/([A-Za-z0-9_]+)(?:@\w+)?(?:\s|$)", 1)
    out = F.when(kind == "callback", F.when(payload == "next_page", "next").when(payload == "prev_page", "prev").otherwise("id"))
    for text, value in BUTTONS.items():
        out = out.when(payload == text, value)
    for command, value in COMMANDS.items():
        out = out.when(name == command, value)
    return out.when(payload.startswith("/"), "command_other").otherwise("text")


def typed(kind: Column, payload: Column) -> Column:
    """Whether an update is text that a step reads: no callback, no command. A button's text is one, but for Help, which is answered in any state."""
    return (kind != "callback") & ~payload.startswith("/") & (payload != "Help")


_MOVES = {(a, s): b for a, s, b in TRANSITIONS}
SYMBOLS = tuple(sorted({s for _, s, _ in TRANSITIONS}))


def next_state(state: int, symbol_: str) -> int:
    return STATES.index(_MOVES.get((STATES[state], symbol_), STATES[state]))


def _next() -> Column:
    """map from symbol to the next state of each state; a symbol that moves nothing isn't in it."""
    return F.create_map(*(x for s in SYMBOLS for x in (F.lit(s), F.array(*(F.lit(next_state(i, s)) for i in range(len(STATES)))))))


def _run(state, mask, done) -> Column:
    return F.struct(state.cast("int").alias("state"), mask.cast("int").alias("mask"), done.cast("bigint").alias("done"))


def _chunk_fold(symbols: Column) -> Column:
    """From each start state: where the symbols lead, the states they reach (bits), the clips they finish."""
    start = F.array(*(_run(F.lit(i), F.lit(0), F.lit(0)) for i in range(len(STATES))))
    same = F.array(*map(F.lit, range(len(STATES))))

    def step(acc, x):
        move = F.coalesce(F.try_element_at(_next(), x), same)

        def one(a):
            to = F.get(move, a["state"])
            finished = (a["state"] == STATES.index("CUT_INTERVAL")) & (x == "interval_ok")
            return _run(to, a["mask"].bitwiseOR(F.call_function("shiftleft", F.lit(1), to)), a["done"] + finished.cast("bigint"))

        return F.transform(acc, one)

    return F.aggregate(symbols, start, step)


def _after(first: Column, then: Column) -> Column:
    def one(a):
        b = F.get(then, a["state"])
        return _run(b["state"], a["mask"].bitwiseOR(b["mask"]), a["done"] + b["done"])

    return F.transform(first, one)


def fold(updates: DataFrame) -> DataFrame:
    """user_id, n_updates, final_state, reached (bit i: STATES[i]) and finished clips, from update_id, user_id, symbol.

    A fold from every start state at once is a function, and functions can be put together in any grouping that
    keeps their order. So a user's log is folded by ranges of CHUNK update ids, then CHUNK ranges at a
    time, until one is left: no task holds more than CHUNK updates of a user, however long the log.
    Null symbols move nothing.
    """
    level = updates.select("user_id", F.floor(F.col("update_id") / CHUNK).alias("c"), F.struct("update_id", F.coalesce("symbol", F.lit("")).alias("symbol")).alias("u"))
    level = level.groupBy("user_id", "c").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("u")).alias("us"))
    level = level.select("user_id", "c", "n", _chunk_fold(F.transform("us", lambda u: u["symbol"])).alias("f"))
    for _ in range(5):  # CHUNK ** 6 exceeds any bigint of ids
        level = level.groupBy("user_id", F.floor(F.col("c") / CHUNK).alias("c")).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("c", "f"))).alias("fs"))
        level = level.select("user_id", "c", "n", F.aggregate(F.slice("fs", 2, CHUNK), F.get("fs", F.lit(0))["f"], lambda a, x: _after(a, x["f"])).alias("f"))
    at = F.get("f", F.lit(0))
    return level.select("user_id", F.col("n").alias("n_updates"), F.get(F.array(*map(F.lit, STATES)), at["state"]).alias("final_state"), at["mask"].cast("bigint").alias("reached"), at["done"].alias("finished"))


def funnel(folded: DataFrame) -> DataFrame:
    """Users that reached each state, and users that finished a clip, as rows (step, users)."""
    steps = [F.struct(F.lit(s).alias("step"), F.col("reached").bitwiseAND(F.lit(1 << i)) > 0) for i, s in enumerate(STATES)]
    steps.append(F.struct(F.lit("FINISHED").alias("step"), F.col("finished") > 0))
    return folded.select(F.explode(F.array(*(F.struct(s["step"].alias("step"), s["col2"].cast("bigint").alias("hit")) for s in steps))).alias("s")).groupBy("s.step").agg(F.sum("s.hit").alias("users"))
