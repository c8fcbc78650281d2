"""Labels and file names. Null and missing values take the defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
PODCAST, EPISODE, UNKNOWN = "Podcast", "Episode", "Unknown"


def _or(value: Column, default: str) -> Column:
    return F.coalesce(value, F.lit(default))


def global_result(feed_title: Column, title: Column) -> Column:
    return F.concat(F.substring(_or(feed_title, PODCAST), 1, 20), F.lit(": "), F.substring(_or(title, EPISODE), 1, 30))


def feed(title: Column, author: Column) -> Column:
    return F.format_string("Title: %s, Author: %s", _or(title, UNKNOWN), _or(author, UNKNOWN))


def episode(title: Column) -> Column:
    return F.concat(F.lit("ep "), _or(title, EPISODE))


def clip_filename(feed_title: Column, title: Column, interval: Column) -> Column:
    """Spaces to ``_``, colons of the interval to ``-`` and its spaces gone, then both slashes to ``_``."""
    parts = [F.translate(_or(feed_title, PODCAST), " ", "_"), F.translate(_or(title, EPISODE), " ", "_"), F.translate(_or(interval, ""), ": ", "-")]
    return F.translate(F.concat(F.concat_ws("-", *parts), F.lit(".mp3")), "/\\", "__")


def clip_title(feed_title: Column, title: Column, interval: Column) -> Column:
    return F.format_string("%s - %s (%s)", _or(feed_title, PODCAST), _or(title, EPISODE), _or(interval, ""))
