"""Named queries over a data folder, each with its check SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.worlds import World, event_world, order_world
from .worlds_sql import EVENT_HEAD, ORDER_HEAD

_WORLDS = {"event": (event_world, EVENT_HEAD), "order": (order_world, ORDER_HEAD)}


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def portable(df: DataFrame) -> DataFrame:
    """Types every client reads alike: dates as text, whole numbers as 64 bit."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType, T.BooleanType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def register(name: str, fn: Callable[[World], DataFrame], sql: str | None = None,
             world: str = "event") -> None:
    """``sql`` continues the world head: it starts with more tables (``,``) or ``SELECT``."""
    build, head = _WORLDS[world]
    if name in ENTRIES:
        raise ValueError(f"duplicate query {name}")
    text = None if sql is None else head + (sql if sql.lstrip().startswith(",") else "\n" + sql)
    ENTRIES[name] = Entry(lambda spark, sf_dir: portable(fn(build(spark, sf_dir))), text)
