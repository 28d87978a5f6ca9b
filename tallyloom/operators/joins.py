"""Joins whose physical form depends on a counted size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import keep

#: Ids up to this number (8 MB) may be broadcast, whatever the size of the other side; more go through a shuffle join, with
#: the same result. The session's ``tallyloom.broadcastIds`` sets another bound, 0 none at all.
BROADCAST_IDS = 1_000_000


def by_ids(df: DataFrame, ids: DataFrame, on: str, how: str) -> DataFrame:
    """Semi or anti join with a table of distinct ids, which is counted first: broadcast within a bound, else shuffled."""
    ids = keep(ids, "ids")
    most = int(df.sparkSession.conf.get("tallyloom.broadcastIds", str(BROADCAST_IDS)))
    return df.join(F.broadcast(ids) if ids.count() <= most else ids, on, how)


def first_per(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each ``key`` by ``order``, which is unique. Only keys and places are shuffled; the later rows, mostly
    few, are then taken out by an anti join, so wide columns stay where they are."""
    least = df.groupBy(key).agg(F.min(order).alias("_m"), F.count("*").alias("_c")).where("_c > 1")
    places = df.select(F.col(key).alias("_k"), order)
    later = places.join(least, F.col("_k").eqNullSafe(F.col(key))).where(F.col(order) > F.col("_m")).select(order)
    return by_ids(df, later, order, "left_anti").select(*df.columns)

