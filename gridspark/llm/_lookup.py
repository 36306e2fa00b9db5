"""Joins with a table of one row for each key, where a few keys may hold most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than one of so many rows; so there are fewer hot keys than this.
SHARES = 1000


def looked_up(rows: DataFrame, found: DataFrame, keys: Sequence[str], times: str, total: int) -> DataFrame:
    """``rows`` joined with ``found`` on ``keys``; ``times`` of ``found`` is how many of the ``total`` rows have its key.

    Hot keys, of which there are less than ``SHARES``, are broadcast, so that their rows stay where they lie; those of all others meet by
    a shuffle, in which no key has more than one of ``SHARES`` rows.  Rows without a partner are left out.
    """
    hot = F.col(times) * SHARES > total
    few = F.broadcast(found.where(hot).drop(times).withColumn("_hit", F.lit(True)))
    both = rows.join(few, list(keys), "left").where("_hit").drop("_hit")
    rest = rows.join(F.broadcast(found.where(hot).select(*keys)), list(keys), "left_anti").join(found.where(~hot).drop(times), list(keys))
    return both.unionByName(rest)
