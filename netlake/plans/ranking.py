"""Reachability along successor links by pointer doubling.

Operators whose next step depends on the last *taken* step (a cooldown since
the last alert sent, a block since the last strike counted) are chains: every
place of a key has one place that would come next.  Which places a chain
visits looks sequential, but the links themselves do not depend on it, so they can
be composed in parallel:

* up: links of 2, 4, 8, ... steps, each level the join of the level below
  with itself.  A level is only needed where chains can be after so many
  steps, the starts and the targets of the level below; chains that run into
  one another leave fewer and fewer such places.
* down: from the longest links to the shortest, every place reached so far also
  reaches the target of its link; all step counts are sums of the levels.

Each level is one join on (key, place); a key with any share of the rows is
spread over its places.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import materialize, release


def reached(starts: DataFrame, links: DataFrame, key: str, at: str = "at", to: str = "to") -> DataFrame:
    """``(key, at)`` of every place that chains from ``starts(key, at)`` visit, starts included.

    ``links(key, at, to)`` holds at most one link per place and leads forward (``to > at``); keys are non-null.
    A chain ends where there is no link.  Links into a start are cut: the start is known.
    """
    starts = materialize(starts.select(key, at).distinct(), "starts")
    known = starts.select(key, F.col(at).alias(to))
    level = materialize(links.where(F.col(to).isNotNull()).select(key, at, to).join(known, [key, to], "left_anti").select(key, at, to), "links")
    levels = []
    while not level.isEmpty():
        levels.append(level)
        entered = starts.union(level.select(key, to)).distinct()
        on = level.select(key, F.col(at).alias(to), F.col(to).alias("_over"))
        level = materialize(level.join(entered, [key, at], "left_semi").join(on, [key, to]).select(key, at, F.col("_over").alias(to)), "links")
    parts = [starts]
    for level in reversed(levels):
        new = starts
        for p in parts[1:]:
            new = new.union(p)
        parts.append(materialize(new.join(level, [key, at]).select(key, F.col(to).alias(at)), "reached"))
        release(level)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()
