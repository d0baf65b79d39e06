"""First-come acceptance of a batch of competing requests."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from vigilia.sources.work import materialise

#: Competing requests that one task may hold.
BLOCK = 50_000


def linked_groups(links: DataFrame, key: str) -> DataFrame:
    """(key, _group) for every key in ``links`` (key, _place): keys that share a
    place, directly or by others, have one group, their lowest key.

    Each round takes the lowest group met in a key's places and then that group's
    own group, so that rounds grow with the logarithm of the longest chain.
    """
    links = materialise(links.select(key, "_place").distinct())
    groups = links.select(key, F.col(key).alias("_group")).distinct()
    total = None
    while True:
        least = links.join(groups, key).groupBy("_place").agg(F.min("_group").alias("_group"))
        met = links.join(least, "_place").groupBy(key).agg(F.min("_group").alias("_met"))
        above = met.select(F.col(key).alias("_met"), F.col("_met").alias("_group"))
        groups = materialise(met.join(above, "_met").select(key, "_group"))
        # Groups only ever fall, so an equal sum means that none has changed.
        now = groups.agg(F.sum(F.col("_group").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return groups
        total = now


def first_blocks(links: DataFrame, key: str, block: int) -> DataFrame:
    """(key, _group, _n): the lowest keys of ``links`` (key, _place) in linked groups
    of ``_n <= block`` rows, with every key lower than one of them that is linked to it.

    Of a group that exceeds the block the lower half of its span of keys stays; with
    the upper half its links go, so what stays falls apart into groups. Halving ends
    when every group fits, after as many steps as the span has bits at most.
    """
    links = materialise(links.select(key, "_place").distinct())
    groups, fitting = linked_groups(links, key), []
    while True:
        sizes = groups.groupBy("_group").agg(
            F.count(F.lit(1)).alias("_n"), F.min(key).alias("_low"), F.max(key).alias("_high"))
        sized = materialise(groups.join(sizes, "_group"))
        fitting.append(sized.where(F.col("_n") <= block).select(key, "_group", "_n"))
        middle = F.col("_low") + F.shiftright(F.col("_high") - F.col("_low"), 1)
        lower = materialise(sized.where((F.col("_n") > block) & (F.col(key) <= middle)).select(key))
        if lower.isEmpty():
            return reduce(DataFrame.unionByName, fitting)
        groups = linked_groups(links.join(lower, key, "left_semi"), key)


def accept_in_order(
    requests: DataFrame,
    key: str,
    places: Callable[[DataFrame], DataFrame],
    blocked: Callable[[DataFrame, DataFrame], DataFrame],
    one_by_one: Callable[[pd.DataFrame], list],
    block: int = BLOCK,
) -> DataFrame:
    """(key) of the requests accepted, as if handled one by one in key order.

    ``places(pending)`` gives (key, _place): requests in conflict share a place.
    Each round settles the first block of every group of linked requests, for
    which all earlier rivals are in the same group: ``one_by_one`` takes a group's
    rows sorted by key and gives the accepted keys, a request alone in its group is
    accepted. ``blocked(rest, accepted)`` then gives the keys in conflict with those;
    what is left goes through the next round. Groups within the block, of any
    number, need one round; a chain of rivals in key order one round a block.
    """
    pending, settled = materialise(requests), []
    while not pending.isEmpty():
        turn = first_blocks(places(pending), key, block)
        rivals = turn.where(F.col("_n") > 1).drop("_n")
        winners = materialise(pending.join(rivals, key).groupBy("_group").applyInPandas(
            lambda pdf: pd.DataFrame({key: one_by_one(pdf.sort_values(key))}), f"{key} bigint").unionByName(
            turn.where(F.col("_n") == 1).select(key)))
        settled.append(winners)
        rest = materialise(pending.join(turn.select(key), key, "left_anti"))
        if rest.isEmpty():
            break
        taken = pending.join(winners, key, "left_semi")
        pending = materialise(rest.join(blocked(rest, taken), key, "left_anti"))
    return reduce(DataFrame.unionByName, settled, requests.select(key).where(F.lit(False)))
