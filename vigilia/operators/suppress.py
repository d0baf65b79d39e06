"""Alerts with a quiet period: the one rule that is sequential by nature.

A candidate fires when no still-active alert of its key fired within the last
``quiet`` seconds. Suppressed candidates do not extend the quiet period, and
closing an alert re-opens the gate.

Distinct instants are dealt by (key, instant) into ranges of even size (see
`ranges`), whatever the keys. Keys that lie in one range are folded there. Of a
key that goes on into other ranges, pass one turns the part in each range into a
step function "last active alert on entry -> last active alert on exit",
independently of all others. Pass two merges those functions up a tree, ``FAN``
neighbours in a task, and hands the true entries down the same tree. Pass three
replays every part with its true entry. No task holds more than a range or the
functions of ``FAN`` of them. A function is kept for entries from before its
range only: its steps number at most the moments of a range or, merged, of one
quiet period.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from vigilia.functions.clock import epoch_micros
from vigilia.operators.ranges import RANGE, borders, by_ranges
from vigilia.sources.work import materialise

NEVER = int(np.iinfo(np.int64).min)
#: As an exit: the entry is returned. As a step's end: all later entries.
KEEP = int(np.iinfo(np.int64).max)
FAN = 8


def suppress(df: DataFrame, keys: Sequence[str], ts: str, tie: str, quiet: int,
             closed: DataFrame | None = None, carry: DataFrame | None = None) -> DataFrame:
    """The rows of ``df`` that fire.

    ``closed`` (keys + ``ts``) ends every active alert of the key at that
    moment; a candidate at the very same moment comes after it. ``carry``
    (keys + ``ts``) gives the key's last active alert from before the batch.
    Equal candidate times are taken in ``tie`` order. Keys must not be NULL; a
    candidate without a time never fires.
    """
    gap = quiet * 1_000_000
    keys = list(keys)
    starts = None if carry is None else carry.groupBy(*keys).agg(
        F.max(epoch_micros(F.col(ts))).alias("_exit"))
    at = epoch_micros(F.col(ts)).alias("_us")
    # Of candidates at one instant only the first can fire, so distinct instants do.
    moments = df.select(*keys, at, F.lit(False).alias("_reset"))
    if closed is not None:
        moments = moments.unionByName(closed.select(*keys, at, F.lit(True).alias("_reset")))
    # By instant alone: a closing and a candidate of one instant must not be parted.
    ranged = by_ranges(moments.where("_us IS NOT NULL").distinct(), keys, ["_us"])
    before = Window.orderBy(RANGE)
    crossing = (borders(ranged, keys).withColumn("_before", F.lag("_high").over(before))
                .where(F.col("_before") == F.col("_low")).select("_low.*").distinct())
    # As many keys as there are ranges at most.
    small = ranged.join(F.broadcast(crossing), keys, "left_anti")
    large = ranged.join(F.broadcast(crossing), keys, "left_semi").withColumnRenamed(RANGE, "_chunk")
    fired = _fold(small, keys, gap, starts).unionByName(_fold_large(large, df, keys, gap, starts))
    first = df.withColumn("_us", epoch_micros(F.col(ts))).join(fired, [*keys, "_us"], "left_semi")
    return first.groupBy(*keys, "_us").agg(
        F.min(F.struct(F.col(tie).alias("tie"), F.struct(*df.columns).alias("row"))).alias("_first")
    ).select("_first.row.*")


def _ddl(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def _fold(moments: DataFrame, keys: list[str], gap: int, starts: DataFrame | None) -> DataFrame:
    """(keys, _us) fired by keys that lie in one range."""
    if starts is None:
        entered = moments.withColumn("_entry", F.lit(NEVER))
    else:
        entered = moments.join(starts, keys, "left").withColumn("_entry", F.coalesce("_exit", F.lit(NEVER)))
    return entered.select(RANGE, *keys, "_us", "_reset", "_entry").groupBy(RANGE).applyInPandas(
        lambda pdf: _fold_range(pdf, keys, gap), f"{_ddl(moments, keys)}, _us bigint")


def _fold_range(pdf: pd.DataFrame, keys: list[str], gap: int) -> pd.DataFrame:
    group = pdf.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
    us, reset = pdf["_us"].to_numpy(np.int64), pdf["_reset"].to_numpy(bool)
    order = np.lexsort((~reset, us, group))
    fired, current, last = [], None, NEVER
    columns = (x[order].tolist() for x in (group, us, reset, pdf["_entry"].to_numpy(np.int64)))
    for i, g, t, closes, entry in zip(order.tolist(), *columns):
        if g != current:
            current, last = g, entry
        if closes:
            last = NEVER if t > last else last
        elif last == NEVER or t > last + gap:
            fired.append(i)
            last = t
    return pdf.iloc[fired][[*keys, "_us"]]


def _fold_large(moments: DataFrame, df: DataFrame, keys: list[str], gap: int,
                starts: DataFrame | None) -> DataFrame:
    """(keys, _us) fired by keys cut into chunks, one for each range they lie in."""
    ddl = _ddl(df, keys)
    known = moments.select(*keys).distinct()
    if starts is None:
        roots = known.withColumn("_entry", F.lit(NEVER))
    else:
        roots = known.join(starts, keys, "left").select(
            *keys, F.coalesce("_exit", F.lit(NEVER)).alias("_entry"))
    steps = moments.join(F.broadcast(roots), keys).groupBy(*keys, "_chunk").applyInPandas(
        lambda pdf: _step_function(pdf, keys, gap), f"{ddl}, {_STEP}")
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = _entries(steps, keys, ddl, ranges, roots)
    return moments.join(entries, [*keys, "_chunk"]).groupBy(*keys, "_chunk").applyInPandas(
        lambda pdf: _replay(pdf, keys, gap), f"{ddl}, _us bigint")


_STEP = "_chunk bigint, _asked bigint, _upto bigint, _exit bigint"


def _entries(steps: DataFrame, keys: list[str], ddl: str, chunks: int, roots: DataFrame) -> DataFrame:
    """(keys, _chunk, _entry): the true entry of every chunk; ``chunks`` bounds their numbers."""
    if chunks <= FAN:
        return steps.join(F.broadcast(roots), keys).groupBy(*keys).applyInPandas(
            lambda pdf: _hand_down(pdf, keys), f"{ddl}, _chunk bigint, _entry bigint")
    grouped = materialise(steps.withColumn("_group", F.floor(F.col("_chunk") / F.lit(FAN))))
    merged = grouped.groupBy(*keys, "_group").applyInPandas(
        lambda pdf: _merge(pdf, keys), f"{ddl}, {_STEP}")
    above = _entries(merged, keys, ddl, -(-chunks // FAN), roots).withColumnRenamed("_chunk", "_group")
    return grouped.join(above, [*keys, "_group"]).groupBy(*keys, "_group").applyInPandas(
        lambda pdf: _hand_down(pdf, keys), f"{ddl}, _chunk bigint, _entry bigint")


def _timeline(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Candidate instants, and for each the last reset at or before it."""
    us, reset = pdf["_us"].to_numpy(np.int64), pdf["_reset"].to_numpy(bool)
    order = np.lexsort((~reset, us))
    us, reset = us[order], reset[order]
    last_reset = np.maximum.accumulate(np.where(reset, us, NEVER))
    return us[~reset], last_reset[~reset]


def _jump(us: np.ndarray, last_reset: np.ndarray, gap: int) -> np.ndarray:
    """Index of the candidate firing next after each candidate, len(us) if none."""
    n = len(us)
    after_quiet = np.searchsorted(us, us + gap, side="right")
    # First candidate seeing a reset later than (or at) this one's instant: the
    # reset must come after the alert fired, so equal instants do not count.
    after_reset = np.searchsorted(last_reset, us, side="right")
    return np.minimum(np.maximum(after_reset, np.arange(1, n + 1)), after_quiet)


def _first(us: np.ndarray, last_reset: np.ndarray, gap: int, entry: int) -> int:
    """Index of the first candidate to fire given the last active alert."""
    if entry == NEVER:
        return 0
    return int(min(np.searchsorted(us, entry + gap, side="right"),
                   np.searchsorted(last_reset, entry, side="right")))


def _exits(us: np.ndarray, last_reset: np.ndarray, gap: int, final_reset: int) -> np.ndarray:
    """Active alert left at the end of the chunk when candidate i fires first."""
    n = len(us)
    nxt = _jump(us, last_reset, gap)
    hop = np.where(nxt < n, nxt, np.arange(n))
    while True:
        further = hop[hop]
        if np.array_equal(further, hop):
            break
        hop = further
    out = us[hop]
    return np.where(out < final_reset, NEVER, out)


def _final_reset(pdf: pd.DataFrame) -> int:
    resets = pdf.loc[pdf["_reset"].astype(bool), "_us"]
    return int(resets.max()) if len(resets) else NEVER


def _step_function(pdf: pd.DataFrame, keys: list[str], gap: int) -> pd.DataFrame:
    """Rows (_upto, _exit): an entry alert at or before ``_upto`` and after the
    previous row's leaves ``_exit`` active; the exit ``KEEP`` returns the entry."""
    us, last_reset = _timeline(pdf)
    final = _final_reset(pdf)
    upto, leaves = np.empty(0, np.int64), np.empty(0, np.int64)
    if len(us):
        leaves = _exits(us, last_reset, gap, final)
        # Candidate i (or an earlier one) fires for entries whose quiet period
        # is over by then or that a reset closed before it.
        upto = np.maximum(us - gap - 1, np.where(last_reset == NEVER, NEVER, last_reset - 1))
        upto, kept = np.unique(upto, return_index=True)
        leaves = leaves[kept]
        run_ends = np.append(leaves[1:] != leaves[:-1], True)
        upto, leaves = upto[run_ends], leaves[run_ends]
    if final != NEVER and (not len(upto) or final - 1 > upto[-1]):
        upto, leaves = np.append(upto, final - 1), np.append(leaves, NEVER)
    asked = max(int(pdf["_us"].min()) - 1, int(pdf["_entry"].iloc[0]))
    steps = _shorten(np.append(upto, KEEP), np.append(leaves, KEEP), asked)
    return _rows(pdf, keys, pdf["_chunk"].iloc[0], asked, *steps)


def _rows(pdf: pd.DataFrame, keys: list[str], chunk: int, asked: int, upto: np.ndarray,
          leaves: np.ndarray) -> pd.DataFrame:
    out = pd.DataFrame({"_chunk": chunk, "_asked": asked, "_upto": upto, "_exit": leaves})
    for k in keys:
        out[k] = pdf[k].iloc[0]
    return out[[*keys, "_chunk", "_asked", "_upto", "_exit"]]


def _shorten(upto: np.ndarray, leaves: np.ndarray, asked: int) -> tuple[np.ndarray, np.ndarray]:
    """The steps for entries up to ``asked``, neighbours of one exit joined."""
    end = int(np.searchsorted(upto, asked, "left")) + 1
    upto, leaves = np.append(upto[:end - 1], KEEP), leaves[:end]
    run_ends = np.append(leaves[1:] != leaves[:-1], True)
    return upto[run_ends], leaves[run_ends]


def _functions(pdf: pd.DataFrame) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(chunk, asked, upto, exit) of every chunk, in order."""
    pdf = pdf.sort_values(["_chunk", "_upto"], kind="stable")
    return [(int(chunk), int(part["_asked"].iloc[0]), part["_upto"].to_numpy(np.int64),
             part["_exit"].to_numpy(np.int64)) for chunk, part in pdf.groupby("_chunk", sort=True)]


def _merge(pdf: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """The function of neighbouring chunks, one after the other, as one chunk's."""
    (_, asked, upto, leaves), *later = _functions(pdf)
    for _, _, next_upto, next_leaves in later:
        ends = np.union1d(upto, next_upto)
        middle = leaves[np.searchsorted(upto, ends, "left")]
        passed = np.where(middle == KEEP, ends, middle)
        after = next_leaves[np.searchsorted(next_upto, passed, "left")]
        upto, leaves = _shorten(ends, np.where(after == KEEP, middle, after), asked)
    return _rows(pdf, keys, pdf["_group"].iloc[0], asked, upto, leaves)


def _hand_down(pdf: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """True entry of every chunk of a group, from the group's."""
    state, chunks, entries = int(pdf["_entry"].iloc[0]), [], []
    for chunk, _, upto, leaves in _functions(pdf):
        chunks.append(chunk)
        entries.append(state)
        leave = int(leaves[np.searchsorted(upto, state, "left")])
        state = state if leave == KEEP else leave
    out = pd.DataFrame({"_chunk": chunks, "_entry": entries})
    for k in keys:
        out[k] = pdf[k].iloc[0]
    return out[[*keys, "_chunk", "_entry"]]


def _replay(pdf: pd.DataFrame, keys: list[str], gap: int) -> pd.DataFrame:
    us, last_reset = _timeline(pdf)
    nxt = _jump(us, last_reset, gap)
    i = _first(us, last_reset, gap, int(pdf["_entry"].iloc[0])) if len(us) else 0
    fired = []
    while i < len(us):
        fired.append(us[i])
        i = int(nxt[i])
    out = pd.DataFrame({"_us": np.array(fired, dtype=np.int64)})
    for k in keys:
        out[k] = pdf[k].iloc[0]
    return out[[*keys, "_us"]]

