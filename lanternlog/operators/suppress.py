"""Suppression of repeats: keep a hit when a full window has passed since the last kept one.

The rule is sequential per (rule, key): which hits stay depends on every earlier
decision. Ordinary keys are shuffled, sorted and streamed through tasks in Arrow
batches. A hot key is cut into time chunks that are solved in parallel:

1. per chunk, a *transition table*: for every hit that could be the first one kept,
   the last one kept in the chunk;
2. tables of neighbouring chunks are composed, ``FAN`` at a time, up a tree;
3. going back down, each chunk learns from when on it may keep a hit;
4. all chunks then run the plain pass at once.

The result is exact for any distribution. A task holds one chunk, or ``FAN`` tables, each with a row for every hit
of one window at most; chunks are cut by running counts, so neither a long window nor a busy moment makes one large.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lanternlog.model import TS
from lanternlog.operators.prefix import running
from lanternlog.session import checkpointed

_KEY = ["rule_id", "key"]
_NODE = "rule_id string, key string, node bigint, first bigint, entry bigint, exit bigint"
_NEVER = -(2**62)


@dataclass(frozen=True)
class Limits:
    """Sizes above which work is split: hits of one key, hits of one chunk, tables per task."""

    hot: int = 500_000
    chunk: int = 500_000
    fan: int = 8


def suppress(
    hits: DataFrame, window_seconds: int = 60, state: DataFrame | None = None, limits: Limits = Limits()
) -> DataFrame:
    """Kept hits. ``state`` (``rule_id, key, last_us``; a key may have several) continues an earlier pass.

    Of several hits at one instant the first by event id counts.
    """
    if window_seconds <= 0:
        raise ValueError("window must be positive")
    window = window_seconds * 1_000_000
    # Written once: a hit without a time of its own got the clock's, and ids may be drawn anew each
    # time, so what is decided and what is returned must be the same rows.
    keyed = checkpointed(hits.withColumns({"key": key_of(F.col("query_key")), "us": F.unix_micros(TS)}))
    moments = checkpointed(keyed.groupBy(*_KEY, "us").agg(F.min(F.struct("event_index", "event_id")).alias("who")))
    kept = kept_moments(moments.select(*_KEY, "us"), window, state, limits)
    chosen = moments.join(kept, [*_KEY, "us"], "left_semi").select(
        *_KEY, "us", F.col("who.event_index").alias("event_index"), F.col("who.event_id").alias("event_id")
    )
    return keyed.join(chosen, [*_KEY, "us", "event_index", "event_id"], "left_semi").drop("key", "us")


def key_of(query_key: Column) -> Column:
    """Suppression key; hits without one share a key of their own."""
    return F.coalesce(F.concat(F.lit("="), query_key), F.lit("-"))


def kept_moments(
    moments: DataFrame, window: int, state: DataFrame | None = None, limits: Limits = Limits()
) -> DataFrame:
    """Distinct ``(rule_id, key, us)`` -> the kept ones."""
    if state is not None:
        # What the earlier pass rules out goes first; then every key starts afresh. A hit that comes late,
        # from outside the windows around all kept ones, is news and stays. Hits and kept times meet by
        # window-long slots, so a key with many of both is no product of the two.
        slot = F.floor(F.col("last_us") / window)
        kept = state.select(*_KEY, "last_us", F.explode(F.array(slot - 1, slot, slot + 1)).alias("slot")).alias("k")
        asked = moments.withColumn("slot", F.floor(F.col("us") / window)).alias("m")
        same = [F.col(f"m.{c}") == F.col(f"k.{c}") for c in (*_KEY, "slot")]
        near = F.abs(F.col("m.us") - F.col("k.last_us")) < window
        moments = asked.join(kept, [*same, near], "left_anti").drop("slot")
    sizes = moments.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"))
    hot = sizes.where(F.col("n") > limits.hot).select(*_KEY)
    never = F.lit(_NEVER).cast("bigint")
    if hot.isEmpty():
        return _stream(moments.withColumn("theta", never), [*_KEY], window)
    plain = _stream(moments.join(hot, _KEY, "left_anti").withColumn("theta", never), [*_KEY], window)
    split = checkpointed(_chunked(moments.join(hot, _KEY, "left_semi"), limits.chunk))
    thetas = _chunk_thetas(split, window, limits.fan)
    cut = split.join(thetas, [*_KEY, "node"], "left").withColumn("theta", F.coalesce("theta", never))
    return plain.unionByName(_stream(cut, [*_KEY, "node"], window))


# The plain pass -----------------------------------------------------------------------


def _stream(moments: DataFrame, group: list[str], window: int) -> DataFrame:
    """Sorted groups through tasks batch by batch; only the last kept time is carried over."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_group, theta = None, _NEVER
        for batch in batches:
            if batch.empty:
                continue
            codes = batch.groupby(group, sort=False, dropna=False).ngroup().to_numpy()
            us = batch["us"].to_numpy()
            starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            floors = batch["theta"].to_numpy()[starts].copy()
            head = tuple(batch[group].iloc[0])
            if head == open_group:
                floors[0] = max(floors[0], theta)
            mask = greedy_mask(us, starts, floors, window)
            tail = us[starts[-1] :][mask[starts[-1] :]]
            open_group = tuple(batch[group].iloc[-1])
            theta = int(tail[-1]) + window if tail.size else int(floors[-1])
            yield batch.loc[mask, [*_KEY, "us"]]

    ordered = moments.select(*dict.fromkeys([*_KEY, *group]), "us", "theta").repartition(*group)
    return ordered.sortWithinPartitions(*group, "us").mapInPandas(run, "rule_id string, key string, us bigint")


def greedy_mask(us: np.ndarray, starts: np.ndarray, floors: np.ndarray, window: int) -> np.ndarray:
    """Kept positions of consecutive sorted groups, all groups advancing one hit per step."""
    n = len(us)
    ends = np.r_[starts[1:], n]
    mask = np.zeros(n, dtype=bool)
    if len(starts) > 1 and int(us.max()) - int(us.min()) + window > 2**62 // len(starts):
        for i, (a, b) in enumerate(zip(starts, ends)):
            mask[a:b] = greedy_mask(us[a:b], np.array([0]), floors[i : i + 1], window)
        return mask
    owner = np.repeat(np.arange(len(starts)), ends - starts)
    # One global search array: groups are laid out far enough apart not to meet.
    low = int(us.min())
    span = int(us.max()) - low + window + 1
    flat = owner * span + (us - low)
    where = np.clip(floors, low, low + span - 1) - low
    active = np.arange(len(starts))
    at = np.searchsorted(flat, active * span + where)
    while active.size:
        inside = at < ends[active]
        active, at = active[inside], at[inside]
        mask[at] = True
        at = np.searchsorted(flat, flat[at] + window)
    return mask


# Hot keys ------------------------------------------------------------------------------


def _chunked(moments: DataFrame, size: int) -> DataFrame:
    """Number the time chunks of each key, ``size`` hits each, by running counts that are themselves many tasks."""
    counted = running(moments.withColumn("_one", F.lit(1)), _KEY, ["us"], "_one", "_rank")
    return counted.withColumn("node", F.floor((F.col("_rank") - 1) / size)).drop("_one", "_rank")


def _chunk_thetas(split: DataFrame, window: int, fan: int) -> DataFrame:
    """``(rule_id, key, node, theta)``: the earliest time each chunk may keep a hit."""
    base = split.groupBy(*_KEY, "node").applyInPandas(lambda pdf: _transitions(pdf, window), _NODE)
    levels = [checkpointed(base)]
    while levels[-1].agg(F.max("node")).first()[0] >= fan:
        grouped = levels[-1].withColumn("parent", F.floor(F.col("node") / fan)).groupBy(*_KEY, "parent")
        levels.append(checkpointed(grouped.applyInPandas(lambda pdf: _compose(pdf, window), _NODE)))
    start = [F.lit(0).cast("bigint").alias("parent"), F.lit(_NEVER).cast("bigint").alias("theta")]
    thetas = levels[-1].select(*_KEY).distinct().select(*_KEY, *start)
    for level in reversed(levels):
        children = level.withColumn("parent", F.floor(F.col("node") / fan))
        thetas = (
            children.join(thetas, [*_KEY, "parent"])
            .groupBy(*_KEY, "parent")
            .applyInPandas(lambda pdf: _descend(pdf, window), "rule_id string, key string, parent bigint, theta bigint")
        )
    return thetas.withColumnRenamed("parent", "node")


def _table(head: pd.DataFrame, node: int, first: int, entry: np.ndarray, exit_: np.ndarray) -> pd.DataFrame:
    """A transition table with runs of equal exits merged into their last entry."""
    last = np.r_[exit_[1:] != exit_[:-1], True]
    return pd.DataFrame(
        {
            "rule_id": head["rule_id"].iloc[0],
            "key": head["key"].iloc[0],
            "node": node,
            "first": first,
            "entry": entry[last],
            "exit": exit_[last],
        }
    )


def _entries(us: np.ndarray, window: int) -> int:
    """How many leading times can be the first kept: one window's worth, and the next one."""
    return min(len(us), int(np.searchsorted(us, us[0] + window)) + 1)


def _transitions(pdf: pd.DataFrame, window: int) -> pd.DataFrame:
    us = np.sort(pdf["us"].to_numpy())
    following = np.searchsorted(us, us + window)
    last = np.arange(_entries(us, window))
    while True:
        ahead = following[last]
        more = ahead < len(us)
        if not more.any():
            break
        last = np.where(more, ahead, last)
    return _table(pdf, int(pdf["node"].iloc[0]), int(us[0]), us[: len(last)], us[last])


def _children(pdf: pd.DataFrame) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    out = []
    for node, part in pdf.sort_values(["node", "entry"]).groupby("node"):
        out.append((int(node), int(part["first"].iloc[0]), part["entry"].to_numpy(), part["exit"].to_numpy()))
    return out


def _advance(theta: np.ndarray, entry: np.ndarray, exit_: np.ndarray, window: int) -> np.ndarray:
    at = np.searchsorted(entry, theta)
    inside = at < len(entry)
    return np.where(inside, exit_[np.minimum(at, len(entry) - 1)] + window, theta)


def _compose(pdf: pd.DataFrame, window: int) -> pd.DataFrame:
    children = _children(pdf)
    first = children[0][1]
    entries, thetas, seen = [], [], _NEVER
    for i, (_, _, entry, exit_) in enumerate(children):
        # Later children only decide for times that pass all earlier ones by.
        if seen >= first + window:
            break
        fresh = entry > seen
        theta = exit_[fresh] + window
        for _, _, next_entry, next_exit in children[i + 1 :]:
            theta = _advance(theta, next_entry, next_exit, window)
        entries.append(entry[fresh])
        thetas.append(theta)
        seen = max(seen, int(entry[-1]))
    entry, theta = np.concatenate(entries), np.concatenate(thetas)
    keep = min(len(entry), int(np.searchsorted(entry, first + window)) + 1)
    return _table(pdf, int(pdf["parent"].iloc[0]), first, entry[:keep], theta[:keep] - window)


def _descend(pdf: pd.DataFrame, window: int) -> pd.DataFrame:
    theta = np.array([pdf["theta"].iloc[0]])
    nodes, floors = [], []
    for node, _, entry, exit_ in _children(pdf):
        nodes.append(node)
        floors.append(int(theta[0]))
        theta = _advance(theta, entry, exit_, window)
    return pd.DataFrame(
        {"rule_id": pdf["rule_id"].iloc[0], "key": pdf["key"].iloc[0], "parent": nodes, "theta": floors}
    )
