"""Attributes as known at event time: persistent search trees over valid time.

For every entity the attribute rows are inserted in the order in which they became known. Each
insertion paints its validity interval into a search tree over the entity's valid-time bounds and
copies only the path it touches, so the root of every earlier version stays usable. An event picks
the root of the last version known at its time and walks down to its own time; the newest paint on
the way is the row that was valid then as far as was known then.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorline.functions.geo import code, micros
from tremorline.session import small_side


class PersistentTree:
    """Versions of a painted line; node 0 is the empty tree. Version k holds the first k intervals."""

    def __init__(self, first: np.ndarray, last: np.ndarray, leaves: int) -> None:
        """``first[k] <= leaf < last[k]`` is painted by insertion k."""
        self.leaves = max(1, leaves)
        self.left, self.right, self.paint = [0], [0], [-1]
        self.roots = [0]
        for k, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
            self.roots.append(self._paint(self.roots[-1], 0, self.leaves, a, b, k) if a < b else self.roots[-1])
        self._left, self._right, self._tag = (np.array(x, "i8") for x in (self.left, self.right, self.paint))
        self._roots = np.array(self.roots, "i8")

    def _paint(self, old: int, lo: int, hi: int, a: int, b: int, k: int) -> int:
        node = len(self.paint)
        self.left.append(self.left[old])
        self.right.append(self.right[old])
        self.paint.append(self.paint[old])
        if a <= lo and hi <= b:
            self.paint[node] = k
            return node
        mid = (lo + hi) // 2
        if a < mid:
            self.left[node] = self._paint(self.left[old], lo, mid, a, b, k)
        if b > mid:
            self.right[node] = self._paint(self.right[old], mid, hi, a, b, k)
        return node

    def newest(self, version: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """For each query the last insertion of its version that covers its leaf, or -1."""
        node = self._roots[version]
        lo, hi = np.zeros(len(leaf), "i8"), np.full(len(leaf), self.leaves, "i8")
        best = self._tag[node]
        while (node > 0).any() and (hi - lo > 1).any():
            mid = (lo + hi) // 2
            go_left = leaf < mid
            deep = hi - lo > 1
            node = np.where(deep, np.where(go_left, self._left[node], self._right[node]), 0)
            lo, hi = np.where(deep & ~go_left, mid, lo), np.where(deep & go_left, mid, hi)
            best = np.maximum(best, self._tag[node])
        return best


def pick_known(times: np.ndarray, t0: np.ndarray, t1: np.ndarray, known: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Index of the attribute row for each time, or -1. ``t1`` is exclusive; all in microseconds.

    The rows must be ordered by (known, t0, -id): of rows known at the same moment the later start
    wins, then the smaller id.
    """
    if not len(t0):
        return np.full(len(times), -1, "i8")
    bounds = np.unique(np.concatenate([t0, t1]))
    tree = PersistentTree(np.searchsorted(bounds, t0), np.searchsorted(bounds, t1), len(bounds))
    leaf = np.searchsorted(bounds, times, side="right") - 1
    version = np.searchsorted(known, times, side="right")
    out = tree.newest(version, np.maximum(leaf, 0))
    return np.where(leaf < 0, -1, out)


OPEN = np.iinfo("i8").max


def as_known(
    events: DataFrame, attrs: DataFrame, event_id: str, event_entity: str, event_time: str, attr_id: str, attr_entity: str, valid_from: str, valid_to: str, known_at: str, shard_rows: int = 200_000
) -> DataFrame:
    """``(event_id bigint, attr_id bigint)``: for each event the attribute row valid at its time as known then.

    A row is valid while ``valid_from <= time < valid_to`` (null end: no limit) and known from
    ``known_at`` on (null: never). Of several, the one known last; then the later start, then the smaller
    id. Events without entity or time, and events without such a row, are left out. Repeated rows of
    either side count once. Entities are compared without case and surrounding blanks.

    Events of one entity are spread over shards of about ``shard_rows`` by a hash of their id; the
    entity's attribute rows go to each of its shards and the trees are built there.
    """
    ev = events.select(F.col(event_id).cast("bigint").alias("id"), code(event_entity).alias("entity"), micros(event_time).alias("t")).where("id is not null and entity is not null and t is not null")
    at = attrs.select(F.col(attr_id).cast("bigint").alias("aid"), code(attr_entity).alias("entity"), micros(valid_from).alias("t0"), F.coalesce(micros(valid_to), F.lit(OPEN)).alias("t1"), micros(known_at).alias("known"))
    at = at.where("aid is not null and entity is not null and t0 is not null and known is not null and t0 < t1").dropDuplicates(["aid"])
    shards = small_side(ev.groupBy("entity").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards")), "shards")
    ev = ev.join(shards, "entity").select("id", "entity", "t", F.pmod(F.xxhash64("id"), F.col("shards").cast("bigint")).cast("int").alias("shard"))
    at = at.join(shards, "entity").select("aid", "entity", "t0", "t1", "known", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"event_id": np.array([], "i8"), "attr_id": np.array([], "i8")})
        ids, first = np.unique(left["id"].to_numpy(), return_index=True)
        times = left["t"].to_numpy()[first]
        right = right.assign(back=-right["aid"]).sort_values(["known", "t0", "back"], kind="stable")
        aid = right["aid"].to_numpy()
        got = pick_known(times, right["t0"].to_numpy(), right["t1"].to_numpy(), right["known"].to_numpy(), aid)
        hit = got >= 0
        return pd.DataFrame({"event_id": ids[hit], "attr_id": aid[got[hit]]})

    return ev.groupBy("entity", "shard").cogroup(at.groupBy("entity", "shard")).applyInPandas(kernel, "event_id bigint, attr_id bigint")


def first_epoch(times: np.ndarray, t0: np.ndarray, t1: np.ndarray) -> np.ndarray:
    """Index of the first row with ``t0 < time < t1``, or -1."""
    if not len(t0):
        return np.full(len(times), -1, "i8")
    bounds = np.unique(np.concatenate([t0, t1]))
    # leaves: every bound by itself and every gap between two bounds
    first = np.full(2 * len(bounds) + 1, -1, "i8")
    a, b = np.searchsorted(bounds, t0), np.searchsorted(bounds, t1)
    for k in range(len(t0) - 1, -1, -1):
        first[2 * a[k] + 2 : 2 * b[k] + 1] = k
    at = np.searchsorted(bounds, times, side="right")
    on = (at > 0) & (bounds[np.maximum(at, 1) - 1] == times)
    return first[np.where(on, 2 * at - 1, 2 * at)]


def epoch_lookup(events: DataFrame, epochs: DataFrame, event_id: str, event_entity: str, event_time: str, epoch_id: str, epoch_entity: str, valid_from: str, valid_to: str, shard_rows: int = 200_000) -> DataFrame:
    """``(event_id, epoch_id, matched boolean)``: the first epoch by id whose open interval holds the event's time.

    Where none does, the entity's last epoch by id is used and ``matched`` is false. Null bounds are open. Events
    without entity or time, and of entities without epochs, are left out; repeated rows count once.
    """
    ev = events.select(F.col(event_id).cast("bigint").alias("id"), code(event_entity).alias("entity"), micros(event_time).alias("t")).where("id is not null and entity is not null and t is not null")
    at = epochs.select(F.col(epoch_id).cast("bigint").alias("eid"), code(epoch_entity).alias("entity"), F.coalesce(micros(valid_from), F.lit(-OPEN)).alias("t0"), F.coalesce(micros(valid_to), F.lit(OPEN)).alias("t1"))
    at = at.where("eid is not null and entity is not null").dropDuplicates(["eid"])
    shards = small_side(ev.groupBy("entity").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards")), "shards")
    ev = ev.join(shards, "entity").select("id", "entity", "t", F.pmod(F.xxhash64("id"), F.col("shards").cast("bigint")).cast("int").alias("shard"))
    at = at.join(shards, "entity").select("eid", "entity", "t0", "t1", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"event_id": np.array([], "i8"), "epoch_id": np.array([], "i8"), "matched": np.array([], bool)})
        ids, first = np.unique(left["id"].to_numpy(), return_index=True)
        right = right.sort_values("eid")
        proper = (right["t0"] < right["t1"]).to_numpy()
        eid = right["eid"].to_numpy()
        got = first_epoch(left["t"].to_numpy()[first], right["t0"].to_numpy()[proper], right["t1"].to_numpy()[proper])
        return pd.DataFrame({"event_id": ids, "epoch_id": np.where(got >= 0, np.append(eid[proper], 0)[got], eid[-1]), "matched": got >= 0})

    return ev.groupBy("entity", "shard").cogroup(at.groupBy("entity", "shard")).applyInPandas(kernel, "event_id bigint, epoch_id bigint, matched boolean")
