"""Items packed into containers of fixed capacity: minimum bin slack on multisets of lengths.

Items are spread over shards by a hash. In a shard the largest remaining item opens a container, and
a subset-sum over the remaining lengths (one bit per reachable sum, lengths with their counts)
finds the multiset that fills the rest as closely as possible. The chosen counts are traced back,
and the same filling is repeated while its items last. Shards have some ten thousand items, so that
what the last container of each leaves open does not weigh.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorline.session import spread


def best_filling(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """The multiset of ``lengths`` (ascending, each at most ``counts`` times) whose sum is closest to ``room`` from below."""
    reach, mask, goal, steps = 1, (1 << (room + 1)) - 1, 1 << room, []
    for k in range(bisect_right(lengths, room) - 1, -1, -1):
        length, left, take = lengths[k], min(counts[lengths[k]], room // lengths[k]), 1
        while left > 0 and not reach & goal:
            take = min(take, left)
            wider = reach | (reach << take * length) & mask
            if wider != reach:
                steps.append((length, take, reach))
                reach = wider
            left -= take
            take *= 2
        if reach & goal:
            break
    at, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= take * length
    return used


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of every item; each size is in ``0..capacity``. Items of size 0 go to container 0."""
    out = np.zeros(len(sizes), "i8")
    if not len(sizes):
        return out
    order = np.argsort(sizes, kind="stable")
    values, first = np.unique(sizes[order], return_index=True)
    stacks = {int(v): part.tolist() for v, part in zip(values, np.split(order, first[1:]), strict=True) if v > 0}
    counts = {v: len(s) for v, s in stacks.items()}
    lengths: list[int] = []
    for v in counts:
        insort(lengths, v)
    n = 0
    while lengths:
        seed = lengths[-1]
        counts[seed] -= 1
        used = best_filling(counts, lengths, capacity - seed) if seed < capacity else {}
        counts[seed] += 1
        used[seed] = used.get(seed, 0) + 1
        repeat = min(counts[v] // c for v, c in used.items())
        for _ in range(repeat):
            for v, c in used.items():
                for _ in range(c):
                    out[stacks[v].pop()] = n
            n += 1
        for v, c in used.items():
            counts[v] -= c * repeat
            if not counts[v]:
                lengths.pop(bisect_right(lengths, v) - 1)
    return out


def pack_items(items: DataFrame, specs: list[tuple[int, int]], shard_items: int = 25_000) -> DataFrame:
    """Assign ``items (doc_id bigint, n_tokens bigint)`` to containers of each ``(spec_id, capacity)``.

    ``spec_id int, container_id bigint, doc_id bigint, piece int, token_start bigint, n_tokens bigint``.
    An item longer than the capacity is cut into whole containers and a rest, at token positions
    ``token_start``; no other item is cut. Items without tokens share a container with others. Equal
    items are different items; no specs or no items give no rows.
    """
    if not specs:
        return items.sparkSession.createDataFrame([], "spec_id int, container_id bigint, doc_id bigint, piece int, token_start bigint, n_tokens bigint")
    each = F.array(*[F.struct(F.lit(s).cast("int").alias("spec_id"), F.lit(c).cast("bigint").alias("capacity")) for s, c in specs])
    rows = items.withColumn("s", F.explode(each)).select("doc_id", F.col("n_tokens").alias("total"), "s.spec_id", "s.capacity")
    last = F.greatest(F.ceil(F.col("total") / F.col("capacity")) - 1, F.lit(0)).cast("int")
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), last))).withColumn("token_start", F.col("piece") * F.col("capacity"))
    pieces = pieces.withColumn("n_tokens", F.least(F.col("capacity"), F.col("total") - F.col("token_start")))
    n = {r[0]: r[1] for r in rows.groupBy("spec_id").agg(F.sum(F.greatest(F.ceil(F.col("total") / F.col("capacity")), F.lit(1)))).collect()}
    shards = F.create_map(*[F.lit(x) for s, _ in specs for x in (s, max(1, round(n.get(s, 0) / shard_items)))])
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), shards[F.col("spec_id")].cast("bigint")))

    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece"], kind="stable")
        container = pack(pdf["n_tokens"].to_numpy(), int(pdf["capacity"].iloc[0]))
        return pdf.assign(container_id=container + (int(key[1]) << 32))[["spec_id", "container_id", "doc_id", "piece", "token_start", "n_tokens"]]

    return spread(pieces, "spec_id", "shard").groupBy("spec_id", "shard").applyInPandas(kernel, "spec_id int, container_id bigint, doc_id bigint, piece int, token_start bigint, n_tokens bigint")


def fill_report(packed: DataFrame, specs: list[tuple[int, int]]) -> DataFrame:
    """Per spec: containers, tokens, unused tokens and the share of the space that is used."""
    sums = packed.groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("used")).groupBy("spec_id").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"))
    capacity = F.create_map(*[F.lit(x) for s, c in specs for x in (s, c)])[F.col("spec_id")]
    return sums.withColumn("unused", F.col("containers") * capacity - F.col("tokens")).withColumn("fill", F.col("tokens") / (F.col("containers") * capacity))
