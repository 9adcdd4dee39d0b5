"""Group identifiers from pairwise links: union-find on a two-dimensional grid of edge blocks.

A round hashes the vertices into blocks; every pair of blocks is one cell of edges, and a union-find
runs on each cell by itself. A vertex then has one representative from each cell of its row and
column. These are exchanged: the vertex hangs on the first of them, and the others become links to
the first, which are the edges of the next round, among representatives only. When no such link is
left the parents are stable, and the chain of parents is resolved from the last round back.

Vertices are compared by a scrambled id, so that long chains in order of their ids shrink as fast as
others. A vertex with very many links has them spread over all cells of its row and column, and a cell that
still holds far more edges than others is divided by a hash of the edge: any division of the edges is as good,
since the representatives are exchanged in the same way. Chains of parents are followed with hot parents apart.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorline.session import cut, join_hot, small_side, spread


def scramble(c: Column) -> Column:
    """A reversible mixing of a bigint by shifts and exclusive ors only."""
    for _ in range(3):
        c = c.bitwiseXOR(F.shiftleft(c, 13))
        c = c.bitwiseXOR(F.shiftrightunsigned(c, 7))
        c = c.bitwiseXOR(F.shiftleft(c, 17))
    return c


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of the edges ``a - b`` and for each the smallest vertex it is linked to."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    parent = np.arange(len(names))
    while True:
        pu, pv = parent[u], parent[v]
        open_ = pu != pv
        if not open_.any():
            return names, names[parent]
        u, v, pu, pv = u[open_], v[open_], pu[open_], pv[open_]
        np.minimum.at(parent, np.maximum(pu, pv), np.minimum(pu, pv))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def _cell_roots(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    v, r = local_roots(pdf["a"].to_numpy(), pdf["b"].to_numpy())
    return pd.DataFrame({"v": v, "r": r})


def _divide(cells: DataFrame, edges: int, cell_edges: int) -> DataFrame:
    """``i, j, part, a, b``: cells of more than ``2 * cell_edges`` edges in parts of about ``cell_edges``."""
    cells = cells.select("i", "j", "a", "b")
    if edges <= 2 * cell_edges:
        return cells.withColumn("part", F.lit(0))
    full = cells.groupBy("i", "j").agg(F.count("*").alias("n")).where(F.col("n") > 2 * cell_edges)
    full = small_side(full.select("i", "j", F.ceil(F.col("n") / cell_edges).alias("parts")), "cells")
    part = F.pmod(F.xxhash64("a", "b"), F.coalesce("parts", F.lit(1).cast("bigint"))).cast("int")
    return cells.join(full, ["i", "j"], "left").select("i", "j", part.alias("part"), "a", "b")


def group_ids(pairs: DataFrame, a: str, b: str, missing: int | None = None, cell_edges: int = 250_000, least_blocks: int = 4) -> DataFrame:
    """``(id bigint, group_id bigint)``: every id of the pairs and the smallest id it is linked to, directly or not.

    A null or ``missing`` id is none; a row with one id names it without a link, and so does a row that
    links an id with itself. Order and number of repeated pairs do not matter. An empty table gives no
    rows. The first round has at least ``least_blocks`` blocks; the number of cells follows the edges, about
    ``cell_edges`` each.
    """
    present = lambda c: F.when(c != missing, c) if missing is not None else c
    raw = pairs.select(present(F.col(a).cast("bigint")).alias("x"), present(F.col(b).cast("bigint")).alias("y"))
    both = raw.where("x is not null and y is not null and x <> y").select(scramble(F.col("x")).alias("x"), scramble(F.col("y")).alias("y"))
    edges = cut(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    n, rounds = edges.count(), []
    while n:
        blocks = max(1 if rounds else least_blocks, math.ceil(math.sqrt(2 * n / cell_edges)))
        block = lambda c: F.pmod(F.xxhash64(c, F.lit(len(rounds))), F.lit(blocks)).cast("int")  # noqa: B023, E731
        cells = edges.withColumn("i", F.least(block("a"), block("b"))).withColumn("j", F.greatest(block("a"), block("b")))
        cells = _divide(cells, n, cell_edges)
        roots = spread(cells, "i", "j", "part").groupBy("i", "j", "part").applyInPandas(_cell_roots, "v bigint, r bigint")
        # at most one representative per cell of the vertex's row and column
        state = cut(roots.groupBy("v").agg(F.min("r").alias("p"), F.collect_set("r").alias("rs")), f"parents{len(rounds)}")
        rounds.append(state.where(~F.array_contains("rs", F.col("v"))).select("v", "p"))
        n = state.agg(F.sum(F.size("rs") - 1)).first()[0] or 0
        links = state.where(F.size("rs") > 1).select("p", F.explode("rs").alias("r")).where("p <> r")
        edges = links.select(F.least("p", "r").alias("a"), F.greatest("p", "r").alias("b")).distinct()

    ids = raw.select(F.explode(F.array("x", "y")).alias("id")).where("id is not null").distinct().withColumn("v", scramble(F.col("id")))
    if not rounds:
        return ids.select("id", F.col("id").alias("group_id"))
    top = rounds[-1].select("v", F.col("p").alias("root"))
    for k, own in enumerate(reversed(rounds[:-1])):
        up = join_hot(own, top.select(F.col("v").alias("p"), "root"), "p", "left").select("v", F.coalesce("root", "p").alias("root"))
        top = up.unionByName(top)
        if k % 4 == 3:
            top = cut(top, "resolved")
    labelled = cut(ids.join(top, "v", "left").select("id", F.coalesce("root", "v").alias("root")), "labelled")
    groups = labelled.groupBy("root").agg(F.min("id").alias("group_id"))
    return join_hot(labelled, groups, "root").select("id", "group_id")
