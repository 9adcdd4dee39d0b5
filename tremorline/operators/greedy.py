"""Greedy selections along time. They are sequential, but only within islands: what lies beyond a gap of the
selection's own reach cannot influence it. Islands are kept whole and grouped by the time they start."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorline.operators.ordered import time_islands

#: Islands that start within this time are handled together.
MONTH = 30 * 86_400_000_000


def refractory(t: np.ndarray, gap: int) -> np.ndarray:
    """Which of the ascending times are taken, if each taken one blocks all others less than ``gap`` later."""
    out, at = np.zeros(len(t), bool), 0
    while at < len(t):
        out[at] = True
        at = int(np.searchsorted(t, t[at] + gap, side="left"))
    return out


def gap_selection(df: DataFrame, keys: Sequence[str], time: str, tie: str, gap: int) -> DataFrame:
    """Keys, ``tie`` and ``time`` of the rows taken in order of time. Rows without time are left out."""
    rows = time_islands(df.select(*keys, time, tie), keys, time, tie, gap)
    rows = rows.withColumn("_part", F.floor(F.col("island") / MONTH))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([time, tie], kind="stable")
        return pdf[refractory(pdf[time].to_numpy("i8"), gap)][[*keys, time, tie]]

    schema = ", ".join(f"{n} {dict(df.dtypes)[n]}" for n in (*keys, time, tie))
    return rows.groupBy(*keys, "_part").applyInPandas(kernel, schema)


def clusters(pdf: pd.DataFrame, within: int, most: int) -> pd.DataFrame:
    """Clusters of the detections of whole islands; rows as in ``cluster_detections``."""
    pdf = pdf.sort_values("det_id", kind="stable")
    ids, ot, cc = (pdf[c].to_numpy() for c in ("det_id", "ot", "cc"))
    own = np.abs(pdf["temp_ot"].fillna(-(1 << 62)).to_numpy("i8") - ot) <= within
    n_picks = pdf["n_picks"].fillna(0).to_numpy()
    left, out = np.ones(len(pdf), bool), []
    order = np.argsort(ot, kind="stable")
    sorted_ot = ot[order]
    for seed in range(len(pdf)):
        if not left[seed]:
            continue
        lo, hi = np.searchsorted(sorted_ot, [ot[seed] - within + 1, ot[seed] + within])
        member = np.sort(order[lo:hi])
        member = member[left[member]]
        left[member] = False
        mine = own[member]
        event = member[np.argmax(np.where(mine, n_picks[member], -1))] if mine.any() else member[np.argmax(cc[member])]
        link = member[~mine] if mine.any() else member
        if len(link) > most:  # the cap, ties with its last one kept
            link = link[cc[link] >= np.partition(cc[link], -most)[-most]]
        out.append((int(ids[seed]), int(ids[event]), bool(mine.any()), len(member), len(link), int(ot[event]), ids[link].tolist()))
    return pd.DataFrame(out, columns=["seed", "event", "is_self", "members", "links", "ot", "linked"])


CLUSTER = "seed bigint, event bigint, is_self boolean, members int, links int, ot bigint, linked array<bigint>"


def linked_clusters(dets: DataFrame, within: int, most_links: int = 30) -> DataFrame:
    """As ``cluster_detections``, with the detections that each cluster keeps as links (``linked``)."""
    rows = time_islands(dets.where("ot is not null"), [], "ot", "det_id", within).withColumn("_part", F.floor(F.col("island") / (MONTH // 30)))
    return rows.groupBy("_part").applyInPandas(lambda pdf: clusters(pdf, within, most_links), CLUSTER)


def cluster_detections(dets: DataFrame, within: int, most_links: int = 30) -> DataFrame:
    """``seed, event, is_self, members, links, ot``: clusters of detections less than ``within`` from their first remaining one.

    ``dets`` has ``det_id, ot, cc, temp_ot, n_picks``; the order is by ``det_id``. A detection within ``within`` of its
    own template's time is a self detection: the one with most picks is the event and none of them is a link; else
    the one with the greatest ``cc`` is. Links keep the ``most_links``-th greatest ``cc`` and its ties.
    """
    return linked_clusters(dets, within, most_links).drop("linked")
