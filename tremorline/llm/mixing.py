"""Mixing sources to target shares: soft domain membership and a distributed least-squares fit.

A naive Bayes classifier on token counts, trained on a bounded sample of labelled documents, gives
every document a posterior over the domains (the sources that a mix names, and all others). Each
document of a named source has a rate, its expected uses between 0 and the cap. Projected gradient
steps change the rates until the expected token totals of the domains, each document counted by its
posterior, are as close to the targets as least squares can bring them; the projection keeps every
rate within its bounds and every source's own tokens at its target, or at all it has. So the labels
say how much of a source is taken, and the fit says which of its documents.

Documents of one source and alike posteriors have one rate. The fit works on those cells, whose token
and posterior sums are exact and are summed over all documents once; a step is one job over the cells,
grouped by source. Rates become whole uses by carrying the rounding error from document to document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorline.functions.geo import code
from tremorline.llm.tokens import VOCABULARY, encoder
from tremorline.session import cut, small_side

#: Token ids are counted modulo this many buckets.
BUCKETS = 4096
#: A cell: the two likeliest domains and this many levels of each of their probabilities.
LEVELS = 8
#: The targets are parameters: more rows, or more sources named by them, are refused.
MOST_ROWS, MOST_SOURCES = 10_000, 100
#: Step lengths that one job tries.
LENGTHS = (1.0, 0.5, 0.25, 0.1)


@dataclass(frozen=True)
class MixOptions:
    """``sample_docs``: bound of the labelled sample for the classifier. ``ridge``: how much plain equal rates are preferred.

    A fit that has not settled to ``tolerance`` (as a share of the mix) after ``rounds`` steps raises.
    """

    vocabulary: str = VOCABULARY
    sample_docs: int = 20_000
    ridge: float = 1e-2
    tolerance: float = 1e-3
    rounds: int = 60
    shard_docs: int = 20_000


@dataclass
class Domains:
    """The named labels in order (one more domain stands for all others), and the trained weights."""

    labels: list[str]
    logp: np.ndarray
    prior: np.ndarray

    def posterior(self, ids: np.ndarray) -> np.ndarray:
        """Softened by the length, so that long texts keep more than one domain."""
        score = self.prior + self.logp[:, ids % BUCKETS].sum(axis=1) / max(1.0, len(ids)) ** 0.5
        p = np.exp(score - score.max())
        return p / p.sum()


def train_domains(docs: DataFrame, labels: list[str], options: MixOptions) -> Domains:
    """Train on at most about ``sample_docs`` labelled documents, chosen by a hash of their id."""
    labelled = docs.where("label is not null and text is not null")
    at = {label: k for k, label in enumerate(labels)}
    domain = F.when(F.col("label").isin(labels), F.col("label"))  # null: another source
    sizes = {r[0]: r[1] for r in labelled.groupBy(domain.alias("domain")).count().collect()}
    total = sum(sizes.values())
    share = min(1.0, options.sample_docs / max(1, total))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 53)) / float(1 << 53)
    sample = labelled.where(draw < share) if share < 1 else labelled
    path, width = options.vocabulary, len(labels) + 1

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((width, BUCKETS))
        for pdf in batches:
            for label, text in zip(pdf["label"], pdf["text"], strict=True):
                ids = np.asarray(encoder(path).encode_ordinary(text), "i8") % BUCKETS
                counts[at.get(label, width - 1)] += np.bincount(ids, minlength=BUCKETS)
        k, b = np.nonzero(counts)
        yield pd.DataFrame({"k": k.astype("i4"), "b": b.astype("i4"), "n": counts[k, b]})

    counts = np.ones((width, BUCKETS)) * 0.5
    sums = sample.select("label", "text").mapInPandas(kernel, "k int, b int, n double").groupBy("k", "b").agg(F.sum("n").alias("n"))
    for k, b, n in sums.groupBy("k").agg(F.collect_list("b"), F.collect_list("n")).collect():  # a row per domain
        counts[k, b] += n
    prior = np.log(np.array([sizes.get(x, 0) + 1.0 for x in (*labels, None)]) / (total + width))
    return Domains(labels, np.log(counts / counts.sum(axis=1, keepdims=True)), prior)


def score_documents(docs: DataFrame, domains: Domains, options: MixOptions) -> DataFrame:
    """``doc_id, label, n_tokens, bin, p array<double>``: sizes, cells and domain posteriors of all documents with a text."""
    path, width = options.vocabulary, len(domains.labels) + 1

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path).encode_ordinary
        for pdf in batches:
            n, p = np.zeros(len(pdf), "i8"), np.zeros((len(pdf), width))
            for i, text in enumerate(pdf["text"]):
                ids = np.asarray(encode(text), "i8")
                n[i], p[i] = len(ids), domains.posterior(ids)
            order = np.argsort(-p, axis=1, kind="stable")
            top = [order[:, min(j, width - 1)] for j in (0, 1)]
            level = [np.minimum(p[np.arange(len(p)), t] * LEVELS, LEVELS - 1).astype("i8") for t in top]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "n_tokens": n, "bin": ((top[0] * width + top[1]) * LEVELS + level[0]) * LEVELS + level[1], "p": pd.Series(list(p[:, :-1]), dtype=object)})

    return docs.where("text is not null").mapInPandas(kernel, "doc_id bigint, label string, n_tokens bigint, bin bigint, p array<double>")


@dataclass
class Mixes:
    """All mixes at once, by ``[mix, label]``: caps, tokens wanted, and tokens to take (no more than there are)."""

    labels: list[str]
    size: np.ndarray
    cap: np.ndarray
    goal: np.ndarray

    def take(self) -> np.ndarray:
        return np.minimum(self.goal, self.cap * self.size)

    def rates(self, k: int, n: np.ndarray, p: np.ndarray, i: int, pull: np.ndarray) -> np.ndarray:
        """Rates in mix ``i`` of the cells of label ``k`` (tokens ``n``, mean posteriors ``p``): the equal rate moved by ``p @ pull``,
        then projected to rates within 0 and the cap that take the label's tokens."""
        cap, take = self.cap[i, k], self.take()[i, k]
        if take <= 0:
            return np.zeros(len(n))
        z = take / self.size[k] + p @ pull
        low, high = z.min() - cap, z.max()
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if n @ np.clip(z - mid, 0.0, cap) > take else (low, mid)
        return np.clip(z - (low + high) / 2, 0.0, cap)


def _evaluate(cells: DataFrame, mixes: Mixes, pulls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ``pulls [try, mix, domain]`` the expected domain tokens ``[try, mix, domain]`` and their change with the pull ``[.., domain, domain]``."""
    at, (t, m, k) = {x: j for j, x in enumerate(mixes.labels)}, pulls.shape

    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n, mass = pdf["n"].to_numpy("f8"), np.stack(pdf["mass"].to_list()).astype("f8")
        p, own = mass / n[:, None], at[key[0]]
        out = np.zeros((t, m, k * (1 + k)))
        for j in range(t):
            for i in range(m):
                x = mixes.rates(own, n, p, i, pulls[j, i])
                free = (x > 1e-9) & (x < mixes.cap[i, own] - 1e-9)
                out[j, i, :k] = x @ mass
                if free.any():
                    centred = p[free] - np.average(p[free], axis=0, weights=n[free])
                    out[j, i, k:] = ((centred * n[free][:, None]).T @ centred).ravel()
        return pd.DataFrame({"v": [out.ravel()]})

    sums = cells.groupBy("label").applyInPandas(kernel, "v array<double>").select(F.posexplode("v")).groupBy("pos").agg(F.sum("col"))
    flat = np.zeros(t * m * k * (1 + k))
    for pos, v in sums.collect():
        flat[pos] = v
    flat = flat.reshape(t, m, k * (1 + k))
    return flat[..., :k], flat[..., k:].reshape(t, m, k, k)


def fit_pulls(cells: DataFrame, mixes: Mixes, options: MixOptions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``pull [mix, domain]`` at the least squares, and the expected domain tokens there and at equal rates.

    The gradient of the squared error with regard to a document's rate is its posterior times the errors of the domains, so
    the sum of all steps is one pull per domain. A step is the gradient scaled by the inverse of its change.
    """
    m, k = mixes.cap.shape
    pull = np.zeros((m, k))
    if not (m and k):
        return pull, pull, pull
    scale = np.maximum(mixes.goal.sum(axis=1), 1.0)[:, None]
    got, change = (x[0] for x in _evaluate(cells, mixes, pull[None]))
    equal = got
    ridge = np.maximum(options.ridge * np.trace(change, axis1=1, axis2=2)[:, None] / scale / k, 1e-9)
    error = (mixes.goal - got) / scale - ridge * pull
    for _ in range(options.rounds):
        if np.abs(error).max() <= options.tolerance:
            return pull, got, equal
        step = np.linalg.solve(change / scale[..., None] + ridge[..., None] * np.eye(k), error[..., None])[..., 0]
        tries = np.stack([pull + a * step for a in LENGTHS])
        gots, changes = _evaluate(cells, mixes, tries)
        errors = (mixes.goal - gots) / scale - ridge * tries
        best = np.square(errors).sum(axis=2).argmin(axis=0)
        pull, got, change, error = (x[best, np.arange(m)] for x in (tries, gots, changes, errors))
    raise RuntimeError(f"the fit still moves by {np.abs(error).max():.2g} of a mix after {options.rounds} steps")


def whole_uses(x: np.ndarray, n: np.ndarray, cap: int) -> np.ndarray:
    """Whole uses (0 to ``cap``) of documents of ``n`` tokens, long ones first, whose tokens together come to those of the rates ``x``.

    Each document takes its rate rounded down or up, whichever brings the tokens so far closer to where they should be. What is left
    at the end is made up by the longest documents that fit it.
    """
    uses, over = np.zeros(len(x), "i8"), 0.0
    for d, (rate, size) in enumerate(zip(x.tolist(), n.tolist(), strict=True)):
        u = min(max(round(rate - over / size), int(rate)), min(cap, int(np.ceil(rate))))
        uses[d] = u
        over += (u - rate) * size
    for d, size in enumerate(n.tolist()):
        if abs(over) > size / 2:
            more = min(max(round(-over / size), -uses[d]), cap - uses[d])
            uses[d] += more
            over += more * size
    return uses


def mix_documents(docs: DataFrame, targets: DataFrame, options: MixOptions = MixOptions()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """``(uses, shares)`` for documents ``(doc_id, text, source)`` and targets ``(mix_id, source, target_share, max_uses, total_ratio)``.

    ``uses``: ``mix_id, doc_id, source, n_tokens, uses``, one row per document that a mix takes, 1 to
    ``max_uses`` times. ``shares``: one row per row of ``targets`` with ``target_tokens``,
    ``source_tokens``, ``capacity_tokens`` (all uses), ``feasible``, ``fitted_tokens`` (by the rates), ``actual_tokens``, ``actual_share`` (of the mix's
    intended size), ``reached_share`` (of the size it reached), and ``expected_tokens`` and ``expected_equal``: the domain's
    tokens by the posteriors, at the fitted rates and at equal rates. Sources are compared without case and surrounding blanks. Documents without source belong
    to no source but count in the size of all documents; null texts have no size. A source without
    documents, or with too few, is taken as often as allowed and its row is not feasible.
    """
    spark = docs.sparkSession
    wanted = targets.select("mix_id", "source", code("source").alias("label"), "target_share", "max_uses", "total_ratio").limit(MOST_ROWS + 1).collect()
    named = sorted({r.label for r in wanted if r.label})
    if len(wanted) > MOST_ROWS or len(named) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_ROWS} rows of targets or {MOST_SOURCES} sources")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", code("source").alias("label"))
    scored = cut(score_documents(rows, train_domains(rows, named, options), options), "scored")
    sums = scored.groupBy(F.when(F.col("label").isin(named), F.col("label")).alias("label")).agg(F.sum("n_tokens")).collect()
    by_label, total = {r[0]: float(r[1]) for r in sums}, float(sum(r[1] for r in sums))

    at, ids = {x: j for j, x in enumerate(named)}, sorted({r.mix_id for r in wanted})
    cap, share, ratio = np.zeros((len(ids), len(named))), np.zeros((len(ids), len(named))), np.zeros(len(ids))
    for r in wanted:
        i = ids.index(r.mix_id)
        ratio[i] = r.total_ratio
        if r.label:
            cap[i, at[r.label]], share[i, at[r.label]] = r.max_uses, r.target_share
    mixes = Mixes(named, np.array([by_label.get(x, 0.0) for x in named]), cap, share * ratio[:, None] * total)
    mass = F.array(*[F.sum(F.col("n_tokens") * F.get("p", F.lit(j))) for j in range(len(named))])
    cells = scored.where(F.col("label").isin(named) & (F.col("n_tokens") > 0)).groupBy("label", "bin").agg(F.sum("n_tokens").cast("double").alias("n"), mass.cast("array<double>").alias("mass"))
    cells = cut(cells, "cells")
    pull, expected, equal = fit_pulls(cells, mixes, options)

    def rate_kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n, own = pdf["n"].to_numpy("f8"), at[key[0]]
        p = np.stack(pdf["mass"].to_list()).astype("f8") / n[:, None]
        x = np.stack([mixes.rates(own, n, p, i, pull[i]) for i in range(len(ids))], axis=1) if ids else np.zeros((len(n), 0))
        return pdf[["label", "bin", "n"]].assign(x=pd.Series(list(x), index=pdf.index, dtype=object))

    rates = cut(cells.groupBy("label").applyInPandas(rate_kernel, "label string, bin bigint, n double, x array<double>"), "rates")
    tokens = rates.select("label", F.posexplode(F.transform("x", lambda x: x * F.col("n"))).alias("i", "v")).groupBy("i", "label").agg(F.sum("v"))
    fitted = {(ids[i], label): v for i, label, v in tokens.collect()}  # a number per mix and named source

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["label", "n_tokens", "doc_id"], ascending=[True, False, True], kind="stable")  # small ones make up for large ones
        x, out = np.stack(pdf["x"].to_list()), []
        for label, part in pdf.reset_index(drop=True).groupby("label", sort=True):
            n, doc = part["n_tokens"].to_numpy("i8"), part["doc_id"].to_numpy("i8")
            for i, mix in enumerate(ids):
                uses = whole_uses(x[part.index, i], n, int(cap[i, at[label]]))
                took = np.flatnonzero(uses)
                out.append(pd.DataFrame({"mix_id": mix, "doc_id": doc[took], "source": label, "n_tokens": n[took], "uses": uses[took]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["mix_id", "doc_id", "source", "n_tokens", "uses"])

    shards = max(1, round(scored.count() / options.shard_docs))
    sharded = scored.where("n_tokens > 0").join(small_side(rates.select("label", "bin", "x"), "rates"), ["label", "bin"])
    sharded = sharded.select("doc_id", "label", "n_tokens", "x", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"))
    uses = sharded.groupBy("shard").applyInPandas(lambda pdf: kernel(pdf.drop(columns="shard")), "mix_id int, doc_id bigint, source string, n_tokens bigint, uses int")
    uses = cut(uses, "uses")
    got = {(r[0], r[1]): int(r[2]) for r in uses.groupBy("mix_id", "source").agg(F.sum(F.col("uses") * F.col("n_tokens"))).collect()}
    reached: dict[int, int] = {}
    for (mix, _), n in got.items():
        reached[mix] = reached.get(mix, 0) + n
    report = []
    for r in wanted:
        size, own, i = float(r.total_ratio) * total, by_label.get(r.label, 0.0) if r.label else 0.0, ids.index(r.mix_id)
        actual, goal, most = got.get((r.mix_id, r.label), 0), float(r.target_share * size), float(r.max_uses * own)
        soft = [float(v[i, at[r.label]]) if r.label else 0.0 for v in (expected, equal)]
        by_rates = float(fitted.get((r.mix_id, r.label), 0.0))
        short = by_rates < goal * (1 - 1e-6) and most < goal  # what the rates could not take is not there
        report.append((r.mix_id, r.source, r.target_share, actual / size if size else 0.0, actual / max(1, reached.get(r.mix_id, 0)), goal, own, most, by_rates, actual, *soft, r.max_uses, not short))
    kinds = "mix_id int, source string, target_share double, actual_share double, reached_share double, target_tokens double, source_tokens double, capacity_tokens double, fitted_tokens double, actual_tokens bigint, expected_tokens double, expected_equal double, max_uses int, feasible boolean"
    return uses, spark.createDataFrame(report, kinds)
