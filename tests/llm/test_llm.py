"""Operators of problems 2, 6, 7, 8 and 9 against brute force on small, random and dirty tables."""

from __future__ import annotations

import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorline.llm import queries, survivors
from tremorline.llm.components import _divide, group_ids, local_roots
from tremorline.llm.mixing import MixOptions, mix_documents, whole_uses
from tremorline.llm.packing import best_filling, fill_report, pack, pack_items
from tremorline.llm.spans import GEAR, MIN_CHARS, SPREAD, chunks, code_points, gear_hash, shared_spans, window_hashes
from tremorline.llm.survivors import FieldRule, claims_of, truth_discovery, votes_of, winners_of
from tremorline.llm.tokens import count_tokens, encoder

# ---------------------------------------------------------------- problem 2


def brute_groups(pairs):
    parent: dict = {}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in pairs:
        for v in (a, b):
            if v is not None and v != -1:
                parent.setdefault(v, v)
        if None not in (a, b) and -1 not in (a, b):
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {v: find(v) for v in parent}


def test_local_roots():
    v, r = local_roots(np.array([5, 9, 2]), np.array([7, 7, 1]))
    assert dict(zip(v.tolist(), r.tolist(), strict=True)) == {5: 5, 7: 5, 9: 5, 1: 1, 2: 1}


@pytest.mark.parametrize("cell_edges", [250_000, 20])
def test_groups(spark, cell_edges):
    rng = random.Random(cell_edges)
    chain = [(i, i + 1) for i in range(1000, 1200)]
    star = [(5000, 5000 + k) for k in range(1, 150)]
    noise = [(rng.randrange(1, 300), rng.randrange(1, 300)) for _ in range(120)]
    dirty = [(None, 7000), (7001, -1), (-1, None), (7002, 7002), (2**40, 2**41), (-5, 2**40)]
    rows = chain + [(b, a) for a, b in chain[:50]] + star + noise + dirty
    rng.shuffle(rows)
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "x bigint, y bigint, id int")
    got = group_ids(df, "x", "y", missing=-1, cell_edges=cell_edges).collect()
    assert {r.id: r.group_id for r in got} == brute_groups(rows) and len(got) == len({r.id for r in got})


def test_groups_without_links(spark):
    df = spark.createDataFrame([(1, None), (2, 2)], "x bigint, y bigint")
    assert {(r.id, r.group_id) for r in group_ids(df, "x", "y").collect()} == {(1, 1), (2, 2)}
    assert group_ids(df.limit(0), "x", "y").count() == 0


def test_star_is_divided(spark):
    """A hub with most links: its cells are divided into parts of bounded size, and the group is still one."""
    df = spark.createDataFrame([(7, 100 + i) for i in range(3000)] + [(5000 + i, 5001 + i) for i in range(0, 60, 2)], "x bigint, y bigint")
    got = {r.id: r.group_id for r in group_ids(df, "x", "y", cell_edges=60).collect()}
    assert {got[100 + i] for i in range(3000)} == {7} and got[5001] == 5000 and len(got) == 3061
    cells = spark.range(2000).select(F.lit(0).alias("i"), (F.col("id") % 20 == 0).cast("int").alias("j"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    sizes = {(r.j, r.part): r["count"] for r in _divide(cells, 2000, 100).groupBy("i", "j", "part").count().collect()}
    assert sum(sizes.values()) == 2000 and max(sizes.values()) < 200 and [p for j, p in sizes if j == 1] == [0]


# ---------------------------------------------------------------- problem 6


def test_survivors_against_rule(spark):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        rows.append((i, rng.choice([1, 2, 3, 4, None, 100 + i]), rng.choice(["s1", "s2", "s3"]), rng.choice([None, 1.0, 0.5, 0.5, rng.random(), float("nan")]), rng.choice([None, 1, 2, 3])))
    rows += rows[:20]
    df = spark.createDataFrame(rows, "m bigint, g bigint, src string, q double, age bigint")
    fields = [FieldRule("value", F.col("q"), 0.0, 1.0), FieldRule("any", F.when(F.col("q").isNotNull(), 0.0), 0.0, 1.0)]
    winners, weights = truth_discovery(claims_of(df, "g", "m", F.col("src"), F.col("age"), fields))
    got = {(r.grp, r.field): r.member for r in winners.collect()}
    want = {}
    for g in {r[1] for r in rows if r[1] is not None}:
        own = {r for r in rows if r[1] == g}
        if len({r[0] for r in own}) > 1:
            usable = [r for r in own if r[3] is not None and r[3] == r[3]]
            if usable:
                want[g, "value"] = max(usable, key=lambda r: (r[3], -1 if r[4] is None else r[4], -r[0]))[0]
            some = [r for r in own if r[3] is not None]
            if some:
                want[g, "any"] = max(some, key=lambda r: (-1 if r[4] is None else r[4], -r[0]))[0]
    assert got == want
    assert all(0 < r.weight <= 1 for r in weights.collect())


def test_reliability_follows_support(spark):
    """A source whose values are always the best of their group ends above one whose values never are."""
    rows = [(2 * g + k, g, src, q) for g in range(20) for k, (src, q) in enumerate((("good", 0.9), ("bad", 0.1)))]
    df = spark.createDataFrame(rows, "m bigint, g bigint, src string, q double")
    winners, weights = truth_discovery(claims_of(df, "g", "m", F.col("src"), F.lit(None).cast("bigint"), [FieldRule("v", F.col("q"), 0.0, 1.0)]))
    w = {r.source: r.weight for r in weights.collect()}
    assert w["good"] > 0.9 > 0.5 > w["bad"] and winners.count() == 20
    empty = claims_of(df.limit(0), "g", "m", F.col("src"), F.lit(None).cast("bigint"), [FieldRule("v", F.col("q"), 0.0, 1.0)])
    assert truth_discovery(empty)[0].count() == 0


def test_reliability_decides_survivors(spark):
    """A source that its groups contradict loses, though it votes twice; without the rounds it would win."""
    rows = [(10 * g + k, g, src, v) for g in range(20) for k, (src, v) in enumerate((("a", "right"), ("b", "right"), ("c", "wrong")))]
    rows += [(900, 99, "a", "y"), (901, 99, "c", "x"), (902, 99, "c", "x"), (902, 99, "c", "x"), (903, 99, "a", None)]
    df = spark.createDataFrame(rows, "m bigint, g bigint, src string, v string")
    rule = FieldRule("v", F.when(F.col("v").isNotNull(), 1.0), 0.0, 1.0, F.col("v"), ordered=False)
    claims = claims_of(df, "g", "m", F.col("src"), F.lit(None).cast("bigint"), [rule])
    winners, weights = truth_discovery(claims)
    plain = winners_of(votes_of(claims), weights.select("source", F.lit(1.0).alias("weight")))
    member = lambda d: {r.grp: r.member for r in d.collect()}[99]
    assert member(winners) == 900 and member(plain) == 901
    w = {r.source: r.weight for r in weights.collect()}
    assert w["b"] > 0.9 and w["c"] < 0.2
    with pytest.raises(RuntimeError):
        truth_discovery(claims, tolerance=0.0, rounds=4)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="test tables are not here")
def test_no_stage_without_effect(spark, monkeypatch):
    """``p6_found`` estimates no reliabilities, which its order could not heed, and has the winners of truth discovery; ``p6_trusted`` estimates them."""
    want = sorted(tuple(r)[:3] for r in truth_discovery(queries._claims(spark, "/root/testdata/sf0.001", ordered=True))[0].collect())

    def estimate(*_):
        raise AssertionError("estimated")

    monkeypatch.setattr(survivors, "_reliability", estimate)
    assert sorted(map(tuple, queries.p6_found(spark, "/root/testdata/sf0.001").collect())) == want
    with pytest.raises(AssertionError):
        queries.p6_trusted(spark, "/root/testdata/sf0.001")
    with pytest.raises(Exception, match="needs votes"):
        survivors.ordered_winners(queries._claims(spark, "/root/testdata/sf0.001", ordered=False)).collect()


def test_truth_discovery_against_numpy(spark):
    rng = random.Random(61)
    rows = [(i, rng.randrange(40), rng.choice("abcdef"), rng.choice(["p", "q", "r", None]), rng.choice([None, 1, 2, 3])) for i in range(300)]
    df = spark.createDataFrame(rows, "m bigint, g bigint, src string, v string, age bigint")
    rule = FieldRule("v", F.when(F.col("v").isNotNull(), 1.0), 0.0, 1.0, F.col("v"), ordered=False)
    claims = claims_of(df, "g", "m", F.col("src"), F.col("age"), [rule])
    own = claims.toPandas()
    w = dict.fromkeys("abcdef", 1.0)
    for _ in range(300):
        own["x"] = own["confidence"] * own["source"].map(w)
        own["s"] = own.groupby(["grp", "value"])["x"].transform("sum") / own.groupby("grp")["x"].transform("sum")
        w = {k: (p["s"].sum() + 0.5) / (len(p) + 1) for k, p in own.groupby("source")}
    got = {r.source: r.weight for r in truth_discovery(claims, tolerance=1e-6)[1].collect()}
    assert got.keys() == w.keys() and all(abs(got[k] - w[k]) < 1e-4 for k in w)


# ---------------------------------------------------------------- problem 7


def test_best_filling_is_optimal():
    rng = random.Random(7)
    for _ in range(200):
        counts = Counter(rng.randrange(1, 30) for _ in range(rng.randrange(0, 12)))
        room = rng.randrange(0, 80)
        used = best_filling(dict(counts), sorted(counts), room)
        sums = {0}
        for v in counts.elements():
            sums |= {s + v for s in sums}
        assert all(0 < c <= counts[v] for v, c in used.items())
        assert sum(v * c for v, c in used.items()) == max(s for s in sums if s <= room)


def test_pack_keeps_rules():
    rng = np.random.default_rng(7)
    sizes = np.minimum(rng.geometric(0.01, 3000), 512)
    box = pack(sizes, 512)
    used = np.bincount(box, weights=sizes)
    assert (used <= 512).all() and (used > 0).all()
    assert len(used) <= -(-sizes.sum() // 512) + 1  # at most one container more than the least possible
    assert pack(np.array([0, 0]), 5).tolist() == [0, 0] and len(pack(np.array([], "i8"), 5)) == 0


def test_pack_items(spark):
    lengths = [0, 1, 5, 10, 10, 11, 25, 3, 7, 30, 2, 2, 2]
    df = spark.createDataFrame(list(enumerate(lengths)), "doc_id bigint, n_tokens bigint")
    for shard_items in (25_000, 4):
        rows = pack_items(df, [(1, 10), (2, 100)], shard_items).collect()
        for spec, capacity in ((1, 10), (2, 100)):
            own = [r for r in rows if r.spec_id == spec]
            used = Counter()
            for r in own:
                used[r.container_id] += r.n_tokens
            assert max(used.values()) <= capacity
            for doc, n in enumerate(lengths):
                parts = sorted((r.piece, r.token_start, r.n_tokens) for r in own if r.doc_id == doc)
                assert sum(p[2] for p in parts) == n and len(parts) == max(1, -(-n // capacity))
                assert all(s == k * capacity and p == k for k, (p, s, _) in enumerate(parts))
    report = {r.spec_id: r for r in fill_report(pack_items(df, [(1, 10), (2, 100)]), [(1, 10), (2, 100)]).collect()}
    assert report[1].containers == 11 and report[1].unused == 2 and report[2].containers == 2
    assert pack_items(df.limit(0), [(1, 10)]).count() == 0 and pack_items(df, []).count() == 0


def test_count_tokens(spark):
    texts = ["", " ", "Hello, world", None, "é" * 1000, "a" * 50_000, "<|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in count_tokens(df, "id", "text").collect()}
    assert sorted(got) == [0, 1, 2, 4, 5, 6] and got[0] == 0
    assert encoder("/opt/tokenizers/byte_bpe_50k.tiktoken").decode(encoder("/opt/tokenizers/byte_bpe_50k.tiktoken").encode_ordinary(texts[2])) == texts[2]


# ---------------------------------------------------------------- problem 8


def words(rng, kind, n):
    return " ".join(rng.choice({"a": ["alpha", "beta", "gamma"], "b": ["one", "two", "three"]}[kind]) for _ in range(n))


def test_mix_meets_targets(spark):
    rng = random.Random(8)
    docs = [(i, words(rng, "a" if i % 3 else "b", rng.randrange(5, 60)), " A" if i % 3 else "b ", 1) for i in range(600)]
    docs += [(1000, None, "a", 1), (1001, "", "a", 1), (1002, words(rng, "a", 40), None, 1), (1003, words(rng, "b", 30), "  ", 1)]
    targets = [(1, "A", 0.5, 2, 0.5), (1, "b", 0.5, 1, 0.5), (2, "a", 0.2, 3, 1.0), (2, "B", 0.8, 1, 1.0), (2, "none", 0.1, 9, 1.0)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, label int")
    tf = spark.createDataFrame(targets, "mix_id int, source string, target_share double, max_uses int, total_ratio double")
    uses, shares = mix_documents(df, tf, MixOptions(shard_docs=200))
    rows = uses.collect()
    cap = {(m, s.strip().lower()): c for m, s, _, c, _ in targets}
    assert all(1 <= r.uses <= cap[r.mix_id, r.source.lower()] and r.n_tokens > 0 for r in rows)
    assert len({(r.mix_id, r.doc_id) for r in rows}) == len(rows) and not {1000, 1001, 1002, 1003} & {r.doc_id for r in rows}
    got = {(r.mix_id, r.source): r for r in shares.collect()}
    assert [k for k, r in got.items() if not r.feasible] == [(2, "B"), (2, "none")]
    for key, r in got.items():
        if r.feasible:
            assert abs(r.actual_share - r.target_share) < 0.01, key
        else:
            assert r.actual_tokens == r.capacity_tokens < r.target_tokens


def test_fit_chooses_documents(spark):
    """Half of the texts of a source read like the other one: equal rates miss the domains' targets, the fit meets them, and the labels' too."""
    rng = random.Random(80)
    docs = [(i, words(rng, "ab"[i % 2] if i % 4 < 2 or i % 3 else "b", rng.randrange(20, 60)), "ab"[i % 2]) for i in range(800)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    tf = spark.createDataFrame([(1, "a", 0.7, 2, 0.5), (1, "b", 0.3, 2, 0.5)], "mix_id int, source string, target_share double, max_uses int, total_ratio double")
    rows = mix_documents(df, tf)[1].collect()
    off = lambda c: sum(abs(r[c] - r.target_tokens) for r in rows)
    assert all(abs(r.actual_share - r.target_share) < 0.002 for r in rows)
    assert off("expected_tokens") < 0.2 * off("expected_equal")
    with pytest.raises(RuntimeError):
        mix_documents(df, tf, MixOptions(rounds=0, tolerance=1e-9))


def test_whole_uses():
    rng = np.random.default_rng(4)
    for _ in range(50):
        n = np.sort(rng.integers(1, 500, 30))[::-1]
        x = np.clip(rng.uniform(-0.5, 2.5, 30), 0, 2)
        uses = whole_uses(x, n, 2)
        assert uses.min() >= 0 and uses.max() <= 2
        off = (x * n).sum() - (uses * n).sum()
        free = n[uses < 2] if off > 0 else n[uses > 0]
        assert not len(free) or abs(off) <= free.min() / 2 + 1e-9  # no text that can still move would bring it closer
    # one long text with a small rate: the others make it up
    assert (whole_uses(np.array([0.33, 0.0, 0.0]), np.array([7908, 1500, 1100]), 1) * [7908, 1500, 1100]).sum() == 2600


def test_mix_without_documents(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id bigint, text string, source string")
    tf = spark.createDataFrame([(1, "a", 1.0, 2, 1.0)], "mix_id int, source string, target_share double, max_uses int, total_ratio double")
    for docs in (df, df.limit(0)):
        uses, shares = mix_documents(docs, tf)
        assert uses.count() == 0 and [r.actual_tokens for r in shares.collect()] == [0]
    assert [d.count() for d in mix_documents(df, tf.limit(0))] == [0, 0]


# ---------------------------------------------------------------- problem 9


def brute_spans(docs):
    seen: dict = {}
    for d, t in docs.items():
        for i in range(len(t or "") - MIN_CHARS + 1):
            seen.setdefault(t[i : i + MIN_CHARS], set()).add(d)
    out = []
    for d, t in docs.items():
        starts = [i for i in range(len(t or "") - MIN_CHARS + 1) if len(seen[t[i : i + MIN_CHARS]]) > 1]
        for k, i in enumerate(starts):
            if k == 0 or i > starts[k - 1] + MIN_CHARS:
                out.append([d, i, 0])
            out[-1][2] = i + MIN_CHARS
    return sorted(map(tuple, out))


def random_docs(rng, alphabet, n):
    text = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    pool = [text(rng.choice([149, 150, 151, 160, 209, 210, 300, 700])) for _ in range(12)]
    docs = {}
    for i in range(n):
        parts = [rng.choice(pool) if rng.random() < 0.5 else text(rng.randrange(0, 80)) for _ in range(rng.randrange(0, 5))]
        docs[i] = "".join(parts)
    docs |= {n: None, n + 1: "", n + 2: pool[-1][:MIN_CHARS], n + 3: pool[-1][:MIN_CHARS], n + 4: docs[0], n + 5: docs[0], n + 6: pool[0] * 3}
    return docs


@pytest.mark.parametrize(("alphabet", "hot_rows"), [("abcdefghij ", 200_000), ("ab", 200_000), ("\U0001f600é漢x", 200_000), ("abcdefghij ", 2)])
def test_spans_against_brute_force(spark, alphabet, hot_rows):
    docs = random_docs(random.Random(len(alphabet) + hot_rows), alphabet, 60)
    df = spark.createDataFrame([(k, t, 1) for k, t in docs.items()], "id bigint, text string, doc_id int")
    got = sorted((r.doc_id, r.span_start, r.span_end) for r in shared_spans(df, "id", "text", hot_rows).collect())
    assert got == brute_spans(docs)


def test_spans_of_uniform_and_long_texts(spark):
    docs = {0: "a" * 400, 1: "b" + "a" * 200, 2: "x" * 149, 3: "x" * 149, 4: "c" * 500}
    df = spark.createDataFrame(list(docs.items()), "id bigint, text string")
    assert sorted((r.doc_id, r.span_start, r.span_end) for r in shared_spans(df, "id", "text").collect()) == brute_spans(docs)
    assert shared_spans(df.limit(0), "id", "text").count() == 0


def test_every_stretch_holds_a_chunk():
    """The chunk of a window is the same wherever the window stands."""
    rng = random.Random(9)
    core = "".join(rng.choice("abcdef") for _ in range(MIN_CHARS))
    seen = set()
    for _ in range(50):
        before = "".join(rng.choice("abcdef") for _ in range(rng.randrange(200)))
        text = before + core + "".join(rng.choice("abcdef") for _ in range(rng.randrange(200)))
        doc, lo, hi, key, digest = chunks(["", text, "short"])
        own = (lo <= len(before)) & (len(before) <= hi)
        assert own.sum() == 1 and set(doc.tolist()) == {1}
        seen.add((int(digest[own][0]), int(key[own][0]) - len(before)))
    assert len(seen) == 1


def test_hashes_depend_on_their_window_only():
    cps, begin = code_points(["xyz" * 50, "q" + "xyz" * 50])
    g, w = gear_hash(cps), window_hashes(cps, 37)
    assert (g[GEAR - 1 : 150] == g[151 + GEAR - 1 :]).all() and (w[:114] == w[151 : 151 + 114]).all()
    assert MIN_CHARS - GEAR + 1 >= 2 * SPREAD and begin.tolist() == [0, 150, 301]
