"""Queries p2, p6, p7, p8 and p9 of TESTDATA.md, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorline.functions.geo import code, micros
from tremorline.llm.components import group_ids
from tremorline.llm.mixing import mix_documents
from tremorline.llm.packing import fill_report, pack_items
from tremorline.llm.spans import shared_spans
from tremorline.llm.survivors import FieldRule, claims_of, ordered_winners, truth_discovery
from tremorline.llm.tokens import count_tokens
from tremorline.session import cut, load


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_ids(load(spark, sf_dir, "dt_cc"), "evid1", "evid2", missing=-1).select(F.col("id").alias("evid"), "group_id")


def _temp_id() -> Column:
    text = F.trim("temp_id")
    return F.when((text != "") & (text != "-1"), text)


def _claims(spark: SparkSession, sf_dir: str, ordered: bool) -> DataFrame:
    """Claims of all detections. Their source is the template that made them; equal are codes, correlations to 0.01 and numbers of stations."""
    used = F.filter("picks", lambda p: p.isNotNull() & (p["dt_p"].isNotNull() | p["dt_s"].isNotNull()) & p["net_sta"].isNotNull())
    stations = F.size(F.array_distinct(F.transform(used, lambda p: code(p["net_sta"]))))
    cc = F.when((F.col("cc") > 0) & (F.col("cc") <= 1), F.col("cc"))
    fields = [
        FieldRule("temp_id", F.when(_temp_id().isNotNull(), 0.0), 0.0, 1.0, _temp_id(), ordered),
        FieldRule("cc", cc, 0.0, 1.0, F.round(cc, 2), ordered),
        FieldRule("picks", F.when(F.col("picks").isNotNull() & (stations >= 1), stations), 0.0, 16.0, stations, ordered),
    ]
    return claims_of(load(spark, sf_dir, "detections"), "clu_id", "det_id", F.coalesce(_temp_id(), F.lit("none")), micros("made_at"), fields)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winners by the order that is demanded of every field; reliabilities could not change them and are left to ``p6_trusted``."""
    winners = ordered_winners(_claims(spark, sf_dir, ordered=True))
    return winners.select(F.col("grp").alias("clu_id"), "field", F.col("member").alias("det_id"))


def p6_trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winners where no order binds: in each group and field the value with the highest support."""
    winners = truth_discovery(_claims(spark, sf_dir, ordered=False))[0]
    return winners.select(F.col("grp").alias("clu_id"), "field", F.col("member").alias("det_id"), F.round("support", 3).alias("support"))


def p6_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reliability of every template."""
    weights = truth_discovery(_claims(spark, sf_dir, ordered=False))[1]
    return weights.select(F.col("source").alias("temp_id"), F.round("weight", 2).alias("weight"))


def p6_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per group of two or more detections, its fields taken from the winners."""
    winners = cut(p6_found(spark, sf_dir), "winners")
    values = load(spark, sf_dir, "detections").select("det_id", "clu_id", "temp_id", "cc", "picks")
    own = values.join(winners, ["clu_id", "det_id"]).groupBy("clu_id")
    take = lambda f: F.any_value(F.when(F.col("field") == f, F.col(f)), True).alias(f)
    return own.agg(take("temp_id"), take("cc"), take("picks"))


def p6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The survivors in plain columns: the codes of the picks' stations as one text."""
    stations = F.concat_ws(" ", F.transform("picks", lambda p: F.coalesce(code(p["net_sta"]), F.lit("-"))))
    return p6_survivors(spark, sf_dir).select("clu_id", "temp_id", "cc", F.size("picks").alias("n_picks"), stations.alias("stations"))


def _specs(spark: SparkSession, sf_dir: str) -> list[tuple[int, int]]:
    """The container sizes are parameters; a thousand of them are the most that is accepted."""
    rows = load(spark, sf_dir, "pack_specs").where("capacity_tokens > 0").select("spec_id", "capacity_tokens").distinct().limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1000 container sizes")
    return sorted((r[0], r[1]) for r in rows)


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = cut(count_tokens(load(spark, sf_dir, "documents"), "doc_id", "text"), "tokens")
    return pack_items(counts, _specs(spark, sf_dir))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_report(p7_packed(spark, sf_dir), _specs(spark, sf_dir))


def p7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per spec the texts packed, and the violations: containers over capacity, texts with tokens lost, doubled or cut without need."""
    specs = _specs(spark, sf_dir)
    counts = cut(count_tokens(load(spark, sf_dir, "documents"), "doc_id", "text"), "tokens")
    packed = cut(pack_items(counts, specs), "packed")
    capacity = F.create_map(*[F.lit(x) for s, c in specs for x in (s, c)])[F.col("spec_id")] if specs else F.lit(0)
    over = packed.groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("used")).where(F.col("used") > capacity).groupBy("spec_id").agg(F.count("*").alias("over"))
    pieces = packed.groupBy("spec_id", "doc_id").agg(F.sum("n_tokens").alias("got"), F.count("*").alias("pieces"), F.count_distinct("token_start").alias("starts"))
    whole = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / capacity))
    broken = (F.col("got") != F.col("n_tokens")) | (F.col("pieces") != whole) | (F.col("starts") != F.col("pieces"))
    texts = pieces.join(counts, "doc_id").groupBy("spec_id").agg(F.count("*").alias("texts"), F.count_if(broken).alias("broken"))
    return texts.join(over, "spec_id", "left").select("spec_id", "texts", "broken", F.coalesce("over", F.lit(0).cast("bigint")).alias("over"))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mix_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1].where("not feasible").select("mix_id", "source")


def p8_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


def p8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target whether it can be met, and whether it was: the share to 0.01 or the tokens to half the source's mean text, each text within its cap."""
    uses, shares = _mixed(spark, sf_dir)
    most = uses.withColumn("source", F.lower("source")).groupBy("mix_id", "source").agg(F.max("uses").alias("most"), F.avg("n_tokens").alias("mean"))
    rows = shares.withColumn("source", F.lower(F.trim("source"))).join(most, ["mix_id", "source"], "left")
    near = (F.abs(F.col("actual_share") - F.col("target_share")) < 0.01) | (F.abs(F.col("actual_tokens") - F.col("target_tokens")) <= F.col("mean") / 2)
    full = F.col("actual_tokens") == F.col("capacity_tokens")
    met = F.when(F.col("feasible"), near).otherwise(full) & (F.coalesce("most", F.lit(0)) <= F.col("max_uses"))
    return rows.select("mix_id", "source", "feasible", met.alias("met"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans(load(spark, sf_dir, "documents"), "doc_id", "text")


def p9_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document with a text: its characters, how many of them are shared, and their share."""
    sums = p9_found(spark, sf_dir).groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared"))
    docs = load(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.length("text").cast("bigint").alias("chars"))
    out = docs.join(sums, "doc_id", "left").select("doc_id", "chars", F.coalesce("shared", F.lit(0).cast("bigint")).alias("shared_chars"))
    return out.withColumn("share", F.coalesce(F.try_divide("shared_chars", "chars"), F.lit(0.0)))


QUERIES = {
    "p2_found": p2_found, "p6_found": p6_found, "p6_survivors": p6_survivors, "p6_records": p6_records, "p6_trusted": p6_trusted, "p6_reliability": p6_reliability, "p7_packed": p7_packed, "p7_fill": p7_fill, "p7_rules": p7_rules,
    "p8_found": p8_found, "p8_uses": p8_uses, "p8_shares": p8_shares, "p8_rules": p8_rules, "p9_found": p9_found, "p9_shared": p9_shared,
}

P2_FOUND = """
WITH RECURSIVE e AS (
  SELECT DISTINCT evid1 AS a, evid2 AS b FROM dt_cc WHERE evid1 <> -1 AND evid2 <> -1 AND evid1 <> evid2
), d AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
v AS (SELECT DISTINCT evid1 AS evid FROM dt_cc WHERE evid1 <> -1 UNION SELECT DISTINCT evid2 FROM dt_cc WHERE evid2 <> -1),
r(evid, other) AS (SELECT evid, evid FROM v UNION SELECT r.evid, d.b FROM r JOIN d ON r.other = d.a)
SELECT evid, min(other) AS group_id FROM r GROUP BY evid"""

_P6 = """
WITH d AS (
  SELECT DISTINCT clu_id, det_id, CASE WHEN trim(temp_id) NOT IN ('', '-1') THEN trim(temp_id) END AS temp, temp_id,
    CASE WHEN cc > 0 AND cc <= 1 THEN cc END AS cc, picks, made_at,
    len(list_distinct(list_transform(list_filter(picks, lambda p: p IS NOT NULL AND (p.dt_p IS NOT NULL OR p.dt_s IS NOT NULL) AND p.net_sta IS NOT NULL), lambda p: upper(trim(p.net_sta))))) AS n
  FROM detections WHERE clu_id IS NOT NULL
), m AS (SELECT clu_id FROM d GROUP BY clu_id HAVING count(DISTINCT det_id) > 1),
c AS (
  SELECT clu_id, 'temp_id' AS field, det_id, 0.0 AS q, made_at FROM d SEMI JOIN m USING (clu_id) WHERE temp IS NOT NULL
  UNION ALL SELECT clu_id, 'cc', det_id, cc, made_at FROM d SEMI JOIN m USING (clu_id) WHERE cc IS NOT NULL
  UNION ALL SELECT clu_id, 'picks', det_id, n, made_at FROM d SEMI JOIN m USING (clu_id) WHERE n >= 1
), w AS (
  SELECT clu_id, field, det_id FROM (
    SELECT *, row_number() OVER (PARTITION BY clu_id, field ORDER BY q DESC, made_at DESC NULLS LAST, det_id) AS r FROM c) WHERE r = 1
)
"""
P6_FOUND = _P6 + "SELECT clu_id, field, det_id FROM w"
P6_RECORDS = _P6 + """
SELECT w.clu_id, max(CASE WHEN field = 'temp_id' THEN d.temp_id END) AS temp_id, max(CASE WHEN field = 'cc' THEN d.cc END) AS cc, max(CASE WHEN field = 'picks' THEN len(d.picks) END)::int AS n_picks,
  coalesce(max(CASE WHEN field = 'picks' THEN array_to_string(list_transform(d.picks, lambda p: coalesce(nullif(upper(trim(p.net_sta)), ''), '-')), ' ') END), '') AS stations
FROM w JOIN d USING (clu_id, det_id) GROUP BY w.clu_id"""

_P9 = """
WITH g AS (
  SELECT doc_id, text, unnest(range(0, length(text) - 149)) AS i FROM documents WHERE length(text) >= 150
), h AS (SELECT doc_id, i, md5(substring(text, i + 1, 150)) AS k FROM g),
s AS (SELECT k FROM h GROUP BY k HAVING min(doc_id) <> max(doc_id)),
w AS (SELECT doc_id, i FROM h SEMI JOIN s USING (k)),
o AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 150 THEN 0 ELSE 1 END AS fresh FROM w),
p AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM o),
spans AS (SELECT doc_id, min(i) AS span_start, max(i) + 150 AS span_end FROM p GROUP BY doc_id, island)
"""
P9_FOUND = _P9 + "SELECT doc_id, span_start, span_end FROM spans"
P9_SHARED = _P9 + """
SELECT d.doc_id, length(d.text) AS chars, coalesce(sum(span_end - span_start), 0)::bigint AS shared_chars,
  CASE WHEN length(d.text) > 0 THEN coalesce(sum(span_end - span_start), 0) / length(d.text) ELSE 0.0 END AS share
FROM documents d LEFT JOIN spans USING (doc_id) WHERE d.text IS NOT NULL GROUP BY d.doc_id, d.text"""

# Sizes in bytes: no case depends on the tokenizer, and one token per byte is a tokenizer too.
P8_FOUND = """
WITH d AS (SELECT nullif(upper(trim(source)), '') AS label, strlen(text) AS size FROM documents WHERE text IS NOT NULL),
s AS (SELECT label, sum(size) AS size FROM d GROUP BY label)
SELECT mix_id, source FROM mix_targets t LEFT JOIN s ON s.label = upper(trim(t.source))
WHERE max_uses * coalesce(s.size, 0) < target_share * total_ratio * (SELECT sum(size) FROM d)"""
P8_RULES = """
WITH d AS (SELECT nullif(upper(trim(source)), '') AS label, strlen(text) AS size FROM documents WHERE text IS NOT NULL),
s AS (SELECT label, sum(size) AS size FROM d GROUP BY label)
SELECT mix_id, lower(trim(t.source)) AS source, NOT max_uses * coalesce(s.size, 0) < target_share * total_ratio * (SELECT sum(size) FROM d) AS feasible, true AS met
FROM mix_targets t LEFT JOIN s ON s.label = upper(trim(t.source))"""

# Every text of every spec is packed and no rule is broken.
P7_RULES = """
SELECT spec_id, (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS texts, 0::bigint AS broken, 0::bigint AS over FROM (SELECT DISTINCT spec_id FROM pack_specs)"""

ORACLES = {"p7_rules": P7_RULES, "p8_found": P8_FOUND, "p8_rules": P8_RULES, "p2_found": P2_FOUND, "p6_found": P6_FOUND, "p6_records": P6_RECORDS, "p9_found": P9_FOUND, "p9_shared": P9_SHARED}
