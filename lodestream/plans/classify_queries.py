"""Classification of entities against a library, and operator corrections of it."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestream.operators import classify, corrections
from lodestream.plans.scalar_queries import phi_sql
from lodestream.plans.tables import observations, query

#: A small library: class and parent; and per class and feature low, high, soft, want, any_of, weight.
_TREE = [("all", None), ("net", "all"), ("link", "all"), ("net.voice", "net"), ("net.relay", "net"), ("link.up", "link"), ("link.down", "link")]
_LEAVES = ["net.voice", "net.relay", "link.up", "link.down"]
_FEATURES = [
    ("net.voice", "duration_s", 20.0, 60.0, None, None, None, 1.0), ("net.voice", "stationary", None, None, None, 0.3, None, 1.0), ("net.voice", "speed_mps", 0.0, 8.0, None, None, None, 1.0), ("net.voice", "modulation_hints", None, None, None, None, ["click"], 1.0),
    ("net.relay", "duration_s", 40.0, 52.0, 0.05, None, None, 1.0), ("net.relay", "stationary", None, None, None, 0.9, None, 1.0), ("net.relay", "bandwidth_hz", 25_000.0, 40_000.0, None, None, None, 0.5), ("net.relay", "modulation_hints", None, None, None, None, ["view", "signup"], 1.0),
    ("link.up", "duration_s", 52.0, 120.0, None, None, None, 1.0), ("link.up", "speed_mps", 6.0, 20.0, 1.0, None, None, 1.0), ("link.up", "modulation_hints", None, None, None, None, ["purchase"], 0.5),
    ("link.down", "bandwidth_hz", 30_000.0, 30_000.0, 0.05, None, None, 1.0), ("link.down", "duration_s", 10.0, 200.0, None, None, None, 1.0),
]
_BACKGROUND = {"duration_s": (1.0, 500.0), "bandwidth_hz": (1_000.0, 100_000.0), "speed_mps": (0.0, 60.0)}


def _value(v) -> str:
    if isinstance(v, list):
        return "[" + ", ".join(map(repr, v)) + "]"
    return "NULL" if v is None else repr(v) if isinstance(v, str) else f"{v!r}::DOUBLE"


def _rows(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in rows) + ")"


_LIBRARY = [(*r[:5], *_BACKGROUND.get(r[1], (None, None)), *r[5:]) for r in _FEATURES]
_LLR_SQL = f""", leaf(class_id) AS {_rows([(x,) for x in _LEAVES])}, lib(class_id, feature, low, high, soft0, b_low, b_high, want, any_of, weight) AS {_rows(_LIBRARY)},
e AS (SELECT entity, avg(abs(duration_s)) AS dur, stddev_pop(duration_s) / sqrt(count(*)) AS ds, avg(bandwidth_hz) AS bw, list(DISTINCT source_id) FILTER (k % 10 < 2) AS hints, sqrt(power(entity * 31 % 23 - 11, 2) + power(entity * 17 % 19 - 9, 2)) AS speed FROM obs GROUP BY entity),
feat AS (SELECT entity, 'duration_s' AS feature, dur AS value, ds AS sigma, CASE WHEN entity % 3 = 0 THEN 'unreported' ELSE 'measured' END AS basis, NULL::VARCHAR[] AS categories FROM e UNION ALL
  SELECT entity, 'bandwidth_hz', bw, NULL, 'measured', NULL FROM e WHERE entity % 4 <> 0 UNION ALL SELECT entity, 'stationary', 1 / (1.0::DOUBLE + entity % 9), NULL, 'measured', NULL FROM e UNION ALL
  SELECT entity, 'speed_mps', speed, 1.5, 'measured', NULL FROM e WHERE entity % 5 <> 0 UNION ALL SELECT entity, 'modulation_hints', NULL, NULL, 'unreported', hints FROM e WHERE len(hints) > 0),
c0 AS (SELECT *, feature IN ('freq_hz', 'bandwidth_hz', 'duration_s', 'period_s') AS sc, CASE WHEN basis = 'unreported' THEN 0.5 ELSE 1 END AS bw FROM feat JOIN lib USING (feature)),
c1 AS (SELECT *, CASE WHEN sc THEN log10(greatest(value, 1e-12)) ELSE value END AS x, CASE WHEN sc THEN coalesce(sigma, 0) / (greatest(value, 1e-12) * ln(10.0::DOUBLE)) ELSE coalesce(sigma, 0) END AS s, CASE WHEN sc THEN log10(low) ELSE low END AS l, CASE WHEN sc THEN log10(high) ELSE high END AS h,
  CASE WHEN sc THEN log10(b_low) ELSE b_low END AS bl, CASE WHEN sc THEN log10(b_high) ELSE b_high END AS bh, greatest(0.001, least(0.999, value)) AS q FROM c0),
c2 AS (SELECT *, sqrt(power(coalesce(soft0, CASE WHEN sc THEN 0.02 ELSE 0.05 * greatest(h - l, 1e-9) END), 2) + s * s) AS t FROM c1),
c3 AS (SELECT *, (h - x) / t AS z1, (l - x) / t AS z0, (bh - x) / t AS y1, (bl - x) / t AS y0 FROM c2),
c4 AS (SELECT entity, class_id, feature, CASE WHEN want IS NOT NULL THEN ln((q * want + (1 - q) * (1 - want)) / 0.5) * bw WHEN any_of IS NOT NULL THEN ln(CASE WHEN list_has_any(categories, any_of) THEN 0.9 ELSE 0.1 END / 0.5::DOUBLE) * weight
  WHEN b_low IS NOT NULL THEN greatest(-6.0, least(6.0, ln(CASE WHEN h - l <= 1e-12 THEN exp(-0.5 * z0 * z0) / (t * sqrt(2 * pi())) ELSE greatest({phi_sql('z1')} - {phi_sql('z0')}, 1e-12) / (h - l) END / (greatest({phi_sql('y1')} - {phi_sql('y0')}, 1e-12) / (bh - bl))))) * bw * weight END AS llr FROM c3),
c5 AS (SELECT * FROM c4 WHERE llr IS NOT NULL), mo AS (SELECT entity, class_id, avg(llr) AS mean, count(*) AS votes FROM c5 WHERE feature IN ('speed_mps', 'stationary') GROUP BY 1, 2),
contrib AS (SELECT entity, class_id, feature, CASE WHEN feature IN ('speed_mps', 'stationary') THEN mean / votes ELSE llr END AS llr FROM c5 LEFT JOIN mo USING (entity, class_id))"""
_POST_SQL = _LLR_SQL + """, en AS (SELECT entity FROM feat GROUP BY 1 HAVING count(*) >= 2), sc AS (SELECT entity, class_id, 0.8::DOUBLE * coalesce(s, 0) AS score FROM (SELECT * FROM en CROSS JOIN leaf) LEFT JOIN (SELECT entity, class_id, sum(llr) AS s FROM contrib GROUP BY 1, 2) USING (entity, class_id)),
tp AS (SELECT entity, greatest(max(score), 0) AS top FROM sc GROUP BY 1), ms AS (SELECT sc.*, 0.125::DOUBLE * exp(score - top) AS mass, 0.5::DOUBLE * exp(-top) AS rest FROM sc JOIN tp USING (entity)),
post AS (SELECT entity, class_id, substr(class_id, 1, strpos(class_id, '.') - 1) AS parent, score, round(mass / (sum(mass) OVER (PARTITION BY entity) + rest), 6) AS p, round(rest / (sum(mass) OVER (PARTITION BY entity) + rest), 6) AS p_bg FROM ms)"""


def features(spark, sf_dir):
    """Usable features of every entity, one row each."""
    o, entity = observations(spark, sf_dir), F.col("entity")
    e = o.groupBy("entity").agg(F.avg(F.abs("duration_s")).alias("dur"), (F.stddev_pop("duration_s") / F.sqrt(F.count("*"))).alias("ds"), F.avg("bandwidth_hz").alias("bw"), F.collect_set(F.when(F.col("k") % 10 < 2, F.col("source_id"))).alias("hints"))
    none, measured = F.lit(None).cast("double"), F.lit("measured")
    one = lambda name, value, sigma, basis, cats=None: F.struct(F.lit(name).alias("feature"), value.alias("value"), sigma.alias("sigma"), basis.alias("basis"), (cats if cats is not None else F.lit(None).cast("array<string>")).alias("categories"))
    speed = F.sqrt(F.pow(entity * 31 % 23 - 11, 2) + F.pow(entity * 17 % 19 - 9, 2))
    found = F.array(
        one("duration_s", F.col("dur"), F.col("ds"), F.when(entity % 3 == 0, "unreported").otherwise("measured")),
        F.when(entity % 4 != 0, one("bandwidth_hz", F.col("bw"), none, measured)),
        one("stationary", 1 / (1.0 + entity % 9), none, measured),
        F.when(entity % 5 != 0, one("speed_mps", speed, F.lit(1.5), measured)),
        F.when(F.size("hints") > 0, one("modulation_hints", none, none, F.lit("unreported"), F.col("hints"))),
    )
    return e.select("entity", F.inline(F.filter(found, lambda f: f.isNotNull())))


def library(spark):
    return spark.createDataFrame(_LIBRARY, "class_id string, feature string, low double, high double, soft double, b_low double, b_high double, want double, any_of array<string>, weight double")


def contributions(spark, sf_dir):
    return classify.contributions(features(spark, sf_dir), library(spark))


def posterior(spark, sf_dir):
    f = features(spark, sf_dir)
    leaves = spark.createDataFrame([(x, (1 - classify.BACKGROUND) / len(_LEAVES)) for x in _LEAVES], "class_id string, prior double")
    p = classify.posterior(classify.contributions(f, library(spark)), leaves, f.groupBy("entity").agg(F.count("*").alias("n")))
    return p.withColumns({"parent": F.split_part("class_id", F.lit("."), F.lit(1)), "p": F.round("p", 6), "p_bg": F.round("p_bg", 6)})


@query("feature_llr", _LLR_SQL + " SELECT entity, class_id, feature, round(llr, 6) AS llr FROM contrib")
def feature_llr(spark, sf_dir):
    """What each feature says for or against each class."""
    return contributions(spark, sf_dir).withColumn("llr", F.round("llr", 6))


@query("posterior_softmax", _POST_SQL + " SELECT entity, class_id, p, p_bg FROM post")
def posterior_softmax(spark, sf_dir):
    return posterior(spark, sf_dir).select("entity", "class_id", "p", "p_bg")


@query("library_ancestors", "WITH RECURSIVE lib(class_id, parent) AS " + _rows(_TREE) + ", up AS (SELECT class_id, class_id AS ancestor, 0 AS depth FROM lib UNION ALL SELECT up.class_id, lib.parent, depth + 1 FROM up JOIN lib ON lib.class_id = up.ancestor WHERE lib.parent IS NOT NULL) SELECT * FROM up", obs=False)
def library_ancestors(spark, sf_dir):
    """Every class with itself and all above it: joins until no class has a higher one."""
    return ancestors(spark)


def ancestors(spark):
    tree = spark.createDataFrame(_TREE, "class_id string, parent string")
    step = tree.select("class_id", F.col("class_id").alias("ancestor"), F.lit(0).alias("depth"))
    every, parents = step, F.broadcast(tree.where("parent is not null").select(F.col("class_id").alias("ancestor"), "parent"))
    for depth in range(1, len(_TREE)):
        step = step.join(parents, "ancestor").select("class_id", F.col("parent").alias("ancestor"), F.lit(depth).alias("depth"))
        if step.isEmpty():
            break
        every = every.unionByName(step)
    return every


@query("tree_rollup", _POST_SQL + """, up(class_id, category) AS (VALUES """ + ", ".join(f"('{x}', '{x.split('.')[0]}'), ('{x}', 'all')" for x in _LEAVES) + """)
SELECT entity, category, round(sum(p), 6) AS p FROM post JOIN up USING (class_id) GROUP BY 1, 2""")
def tree_rollup(spark, sf_dir):
    """The posterior of each category: that of all leaves under it."""
    up = ancestors(spark).where("depth > 0").select("class_id", F.col("ancestor").alias("category"))
    return posterior(spark, sf_dir).join(F.broadcast(up), "class_id").groupBy("entity", "category").agg(F.round(F.sum("p"), 6).alias("p"))


_LN19 = math.log(19)
_DECIDE = _POST_SQL + f""", r AS (SELECT *, row_number() OVER w AS rn, lead(p) OVER w AS p2, lead(parent) OVER w AS parent2, sum(p) OVER (PARTITION BY entity, parent) AS p_parent, sum(p) OVER (PARTITION BY entity) AS p_all FROM post WINDOW w AS (PARTITION BY entity ORDER BY p DESC, class_id)),
d AS (SELECT *, CASE WHEN p < 0.4 AND p_bg >= 0.6 THEN 'unlike_library' WHEN p < 0.4 THEN 'ambiguous' WHEN p2 < p - 0.15 THEN class_id WHEN parent = parent2 AND p_parent >= 0.4 THEN parent WHEN parent <> parent2 AND p_all >= 0.4 THEN 'all' ELSE 'ambiguous' END AS decision FROM r WHERE rn = 1)"""


@query("decide_class", _DECIDE + f" SELECT entity, decision, decision = class_id AND p >= 0.7 AND score >= {_LN19!r} AS likely, round(p - p2, 6) AS lead FROM d")
def decide_class(spark, sf_dir):
    return decided(posterior(spark, sf_dir))


def decided(post):
    """The best class; where the next is near, what both have above them; 'likely' needs the evidence itself."""
    w = Window.partitionBy("entity").orderBy(F.desc("p"), "class_id")
    above = lambda c: F.array(F.col(c), F.lit("all"))
    r = post.withColumns({
        "rn": F.row_number().over(w), "p2": F.lead("p").over(w), "parent2": F.lead("parent").over(w),
        "p_parent": F.sum("p").over(Window.partitionBy("entity", "parent")), "p_all": F.sum("p").over(Window.partitionBy("entity")),
    }).where("rn = 1")
    shared = F.get(F.array_intersect(above("parent"), above("parent2")), F.lit(0))  # the first on the way up
    p_shared = F.when(shared == F.col("parent"), F.col("p_parent")).otherwise(F.col("p_all"))
    near = F.col("p2") >= F.col("p") - 0.15
    decision = F.when((F.col("p") < 0.4) & (F.col("p_bg") >= 0.6), "unlike_library").when(F.col("p") < 0.4, "ambiguous").when(~near, F.col("class_id")).when(p_shared >= 0.4, shared).otherwise("ambiguous")
    likely = (F.col("decision") == F.col("class_id")) & (F.col("p") >= 0.7) & (F.col("score") >= _LN19)
    return r.withColumn("decision", decision).select("entity", "decision", likely.alias("likely"), F.round(F.col("p") - F.col("p2"), 6).alias("lead"))


@query("top_reasons_llr", _LLR_SQL + """ SELECT entity, class_id, feature, round(llr, 6) AS llr, rn FROM (SELECT *, row_number() OVER (PARTITION BY entity, class_id ORDER BY round(abs(llr), 6) DESC, feature)::INTEGER AS rn FROM contrib) WHERE rn <= 3""")
def top_reasons_llr(spark, sf_dir):
    """The strongest reasons of each class."""
    w = Window.partitionBy("entity", "class_id").orderBy(F.desc(F.round(F.abs("llr"), 6)), "feature")
    return contributions(spark, sf_dir).withColumn("rn", F.row_number().over(w)).where("rn <= 3").withColumn("llr", F.round("llr", 6))


#: Corrections: run, entity, confirmed class, rejected class, affiliation.
_CORR = [("r1", 1, "net.voice", None, None), ("r1", 2, None, "link.up", None), ("r1", 3, None, None, "friend"), ("r1", 7, None, "net.relay", "neutral"), ("r1", 8, "link.down", None, "hostile"), ("r2", 4, None, "net.voice", None), ("r2", 5, "link.up", None, None)]
_CORR_SQL = ", corr0(run, entity, confirm, reject, affiliation) AS " + _rows([(r, float(e), *x) for r, e, *x in _CORR]) + ", corr AS (SELECT run, entity::BIGINT AS entity, confirm, reject, affiliation FROM corr0 WHERE run = 'r1')"


def _corrections(spark, run: str):
    table = spark.createDataFrame(_CORR, "run string, entity long, confirm string, reject string, affiliation string")
    return F.broadcast(table.where(F.col("run") == run))  # an operator's file


@query("corrections_left", _POST_SQL + _CORR_SQL + """, kept AS (SELECT post.*, confirm FROM post LEFT JOIN corr ON corr.entity = post.entity WHERE coalesce(corr.reject, '') <> post.class_id)
SELECT entity, class_id, round(p / (sum(p) OVER (PARTITION BY entity) + p_bg), 7) AS p, coalesce(confirm = class_id, false) AS confirmed FROM kept""")
def corrections_left(spark, sf_dir):
    """Posteriors under this run's corrections: rejected classes removed and the rest normalised, confirmed ones marked with their number unchanged."""
    corr = _corrections(spark, "r1")
    kept = corrections.without_rejected(posterior(spark, sf_dir), corr.where("reject is not null").select("entity", F.col("reject").alias("class_id")))
    said = corr.select("entity", "confirm")
    return kept.join(said, "entity", "left").select("entity", "class_id", F.round("p", 7).alias("p"), F.coalesce(F.col("confirm") == F.col("class_id"), F.lit(False)).alias("confirmed"))


@query("corrections_other_runs", _CORR_SQL + " SELECT run, count(*) AS n FROM corr0 WHERE run <> 'r1' AND entity IN (SELECT entity FROM obs) GROUP BY 1")
def corrections_other_runs(spark, sf_dir):
    """Corrections of other runs are told, not applied."""
    table = spark.createDataFrame(_CORR, "run string, entity long, confirm string, reject string, affiliation string").where("run <> 'r1'")
    return table.join(observations(spark, sf_dir).select("entity"), "entity", "left_semi").groupBy("run").agg(F.count("*").alias("n"))


@query("corrected_decision", _POST_SQL + _CORR_SQL + """, kept AS (SELECT post.*, confirm FROM post LEFT JOIN corr ON corr.entity = post.entity WHERE coalesce(corr.reject, '') <> post.class_id),
again AS (SELECT entity, class_id, parent, score, confirm, round(p / (sum(p) OVER (PARTITION BY entity) + p_bg), 7) AS p, round(p_bg / (sum(p) OVER (PARTITION BY entity) + p_bg), 7) AS p_bg FROM kept),
r AS (SELECT *, row_number() OVER w AS rn, lead(p) OVER w AS p2, lead(parent) OVER w AS parent2, sum(p) OVER (PARTITION BY entity, parent) AS p_parent, sum(p) OVER (PARTITION BY entity) AS p_all FROM again WINDOW w AS (PARTITION BY entity ORDER BY p DESC, class_id))
SELECT entity, coalesce(confirm, CASE WHEN p < 0.4 AND p_bg >= 0.6 THEN 'unlike_library' WHEN p < 0.4 THEN 'ambiguous' WHEN p2 < p - 0.15 THEN class_id WHEN parent = parent2 AND p_parent >= 0.4 THEN parent WHEN parent <> parent2 AND p_all >= 0.4 THEN 'all' ELSE 'ambiguous' END) AS decision FROM r WHERE rn = 1""")
def corrected_decision(spark, sf_dir):
    """The decision again after rejections; a confirmed class is the decision."""
    corr = _corrections(spark, "r1")
    kept = corrections.without_rejected(posterior(spark, sf_dir), corr.where("reject is not null").select("entity", F.col("reject").alias("class_id")))
    again = decided(kept.withColumns({"p": F.round("p", 7), "p_bg": F.round("p_bg", 7)}))
    return again.join(corr.select("entity", "confirm"), "entity", "left").select("entity", F.coalesce("confirm", "decision").alias("decision"))


@query("affiliation_overlay", _CORR_SQL + " SELECT e.entity, coalesce(corr.affiliation, CASE WHEN e.entity % 4 = 0 THEN 'assumed_friend' END, 'unknown') AS affiliation FROM (SELECT DISTINCT entity FROM obs) e LEFT JOIN corr ON corr.entity = e.entity")
def affiliation_overlay(spark, sf_dir):
    """The operator's word goes before the library's, and that before the default."""
    e = observations(spark, sf_dir).select("entity").distinct().join(_corrections(spark, "r1").select("entity", "affiliation"), "entity", "left")
    return e.select("entity", F.coalesce("affiliation", F.when(F.col("entity") % 4 == 0, "assumed_friend"), F.lit("unknown")).alias("affiliation"))


@query("category_sets", """, s AS (SELECT entity, list(DISTINCT source_id) FILTER (k % 10 < 2) AS a, list(DISTINCT source_id) FILTER (k % 10 = 2) AS b FROM obs GROUP BY 1)
SELECT entity, array_to_string(list_sort(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))), ',') AS every, array_to_string(list_sort(list_intersect(coalesce(a, []), coalesce(b, []))), ',') AS both_, coalesce(list_has_any(a, ['click', 'view']), false) AS matches FROM s""")
def category_sets(spark, sf_dir):
    """Union and intersection of two sets of categories, and whether one meets what a class asks for."""
    s = observations(spark, sf_dir).groupBy("entity").agg(F.collect_set(F.when(F.col("k") % 10 < 2, F.col("source_id"))).alias("a"), F.collect_set(F.when(F.col("k") % 10 == 2, F.col("source_id"))).alias("b"))
    text = lambda c: F.array_join(F.array_sort(c), ",")
    return s.select("entity", text(F.array_union("a", "b")).alias("every"), text(F.array_intersect("a", "b")).alias("both_"), F.arrays_overlap("a", F.array(F.lit("click"), F.lit("view"))).alias("matches"))
