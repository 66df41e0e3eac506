"""Feature weights, splits, AUC and model queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import bag, evaluate, features, gridfit, model, outcome, splits
from ..session import stage
from . import roles
from .event_queries import GAPS, _eligible, order_mixed_subjects
from .experiment import SYSTEMS, Experiment, Inputs, feature_bags, run_cross_system, run_single_system, usable_bag
from .roles import INFO, UNITS, Tables, with_roles

SEED = 7


def _profile(t: Tables) -> DataFrame:
    return roles.order_profile(t)


def _split_bags(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train bag, its spine and test bag: older against newer system.

    The bag is a stage table, as every weight needs it more than once.
    """
    systems = _profile(t).select("subject_id", "system")
    both = stage(roles.order_bag(t).join(systems, "subject_id"), "bag")
    train = both.filter(F.col("system") == "carevue").drop("system")
    test = both.filter(F.col("system") == "metavision").drop("system")
    return train, bag.subject_spine(train), test


def _rounded(weights: DataFrame) -> DataFrame:
    return weights.select("subject_id", "item_id", F.round("weight", 6).alias("weight"))


def tfidf_train(t: Tables) -> DataFrame:
    train, spine, _ = _split_bags(t)
    return _rounded(features.tfidf(train, train, spine))


def tfidf_test(t: Tables) -> DataFrame:
    train, spine, test = _split_bags(t)
    return _rounded(features.tfidf(test, train, spine))


def maxabs_scaled(t: Tables) -> DataFrame:
    train, spine, test = _split_bags(t)
    scales = features.max_abs(features.tfidf(train, train, spine))
    return _rounded(features.max_abs_scale(features.tfidf(test, train, spine), scales))


def score_appended(t: Tables) -> DataFrame:
    train, spine, _ = _split_bags(t)
    scores = _profile(t).join(spine, "subject_id", "left_semi")
    return _rounded(features.append_score(features.tfidf(train, train, spine), scores))


def bag_vectors(t: Tables) -> DataFrame:
    """Sparse count vectors per subject, shown by their size and sums."""
    b = stage(roles.order_bag(t), "bag")
    rows = bag.vector_rows(
        b.withColumnRenamed("cnt", "weight"), bag.feature_index(b), bag.subject_spine(b)
    )
    return rows.select(
        "subject_id",
        F.aggregate("features.values", F.lit(0.0), lambda a, x: a + x).alias("total"),
        F.size("features.indices").alias("nonzero"),
        F.col("features.size").alias("width"),
    )


def _labelled(t: Tables) -> DataFrame:
    return outcome.label_outcome(_profile(t), outcome.EVENT_BEFORE_END)


def stratified_folds(t: Tables) -> DataFrame:
    return splits.stratified_folds(_labelled(t).select("subject_id", "label"))


def stratified_holdout(t: Tables) -> DataFrame:
    return splits.stratified_holdouts(_labelled(t), ["unit"], iterations=10, seed=SEED)


def _scored(t: Tables) -> DataFrame:
    return _labelled(t).withColumnRenamed("severity", "score")


def auc_score(t: Tables) -> DataFrame:
    return evaluate.roc_auc(_scored(t), []).withColumn("auc", F.round("auc", 9))


def auc_by_unit(t: Tables) -> DataFrame:
    return evaluate.roc_auc(_scored(t), ["unit", "system"]).withColumn("auc", F.round("auc", 9))


def auc_by_supplier(t: Tables) -> DataFrame:
    """How well quantity tells returned line items, per supplier."""
    lines = t.lineitem.select(
        "l_suppkey",
        F.col("l_quantity").alias("score"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(-1).alias("label"),
    )
    return evaluate.roc_auc(lines, ["l_suppkey"]).withColumn("auc", F.round("auc", 9))


def bootstrap_aucs(t: Tables) -> DataFrame:
    aucs = evaluate.bootstrap_aucs(_scored(t), 1000, SEED)
    return aucs.withColumn("auc", F.round("auc", 9))


def bootstrap_auc_ci(t: Tables) -> DataFrame:
    ci = evaluate.bootstrap_interval(_scored(t), 1000, SEED)
    return ci.select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "replicates")


def class_weights(t: Tables) -> DataFrame:
    weighted = model.with_class_weights(_labelled(t))
    return weighted.select("subject_id", F.round("weight", 9).alias("weight"))


def lr_grid_search(t: Tables) -> DataFrame:
    """AUC of each fold and C, by system, gap and severity setting."""
    inputs, parts = _inputs(t), []
    for system in SYSTEMS:
        run = Experiment(system=system, gaps=GAPS)
        b, spine = feature_bags(run, inputs, stage(usable_bag(inputs, [system]), "usable"), run.gaps)
        people = outcome.population(inputs.profile, run.outcome, spine, UNITS).join(spine, "subject_id")
        folded = splits.stratified_folds(people, run.folds, ["gap"]).withColumn("role", F.lit("train"))
        examples = model.build_examples(b, stage(folded, "people"), ["gap"], run.severity, ["gap"])
        cells = model.grid_search(examples, gridfit.Grid(run.grid, run.folds), predicted=False).cells
        parts.append(cells.select("fold", "c", "n", "auc", F.lit(system).alias("system"), "gap", "severity"))
    return reduce(DataFrame.unionByName, parts)


def severity_models(t: Tables) -> DataFrame:
    """Logistic models on the severity score alone, by system and gap: mean AUC and refit for every C."""
    keys = ["system", "gap"]
    profile = _profile(t)
    eligible = outcome.eligible_subjects(profile, outcome.EVENT_BEFORE_END, GAPS, INFO)
    people = outcome.population(profile, outcome.EVENT_BEFORE_END, eligible, UNITS).join(eligible, "subject_id")
    people = people.join(profile.select("subject_id", "system"), "subject_id")
    rows = stage(splits.stratified_folds(people, 5, keys).withColumn("role", F.lit("train")), "people")
    none = t.spark.createDataFrame([], "gap double, subject_id long, item_id string, cnt long")
    examples = model.build_examples(none, rows, keys, [True], ["gap"])
    search = model.grid_search(examples, gridfit.Grid(model.C_GRID, 5, tol=1e-11), predicted=False)
    mean = model.mean_aucs(search.cells, examples.keys)
    named = search.fitted.where("kind = 'weight'").join(examples.index, "idx")
    weight = lambda item: F.round(F.max(F.when(F.col("item_id") == item, F.col("value"))), 6) + F.lit(0.0)
    fits = named.groupBy(*examples.keys, "c").agg(
        weight(features.SEVERITY_ITEM).alias("weight"), weight(model.INTERCEPT_ITEM).alias("intercept")
    )
    told = fits.join(mean, [*examples.keys, "c"]).join(search.best, examples.keys)
    return told.select(
        *keys, "c", F.round("mean", 9).alias("mean_auc"), "weight", "intercept", (F.col("c") == F.col("best_c")).alias("chosen")
    )


def evaluation_population(t: Tables) -> DataFrame:
    """Subjects, positives and severity AUC of each evaluation: system by gap, of all and of each unit."""
    inputs, parts = _inputs(t), []
    for system in SYSTEMS:
        run = Experiment(system=system, gaps=GAPS)
        _, spine = feature_bags(run, inputs, stage(usable_bag(inputs, [system]), "usable"), run.gaps)
        people = outcome.population(inputs.profile, run.outcome, spine, UNITS).join(spine, "subject_id")
        people = stage(people.withColumnRenamed("severity", "score"), "people")
        for by in ([], ["unit"]):
            auc = evaluate.roc_auc(people, ["gap", *by])
            unit = F.col("unit") if by else F.lit("all")
            parts.append(auc.select(F.lit(system).alias("system"), "gap", unit.alias("unit"), F.round("auc", 9).alias("auc"), "n_pos", "n_neg"))
    return reduce(DataFrame.unionByName, parts)


def single_system_eval(t: Tables) -> DataFrame:
    """AUCs and cohort counts of all repeats, gaps and severity settings of both systems."""
    return _evaluated(t, [(run_single_system, Experiment(system=s, gaps=GAPS)) for s in SYSTEMS])


def cross_system_eval(t: Tables) -> DataFrame:
    """AUCs, bootstrap intervals and cohort counts, with shared and with all items, in both directions."""
    runs = [Experiment(system=s, gaps=GAPS, intersection=i) for i in (True, False) for s in SYSTEMS]
    return _evaluated(t, [(run_cross_system, r) for r in runs])


def _evaluated(t: Tables, runs: list) -> DataFrame:
    """Result tables of the runs under each other; ``result`` names the table, ``run`` and ``intersection`` the run."""
    inputs, parts = _inputs(t), []
    for function, run in runs:
        for name, table in function(run, inputs).items():
            if name in ("metrics", "intervals", "counts"):
                tags = {"result": F.lit(name), "run": F.lit(run.name), "intersection": F.lit(run.intersection)}
                parts.append(table.withColumns(tags))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _inputs(t: Tables) -> Inputs:
    b = stage(roles.order_bag(t), "bag")
    return Inputs(
        bag=b,
        profile=stage(_profile(t), "profile"),
        item_concepts=roles.part_concepts(t).withColumn("method", F.lit("all")),
        mixed_subjects=stage(order_mixed_subjects(t, b), "mixed"),
        units=UNITS,
        info=INFO,
    )


QUERIES = {
    f.__name__: f
    for f in (
        tfidf_train,
        tfidf_test,
        maxabs_scaled,
        score_appended,
        bag_vectors,
        stratified_folds,
        stratified_holdout,
        auc_score,
        auc_by_unit,
        auc_by_supplier,
        bootstrap_aucs,
        bootstrap_auc_ci,
        class_weights,
        lr_grid_search,
        severity_models,
        evaluation_population,
        single_system_eval,
        cross_system_eval,
    )
}

# --- SQL ---------------------------------------------------------------------

_SIDES = {
    s: f"""SELECT b.* FROM order_bag b JOIN order_profile USING (subject_id)
           WHERE system = '{name}'"""
    for s, name in (("train", "carevue"), ("test", "metavision"))
}
_N = "(SELECT count(DISTINCT subject_id) FROM train)"
_IDF = f"SELECT item_id, ln((1.0 + {_N}) / (1 + count(*))) + 1 AS idf FROM train GROUP BY item_id"


def _weights(side: str) -> str:
    return f"""SELECT subject_id, item_id, w / sqrt(sum(w * w) OVER (PARTITION BY subject_id))
        AS weight FROM (SELECT subject_id, item_id,
            (1 + ln(cnt)) * coalesce(idf, ln(1.0 + {_N}) + 1) AS w
          FROM {side} LEFT JOIN idf USING (item_id))"""


def _tfidf_sql(body: str, **extra: str) -> str:
    return with_roles(("order_bag",), body, **_SIDES, idf=_IDF, **extra)


_LABELLED = """SELECT *, CASE WHEN coalesce(min_to_death <= min_to_end, false) THEN 1 ELSE -1 END
    AS label FROM order_profile"""


def _auc_sql(source: str, by: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    ties = f"PARTITION BY {by}, score" if by else "PARTITION BY score"
    lead = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {lead}round(CASE WHEN n_pos > 0 AND n_neg > 0 THEN
          (r - n_pos * (n_pos + 1) / 2.0) / (CAST(n_pos AS DOUBLE) * n_neg) END, 9) AS auc,
          n_pos, n_neg
        FROM (SELECT {lead}sum(CASE WHEN label > 0 THEN midrank END) AS r,
                count(*) FILTER (label > 0) AS n_pos, count(*) FILTER (label <= 0) AS n_neg
              FROM (SELECT *, rank() OVER ({part} ORDER BY score)
                      + (count(*) OVER ({ties}) - 1) / 2.0 AS midrank FROM {source})
              {group})"""


_BOOT = {
    "labelled": _LABELLED,
    "slotted": """SELECT *, row_number() OVER (PARTITION BY cls
          ORDER BY md5(CAST(subject_id AS VARCHAR)), subject_id) AS slot,
        count(*) OVER (PARTITION BY cls) AS n
        FROM (SELECT subject_id, severity AS score, CASE WHEN label > 0 THEN 1 ELSE 0 END AS cls
              FROM labelled)""",
    "draws": f"""SELECT rep, cls, CAST('0x' || substr(md5('{SEED}:' || rep || ':' || cls || ':'
          || slot), 1, 13) AS BIGINT) % n + 1 AS slot FROM slotted, range(1000) r(rep)""",
    "drawn": """SELECT rep, s.score, d.cls AS label FROM draws d
        JOIN slotted s ON s.cls = d.cls AND s.slot = d.slot""",
    "aucs": _auc_sql("drawn", "rep"),
}

_FOLDS, _STEPS = 5, 40
_ELIGIBLE = _eligible(outcome.EVENT_BEFORE_END, GAPS)

#: Every cell by Newton steps from zero, one recursion a step for all cells.
_NEWTON = f"""WITH RECURSIVE
%s,
people AS (SELECT system, gap, subject_id, label, coalesce(severity, 0)::DOUBLE AS severity,
                  ntile({_FOLDS}) OVER (PARTITION BY system, gap, label ORDER BY subject_id) AS fold
           FROM ({_ELIGIBLE}) JOIN ({_LABELLED}) USING (subject_id) WHERE unit IN {UNITS}),
fitted AS (SELECT p.*, f.f, max(abs(severity)) OVER own AS top,
                  count(*) OVER own / (2.0 * count(*) OVER (PARTITION BY system, gap, f.f, label)) AS s
           FROM people p, range({_FOLDS + 1}) f(f) WHERE f.f = 0 OR f.f != p.fold
           WINDOW own AS (PARTITION BY system, gap, f.f)),
x AS (SELECT *, severity / CASE WHEN top > 0 THEN top ELSE 1 END AS z FROM fitted),
cells AS (SELECT DISTINCT system, gap, f, power(10.0, e.e - 7) AS c FROM fitted, range(8) e(e)),
newton(system, gap, f, c, step, a, b) AS (
    SELECT system, gap, f, c, 0, 0.0::DOUBLE, 0.0::DOUBLE FROM cells
    UNION ALL
    SELECT system, gap, f, c, step + 1,
           a - (h_bb * g_a - h_ab * g_b) / (h_aa * h_bb - h_ab * h_ab), b - (h_aa * g_b - h_ab * g_a) / (h_aa * h_bb - h_ab * h_ab)
    FROM (SELECT system, gap, f, c, step, a, b,
                 a - c * sum(s * label * q) AS g_a, b - c * sum(s * label * q * z) AS g_b,
                 1 + c * sum(s * q * (1 - q)) AS h_aa, c * sum(s * q * (1 - q) * z) AS h_ab, 1 + c * sum(s * q * (1 - q) * z * z) AS h_bb
          FROM (SELECT n.*, x.s, x.label, x.z, 1 / (1 + exp(x.label * (n.a + n.b * x.z))) AS q
                FROM newton n JOIN x USING (system, gap, f) WHERE n.step < {_STEPS})
          GROUP BY system, gap, f, c, step, a, b)),
solved AS (SELECT * FROM newton WHERE step = {_STEPS}),
held AS (SELECT system, gap, fold, c, label, 1 / (1 + exp(-(a + b * severity / CASE WHEN m > 0 THEN m ELSE 1 END))) AS score
         FROM people p JOIN solved n USING (system, gap)
         JOIN (SELECT DISTINCT system, gap, f, top AS m FROM x) t USING (system, gap, f) WHERE n.f = p.fold),
aucs AS ({_auc_sql("held", "system, gap, fold, c")}),
means AS (SELECT system, gap, c, round(sum((n_pos + n_neg) * auc) / sum(n_pos + n_neg), 9) AS mean_auc FROM aucs GROUP BY ALL)
SELECT system, gap, c, mean_auc, round(b, 6) + 0.0 AS weight, round(a, 6) + 0.0 AS intercept,
       row_number() OVER (PARTITION BY system, gap ORDER BY mean_auc DESC, c) = 1 AS chosen
FROM solved JOIN means USING (system, gap, c) WHERE f = 0"""

_USABLE = """SELECT DISTINCT subject_id FROM order_bag WHERE subject_id NOT IN
    (SELECT subject_id FROM order_bag JOIN order_profile USING (subject_id)
     JOIN part ON item_id = CAST(p_partkey AS VARCHAR) WHERE system = 'carevue' AND p_size <= 5)"""

ORACLES = {
    "severity_models": _NEWTON % with_roles(("order_profile",), "").removeprefix("WITH ").strip(),
    "evaluation_population": with_roles(
        ("order_bag", "order_profile"),
        f"""SELECT * FROM ({_auc_sql("(SELECT *, 'all' AS whole FROM people)", "system, gap, whole").replace("whole,", "whole AS unit,", 1)})
            UNION ALL BY NAME SELECT * FROM ({_auc_sql("people", "system, gap, unit")})""",
        usable=_USABLE,
        people=f"""SELECT system, gap, unit, label, severity AS score FROM ({_ELIGIBLE}) JOIN usable USING (subject_id)
            JOIN ({_LABELLED}) USING (subject_id) WHERE unit IN {UNITS}""",
    ),
    "tfidf_train": _tfidf_sql(
        "SELECT subject_id, item_id, round(weight, 6) AS weight FROM w", w=_weights("train")
    ),
    "tfidf_test": _tfidf_sql(
        "SELECT subject_id, item_id, round(weight, 6) AS weight FROM w", w=_weights("test")
    ),
    "maxabs_scaled": _tfidf_sql(
        """SELECT subject_id, item_id, round(weight / coalesce(scale, 1), 6) AS weight
           FROM w LEFT JOIN (SELECT item_id, max(abs(weight)) AS scale FROM wtrain
                             GROUP BY item_id) USING (item_id)""",
        w=_weights("test"),
        wtrain=_weights("train"),
    ),
    "score_appended": _tfidf_sql(
        """SELECT subject_id, item_id, round(weight, 6) AS weight FROM w
           UNION ALL SELECT subject_id, 'severity', round(severity, 6) FROM order_profile
           WHERE subject_id IN (SELECT subject_id FROM train)""",
        w=_weights("train"),
    ),
    "bag_vectors": with_roles(
        ("order_bag",),
        """SELECT subject_id, CAST(sum(cnt) AS DOUBLE) AS total, CAST(count(*) AS INTEGER) AS nonzero,
             CAST((SELECT count(DISTINCT item_id) FROM order_bag) AS INTEGER) AS width
           FROM order_bag GROUP BY subject_id""",
    ),
    "stratified_folds": with_roles(
        ("order_profile",),
        """SELECT subject_id, label, CAST(ntile(5) OVER (PARTITION BY label ORDER BY subject_id)
             AS INTEGER) AS fold FROM labelled""",
        labelled=_LABELLED,
    ),
    "stratified_holdout": with_roles(
        ("order_profile",),
        f"""SELECT subject_id, unit, label, CAST(iter AS INTEGER) AS iter,
              CASE WHEN row_number() OVER (PARTITION BY iter, unit, label
                     ORDER BY md5('{SEED}:' || iter || ':' || subject_id), subject_id)
                   <= CASE WHEN label = 1 THEN test_pos ELSE n_test - test_pos END
                   THEN 'test' ELSE 'train' END AS role
            FROM labelled JOIN sizes USING (unit), range(10) r(iter)""",
        labelled=_LABELLED,
        sizes="""SELECT unit, CAST(ceil(0.33 * n) AS BIGINT) AS n_test,
            CAST(floor(ceil(0.33 * n) * pos / n + 0.5) AS BIGINT) AS test_pos
            FROM (SELECT unit, CAST(count(*) AS DOUBLE) AS n,
                    CAST(count(*) FILTER (label = 1) AS DOUBLE) AS pos FROM labelled GROUP BY unit)""",
    ),
    "auc_score": with_roles(
        ("order_profile",),
        _auc_sql("scored", ""),
        labelled=_LABELLED,
        scored="SELECT label, severity AS score FROM labelled",
    ),
    "auc_by_unit": with_roles(
        ("order_profile",),
        _auc_sql("scored", "unit, system"),
        labelled=_LABELLED,
        scored="SELECT unit, system, label, severity AS score FROM labelled",
    ),
    "auc_by_supplier": with_roles(
        (),
        _auc_sql("scored", "l_suppkey"),
        scored="""SELECT l_suppkey, l_quantity AS score,
            CASE WHEN l_returnflag = 'R' THEN 1 ELSE -1 END AS label FROM lineitem""",
    ),
    "bootstrap_aucs": with_roles(("order_profile",), "SELECT CAST(rep AS INTEGER) AS rep, auc FROM aucs", **_BOOT),
    "bootstrap_auc_ci": with_roles(
        ("order_profile",),
        """SELECT round(quantile_cont(auc, 0.025), 6) AS lo, round(quantile_cont(auc, 0.975), 6) AS hi,
             count(*) AS replicates FROM aucs""",
        **_BOOT,
    ),
    "class_weights": with_roles(
        ("order_profile",),
        """SELECT subject_id, round((SELECT count(*) FROM labelled)
             / (2.0 * count(*) OVER (PARTITION BY label)), 9) AS weight
             FROM labelled""",
        labelled=_LABELLED,
    ),
}
