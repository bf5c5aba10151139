"""Metrics, assessment and reports over the prediction table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stackmill.catalog.inputs import METRIC_COLUMNS, MODELS, PRED, RUN_NAMES, predictions, sql_metrics, sql_rounded
from stackmill.catalog.registry import query
from stackmill.functions import scores, text
from stackmill.operators import metrics as M
from stackmill.operators import quality as Q
from stackmill.operators import selection as S
from stackmill.operators import stacking as K

RUN = ["model", "seed", "fold", "role"]


def rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("confusion", f"""WITH {PRED}
SELECT model, count(*) FILTER (y_true = 0 AND cls = 0)::BIGINT AS tn, count(*) FILTER (y_true = 0 AND cls = 1)::BIGINT AS fp,
  count(*) FILTER (y_true = 1 AND cls = 0)::BIGINT AS fn, count(*) FILTER (y_true = 1 AND cls = 1)::BIGINT AS tp
FROM pred GROUP BY model""")
def confusion(spark, folder):
    """Confusion counts per model."""
    return M.confusion(predictions(spark, folder), ["model"])


_M12 = [c for c in METRIC_COLUMNS if c != "balanced_accuracy"]


@query("metrics12", f"WITH {PRED}, {sql_metrics('pred', 'model')} SELECT model, tn, fp, fn, tp, {sql_rounded(_M12)} FROM m")
def metrics12(spark, folder):
    """The 12-value metric list per model."""
    return rounded(M.run_metrics(predictions(spark, folder), ["model"]).drop("balanced_accuracy"), _M12)


@query("metrics13", f"WITH {PRED}, {sql_metrics('pred', 'model')} SELECT model, tn, fp, fn, tp, {sql_rounded(METRIC_COLUMNS)} FROM m")
def metrics13(spark, folder):
    """The 13-value metric list per model, with balanced accuracy."""
    return rounded(M.run_metrics(predictions(spark, folder), ["model"]), METRIC_COLUMNS)


@query("metrics_dnn", f"""WITH {PRED}, {sql_metrics('pred', 'model, seed')}
SELECT model, seed, tn, fp, fn, tp, round(auc, 6) AS auc, round(accuracy, 6) AS accuracy, round(tn / (tn + fn + 1e-10), 6) AS npv FROM m""")
def metrics_dnn(spark, folder):
    """Metric list whose negative predictive value has an epsilon in the denominator."""
    runs = M.run_table(predictions(spark, folder), ["model", "seed"])
    return runs.select(
        "model", "seed", *scores.COUNTS, F.round("auc", 6).alias("auc"), F.round(scores.accuracy(), 6).alias("accuracy"),
        F.round(scores.npv(1e-10), 6).alias("npv"),
    )


@query("auc_rank", f"WITH {PRED}, {sql_metrics('pred', '')} SELECT round(auc, 9) AS auc FROM m")
def auc_rank(spark, folder):
    """Exact ROC AUC of all predictions together."""
    return M.auc(predictions(spark, folder)).select(F.round("auc", 9).alias("auc"))


@query("run_metrics", f"""WITH {PRED}, {sql_metrics('pred', ', '.join(RUN))}
SELECT {', '.join(RUN)}, tn, fp, fn, tp, {sql_rounded(METRIC_COLUMNS)} FROM m""")
def run_metrics(spark, folder):
    """Metrics per (model, seed, fold, role)."""
    return rounded(M.run_metrics(predictions(spark, folder), RUN), METRIC_COLUMNS)


@query("report3", f"""WITH {PRED}, {sql_metrics('pred', 'model, role')}
SELECT model, role, {sql_rounded(['accuracy', 'sensitivity', 'specificity'], 3)} FROM m""")
def report3(spark, folder):
    """Accuracy, sensitivity and specificity rounded to three places."""
    counts = M.confusion(predictions(spark, folder), ["model", "role"])
    return counts.select(
        "model", "role", F.round(scores.accuracy(), 3).alias("accuracy"),
        F.round(scores.sensitivity(), 3).alias("sensitivity"), F.round(scores.specificity(), 3).alias("specificity"),
    )


_VALID = f"""WITH {PRED}, {sql_metrics('pred', 'model, seed, role')}, assessed AS (
  SELECT model, seed, role, mcc, auc, sensitivity, coalesce(specificity, 0) AS specificity, mcc >= 0.3e0 AS mcc_pass, auc >= 0.7e0 AS auc_pass,
    sensitivity >= 0.6e0 AS sensitivity_pass, coalesce(specificity, 0) >= 0.6e0 AS specificity_pass FROM m),
v AS (SELECT *, mcc_pass AND auc_pass AND sensitivity_pass AND specificity_pass AS overall_pass FROM assessed)"""


def _assessed(spark, folder):
    runs = M.run_table(predictions(spark, folder), ["model", "seed", "role"])
    vector = runs.select(
        "model", "seed", "role", scores.mcc().alias("mcc"), "auc", scores.sensitivity().alias("sensitivity"),
        scores.specificity(undefined_as_zero=True).alias("specificity"),
    )
    return Q.assess(vector)


_PASS = ["mcc_pass", "auc_pass", "sensitivity_pass", "specificity_pass", "overall_pass"]


@query("assess", f"{_VALID} SELECT model, seed, role, {sql_rounded(['mcc', 'auc', 'sensitivity', 'specificity'])}, {', '.join(_PASS)} FROM v")
def assess(spark, folder):
    """Threshold assessment of every run."""
    return rounded(_assessed(spark, folder), ["mcc", "auc", "sensitivity", "specificity"])


@query("validation_report", f"""{_VALID} SELECT count(*) AS n_validations, round(avg(mcc), 6) AS avg_mcc, round(max(mcc), 6) AS best_mcc,
  round(avg(auc), 6) AS avg_auc, round(max(auc), 6) AS best_auc, round(avg(overall_pass::INT), 6) AS pass_rate FROM v""")
def validation_report(spark, folder):
    """Average and best scores and the pass rate over all validations."""
    return rounded(
        Q.validation_report(_assessed(spark, folder)), ["avg_mcc", "best_mcc", "avg_auc", "best_auc", "pass_rate"]
    )


_BASE = f"""WITH {PRED}, {sql_metrics('pred', 'model')}, long AS (
  SELECT model, 'mcc' AS metric, mcc AS value FROM m UNION ALL SELECT model, 'auc', auc FROM m UNION ALL SELECT model, 'accuracy', accuracy FROM m),
base AS (SELECT * FROM (VALUES {', '.join(f"('{b}', '{m}', {v}e0)" for b, row in Q.BASELINES.items() for m, v in row.items())}) t(baseline, metric, baseline_value)),
c AS (SELECT model, baseline, metric, value, baseline_value,
  CASE WHEN baseline_value <> 0 THEN (value - baseline_value) / abs(baseline_value) * 100 ELSE value * 100 END AS improvement_pct
  FROM long JOIN base USING (metric))"""


@query("vs_baseline", f"{_BASE} SELECT model, baseline, metric, round(value, 6) AS value, baseline_value, round(improvement_pct, 6) AS improvement_pct FROM c")
def vs_baseline(spark, folder):
    """Improvement of every model over the three baselines."""
    vector = M.run_metrics(predictions(spark, folder), ["model"])
    return rounded(Q.versus_baseline(vector, ["model"]), ["value", "improvement_pct"])


@query("beats_baseline", f"""{_BASE} SELECT model, baseline, count(*) FILTER (metric IN ('mcc', 'auc') AND value < baseline_value) = 0 AS beats_baseline
FROM c GROUP BY model, baseline""")
def beats_baseline(spark, folder):
    """Whether a model reaches a baseline in MCC and AUC."""
    vector = M.run_metrics(predictions(spark, folder), ["model"])
    return Q.beats_baseline(Q.versus_baseline(vector, ["model"]), ["model"])


_STABLE = f"""WITH {PRED}, {sql_metrics('pred', 'model, seed, fold')}, s AS (
  SELECT model, count(*) AS n_folds, avg(mcc) AS mean, stddev_pop(mcc) AS std, min(mcc) AS min, max(mcc) AS max FROM m GROUP BY model)"""


@query("cv_stability", f"""{_STABLE} SELECT model, n_folds, {sql_rounded(['mean', 'std', 'min', 'max'])},
  round(CASE WHEN mean = 0 THEN 'inf'::DOUBLE ELSE std / mean END, 6) AS cv_coefficient,
  CASE WHEN mean = 0 THEN FALSE ELSE std / mean < 0.2e0 END AS is_stable, max - min > 3 * std AS has_outliers,
  concat_ws('; ', CASE WHEN NOT CASE WHEN mean = 0 THEN FALSE ELSE std / mean < 0.2e0 END THEN printf('High variability in CV scores (CV = %.2f)', std / mean) END,
    CASE WHEN max - min > 3 * std THEN 'Potential outlier folds detected' END, CASE WHEN min < 0 THEN 'Negative mcc in some folds' END) AS warnings
FROM s""")
def cv_stability(spark, folder):
    """Mean, spread, coefficient and warnings of the fold scores of every model."""
    folds = M.mcc_by_run(predictions(spark, folder), ["model", "seed", "fold"])
    out = Q.stability(folds, ["model"], F.col("mcc"))
    return rounded(out, ["mean", "std", "min", "max", "cv_coefficient"]).withColumn(
        "warnings", F.array_join("warnings", "; ")
    )


_CV = ["mcc", "auc", "accuracy", "sensitivity", "ppv"]


@query("cv_summary", f"""WITH {PRED}, {sql_metrics('pred', 'model, seed, fold')}
SELECT model, {', '.join(f'round(avg({c}), 6) AS {c}_mean, round(stddev_pop({c}), 6) AS {c}_std' for c in _CV)} FROM m GROUP BY model""")
def cv_summary(spark, folder):
    """Mean and population deviation of five scores over all folds of a model."""
    folds = M.run_metrics(predictions(spark, folder), ["model", "seed", "fold"])
    return folds.groupBy("model").agg(
        *[f for c in _CV for f in (F.round(F.avg(c), 6).alias(f"{c}_mean"), F.round(F.stddev_pop(c), 6).alias(f"{c}_std"))]
    )


@query("ensemble_mean", f"""WITH {PRED} SELECT id, model, round(avg(prob), 9) AS prob FROM pred WHERE role = 'test' GROUP BY id, model""")
def ensemble_mean(spark, folder):
    """Mean probability of a model's runs for every test row."""
    return rounded(K.ensemble_mean(predictions(spark, folder).filter("role = 'test'")), ["prob"], 9)


def _sql_oof(shared: bool) -> str:
    count = "count(*)" if shared else "count(*) FILTER (model = '{m}')"
    cols = ", ".join(
        f"round(coalesce(sum(prob) FILTER (model = '{m}') / nullif({count.format(m=m)}, 0), 0), 9) AS {m}" for m in MODELS
    )
    return f"WITH {PRED} SELECT id, {cols} FROM pred WHERE role = 'fold_val' GROUP BY id"


def _oof(spark, folder, shared):
    rows = predictions(spark, folder).filter("role = 'fold_val'")
    return rounded(K.oof_mean(rows, MODELS, shared_count=shared), MODELS, 9)


@query("oof_mean", _sql_oof(False))
def oof_mean(spark, folder):
    """Out-of-fold meta features, each model's own mean."""
    return _oof(spark, folder, False)


@query("oof_legacy", _sql_oof(True))
def oof_legacy(spark, folder):
    """Out-of-fold meta features divided by the count of all models together."""
    return _oof(spark, folder, True)


_PAIR = f"""WITH {PRED}, a AS (SELECT id, avg(prob) AS p FROM pred WHERE model = 'lr' AND role <> 'holdout' GROUP BY id),
b AS (SELECT id, avg(prob) AS p FROM pred WHERE model = 'rf' AND role <> 'fold_val' GROUP BY id),
pair AS (SELECT coalesce(a.id, b.id) AS id, a.p AS prob_lr, (a.p > 0.5e0)::INT AS class_lr, b.p AS prob_rf, (b.p > 0.5e0)::INT AS class_rf
  FROM a FULL JOIN b ON a.id = b.id)"""


def _pair(spark, folder):
    means = K.ensemble_mean(predictions(spark, folder), ["id", "model", "role"]).withColumn(
        "cls", scores.threshold_class(F.col("prob"))
    )
    a = means.filter("model = 'lr' AND role <> 'holdout'")
    b = means.filter("model = 'rf' AND role <> 'fold_val'")
    return K.compare_pair(a, b, ("lr", "rf"))


@query("compare_pair", f"{_PAIR} SELECT id, round(prob_lr, 9) AS prob_lr, class_lr, round(prob_rf, 9) AS prob_rf, class_rf FROM pair")
def compare_pair(spark, folder):
    """Two models side by side, a missing side null."""
    return rounded(_pair(spark, folder), ["prob_lr", "prob_rf"], 9)


@query("agreement", f"""{_PAIR} SELECT count(*) AS n_both, round(avg((class_lr = class_rf)::INT), 6) AS agreement, round(corr(prob_lr, prob_rf), 6) AS prob_corr
FROM pair WHERE class_lr IS NOT NULL AND class_rf IS NOT NULL""")
def agreement(spark, folder):
    """Agreement rate and probability correlation of two models."""
    out = M.agreement(_pair(spark, folder), "prob_lr", "prob_rf", "class_lr", "class_rf")
    return rounded(out, ["agreement", "prob_corr"])


@query("format_report", f"""WITH {PRED}, {sql_metrics('pred', 'model')}
SELECT model, printf('accuracy=%.3f, mcc=%.3f, auc=%.3f', accuracy, mcc, auc) AS line, printf('%.1f%%', accuracy * 100) AS accuracy_pct FROM m""")
def format_report(spark, folder):
    """Report lines with three places and percentages with one."""
    vector = M.run_metrics(predictions(spark, folder), ["model"])
    return vector.select(
        "model",
        text.report_lines({c: F.col(c) for c in ("accuracy", "mcc", "auc")}).alias("line"),
        text.percent_text(F.col("accuracy")).alias("accuracy_pct"),
    )


# -- selection of runs -------------------------------------------------------------------------------------------------

_SCORES = f"""WITH {PRED}, {sql_metrics('pred', 'model, seed, fold')}, scores AS (SELECT model, seed || '_skf_' || fold AS split, mcc FROM m)"""


def _split_scores(spark, folder):
    """The wide score table: one row per split, one MCC column per model."""
    folds = M.mcc_by_run(predictions(spark, folder), ["model", "seed", "fold"])
    split = F.concat_ws("_skf_", F.col("seed").cast("string"), F.col("fold").cast("string"))
    return (
        folds.groupBy(split.alias("split")).pivot("model", list(MODELS)).agg(F.max("mcc"))
        .select("split", *[F.col(m).alias(f"{m}_MCC") for m in MODELS])
    )


@query("mcc_band", f"{_SCORES} SELECT DISTINCT model, split, round(mcc, 6) AS mcc FROM scores WHERE mcc BETWEEN 0.128e0 AND 0.351e0")
def mcc_band(spark, folder):
    """Runs whose validation MCC lies in the band."""
    return rounded(S.in_band(S.scores_long(_split_scores(spark, folder), "split")).distinct(), ["mcc"])


@query("top_fraction", f"""{_SCORES}, r AS (SELECT model, split, mcc, row_number() OVER (PARTITION BY model ORDER BY mcc DESC, split DESC) AS rank,
  greatest(1, floor(0.7e0 * count(*) OVER (PARTITION BY model))) AS keep FROM scores)
SELECT model, split, round(mcc, 6) AS mcc, rank FROM r WHERE rank <= keep""")
def top_fraction(spark, folder):
    """The best 70 percent of every model's runs."""
    long = S.scores_long(_split_scores(spark, folder), "split")
    return rounded(S.top_fraction(long, "model", "mcc", ["split"]), ["mcc"])


@query("split_value", f"""{_SCORES} SELECT split, round(sum(mcc), 6) AS value FROM scores WHERE model <> 'knn' GROUP BY split""")
def split_value(spark, folder):
    """Sum of the four non-neighbour MCC columns of a split."""
    wide = _split_scores(spark, folder)
    return wide.select("split", F.round(sum(F.col(f"{m}_MCC") for m in ("lr", "svm", "rf", "xgboost")), 6).alias("value"))


@query("leaderboard", f"""WITH {PRED}, {sql_metrics('pred', 'model')}
SELECT model, {sql_rounded(['mcc', 'auc', 'accuracy'])}, row_number() OVER (ORDER BY mcc DESC, model) = 1 AS is_best FROM m""")
def leaderboard(spark, folder):
    """Models by MCC, the best one marked."""
    vector = M.run_metrics(predictions(spark, folder), ["model"]).select("model", "mcc", "auc", "accuracy")
    place = F.row_number().over(Window.orderBy(F.desc("mcc"), "model"))  # one row per model
    ordered = S.leaderboard(vector.withColumn("is_best", place == 1), "mcc", "model")
    return rounded(ordered, ["mcc", "auc", "accuracy"])


_SELECT = f"""{_SCORES}, sel AS (SELECT DISTINCT model, split_part(split, '_skf_', 1)::INT AS seed, split_part(split, '_skf_', 2)::INT AS fold
  FROM scores WHERE mcc BETWEEN 0.128e0 AND 0.351e0)"""


def _selected_runs(spark, folder):
    long = S.in_band(S.scores_long(_split_scores(spark, folder), "split"))
    part = lambda i: F.split_part("split", F.lit("_skf_"), F.lit(i)).cast("int")
    return long.select("model", part(1).alias("seed"), part(2).alias("fold")).distinct()


@query("selected_preds", f"""{_SELECT} SELECT p.id, p.model, p.seed, p.fold, p.prob FROM pred p SEMI JOIN sel s ON p.model = s.model AND p.seed = s.seed AND p.fold = s.fold
WHERE role = 'holdout'""")
def selected_preds(spark, folder):
    """Hold-out predictions of the selected runs."""
    pred = predictions(spark, folder).filter("role = 'holdout'")
    runs = _selected_runs(spark, folder)
    return K.selected(pred, runs, ["model", "seed", "fold"]).select("id", "model", "seed", "fold", "prob")


def _sql_wide(where: str) -> str:
    cols = ", ".join(f"max(prob) FILTER (model || '_' || seed = '{r}') AS {r}" for r in RUN_NAMES)
    return f"WITH {PRED} SELECT id, y_true, {cols} FROM pred WHERE {where} GROUP BY id, y_true"


@query("wide_probs", _sql_wide("role = 'test'"))
def wide_probs(spark, folder):
    """Test probabilities, one column per run named by model and seed."""
    pred = predictions(spark, folder).filter("role = 'test'")
    return K.wide(pred, ["id", "y_true"], K.run_name(), RUN_NAMES)


@query("stack_wide", _sql_wide("role = 'holdout'"))
def stack_wide(spark, folder):
    """The five model tables glued on the id by one pivot."""
    pred = predictions(spark, folder).filter("role = 'holdout'")
    return K.wide(pred, ["id", "y_true"], K.run_name(), RUN_NAMES)
