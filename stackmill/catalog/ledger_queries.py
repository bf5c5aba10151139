"""The run ledger and the text formats of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from stackmill.catalog.inputs import LEDGER, METRIC_COLUMNS, PRED, actions, ledger, predictions, sql_metrics
from stackmill.catalog.metrics_queries import rounded
from stackmill.catalog.registry import query
from stackmill.functions import text
from stackmill.operators import ledger as L
from stackmill.operators import metrics as M
from stackmill.sources.readers import table

_BEST = f"""WITH {LEDGER}, before AS (SELECT *, greatest(0, coalesce(max(score) OVER (PARTITION BY run ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS best_before FROM ledger),
best AS (SELECT *, score > best_before AS improved, greatest(best_before, score) AS best_after FROM before)"""


def _best(spark, folder):
    rows = actions(spark, folder)
    return L.best_so_far(rows, "run", "ts", "event_id", "score", F.date_trunc("hour", "ts"))


@query("best_so_far", f"{_BEST} SELECT run, iteration, round(best_before, 6) AS best_before, round(best_after, 6) AS best_after, improved FROM best")
def best_so_far(spark, folder):
    """Running best score of every run and its strict improvements."""
    return rounded(_best(spark, folder), ["best_before", "best_after"]).select(
        "run", "iteration", "best_before", "best_after", "improved"
    )


@query("recent_history", f"WITH {LEDGER}, r AS (SELECT run, iteration, action, row_number() OVER (PARTITION BY run ORDER BY iteration DESC) AS age FROM ledger) SELECT * FROM r WHERE age <= 5")
def recent_history(spark, folder):
    """The last five actions of every run."""
    rows = ledger(spark, folder).select("run", "iteration", "action")
    return L.recent(rows, "run", [F.col("iteration").desc()], 5)


@query("checkpoints", f"WITH {LEDGER} SELECT run, iteration, 'checkpoint_iter_' || iteration AS checkpoint FROM ledger WHERE iteration % 5 = 0")
def checkpoints(spark, folder):
    """The iterations at which a run's state is saved."""
    return L.checkpoints(ledger(spark, folder)).select("run", "iteration", "checkpoint")


@query("goal_reached", f"""{_BEST} SELECT run, min(iteration) FILTER (best_after >= 0.6) AS goal_iteration,
  least(min(iteration) FILTER (best_after >= 0.6), min(iteration) FILTER (iteration >= 50)) AS stop_iteration, round(max(best_after), 6) AS best_score FROM best GROUP BY run""")
def goal_reached(spark, folder):
    """Where a run reaches the target or its last allowed iteration."""
    return rounded(L.goal_reached(_best(spark, folder), "run", 0.6, 50), ["best_score"])


@query("state_summary", f"""WITH {LEDGER} SELECT run, max(iteration) AS iteration, round(greatest(max(score), 0), 6) AS best_score,
  count(*) FILTER (action = 'purchase') AS models_trained, count(*) FILTER (NOT success) AS errors, count(DISTINCT action) AS n_actions,
  arg_max(action, iteration) AS last_action FROM ledger GROUP BY run""")
def state_summary(spark, folder):
    """State of every run: iterations, best score, trained models, errors, last action."""
    out = L.state_summary(
        ledger(spark, folder), "run", "score", "action", ~F.col("success"), F.col("action") == "purchase"
    )
    return rounded(out, ["best_score"])


@query("experiment_log", f"""WITH {LEDGER} SELECT run, iteration, action, CASE WHEN success THEN 'ok' ELSE 'failed' END AS outcome, round(score, 6) AS mcc FROM ledger""")
def experiment_log(spark, folder):
    """Iteration, action, outcome and score of every run in the order of time."""
    return ledger(spark, folder).select(
        "run", "iteration", "action", F.when(F.col("success"), "ok").otherwise("failed").alias("outcome"),
        F.round("score", 6).alias("mcc"),
    )


@query("truncate_log", "SELECT doc_id, left(text, 500) AS result, left(text, 200) AS observation FROM documents")
def truncate_log(spark, folder):
    """Log texts cut to 500 and 200 characters."""
    docs = table(spark, folder, "documents")
    return docs.select(
        "doc_id", text.clip_text(F.col("text"), 500).alias("result"), text.clip_text(F.col("text"), 200).alias("observation")
    )


@query("parse_perf", f"""WITH {PRED}, {sql_metrics('pred', 'model, seed, fold')}
SELECT 'name_' || model || '_' || seed || '_' || fold AS name, tn, fp, fn, tp, {', '.join(f'round(round({c}, 6), 3) AS {c}' for c in METRIC_COLUMNS)} FROM m""")
def parse_perf(spark, folder):
    """Performance lists stored as text, parsed back to 13 typed columns."""
    runs = M.run_metrics(predictions(spark, folder), ["model", "seed", "fold"])
    order = ["tn", "fp", "fn", "tp", "accuracy", "auc", "sensitivity", "specificity", "ppv", "npv", "f1", "mcc", "balanced_accuracy"]
    stored = runs.select(
        F.concat_ws("_", F.lit("name"), "model", F.col("seed").cast("string"), F.col("fold").cast("string")).alias("name"),
        text.format_performance([F.col(c) if c in ("tn", "fp", "fn", "tp") else F.round(c, 6) for c in order]).alias("value"),
    )
    parsed = text.parse_performance(F.col("value"))
    return stored.select("name", *[c.alias(n) for n, c in parsed.items()])


@query("parse_run_name", f"WITH {PRED} SELECT DISTINCT model, seed, fold, 'x_K_7' AS tag FROM pred")
def parse_run_name(spark, folder):
    """Run names parsed to model, seed, fold and tag."""
    names = predictions(spark, folder).select(
        F.format_string("prob_%s_seed_%d_skf_%d_paras_x_K_7", "model", "seed", "fold").alias("name")
    ).distinct()
    return names.select(*[c.alias(n) for n, c in text.parse_run_name(F.col("name")).items()])
