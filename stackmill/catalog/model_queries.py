"""Model fits and multi-job plans on labelled documents. Fits are approximate across engines, so none has an SQL text."""

from __future__ import annotations

from pyspark.sql import functions as F

from stackmill.catalog.inputs import described, labelled, mechanistic, predictions
from stackmill.catalog.registry import query
from stackmill.catalog.split_queries import _blocks, _probs
from stackmill.functions.text import DESCRIPTOR_NAMES
from stackmill.operators import metrics as M
from stackmill.operators import scaling as C
from stackmill.operators import splits as P
from stackmill.operators import stacking as K
from stackmill.plans import bank as B
from stackmill.plans import estimators as E
from stackmill.plans import stacking as S
from stackmill.session import scratch_path, stored
from stackmill.sources.readers import table


def _truth(spark, folder):
    return table(spark, folder, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))


def _halves(spark, folder):
    """Labelled, standardised documents: a training part and a stratified hold-out."""
    marks = P.stratified_holdout(_truth(spark, folder), "id", "label")
    joined = stored(labelled(spark, folder).join(marks.select("id", "is_holdout"), "id"), "halves")
    stats = C.feature_stats(joined.filter("is_holdout = 0")).first()
    ready = S.standardized(joined, stats)
    return ready.filter("is_holdout = 0"), ready.filter("is_holdout = 1")


def _scored(fitted, rows):
    return fitted.score(rows).select("id", "label", F.round("prob", 6).alias("prob"))


def _fit_query(kind, params):
    def run(spark, folder):
        train, rest = _halves(spark, folder)
        return _scored(E.fit(kind, train, params), train.unionByName(rest))

    return run


_NUMERIC, _RANKED = E.PROFILES["numeric"], E.PROFILES["ranked"]
_FITS = {
    "fit_lr": ("lr", _NUMERIC["lr"], "Logistic regression with an L2 penalty."),
    "fit_rf": ("rf", _NUMERIC["rf"], "Random forest with balanced class weights."),
    "fit_gbt_xgb": ("xgboost", _NUMERIC["xgboost"], "Second-order boosted trees with row sampling and a positive-class weight."),
    "fit_gbt": ("gb", _RANKED["gb"], "Gradient boosting on residuals with Newton leaves."),
    "fit_svm_rff": ("svm", _NUMERIC["svm"], "Support vector machine with an RBF kernel by random features, calibrated."),
    "fit_svm_poly": ("svm", E.PROFILES["embedded"]["svm"], "Support vector machine with a cubic kernel of all features by tensor sketches, calibrated."),
    "fit_svm_linear": ("svm", {**_NUMERIC["svm"], "kernel": "linear"}, "Linear support vector machine, calibrated."),
    "fit_mlp": ("mlp", _RANKED["mlp"], "Multi-layer perceptron."),
    "fit_dnn": ("dnn", E.DNN, "Four hidden layers of 128 nodes with batch normalisation and dropout."),
}
for _name, (_kind, _params, _about) in _FITS.items():
    _run = _fit_query(_kind, _params)
    _run.__doc__ = _about
    query(_name)(_run)


def _meta(rows, shape):
    """Meta-learner on the rows before 1997, its probabilities for the later ones."""
    stats, meta = S.fit_meta(rows.filter("year < 1997").select("id", "label", "features"), shape)
    later = rows.filter("year >= 1997").select("id", "label", "features")
    return _scored(meta, S.standardized(later, stats))


def _meta_rows(spark, folder, vector):
    truth = predictions(spark, folder).filter("model = 'lr' AND seed = 0").select("id", F.col("y_true").alias("label"))
    years = mechanistic(spark, folder).select("id", "year")
    rows = _probs(spark, folder).join(_blocks(spark, folder), "id").join(truth, "id").join(years, "id")
    return stored(rows.select("id", "label", "year", vector.alias("features")), "meta")


@query("fit_meta")
def fit_meta(spark, folder):
    """Meta-learner with layers 64-32-16 on the base probabilities."""
    return _meta(_meta_rows(spark, folder, F.col("probs")), E.META["base"])


@query("fit_meta_v2")
def fit_meta_v2(spark, folder):
    """Meta-learner with layers 32-16 on probabilities and mechanistic columns."""
    vector = K.meta_vector_v2(F.col("probs"), F.concat("mech", "flags"))
    return _meta(_meta_rows(spark, folder, vector), E.META["v2"])


@query("fit_meta_v3")
def fit_meta_v3(spark, folder):
    """Meta-learner with layers 48-24-12 on probabilities, mechanistic, enzyme and flag columns and the interaction."""
    vector = K.meta_vector_v3(F.col("probs"), F.col("mech"), F.col("cyp"), F.col("flags"))
    return _meta(_meta_rows(spark, folder, vector), E.META["v3"])


def _rows(spark, folder):
    return stored(labelled(spark, folder), "labelled")


def _small(*names):
    return {n: E.SMALL[n] for n in names}


def _linear(*names):
    return {n: _NUMERIC[n] for n in names}


def _round(df):
    return df.withColumns({c: F.round(c, 6) for c, t in df.dtypes if t == "double"})


@query("train_model")
def train_model(spark, folder):
    """A logistic regression with the default parameters, scored on the hold-out."""
    train, rest = _halves(spark, folder)
    return _scored(S.train_model(train, "logistic_regression"), rest)


@query("cross_validate")
def cross_validate(spark, folder):
    """Three repeats of five folds: mean and deviation of five scores per model."""
    folds = S.cross_validate(_rows(spark, folder), {"lr": _NUMERIC["lr"], **_small("rf")})
    return _round(S.cv_summary(folds))


@query("compare_models")
def compare_models(spark, folder):
    """Three model types by cross-validated MCC."""
    return _round(S.compare_models(_rows(spark, folder), {**_linear("knn", "lr"), **_small("rf")}))


@query("hyper_search")
def hyper_search(spark, folder):
    """Three regularisation strengths by cross-validated MCC."""
    return _round(S.hyperparameter_search(_rows(spark, folder), "logistic_regression", method="grid"))


@query("train_ensemble")
def train_ensemble(spark, folder):
    """Stacking with a logistic meta-learner: nested metrics of five folds."""
    folds, _, _ = S.train_ensemble(_rows(spark, folder), {**_small("rf", "xgboost"), **_linear("lr", "svm")})
    return _round(folds)


@query("validate_external")
def validate_external(spark, folder):
    """A fitted model scored and assessed on the hold-out."""
    train, rest = _halves(spark, folder)
    return _round(S.validate_external(E.fit("lr", train, _NUMERIC["lr"]), rest.drop("is_holdout")))


def _roles(spark, folder):
    marks = P.stratified_holdout(_truth(spark, folder), "id", "label")
    return labelled(spark, folder).join(marks.select("id", F.when(F.col("is_holdout") == 1, "holdout").otherwise("train").alias("role")), "id")


@query("base_bank")
def base_bank(spark, folder):
    """Five kinds of base classifier on 20 repeats of five folds, all with their full parameters: metrics of every run."""
    pred = B.run_bank(_roles(spark, folder), dict(_NUMERIC)).predictions(spark)
    return _round(M.run_metrics(pred, ["model", "seed", "fold", "role"]))


@query("train")
def train(spark, folder):
    """End-to-end training: metrics of the base models and the stack on the hold-out."""
    _, report = S.train(_rows(spark, folder), {**_linear("knn", "lr", "svm"), **_small("rf")})
    return _round(report)


@query("predict")
def predict(spark, folder):
    """End-to-end scoring of all documents with a saved and reloaded bundle."""
    ensemble, _ = S.train(_rows(spark, folder), {**_linear("knn", "lr"), **_small("rf")}, seeds=[0, 1])
    path = S.save(ensemble, scratch_path(spark, "bundle"), DESCRIPTOR_NAMES)
    rows = described(spark, folder).withColumnRenamed("doc_id", "id")
    return _round(S.predict(S.load(spark, path), rows))


@query("model_roundtrip")
def model_roundtrip(spark, folder):
    """A model saved and loaded again: both score every row alike."""
    train, rest = _halves(spark, folder)
    fitted = E.fit("rf", train, _NUMERIC["rf"])
    path = scratch_path(spark, "model")
    fitted.save(path)
    again = E.Fitted.load(spark, path)
    both = again.score(fitted.score(rest, "before"), "after")
    return both.agg(F.count("*").alias("n"), F.max(F.abs(F.col("before") - F.col("after"))).alias("max_gap"))
