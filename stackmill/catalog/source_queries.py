"""Sources and sinks: every query writes table rows to the shared folder and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from stackmill.catalog.inputs import LEDGER, METRIC_COLUMNS, MODELS, PRED, ledger, predictions, sql_metrics, sql_rounded
from stackmill.catalog.metrics_queries import rounded
from stackmill.catalog.registry import query
from stackmill.operators import metrics as M
from stackmill.operators import stacking as K
from stackmill.operators.clean import concern_key, map_labels
from stackmill.session import scratch_path
from stackmill.sources import readers as R
from stackmill.sources import writers as W
from stackmill.sources.readers import table

# The layout of a molecule record.
PROGRAM_LINE = "     Generated          2D"
COUNTS_TAIL = "  0  0  0  0  0  0  0  0999 V2000"


@query("scan_csv", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_csv(spark, folder):
    """CSV with a header and an unnamed index column, read under an explicit schema."""
    path = scratch_path(spark, "csv")
    rows = table(spark, folder, "customer")
    W.write_predictions(rows.select(F.col("c_custkey").cast("string").alias(" "), "*"), path)
    schema = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    return R.scan_csv(spark, path, schema, unnamed_index=True)


_CONCERN = "CASE WHEN toxic = 1 THEN 'vMost-DILI-concern' WHEN quality = 0 THEN 'vLess-DILI-concern' WHEN doc_id % 7 = 0 THEN 'Ambiguous-DILI-concern' ELSE 'vNo-DILI-Concern' END"


@query("load_labels", f"SELECT 'doc ' || doc_id AS CompoundName, (quality = 0 OR toxic = 1)::INT AS label, 'level ' || toxic AS SeverityClass FROM labels WHERE {_CONCERN} NOT LIKE 'Ambiguous%'")
def load_labels(spark, folder):
    """Label list with a title line above the header: mapped, excluded categories dropped."""
    path = scratch_path(spark, "labels")
    title, header = "Ranked list, version 2", "CompoundName,vDILI-Concern,SeverityClass"
    row = F.concat(F.lit("doc "), "doc_id", F.lit(","), F.expr(_CONCERN), F.lit(",level "), "toxic")
    body = table(spark, folder, "labels").select(F.floor(F.col("doc_id") / 100_000).alias("part"), F.lit(2).alias("place"), row.alias("value"))
    heads = F.explode(F.array(F.struct(F.lit(0).alias("place"), F.lit(title).alias("value")), F.struct(F.lit(1).alias("place"), F.lit(header).alias("value"))))
    tops = body.select("part").distinct().select("part", heads.alias("h")).select("part", "h.place", "h.value")
    # every part file starts with the title and the header
    body.unionByName(tops).repartition("part").sortWithinPartitions("part", "place").select("value").write.text(path)
    rows = map_labels(R.scan_titled_csv(spark, path), concern_key(F.col("vDILI-Concern")))
    return rows.select("CompoundName", "label", "SeverityClass")


def _records(spark, folder, extra_line: bool):
    """One molecule record per part: p_size atoms, p_size - 1 bonds in a chain, two properties."""
    lines = lambda n, line: F.transform(F.sequence(F.lit(1), n), line)
    atoms = lines(F.col("p_size"), lambda i: F.concat(F.lpad(i.cast("string"), 10, " "), F.lit("    0.0000    0.0000 C   0  0")))
    bonds = F.when(
        F.col("p_size") > 1,
        lines(F.col("p_size") - 1, lambda i: F.concat(F.lpad(i.cast("string"), 3, " "), F.lpad((i + 1).cast("string"), 3, " "), F.lit("  1  0"))),
    ).otherwise(F.array().cast("array<string>"))
    counts = F.concat(F.lpad(F.col("p_size").cast("string"), 3, " "), F.lpad((F.col("p_size") - 1).cast("string"), 3, " "), F.lit(COUNTS_TAIL))
    head = [F.col("p_name"), F.lit(PROGRAM_LINE), *([F.lit("")] if extra_line else []), counts]
    tail = [
        F.lit("M  END"), F.lit(">  <Key>  (1) "), F.col("p_partkey").cast("string"), F.lit(""),
        F.lit(">  <Type>  (1) "), F.col("p_type"), F.lit(""), F.lit(""),
    ]
    return table(spark, folder, "part").select(F.array_join(F.concat(F.array(*head), atoms, bonds, F.array(*tail)), "\n").alias("record"))


@query("sdf_scan", "SELECT p_partkey AS key, p_name AS title, p_type AS type, p_size AS n_atoms, p_size - 1 AS n_bonds FROM part")
def sdf_scan(spark, folder):
    """Molecule records: title, counts line and properties, one row per record."""
    path = scratch_path(spark, "sdf")
    _records(spark, folder, False).write.option("lineSep", R.RECORD_END).text(path)
    rows = R.scan_sdf(spark, path)
    return rows.select(F.col("properties")["Key"].cast("bigint").alias("key"), "title", F.col("properties")["Type"].alias("type"), "n_atoms", "n_bonds")


@query("sdf_normalize", "SELECT p_partkey AS key, 2 * p_size + 10 AS n_lines, p_size AS n_atoms FROM part")
def sdf_normalize(spark, folder):
    """Records with a superfluous third line, normalised, written and read again."""
    path = scratch_path(spark, "sdf")
    W.write_records(_records(spark, folder, True), path)
    rows = R.scan_sdf(spark, path)
    lines = F.split("record", "\n")
    third = F.get(lines, F.lit(2))
    return rows.filter(third.contains("V2000")).select(
        F.col("properties")["Key"].cast("bigint").alias("key"), F.size(lines).alias("n_lines"), F.trim(F.substring(third, 1, 3)).cast("int").alias("n_atoms")
    )


_CATALOG = ("supplier", "nation", "labels")


def _data_folder(spark, folder):
    path = scratch_path(spark, "catalog")
    for name in _CATALOG:
        W.write_predictions(table(spark, folder, name), f"{path}/{name}")
    _records(spark, folder, False).write.option("lineSep", R.RECORD_END).text(f"{path}/molecules.sdf")
    return path


def _owner(path):
    return F.element_at(F.split(path, "/"), -2)


@query("find_data", """SELECT 'supplier' AS folder, '.csv' AS type, 's_suppkey,s_name,s_nationkey,s_acctbal' AS columns, (SELECT count(*) FROM supplier) AS n_rows
UNION ALL SELECT 'nation', '.csv', 'n_nationkey,n_name,n_regionkey', (SELECT count(*) FROM nation)
UNION ALL SELECT 'labels', '.csv', 'doc_id,quality,toxic', (SELECT count(*) FROM labels)""")
def find_data(spark, folder):
    """Data files below a folder with their columns and rows."""
    path = _data_folder(spark, folder)
    files = R.find_files(spark, path).filter(F.col("type") == ".csv")
    names = [r["path"] for r in files.select("path").collect()]  # the listing, one row per file
    previews = R.preview_columns(spark, names)
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(path)
    counts = lines.groupBy(_owner(F.input_file_name()).alias("folder")).agg(F.count("*").alias("n_lines"))
    found = files.join(previews, "path").groupBy(_owner(F.col("path")).alias("folder"), "type").agg(
        F.count("*").alias("n_files"), F.max(F.array_join("columns", ",")).alias("columns")
    )
    return found.join(counts, "folder").select("folder", "type", "columns", (F.col("n_lines") - F.col("n_files")).alias("n_rows"))


@query("pick_dataset", "SELECT 'labels' AS folder, '.csv' AS type")
def pick_dataset(spark, folder):
    """The preferred data file of a folder."""
    files = R.find_files(spark, _data_folder(spark, folder)).withColumn("name", F.concat_ws("/", _owner(F.col("path")), "name"))
    return R.pick_file(files, "labels", ["nation", "supplier"]).select(_owner(F.col("path")).alias("folder"), "type")


@query("write_pred", f"WITH {PRED} SELECT id, {', '.join(f'round(avg(prob) FILTER (model = {chr(39)}{m}{chr(39)}), 9) AS {m}' for m in MODELS)} FROM pred WHERE role = 'test' GROUP BY id")
def write_pred(spark, folder):
    """Predictions written as CSV and read back."""
    path = scratch_path(spark, "pred")
    test = predictions(spark, folder).filter("role = 'test'")
    W.write_predictions(K.wide(test, ["id"], F.col("model"), MODELS, how=F.avg), path)
    rows = R.scan_csv(spark, path, "id bigint, " + ", ".join(f"{m} double" for m in MODELS))
    return rounded(rows, MODELS, 9)


@query("write_partitioned", f"WITH {PRED} SELECT id, model, seed, prob FROM pred WHERE role = 'holdout' AND model IN ('knn', 'rf')")
def write_partitioned(spark, folder):
    """A table partitioned by model and role; two models' hold-out folders are read."""
    path = W.write_partitioned(predictions(spark, folder), scratch_path(spark, "parts"))
    kept = spark.read.parquet(path).filter(F.col("role").isin("holdout") & F.col("model").isin("knn", "rf"))
    return kept.select("id", "model", "seed", "prob")


@query("report_json", f"WITH {PRED}, {sql_metrics('pred', 'model')} SELECT model, tn, fp, fn, tp, {sql_rounded(METRIC_COLUMNS)} FROM m")
def report_json(spark, folder):
    """Counts and metrics per model as a JSON report, read back."""
    path = scratch_path(spark, "report")
    report = rounded(M.run_metrics(predictions(spark, folder), ["model"]), METRIC_COLUMNS)
    W.write_report(report.select("model", F.struct("tn", "fp", "fn", "tp").alias("counts"), F.struct(*METRIC_COLUMNS).alias("metrics")), path)
    ddl = "model string, counts struct<tn:bigint,fp:bigint,fn:bigint,tp:bigint>, metrics struct<" + ",".join(f"{c}:double" for c in METRIC_COLUMNS) + ">"
    return spark.read.schema(ddl).json(path).select("model", "counts.*", "metrics.*")


@query("read_ledger", f"WITH {LEDGER} SELECT run, iteration, action, left(props, 500) AS result, success FROM ledger")
def read_ledger(spark, folder):
    """State documents with nested histories, flattened to one row per action."""
    path = scratch_path(spark, "ledger")
    entry = F.struct("iteration", F.lit("execute").alias("phase"), "action", F.substring("props", 1, 500).alias("result"), "success", F.col("ts").cast("string").alias("timestamp"))
    # one document holds 32 neighbouring actions, whichever run they belong to
    rows = ledger(spark, folder)
    documents = rows.groupBy(F.floor(F.col("event_id") / 32).alias("d"), F.col("run").cast("string").alias("goal")).agg(
        F.max("iteration").alias("iteration"), F.array_sort(F.collect_list(entry)).alias("history")
    )
    documents.drop("d").write.json(path)
    state = spark.read.schema(R.LEDGER_SCHEMA).json(path)
    return state.select(F.col("goal").cast("bigint").alias("run"), F.explode("history").alias("h")).select(
        "run", "h.iteration", "h.action", "h.result", "h.success"
    )
