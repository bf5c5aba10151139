"""CSV, titled label lists, molecule records, file discovery and ledger documents."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD_END = "$$$$\n"
DATA_PATTERNS = ("*.csv", "*.xlsx", "*.xls", "*.sdf", "*.smi")
LEDGER_SCHEMA = (
    "iteration bigint, phase string, goal string, "
    "current_best struct<model:string,mcc:double,auc:double,features:array<string>>, "
    "history array<struct<iteration:bigint,phase:string,action:string,result:string,success:boolean,timestamp:string>>, "
    "observations array<string>, errors array<string>, checkpoints array<string>"
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str, unnamed_index: bool = False) -> DataFrame:
    """A CSV table with a header under an explicit schema; a leading unnamed index column is read and dropped."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if unnamed_index:
        schema = T.StructType([T.StructField("__index", T.StringType()), *schema.fields])
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)
    return df.drop("__index")


def scan_titled_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table with one title record above its header; all columns are read as text.

    Records are parsed as CSV: commas, quotes and line ends inside quotes belong to the value. Up front only as many lines
    are read as the title and the header take. A file may repeat them or not: its first record is left out if it is the
    title, and the header if it is the first record or follows the title; a later row that looks alike is a row.
    """
    lines, n = spark.read.text(path), 4
    while True:
        got = lines.head(n)
        records = [r for r in csv.reader(row[0] + "\n" for row in got) if r]
        if len(records) > 2 or len(got) < n:  # the header record has ended
            break
        n *= 2
    title, names = records[0], [name.strip() for name in records[1]]
    schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
    rows = spark.read.schema(schema).option("multiLine", True).option("escape", '"').csv(path)
    columns = [F.col(f"`{name}`") for name in names]
    placed = rows.select(*columns, F.col("_metadata.file_path").alias("__file"), F.monotonically_increasing_id().alias("__m"))
    # a file with quoted line ends is read by one task anyway, so its order costs no more than its scan
    placed = placed.withColumn("__n", F.row_number().over(Window.partitionBy("__file").orderBy("__m")))
    is_title = (F.col("__n") == 1) & columns[0].eqNullSafe(F.lit(title[0]))
    is_header = F.col("__n") <= 2
    for column, name in zip(columns, names, strict=True):
        is_header &= F.trim(column).eqNullSafe(F.lit(name))
    return placed.filter(~is_title & ~is_header).select(*columns)


def _line_end(spark: SparkSession, path: str) -> str:
    first = spark.read.option("lineSep", "\n").text(path).head(1)
    return "\r\n" if first and first[0][0].endswith("\r") else "\n"


def scan_sdf(spark: SparkSession, path: str) -> DataFrame:
    """One row per molecule record: its content, title, atom and bond counts and named properties.

    Lines end in LF or CRLF, the same in all files of ``path``; a mixture is refused. ``record`` has LF. The value of a
    property reaches to the next blank line; the values of a name that repeats are joined by a line end.
    """
    end = _line_end(spark, path)
    raw = spark.read.option("lineSep", "$$$$" + end).text(path)
    mixed = F.col("value").rlike(r"\n\$\$\$\$\r?\n")
    whole = F.when(mixed, F.raise_error(F.lit("records with LF and with CRLF in one path"))).otherwise(
        F.regexp_replace(F.replace("value", F.lit("\r"), F.lit("")), r"(^|\n)\$\$\$\$\s*$", "$1")
    )
    records = raw.select(whole.alias("record")).filter(F.trim(F.translate("record", "\n", "")) != "")
    counts_line = F.get(F.filter("lines", lambda s: s.contains("V2000")), F.lit(0))
    item = F.lit(r"(?m)^>[^\n]*?<([^>\n]+)>[^\n]*\n((?:(?!>[^\n]*<)[^\n]++\n?+)*+)")
    found = records.select(
        "record",
        F.split("record", "\n").alias("lines"),
        F.regexp_extract_all("record", item, F.lit(1)).alias("names"),
        F.transform(F.regexp_extract_all("record", item, F.lit(2)), lambda v: F.rtrim(v, F.lit("\n"))).alias("values"),
    )
    of_name = lambda n: F.array_join(F.filter("values", lambda v, i: F.get(F.col("names"), i) == n), "\n")
    return found.select(
        "record",
        F.trim(F.get("lines", F.lit(0))).alias("title"),
        F.trim(F.substring(counts_line, 1, 3)).try_cast("int").alias("n_atoms"),
        F.trim(F.substring(counts_line, 4, 3)).try_cast("int").alias("n_bonds"),
        F.map_from_arrays(F.array_distinct("names"), F.transform(F.array_distinct("names"), of_name)).alias("properties"),
    )


def normalize_record(record):
    """Drop a record's third line when its fourth carries the V2000 counts, so that the counts move up to line three."""
    lines = F.split(record, "\n")
    moved = F.concat(F.slice(lines, 1, 2), F.slice(lines, 4, F.size(lines)))
    return F.when(F.get(lines, F.lit(3)).contains("V2000"), F.array_join(moved, "\n")).otherwise(record)


def find_files(spark: SparkSession, folder: str, patterns: Sequence[str] = DATA_PATTERNS) -> DataFrame:
    """Data files below a folder with name, size and type. Only the listing is read, not the contents."""
    glob = "{" + ",".join(patterns) + "}"
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    )
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        "path",
        name.alias("name"),
        (F.col("length") / (1024.0 * 1024.0)).alias("size_mb"),
        F.concat(F.lit("."), F.lower(F.element_at(F.split(name, r"\."), -1))).alias("type"),
        F.col("length"),
    )


def preview_columns(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The header of each CSV file. Only first lines are read, a few files at a time."""
    with ThreadPoolExecutor(max_workers=8) as pool:
        headers = list(pool.map(lambda p: spark.read.option("header", True).csv(p).columns, paths))
    rows = list(zip(paths, headers, strict=True))
    return spark.createDataFrame(rows, "path string, columns array<string>")


def pick_file(files: DataFrame, prefer: str, folders: Sequence[str]) -> DataFrame:
    """The first file whose name holds ``prefer``, else the first one; folders in the given order of rank."""
    rank = F.lit(len(folders))
    for i in reversed(range(len(folders))):
        rank = F.when(F.col("path").contains(f"/{folders[i]}/"), F.lit(i)).otherwise(rank)
    liked = F.when(F.lower("name").contains(prefer.lower()), 0).otherwise(1)
    return files.orderBy(liked, rank, "path").limit(1)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """History rows of state documents, one JSON document per file."""
    state = spark.read.schema(LEDGER_SCHEMA).option("multiLine", True).json(path)
    return flatten_history(state)


def flatten_history(state: DataFrame) -> DataFrame:
    return state.select(
        F.col("iteration").alias("last_iteration"), F.col("current_best.mcc").alias("best_mcc"), F.explode("history").alias("h")
    ).select("last_iteration", "best_mcc", "h.*")
