"""Document boundaries of flat token files: vectorised search for the end-of-document id, blocks stitched by a prefix scan."""

from __future__ import annotations

import base64
import posixpath
import uuid
from pathlib import Path

import numpy as np
import pandas as pd
import tiktoken
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stackmill.llm.common import chunks, documents
from stackmill.session import scratch_path, stored

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the public vocabulary cuts text before merging; fixed with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The free id of the vocabulary, used as the end-of-document id.
END = 50256
KIND = "<u2"
BLOCK = 1 << 20
#: Blocks per group of the upper level of the scan.
GROUP = 1024


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")


def write_token_files(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end: int = END, kind: str = KIND) -> DataFrame:
    """Write every text as token ids plus ``end`` into flat files of the shared ``folder``; one file per task attempt.

    Returns the list ``file, position, doc_id`` (position: from 0 in the file), made by the same attempt, so that a file of
    an attempt that was lost is simply not listed. Evaluate the result once (a stored table): every evaluation writes new
    files. Special strings in a text are ordinary text, so ``end`` occurs at ends only. Null texts are written as empty ones.
    """
    raw = Path(vocabulary).read_bytes()

    def run(frames):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        coder = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        name = f"tokens-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.bin"
        out, position = None, 0
        for frame in frames:
            for part, texts in chunks(frame):
                out = out or store.open_output_stream(posixpath.join(root, name))
                for text in texts:
                    out.write(np.array([*coder.encode_ordinary(text), end], kind).tobytes())
                yield pd.DataFrame({"file": posixpath.join(folder, name), "position": np.arange(position, position + len(part)), "doc_id": part["doc_id"].astype("Int64").to_numpy(object)})
                position += len(part)
        if out:
            out.close()

    return docs.select("doc_id", "text").mapInPandas(run, "file string, position long, doc_id long")


def block_separators(files: DataFrame, end: int = END, kind: str = KIND, block: int = BLOCK) -> DataFrame:
    """``file, block, n_tokens, ends`` of every block of ``block`` tokens; ``ends``: places of ``end`` in the whole file.

    ``files`` has ``file`` and ``bytes``. Each task reads only the byte range of its blocks. A last byte that does not fill
    a token is ignored.
    """
    width = np.dtype(kind).itemsize
    wide = F.lit(block * width)
    ranges = files.where(f"bytes >= {width}").select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - width) / wide))).alias("block"))
    cores = files.sparkSession.sparkContext.defaultParallelism

    def run(frames):
        for frame in frames:
            for name, rows in frame.groupby("file"):
                store, path = _open(name)
                with store.open_input_file(path) as source:
                    for row in rows.itertuples():
                        start = row.block * block * width
                        data = source.read_at(min(block * width, row.bytes // width * width - start), start)
                        found = np.flatnonzero(np.frombuffer(data, kind) == end) + row.block * block
                        yield pd.DataFrame({"file": [name], "block": [row.block], "n_tokens": [len(data) // width], "ends": [found]})

    return ranges.repartition(4 * cores, "file", "block").mapInPandas(run, "file string, block long, n_tokens long, ends array<long>")


def scan(files: DataFrame, end: int = END, kind: str = KIND, block: int = BLOCK) -> DataFrame:
    """``file, position, start, n_tokens, ended``: one row per document of the flat files (``file, bytes``).

    Blocks are searched on their own; an exclusive prefix scan over (documents ended, place of the last end) gives each
    block its first position and where its first document began. The scan has two levels, 1,024 blocks to a group, so no
    window holds a whole large file. ``n_tokens`` does not count the end id; two ends in a row are an empty document. Tokens behind the last end of
    a file are one more document with ``ended`` false. Empty files and an empty list give no rows.
    """
    found = stored(block_separators(files, end, kind, block), "separators")
    totals = found.select(
        "file", "block", F.floor(F.col("block") / GROUP).alias("part"), F.size("ends").cast("long").alias("n"),
        F.try_element_at("ends", F.lit(-1)).alias("last"), (F.col("block") * block + F.col("n_tokens")).alias("upto"),
    )

    def before(keys, order):
        return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    upper = totals.groupBy("file", "part").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.max("upto").alias("upto"))
    over = before(["file"], "part")
    carried = upper.select("file", "part", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("n0"), F.max("last").over(over).alias("last0"))
    inner = before(["file", "part"], "block")
    starts = totals.join(carried, ["file", "part"]).select(
        "file", "block",
        (F.col("n0") + F.coalesce(F.sum("n").over(inner), F.lit(0))).alias("first"),
        (F.coalesce(F.max("last").over(inner), F.col("last0"), F.lit(-1)) + 1).alias("open"),
    )
    docs = (
        found.where(F.size("ends") > 0).join(starts, ["file", "block"])
        .select("file", "first", F.posexplode(F.arrays_zip(F.col("ends").alias("upto"), F.concat(F.array("open"), F.transform(F.slice("ends", 1, F.size("ends") - 1), lambda x: x + 1)).alias("start"))).alias("k", "doc"))
        .select("file", (F.col("first") + F.col("k")).alias("position"), F.col("doc.start").alias("start"), (F.col("doc.upto") - F.col("doc.start")).alias("n_tokens"), F.lit(True).alias("ended"))
    )
    rest = upper.groupBy("file").agg(F.sum("n").alias("position"), (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start"), F.max("upto").alias("upto"))
    return docs.unionByName(rest.where("upto > start").select("file", "position", "start", (F.col("upto") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended")))


def file_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """``file, bytes`` of the flat files in a folder; the listing reads no content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def op3(spark, folder):
    """``doc_id, file, position, start, n_tokens`` of all documents, counted from flat token files alone.

    The texts are written as flat files first; the ids come back by (file, position) from the list of the writers.
    """
    target = scratch_path(spark, "tokens")
    listed = stored(write_token_files(documents(spark, folder), target), "token-list")
    name = F.regexp_extract("file", "[^/]+$", 0)
    written = listed.select(name.alias("file"), "position", "doc_id")
    if listed.isEmpty():
        return written.selectExpr("doc_id", "file", "position", "0L AS start", "0L AS n_tokens")
    used = listed.select(name.alias("__used")).distinct()
    sizes = file_sizes(spark, target).join(used, name == F.col("__used"), "left_semi")
    return scan(sizes).select(name.alias("file"), "position", "start", "n_tokens").join(written, ["file", "position"]).select("doc_id", "file", "position", "start", "n_tokens")
