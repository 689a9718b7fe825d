"""Files of a folder tree and inline payloads as tables."""

from __future__ import annotations

import gzip
import os
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions.names import PRUNED, route

#: Bytes a scanned file and an inline payload may have.
MAX_FILE, MAX_PAYLOAD = 5 * 1024 * 1024, 50 * 1024 * 1024
#: What stands for a document that can't be read as text.
UNREADABLE = "Binary or unreadable file"


def contained(base: str, path: str) -> str:
    """The absolute form of ``path`` if it lies in ``base``; raises ValueError otherwise. A sibling with the same beginning isn't inside."""
    root, full = os.path.realpath(base), os.path.realpath(os.path.join(base, path))
    if full != root and not full.startswith(root.rstrip(os.sep) + os.sep):
        raise ValueError(f"{path} is outside of {base}")
    return full


def _walked(batches: Iterator[pa.RecordBatch], root: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """(filename, size_bytes) of the files at or below the entries, without hidden names and folders that a scan doesn't enter."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(root)
    for batch in batches:
        open_ = batch.column(0).to_pylist()
        names, sizes = [], []
        while open_:
            entry = open_.pop()
            info = store.get_file_info(f"{base}/{entry}")
            if info.type == fs.FileType.File and info.size <= max_bytes:
                names.append(entry)
                sizes.append(info.size)
            elif info.type == fs.FileType.Directory:
                inner = store.get_file_info(fs.FileSelector(f"{base}/{entry}"))
                open_ += [f"{entry}/{i.base_name}" for i in inner if not i.base_name.startswith(".") and i.base_name not in PRUNED]
            if len(names) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["filename", "size_bytes"])
                names, sizes = [], []
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["filename", "size_bytes"])


def _contents(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(root)
    for batch in batches:
        for k, name in enumerate(batch.column(0).to_pylist()):
            with store.open_input_stream(f"{base}/{name}") as f:
                yield pa.RecordBatch.from_arrays([*batch.slice(k, 1).columns, pa.array([f.read()], pa.binary())], names=["filename", "size_bytes", "data"])


def scan_folder(spark: SparkSession, base: str, source_id: str, path: str = ".", max_bytes: int = MAX_FILE) -> DataFrame:
    """(source_id, filename, size_bytes, content, route): readable text files below a folder that all executors see.

    The entries of the folder are walked by the executors, which enter no hidden or
    build folder, and files are read where their list is spread to. Names may begin with an
    underscore, which Spark's own file source would skip. Larger files and such that
    aren't UTF-8 are left out.
    """
    from pyarrow import fs

    root = f"file://{contained(base, path)}"
    store, folder = fs.FileSystem.from_uri(root)
    first = [i.base_name for i in store.get_file_info(fs.FileSelector(folder)) if not i.base_name.startswith(".") and i.base_name not in PRUNED]
    entries = spark.createDataFrame([(n,) for n in sorted(first)], "filename string")
    many = max(1, min(len(first), 4 * spark.sparkContext.defaultParallelism))
    files = entries.repartition(many).mapInArrow(lambda b: _walked(b, root, max_bytes), "filename string, size_bytes bigint")
    read = files.repartition(4 * spark.sparkContext.defaultParallelism, "filename").mapInArrow(lambda b: _contents(b, root), "filename string, size_bytes bigint, data binary")
    rows = read.select(F.lit(source_id).alias("source_id"), "filename", "size_bytes", F.col("data").cast("string").alias("content"))
    return rows.where(F.is_valid_utf8("content")).withColumn("route", route(F.col("filename")))


@F.pandas_udf(BinaryType())
def _gunzipped(payloads: pd.Series) -> pd.Series:
    def one(b: bytes | None) -> bytes | None:
        try:
            return None if b is None else gzip.decompress(b)
        except (OSError, EOFError, zlib.error):
            return b

    return payloads.map(one)


def decoded(rows: DataFrame, content: str = "content", is_base64: str = "is_base64", max_bytes: int = MAX_PAYLOAD) -> DataFrame:
    """``rows`` with ``text`` and ``problem``: payloads plain, in base64, or gzipped within it.

    Only gzipped payloads visit Python; one that doesn't unpack is taken as it is.
    Bad base64 and payloads over ``max_bytes`` have a problem and no text. A null
    payload has neither.
    """
    raw = F.when(F.coalesce(F.col(is_base64), F.lit(False)), F.try_to_binary(F.col(content), F.lit("base64"))).otherwise(F.encode(content, "UTF-8"))
    marked = rows.withColumn("_raw", raw)
    zipped = F.hex(F.substring("_raw", 1, 2)) == "1F8B"
    plain = marked.where(~F.coalesce(zipped, F.lit(False)))
    packed = marked.where(zipped).withColumn("_raw", _gunzipped(F.col("_raw")))
    both = plain.unionByName(packed)
    problem = F.when(F.octet_length(content) > max_bytes, "payload too large").when(F.col(content).isNotNull() & F.col("_raw").isNull(), "invalid base64")
    return both.select(*rows.columns, F.when(problem.isNull(), F.col("_raw").cast("string")).alias("text"), problem.alias("problem"))


def plain_document(filename: Column, text: Column) -> Column:
    """struct<title, sections>: a file without a parser as one section; text that isn't UTF-8 is a placeholder."""
    from ..functions.names import stem

    body = F.when(F.is_valid_utf8(text), text).otherwise(F.lit(UNREADABLE))
    return F.struct(stem(filename).alias("title"), F.array(F.struct(F.lit("Content").alias("heading"), F.lit(1).alias("level"), body.alias("content"))).alias("sections"))


def feature_enabled(name: str, table: dict[str, bool] | None = None) -> bool:
    """A toggle: FEATURE_<NAME> or <NAME> in the environment, else the table, else off."""
    for key in (f"FEATURE_{name.upper()}", name.upper()):
        if key in os.environ:
            return os.environ[key].strip().lower() in ("1", "true")
    return bool((table or {}).get(name, False))
