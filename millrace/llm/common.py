"""What the operators share: the shared folder, written tables, stable hashes and word patterns."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A-Z to a-z in bytes; other bytes stay.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000
_own_folder: list[str] = []
_shipped: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; if that is unset, a temporary one, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="millrace-"))
    return _own_folder[0]


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder, read back: cuts lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the tables behind frames that `written` returned, once nothing reads them any more."""
    for frame in frames:
        path = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(frame.written_at)
        path.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def columns(df: DataFrame, *, without: str = "") -> list[Column]:
    """All columns, whatever characters their names hold; `without` names one to leave out."""
    return [named(c) for c in df.columns if c.lower() != without]


def named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def arrow_map(df: DataFrame, function: Callable, schema: object) -> DataFrame:
    """`df.mapInArrow`, after sending this package's code to the executors once per application.

    Also lowers the session's rows per Arrow batch to `BATCH_ROWS`, as rows are whole texts here.
    """
    conf, context = df.sparkSession.conf, df.sparkSession.sparkContext
    if not 0 < int(conf.get(BATCH_SETTING)) <= BATCH_ROWS:
        conf.set(BATCH_SETTING, str(BATCH_ROWS))
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent.parent
        target = Path(tempfile.mkdtemp(prefix="millrace-code-")) / f"{package.name}.zip"
        with zipfile.ZipFile(target, "w") as z:
            for file in sorted(package.rglob("*.py")):
                z.write(file, file.relative_to(package.parent))
        context.addPyFile(str(target))
        _shipped.add(context.applicationId)
    return df.mapInArrow(function, schema)


def open_file(uri: str) -> pa.NativeFile:
    """A file in any store that Arrow opens."""
    uri = re.sub(r"^file:/+", "file:///", uri)
    if "://" not in uri:
        uri = "file://" + uri
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def md5_number(value: Column) -> Column:
    """60 bits of an md5 as a bigint; any SQL engine can compute the same."""
    return F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("bigint")


def id_hash(id_column: str = "doc_id", text_column: str = "text") -> Column:
    """60-bit hash of a document's id, or of its text where the id is null, so that null ids spread."""
    return md5_number(F.coalesce(F.col(id_column).cast("string"), F.col(text_column), F.lit("")))


def crc_of_id(id_column: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary"))


def row_key(df: DataFrame) -> Column:
    """64-bit hash of a whole row; equal rows share it."""
    return F.xxhash64(*columns(df))


def text_bytes(column: str = "text") -> Column:
    """The text in UTF-8; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")
