"""WARC archives: a writer with digest revisits and a reader that verifies record boundaries.

Writing. Records are strings of raw bytes that Spark's text writer puts out with the blank line that
ends a WARC record as its separator, so archives appear under Spark's commit protocol. Of pages with
equal payloads of `MIN_REVISIT` bytes or more, that with the smallest id is a response, and the
others are revisit records without a body.

Reading. The magic may also stand inside payloads, so a record is only what the chain from the file's
start reaches. Each task scans a split of a file for the magic, and for every candidate with a valid
header computes its successor's offset from Content-Length; within the split, pointer jumping gives
each candidate the offset at which its chain leaves the split. Pointer jumping over these exits, in
log2(splits of a file) rounds of joins, finds where the chain from offset 0 enters each split. A last
pass follows the chain inside each split and reads only records that are reached.

Defined cases: a null page is an empty payload; a null url has no target header; null ids sort
last and are read back as null; of repeated rows one is the response and the others revisit it; an url
of any length is written and read whole; no pages give no records. A chain that ends before its file does raises an error.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, open_file, shared_path, written

MIN_REVISIT = 100
END = "\r\n\r\n"
MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
FIELD = re.compile(rb"([!-9;-~]+):[ \t]*([^\r\n]*)")
#: What the beginning of a field may be.
START = re.compile(rb"(?:[!-9;-~]*|[!-9;-~]+:[^\r\n]*)\r?\Z")
#: Bytes of an archive that a task scans at once.
SPLIT_BYTES = 8 << 20
#: Bytes beyond a split that are read with it, for headers that cross its end; longer ones are read on.
AHEAD = 1 << 16
#: Tasks that read splits, at most; beyond it a task reads several.
MAX_TASKS = 20_000
#: Decisions for revisits are broadcast up to this many rows of about 100 bytes, else joined by a shuffle.
BROADCAST_ROWS = 200_000


def _safe(value: Column) -> Column:
    """Header values must not break lines."""
    return F.regexp_replace(value, r"[\x00-\x1F\x7F]+", "%20")


def decisions(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to, repeats) of pages that aren't simply responses; repeats counts equal rows
    of which one must be the response."""
    rows = written(pages.select("page_id", F.octet_length("html").alias("n"), F.sha2(F.col("html").cast("binary"), 256).alias("digest")).where(F.col("n") >= MIN_REVISIT), "warc-digests")
    each = rows.groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n"))
    shared = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("all")).where("all > 1").drop("all")
    shared = written(shared, "warc-shared")
    each = each.join(F.broadcast(shared) if shared.count() <= BROADCAST_ROWS else shared, "digest")
    is_first = F.col("page_id").eqNullSafe(F.col("first"))
    found = each.where(~is_first | (F.col("n") > 1)).select("page_id", "digest", F.col("first").alias("refers_to"), F.when(is_first, F.col("n")).alias("repeats"))
    return written(found, "warc-decisions")


def _typed(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, revisit, refers_to."""
    chosen = decisions(pages).withColumnsRenamed({"page_id": "__page", "digest": "__digest"})
    n, repeated = chosen.agg(F.count(F.lit(1)), F.max("repeats")).first()
    base = pages.select("page_id", "url", "html", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("digest"))
    small = F.broadcast(chosen) if n <= BROADCAST_ROWS else chosen
    long_enough = F.octet_length("html") >= MIN_REVISIT
    out = base.join(small, (F.col("digest") == F.col("__digest")) & F.col("page_id").eqNullSafe(F.col("__page")) & long_enough, "left")
    plain = ["page_id", "url", "html", "digest"]
    single = out if not repeated else out.where("repeats IS NULL")
    single = single.select(*plain, F.col("__digest").isNotNull().alias("revisit"), "refers_to")
    if not repeated:
        return single
    nth = F.row_number().over(Window.partitionBy("digest", "page_id").orderBy("url"))
    return single.unionByName(out.where("repeats IS NOT NULL").select(*plain, (nth > 1).alias("revisit"), "refers_to"))


def write_archives(pages: DataFrame, path: str) -> None:
    page = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    size = F.coalesce(F.octet_length("html"), F.lit(0)).cast("string")
    revisit = F.col("revisit")
    record = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", page("page_id")), F.coalesce(line("WARC-Target-URI", _safe(F.col("url"))), F.lit("")),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")), line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), line("WARC-Payload-Length", size),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", page("refers_to")))).otherwise(""),
        F.lit("Content-Length: "), F.when(revisit, "0").otherwise(size), F.lit(END), F.when(revisit, "").otherwise(F.coalesce("html", F.lit(""))),
    )
    _typed(pages).select(record.alias("value")).write.option("lineSep", END).text(path)



class Part:
    """Bytes of a file from `base` on; `header` and `body` read further where they have to."""

    def __init__(self, file: pa.NativeFile, base: int, end: int):
        self.file, self.base, self.size = file, base, file.size()
        end = min(end, self.size)
        self.data = file.read_at(end - base, base) if end > base else b""

    def _read_on(self) -> bool:
        at = self.base + len(self.data)
        if at >= self.size:
            return False
        self.data += self.file.read_at(min(max(AHEAD, len(self.data)), self.size - at), at)
        return True

    def header(self, at: int) -> tuple[dict[bytes, bytes], int] | None:
        """(fields by lower-case name, offset of the body) of a record header at an offset of the file, or None."""
        at -= self.base
        if not MAGIC.match(self.data, at):
            return None
        fields: dict[bytes, bytes] = {}
        line = self.data.index(b"\r\n", at) + 2
        while True:
            end = self.data.find(b"\r\n", line)
            if end < 0:
                # A line that can't be a field's needs no more bytes.
                if not START.match(self.data, line) or not self._read_on():
                    return None
            elif end == line:
                break
            elif m := FIELD.fullmatch(self.data, line, end):
                fields[m[1].lower()] = m[2]
                line = end + 2
            else:
                return None
        return (fields, self.base + line + 2) if fields.get(b"content-length", b"").isdigit() and b"warc-type" in fields else None

    def body(self, at: int, size: int) -> bytes:
        first = at - self.base
        have = self.data[first : first + size]
        missing = size - len(have)
        return have + self.file.read_at(missing, at + len(have)) if missing else have


def candidates(part: Part, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, successors) in the file of possible records that start before the offset `limit`."""
    found, at = [], part.base
    while m := MAGIC.search(part.data, at - part.base):
        at = part.base + m.start()
        if at >= limit:
            break
        if header := part.header(at):
            found.append((at, header[1] + int(header[0][b"content-length"]) + len(END)))
        at += 1
    out = np.array(found, dtype=np.int64).reshape(-1, 2)
    return out[:, 0], out[:, 1]


def _pointers(offsets: np.ndarray, successors: np.ndarray) -> np.ndarray:
    """Index of each candidate's successor among the candidates; its own index if it isn't one."""
    n = len(offsets)
    at = np.searchsorted(offsets, successors)
    inside = offsets[np.minimum(at, n - 1)] == successors if n else np.zeros(0, dtype=bool)
    return np.where(inside, at, np.arange(n))


def reachable(offsets: np.ndarray, successors: np.ndarray, entry: int) -> np.ndarray:
    """Indices of the candidates on the chain from `entry`: each jump doubles how far the known ones reach."""
    known = np.flatnonzero(offsets == entry)
    jump = _pointers(offsets, successors)
    while len(more := np.union1d(known, jump[known])) > len(known):
        known, jump = more, jump[jump]
    return known


def exits(offsets: np.ndarray, successors: np.ndarray, end: int) -> np.ndarray:
    """For each candidate, where its chain leaves the split; -1 if it leads to no candidate before `end`."""
    jump = _pointers(offsets, successors)
    while (again := jump[jump]).tolist() != jump.tolist():
        jump = again
    out = successors[jump]
    return np.where(out >= end, out, -1)


def _splits(spark: SparkSession, path: str, split_bytes: int) -> DataFrame:
    """(path, length, split) of all archives under `path`, from the listing alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("path", "length")
    numbers = F.sequence(F.lit(0), F.floor((F.col("length") - 1) / split_bytes).cast("int"))
    return files.select("path", "length", F.explode(numbers).alias("split"))


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """One task for each row, as the rows stand for splits to be read; beyond MAX_TASKS rows by a hash."""
    n = rows.count()
    number = F.row_number().over(Window.orderBy(*keys)) - 1 if n <= MAX_TASKS else F.pmod(F.xxhash64(*keys), F.lit(MAX_TASKS))
    return rows.withColumn("task", number.cast("int")).repartitionById(min(max(1, n), MAX_TASKS), F.col("task")).drop("task")


def chain_entries(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, length, entry): the offset at which the chain from each file's start enters each split.

    A file that fits in one split is entered at its start alone, so only longer files are scanned for it.
    """
    splits = written(_splits(spark, path, split_bytes), "warc-splits")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                first, end = r["split"] * split_bytes, min((r["split"] + 1) * split_bytes, r["length"])
                with open_file(r["path"]) as file:
                    offsets, successors = candidates(Part(file, first, end + AHEAD), end)
                out = exits(offsets, successors, end)
                yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * len(out), pa.string()), pa.array(offsets), pa.array(out)], names=["path", "at", "exit"])

    starts = splits.where("split = 0").select("path", "length", F.lit(0).cast("bigint").alias("entry"))
    most = splits.agg(F.max("split")).first()[0]
    if not most:
        return starts
    jumps = written(arrow_map(_dealt(splits.where(F.col("length") > split_bytes), "path", "split"), links, "path string, at bigint, exit bigint"), "warc-links")
    reached, hops = starts, 1
    while hops <= most:
        step = reached.join(jumps, (reached["path"] == jumps["path"]) & (F.col("entry") == F.col("at")))
        step = step.select(reached["path"], "length", F.col("exit").alias("entry")).where("entry BETWEEN 0 AND length - 1")
        reached = written(reached.unionByName(step).distinct(), "warc-reached")
        hops *= 2
        if hops <= most:
            after = jumps.select(F.col("path").alias("p"), F.col("at").alias("a"), F.col("exit").alias("further"))
            twice = jumps.join(after, (F.col("path") == F.col("p")) & (F.col("exit") == F.col("a")), "left")
            jumps = written(twice.select("path", "at", F.coalesce("further", "exit").alias("exit")), "warc-links")
    return reached


def read_archives(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, payloads: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record; optionally url and payload."""

    def number(urn: bytes | None) -> int | None:
        digits = re.fullmatch(rb"<urn:page:(-?\d+)>", urn or b"")
        return int(digits[1]) if digits else None

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                end = min((r["entry"] // split_bytes + 1) * split_bytes, r["length"])
                file = open_file(r["path"])
                part, out = Part(file, r["entry"], end + AHEAD), []
                offsets, successors = candidates(part, end)
                chain = reachable(offsets, successors, r["entry"])
                left = int(successors[chain[-1]]) if len(chain) else r["entry"]
                if left < end or left > r["length"]:
                    raise ValueError(f"{r['path']}: no record at offset {left}, where the one before it ends")
                for at in offsets[chain].tolist():
                    fields, start = part.header(at)
                    size = int(fields[b"content-length"])
                    body = part.body(start, size)
                    kind = fields[b"warc-type"].decode()
                    digest = hashlib.sha256(body).hexdigest()
                    if kind == "revisit":
                        size, digest = int(fields[b"warc-payload-length"]), fields[b"warc-payload-digest"].decode().rpartition(":")[2]
                    elif fields.get(b"warc-payload-digest", b"").decode().rpartition(":")[2] not in ("", digest):
                        raise ValueError(f"{r['path']}: the payload at offset {at} doesn't have its digest")
                    row = (number(fields.get(b"warc-record-id")), size, digest, kind, number(fields.get(b"warc-refers-to")))
                    out.append((*row, fields.get(b"warc-target-uri", b"").decode("utf-8", "replace"), body) if payloads else row)
                file.close()
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
                names = schema.replace(",", "").split()[::2]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    schema += ", url string, payload binary" if payloads else ""
    entries = written(chain_entries(spark, path, split_bytes), "warc-entries")
    return arrow_map(_dealt(entries, "path", "entry"), records, schema)


def write_and_read(pages: DataFrame, path: str | None = None) -> DataFrame:
    path = path or shared_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
r AS (SELECT *, FIRST_VALUE(page_id) OVER w AS first, ROW_NUMBER() OVER w AS nth FROM p WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {MIN_REVISIT} AND nth > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {MIN_REVISIT} AND nth > 1 THEN first END AS refers_to
FROM r"""
