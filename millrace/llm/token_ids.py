"""Token ids in patched frame-of-reference files.

Every text is encoded whole with a given tokenizer and ends with the end id. The ids of all documents,
in ascending order of doc_id, are cut into files, and a file's ids into blocks of `BLOCK`. A block
stores its minimum, and each id's distance from it in as many bits as one of the `PERCENTILES` of
the distances needs, the one that makes the block smallest; ids that need more go to its exception list. The file's header indexes the
documents and the blocks' starts, so any document can be read alone.

File: magic, counts (documents, ids, blocks; the file's number and its length), document ids, nulls among them, lengths, block
starts, blocks. Block: minimum (4 bytes), width (1), number of exceptions (2), packed distances,
exception positions (2 each), exception distances (4 each). All little-endian.

Files are written by Spark's text writer, a row of raw bytes per file, so its commit protocol holds
on any file system; the line separator that it adds is beyond the length in the header.

Rows are dealt to tasks by ranges of doc_id, then of a hash of the text, then of the place in the input, so
that repeated ids, null ones and even repeated rows don't meet in one task. A task sorts its rows, encodes
them in order and puts out a file whenever `FILE_IDS` ids have come together, so its memory is bounded by
a file and its longest document. A file's number is the task's in the upper half and a count in the lower.
Defined cases: null or empty text is just the end id; null doc_ids come first; repeated rows are
separate documents; an empty table gives no file and no rows.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, shared_path, text_bytes, written

END_ID = 2
BLOCK = 1024
PERCENTILES = (0.5, 0.75, 0.9, 0.95, 0.99, 1.0)
EXCEPTION_BITS = 48
#: Bytes of text for each task, bytes encoded at once (many, as every distinct word then costs one look-up),
#: and ids after which a file is complete.
TASK_BYTES = 16 << 20
RUN_BYTES = 8 << 20
FILE_IDS = 1 << 20
#: Ranges of documents, at most, as the driver holds their bounds; beyond it a task writes more files.
MAX_TASKS = 50_000
MAGIC = b"PFORIDS1"
HEADER = struct.Struct("<8sQQQQQ")
BLOCK_HEADER = 7
#: Words whose ids a worker remembers.
CACHE_WORDS = 300_000
LINE_WORDS = 1000
PUNCTUATION = ".,;:!?"
#: A word, with its punctuation at the end as the group.
TAIL = r"(?s)^.*?([.,;:!?]*)$"
#: Latin letters that lower-casing turns into letters.
LATIN = r"^[a-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]+$"
#: The part of a pre-tokenizer's pattern that keeps letters, and what is neither letter nor digit, together.
SPLIT_PATTERN = r"[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
SEPARATOR = "\nEND\n"
_STEP = 256


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Encodes texts word by word, remembering words; splitting and numbering words is Arrow's work.

    Sound for tokenizers whose words never span ASCII white space and that drop it, as this one's
    normaliser and pre-tokenizer do: a text's ids are then its words' ids in a row. If the tokenizer
    also lower-cases and splits letters from punctuation, a Latin word and the punctuation
    after it are looked up apart, so that fewer distinct words need encoding.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        parsed = json.loads(definition)
        self.parts = "Lowercase" in str(parsed["normalizer"]) and SPLIT_PATTERN in str(parsed["pre_tokenizer"])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        #: Ids of words and parts, as bytes; the older half is dropped when the newer is full.
        self.newer: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode_words(self, words: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in encoded]

    def _encode_letters(self, words: list[str]) -> list[bytes]:
        """Words that are one pre-token each: encoded in lines, which end-of-word ids take apart."""
        out: list[bytes] = []
        for first in range(0, len(words), LINE_WORDS):
            some = words[first : first + LINE_WORDS]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(some):
                out += self._encode_words(some)
                continue
            raw, at = ids.tobytes(), [0, *(4 * cuts).tolist()]
            out += [raw[s:e] for s, e in zip(at, at[1:])]
        return out

    def _ids_of(self, words: list[str], letters: np.ndarray) -> list[bytes]:
        """The ids of distinct words; `letters` marks those of Latin letters alone."""
        newer, older = self.newer, self.older
        if len(newer) > CACHE_WORDS // 2:
            newer, older = self.newer, self.older = {}, newer
        found = [newer.get(w) for w in words]
        missing = []
        for k, w in enumerate(words):
            if found[k] is None:
                if (ids := older.get(w)) is None:
                    missing.append(k)
                else:
                    found[k] = newer[w] = ids
        for encode, some in ((self._encode_letters, [k for k in missing if letters[k]]), (self._encode_words, [k for k in missing if not letters[k]])):
            new = [words[k] for k in some]
            for k, w, ids in zip(some, new, encode(new)):
                found[k] = newer[w] = ids
        return found

    def encode(self, texts: pa.Array | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, each with the end id; ids per text)."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.binary())
        lists = pc.ascii_split_whitespace(texts.cast(pa.string()))
        coded = lists.flatten().dictionary_encode()
        words, which = coded.dictionary, coded.indices.to_numpy()
        if self.parts:
            core = pc.utf8_rtrim(words, characters=PUNCTUATION)
            lower = pc.ascii_lower(core)
            letters = pc.match_substring_regex(lower, LATIN)
            keys = pc.if_else(letters, lower, words).dictionary_encode()
            key_of = keys.indices.to_numpy()
            alone = np.zeros(len(keys.dictionary), dtype=bool)
            alone[key_of] = letters.to_numpy(zero_copy_only=False)
            tail = pc.if_else(letters, pc.replace_substring_regex(words, TAIL, "\\1"), "").dictionary_encode()
            tails, tail_of = tail.dictionary.to_pylist(), tail.indices.to_numpy()
            pieces = self._ids_of(keys.dictionary.to_pylist(), alone) + self._ids_of(tails, np.zeros(len(tails), dtype=bool))
            segments = np.column_stack([key_of[which], np.int32(len(alone)) + tail_of[which]]).reshape(-1)
            per_word = 2
        else:
            pieces, segments, per_word = self._ids_of(words.to_pylist(), np.zeros(len(words), dtype=bool)), which, 1
        flat = np.frombuffer(b"".join(pieces), dtype="<u4")
        # A run's ids number far below 2**31, and narrow indices halve what is held at once.
        starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)) // 4)]).astype(np.int32)
        sizes = (starts[1:] - starts[:-1])[segments]
        ends = np.concatenate([np.zeros(1, dtype=np.int32), np.cumsum(sizes, dtype=np.int32)])
        at = np.repeat(starts[segments] - ends[:-1], sizes)
        at += np.arange(ends[-1], dtype=np.int32)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        bounds = ends[per_word * (offsets[1:] - offsets[0])].astype(np.int64)
        return np.insert(flat[at], bounds, END_ID).astype(np.uint32), np.diff(bounds, prepend=0) + 1


_encoders: dict[int, Encoder] = {}


def _encoder(definition: str) -> Encoder:
    key = hash(definition)
    if key not in _encoders:
        _encoders[key] = Encoder(definition)
    return _encoders[key]


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values of `width` bits each, as rows of bytes: one column of all rows at a time."""
    words = np.zeros((BLOCK * width // 32 + 1, len(values)), dtype=np.uint64)
    for j, column in enumerate(np.ascontiguousarray(values.T, dtype=np.uint64)):
        word, shift = divmod(j * width, 32)
        shifted = column << np.uint64(shift)
        words[word] |= shifted & np.uint64(0xFFFFFFFF)
        words[word + 1] |= shifted >> np.uint64(32)
    return np.ascontiguousarray(words[:-1].T.astype("<u4")).view(np.uint8)


def choose_widths(away: np.ndarray) -> np.ndarray:
    """For each row, the cheapest of the widths that hold the PERCENTILES of its distances."""
    n = len(away)
    bits = np.frexp(away.astype(np.float64))[1]  # 0 for 0, else the number of bits
    seen = np.bincount((bits + 33 * np.arange(n)[:, None]).reshape(-1), minlength=33 * n).reshape(n, 33).cumsum(axis=1)
    best, cheapest = np.full(n, 32), np.full(n, np.iinfo(np.int64).max)
    for share in PERCENTILES:
        width = (seen < share * BLOCK).sum(axis=1)
        cost = width * BLOCK + EXCEPTION_BITS * (BLOCK - seen[np.arange(n), width])
        best, cheapest = np.where(cost < cheapest, width, best), np.minimum(cost, cheapest)
    return best


def pack_blocks(ids: np.ndarray) -> list[bytes]:
    """Blocks of BLOCK ids, the last one filled up with its minimum."""
    out: list[bytes] = []
    for first in range(0, len(ids), BLOCK * _STEP):
        part = ids[first : first + BLOCK * _STEP].astype(np.uint32)
        if short := -len(part) % BLOCK:
            part = np.concatenate([part, np.full(short, part[-(BLOCK - short) :].min(), dtype=np.uint32)])
        rows = part.reshape(-1, BLOCK)
        least = rows.min(axis=1)
        away = rows - least[:, None]
        widths = choose_widths(away)
        packed: list[bytes] = [b""] * len(rows)
        for w in np.unique(widths).tolist():
            index = np.flatnonzero(widths == w)
            values = away[index]
            over = values.astype(np.uint64) >> np.uint64(w) != 0
            body = _packed(np.where(over, 0, values), w) if w else np.zeros((len(index), 0), dtype=np.uint8)
            for k, i in enumerate(index.tolist()):
                at = np.flatnonzero(over[k])
                packed[i] = struct.pack("<IBH", least[i], w, len(at)) + body[k].tobytes() + at.astype("<u2").tobytes() + values[k][at].astype("<u4").tobytes()
        out += packed
    return out


def unpack_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that start at starts[:-1] and end at starts[-1]."""
    n = len(starts) - 1
    out = np.zeros((n, BLOCK), dtype=np.uint32)
    if not n:
        return out.reshape(-1)
    base, end = int(starts[0]), int(starts[-1])
    raw = np.frombuffer(data[base:end] + bytes(8), dtype=np.uint8)
    offsets = (starts - base).astype(np.int64)
    at_byte = np.ndarray(len(raw) - 7, dtype="<u8", buffer=raw, strides=(1,))  # the 8 bytes from each byte on
    heads = raw[offsets[:-1][:, None] + np.arange(BLOCK_HEADER)]
    least = heads[:, :4].copy().view("<u4").reshape(-1)
    widths, exceptions = heads[:, 4].astype(np.int64), heads[:, 5:7].copy().view("<u2").reshape(-1)
    bodies = offsets[:-1] + BLOCK_HEADER
    for w in np.unique(widths[widths > 0]).tolist():
        bit = np.arange(BLOCK, dtype=np.int64) * w
        index = np.flatnonzero(widths == w)
        for first in range(0, len(index), _STEP):
            some = index[first : first + _STEP]
            out[some] = (at_byte[bodies[some][:, None] + bit // 8] >> (bit % 8).astype(np.uint64)) & np.uint64((1 << w) - 1)
    for i in np.flatnonzero(exceptions).tolist():
        e, at = int(exceptions[i]), int(bodies[i] + BLOCK * widths[i] // 8)
        out[i, raw[at : at + 2 * e].view("<u2")] = raw[at + 2 * e : at + 6 * e].view("<u4")
    return (out + least[:, None]).reshape(-1)


def pack_file(number: int, doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    blocks = pack_blocks(ids)
    nulls = np.array([d is None for d in doc_ids], dtype=np.uint8)
    index = (
        np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes() + nulls.tobytes() + np.asarray(lengths, dtype="<u8").tobytes()
    )
    first = HEADER.size + len(index) + 8 * (len(blocks) + 1)
    starts = first + np.concatenate([[0], np.cumsum([len(b) for b in blocks], dtype=np.int64)])
    head = HEADER.pack(MAGIC, len(doc_ids), len(ids), len(blocks), number, int(starts[-1]))
    return b"".join([head, index, starts.astype("<u8").tobytes(), *blocks])


class TokenFile:
    """A file's documents; `ids(k)` reads one document's blocks only."""

    def __init__(self, data: bytes):
        magic, docs, self.n_ids, blocks, self.number, size = HEADER.unpack_from(data)
        if magic != MAGIC or len(data) < size:
            raise ValueError("not a token file, or cut short")
        at = HEADER.size
        self.data = data
        self.doc_ids = [None if n else int(d) for d, n in zip(np.frombuffer(data, "<i8", docs, at), np.frombuffer(data, np.uint8, docs, at + 8 * docs))]
        self.lengths = np.frombuffer(data, "<u8", docs, at + 9 * docs).astype(np.int64)
        self.ends = np.cumsum(self.lengths)
        self.blocks = np.frombuffer(data, "<u8", blocks + 1, at + 17 * docs).astype(np.int64)

    def ids(self, k: int) -> np.ndarray:
        return self.range(int(self.ends[k] - self.lengths[k]), int(self.ends[k]))

    def range(self, first: int, end: int) -> np.ndarray:
        block = first // BLOCK
        return unpack_blocks(self.data, self.blocks[block : -(-end // BLOCK) + 1])[first - block * BLOCK : end - block * BLOCK]


def write_files(docs: DataFrame, path: str, tokenizer: str | None = None, n_tasks: int | None = None, file_ids: int = FILE_IDS) -> None:
    """Encode (doc_id, text) and write the files of all documents under `path`."""
    spark = docs.sparkSession
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())
    texts = docs.select("doc_id", text_bytes().alias("text"))
    if n_tasks is None:
        size = texts.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
        n_tasks = min(max(1, ceil(size / TASK_BYTES)), MAX_TASKS)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, count = _encoder(definition.value), 0, 0
        doc_ids: list[int | None] = []
        lengths: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = 0

        def file() -> pa.RecordBatch:
            content = pack_file(task << 32 | count, doc_ids, np.concatenate(lengths), np.concatenate(ids))
            return pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], names=["value"])

        for part in _runs(batches):
            some, some_lengths = encoder.encode(part["text"])
            task = part["task"][0].as_py()
            doc_ids += part["doc_id"].to_pylist()
            lengths.append(some_lengths)
            ids.append(some.astype(np.uint16) if some.max() < 1 << 16 else some)
            held += len(some)
            if held >= file_ids:
                yield file()
                count, held = count + 1, 0
                doc_ids, lengths, ids = [], [], []
            pa.default_memory_pool().release_unused()
        if held:
            yield file()

    order = [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("place")]
    keyed = texts.withColumns({"hash": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    dealt = keyed.repartitionByRange(n_tasks, *order).sortWithinPartitions(*order)
    rows = dealt.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.spark_partition_id().alias("task"), "text")
    files = arrow_map(rows, pack, "value binary").select(F.col("value").cast("string"))
    files.write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", 1).text(path)


def _runs(batches: Iterator[pa.RecordBatch], limit: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches of about `limit` bytes of text, or of one longer text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        first = 0
        for k, n in enumerate(pc.binary_length(batch["text"]).to_pylist()):
            if size and size + n > limit:
                yield pa.concat_batches([*held, batch.slice(first, k - first)])
                held, first, size = [], k, 0
            size += n
        held.append(batch.slice(first))
    if any(len(b) for b in held):
        yield pa.concat_batches(held)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """file_number, row (within the file), doc_id, n_tokens, ids_crc32, local_start."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                file = TokenFile(content.as_buffer().to_pybytes())
                crcs, at, n = [], 0, len(file.doc_ids)
                while at < n:  # documents in runs of about a million ids
                    base = int(file.ends[at] - file.lengths[at])
                    to = max(at + 1, int(np.searchsorted(file.ends, base + (1 << 20), "right")))
                    raw = file.range(base, int(file.ends[to - 1])).astype("<u4").tobytes()
                    for k in range(at, to):
                        e = 4 * (int(file.ends[k]) - base)
                        crcs.append(zlib.crc32(raw[e - 4 * int(file.lengths[k]) : e]))
                    at = to
                columns = [np.full(n, file.number), np.arange(n), file.doc_ids, file.lengths, crcs, file.ends - file.lengths]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=schema.fieldNames())

    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("file_number", "row", "doc_id", "n_tokens", "ids_crc32", "local_start")])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where(F.col("length") >= HEADER.size).select("content")
    return arrow_map(files, decode, schema)


def write_and_index(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, n_tasks: int | None = None, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the files, read them back: doc_id, start, n_tokens, ids_crc32 for every row."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "token-ids")
    write_files(docs, path, tokenizer, n_tasks, file_ids)
    rows = written(read_files(spark, path), "token-rows")
    # One row per file; the places of files are summed within tasks, and only tasks' totals in one place.
    files = rows.groupBy("file_number").agg(F.sum("n_tokens").alias("n")).withColumn("task", F.shiftright("file_number", 32))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    tasks = files.groupBy("task").agg(F.sum("n").alias("n"))
    tasks = tasks.select("task", F.coalesce(F.sum("n").over(before.orderBy("task")), F.lit(0)).alias("task_start"))
    within = F.coalesce(F.sum("n").over(before.partitionBy("task").orderBy("file_number")), F.lit(0))
    starts = files.withColumn("within", within).join(tasks, "task").select("file_number", (F.col("task_start") + F.col("within")).alias("file_start"))
    return rows.join(starts, "file_number").select("doc_id", (F.col("file_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
