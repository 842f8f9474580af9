"""Benchmark decontamination with one Aho-Corasick automaton over normalised questions and answers.

Normal form: A-Z lower-cased, words are runs of ASCII letters, digits and non-ASCII characters, joined
by single blanks. In UTF-8 that is a byte table and a split, so no character is decoded. A window is
`window` consecutive words of an item, or the whole item if it is shorter. Each document is scanned
once; hits come back as word positions and as character offsets of the original text.

The benchmark's size is checked first. Its text is broadcast, and every worker builds the automaton once.
Beyond `MAX_BENCHMARK_BYTES` that would not fit in a worker's memory, so the items are dealt into several
automata, and a worker builds one after the other for every `CHUNK_BYTES` of documents: the documents are
still read once. Only beyond `PASS_BYTES`, too much to broadcast, are there several passes, with the hits
carried along in a written table.

Defined cases: null or empty text has no words and no hits; items without words never occur; an
item with a null id takes part in hits but has no id to report; repeated items count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, arrow_map, columns, text_bytes, written

WINDOW = 13
#: A document is contaminated if at least one in so many of its words is hit.
ONE_IN = 20
#: Text of the benchmark in one automaton; about 100 times as much memory at most.
MAX_BENCHMARK_BYTES = 1 << 20
#: Text of documents that is held while one automaton after the other scans it.
CHUNK_BYTES = 64 << 20
#: Text of the benchmark that is broadcast at once.
PASS_BYTES = 64 << 20
WORD_BYTES = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(128, 256))
NORMAL = bytes(c if c in WORD_BYTES else 0x20 for c in LOWER)
RUN = re.compile(rb"[^ ]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def build(items: list[tuple[int | None, bytes]], window: int = WINDOW) -> tuple[ahocorasick.Automaton | None, list[list[int]]]:
    """The automaton over all windows; a window's value is (its index, its words), and the list has
    the item ids by index. Latin-1 maps bytes to characters one to one."""
    found: dict[bytes, tuple[int, set[int]]] = {}
    for item_id, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - window + 1)) if words else ():
            n = min(window, len(words))
            _, ids = found.setdefault(b" " + b" ".join(words[i : i + n]) + b" ", (n, set()))
            if item_id is not None:
                ids.add(item_id)
    if not found:
        return None, []
    automaton, ids_of = ahocorasick.Automaton(), []
    for key, (n, ids) in found.items():
        automaton.add_word(key.decode("latin-1"), (len(ids_of), n))
        ids_of.append(sorted(ids))
    automaton.make_automaton()
    return automaton, ids_of


def scan(text: bytes, automaton: ahocorasick.Automaton | None, ids_of: list[list[int]]) -> tuple[int, set[int], set[int]]:
    """(number of words, positions of hit words, ids of the items that occur)."""
    words = words_of(text)
    hits: set[int] = set()
    ids: set[int] = set()
    if automaton is None or not words:
        return len(words), hits, ids
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    found = list(automaton.iter(line))
    if found:
        blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 0x20)
        for end, (index, n) in found:
            last = int(np.searchsorted(blanks, end))  # the blank after a word has that word's number plus one
            hits.update(range(last - n, last))
            ids.update(ids_of[index])
    return len(words), hits, ids


def spans_of(text: bytes, hits: set[int]) -> list[tuple[int, int]]:
    """Character offsets [start, end) in the original text of the runs of hit words."""
    out: list[tuple[int, int]] = []
    at = done = chars = 0
    for number, m in enumerate(RUN.finditer(text.translate(NORMAL))):
        if number not in hits:
            continue
        chars += len(text[done : m.start()].decode("utf-8", "replace"))
        size = len(m[0].decode("utf-8", "replace"))
        done = m.end()
        if out and at == number - 1:
            out[-1] = (out[-1][0], chars + size)
        else:
            out.append((chars, chars + size))
        at, chars = number, chars + size
    return out


def dealt(items: list[tuple[int | None, bytes]], limit: int) -> list[list[tuple[int | None, bytes]]]:
    """The items in groups of up to `limit` bytes of text, or of one longer item."""
    out: list[list[tuple[int | None, bytes]]] = [[]]
    size = 0
    for item in items:
        if out[-1] and size + len(item[1]) > limit:
            out.append([])
            size = 0
        out[-1].append(item)
        size += len(item[1])
    return out


def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[pa.RecordBatch]]:
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def annotate(docs: DataFrame, bench: DataFrame, window: int = WINDOW, limit: int = MAX_BENCHMARK_BYTES, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The documents with __n_words, __hits (word positions), __items (ids), each sorted, and __spans (`spans_of` the hits)."""
    spark = docs.sparkSession
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, ceil(size / pass_bytes))
    none = [F.lit(0).cast("bigint").alias("__n_words"), F.array().cast("array<int>").alias("__hits"), F.array().cast("array<bigint>").alias("__items"), F.lit("").alias("__spans")]
    out = docs.select(*columns(docs), *none)
    for k in range(passes):
        rows = bench.where(F.pmod(F.xxhash64("text"), F.lit(passes)) == k).select("item_id", text_bytes().alias("text")).collect()
        items = spark.sparkContext.broadcast([(r["item_id"], bytes(r["text"])) for r in rows])
        out = out.withColumn("__bytes", text_bytes())
        schema = T.StructType(out.schema.fields[:-1])

        def run(batches: Iterator[pa.RecordBatch], items=items, schema=schema) -> Iterator[pa.RecordBatch]:
            parts = dealt(items.value, limit)
            one = build(parts[0], window) if len(parts) == 1 else None
            for held in _chunks(batches, 0 if one else CHUNK_BYTES):
                texts = [[t.as_buffer().to_pybytes() for t in batch["__bytes"]] for batch in held]
                n_words = [[0] * len(b) for b in held]
                hits = [[set(x) for x in b["__hits"].to_pylist()] for b in held]
                ids = [[set(x) for x in b["__items"].to_pylist()] for b in held]
                for part in parts:
                    automaton, ids_of = one or build(part, window)
                    for b, some in enumerate(texts):
                        for i, text in enumerate(some):
                            n_words[b][i], new_hits, new_ids = scan(text, automaton, ids_of)
                            hits[b][i] |= new_hits
                            ids[b][i] |= new_ids
                for b, batch in enumerate(held):
                    spans = [",".join(f"{s}-{e}" for s, e in spans_of(t, h)) if h else "" for t, h in zip(texts[b], hits[b])]
                    found = [pa.array(n_words[b], pa.int64()), pa.array(map(sorted, hits[b]), pa.list_(pa.int32())), pa.array(map(sorted, ids[b]), pa.list_(pa.int64())), pa.array(spans, pa.string())]
                    yield pa.RecordBatch.from_arrays(batch.columns[:-5] + found, names=schema.fieldNames())

        out = arrow_map(out, run, schema)
        if k + 1 < passes:
            out = written(out, "decontaminate")
    return out


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (n_hit * ONE_IN >= n_words)


def report(docs: DataFrame, bench: DataFrame, window: int = WINDOW, limit: int = MAX_BENCHMARK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hit_spans for every row.

    hit_spans has the runs of hit words as start-end, comma-joined, in characters of the original text.
    """
    ids = F.array_sort(F.transform("__items", lambda x: x.cast("string")))
    n_hit = F.size("__hits").cast("bigint")
    return annotate(docs.select("doc_id", "text"), bench, window, limit).select(
        "doc_id", F.col("__n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("__items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), is_contaminated(n_hit, F.col("__n_words")).alias("contaminated"),
        F.col("__spans").alias("hit_spans"),
    )


def clean(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, unchanged."""
    return annotate(docs, bench).where(~is_contaminated(F.size("__hits").cast("bigint"), F.col("__n_words"))).select(*columns(docs))


def hit_spans(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id, start, end, matched text of each run of hit words, in characters of the original."""
    hit = annotate(docs.select("doc_id", "text"), bench).where(F.col("__spans") != "")
    ends = F.split("span", "-")
    found = hit.select("doc_id", "text", F.explode(F.split("__spans", ",")).alias("span"))
    found = found.select("doc_id", "text", ends[0].cast("bigint").alias("start"), ends[1].cast("bigint").alias("end"))
    return found.select("doc_id", "start", "end", F.expr("substring(text, int(start) + 1, int(end - start))").alias("match"))


_UPPER, _LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD, _NORMAL = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'", f"translate(text, '{_UPPER}', '{_LOWERED}')"
_WORDS = f"regexp_extract_all({_NORMAL}, {_WORD})"
ORACLE_SQL = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS i FROM items WHERE len(w) > 0) x),
docs AS (SELECT doc_id, coalesce({_WORDS}, []) AS w, regexp_split_to_array({_NORMAL}, {_WORD}) AS between FROM documents),
grams AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM docs) d, (SELECT DISTINCT n FROM windows) l
  WHERE i + n - 1 <= len(w)),
found AS (SELECT doc_id, i, n, item_id FROM grams JOIN windows USING (n, gram)),
places AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM found) f) g),
hit AS (SELECT doc_id, COUNT(*) AS n_hit FROM places GROUP BY doc_id),
runs AS (SELECT doc_id, MIN(p) AS a, MAX(p) AS b FROM (SELECT doc_id, p, p - ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY p) AS g FROM places) q GROUP BY doc_id, g),
sized AS (SELECT doc_id, list_transform(w, lambda x: length(x)) AS lw, list_transform(between, lambda x: length(x)) AS lb FROM (SELECT DISTINCT * FROM docs) d WHERE doc_id IN (SELECT doc_id FROM hit)),
spans AS (
  SELECT doc_id, string_agg(CAST(first AS VARCHAR) || '-' || CAST(last AS VARCHAR), ',' ORDER BY first) AS hit_spans FROM (
    SELECT doc_id, CAST(list_sum(lb[1:a]) + coalesce(list_sum(lw[1:a - 1]), 0) AS BIGINT) AS first, CAST(list_sum(lb[1:b]) + list_sum(lw[1:b]) AS BIGINT) AS last
    FROM runs JOIN sized USING (doc_id)) s GROUP BY doc_id),
named AS (SELECT doc_id, COUNT(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {ONE_IN} * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(hit_spans, '') AS hit_spans
FROM docs d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN spans USING (doc_id)"""
