"""Language-model scores: a log-bilinear neural model over word classes, and an add-one unigram base.

Tokens are runs of non-blank characters, A-Z lower-cased, then one end per document. Every token's
training count is kept in a written table. The neural model predicts a token's class: the
`FREQUENT` most frequent tokens are classes of their own, and all others share `BUCKETS` classes by a
hash of their first bytes. Inside a shared class a token has probability (c + 1) / (class tokens +
class words + 1), so token probabilities are normalised for seen and unseen tokens alike.

The class model is log-bilinear: the vectors of the two tokens before are added, and a class's score is
the product with its own vector plus a bias. It is trained by noise-contrastive estimation in numpy on
every position of every training document. Documents are dealt by a hash into parts of about `PART_TOKENS`
tokens, and a part is trained on in the order of that hash, from the same start as all others, so that
the result doesn't depend on files or partitions; the weighted mean of the parts' parameters is the next
start. What parts emit grows with the corpus; it is summed by parameter chunk, and only one model
reaches the driver.

For scoring, batched matrix products give each context's normaliser over all classes, once per context
and worker. Counts of the `DICTIONARY` most frequent tokens are broadcast, which bounds the size; the
counts of other tokens come from a join on the token, summed by document.

Defined cases: null text is empty and has just the end; without training documents every count is 0;
repeated rows are scored each; a null id counts as empty text in the hash that makes the folds.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, arrow_map, crc_of_id, discard, text_bytes, written

FOLDS, HELD_OUT = 7, 2
#: Tokens whose counts are broadcast, at most; about 100 bytes each in a worker.
DICTIONARY = 300_000
FREQUENT, BUCKETS, PREFIX = 895, 128, 3
END = FREQUENT + BUCKETS
CLASSES = END + 1
CONTEXT, SIZE = 2, 32
NOISE, BATCH, RATE = 64, 1024, 0.15
#: Documents (one in so many, by hash) in each round of training.
ROUNDS = (8, 1)
PART_TOKENS = 1 << 21
BUFFER = 1 << 16
FLUSH = 300_000
CHUNKS = 64
END_TOKEN = b""


def held_out() -> Column:
    return F.pmod(crc_of_id(), F.lit(FOLDS)) == HELD_OUT


def tokens(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def bucket(token: bytes) -> int:
    return FREQUENT + zlib.crc32(token[:PREFIX]) % BUCKETS


def count_tokens(texts: DataFrame) -> DataFrame:
    """(token, c), the end included as the empty token, of a frame with `text` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["token", "c"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch["text"]:
                counts.update(tokens(text.as_buffer().to_pybytes()))
                counts[END_TOKEN] += 1
                if len(counts) > FLUSH:
                    yield flush()
        yield flush()

    return arrow_map(texts.select("text"), run, "token binary, c bigint").groupBy("token").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Counts of the frequent tokens and the classes of all."""

    def __init__(self, known: list[tuple[bytes, int]], total: int, distinct: int, by_bucket: dict[int, tuple[int, int]]):
        known = sorted(known, key=lambda x: (-x[1], x[0]))
        self.number = {t: i for i, (t, _) in enumerate(known)}
        self.counts = np.array([c for _, c in known], dtype=np.float64)
        self.total, self.distinct = total, distinct
        words = [(t, c) for t, c in known if t != END_TOKEN]
        self.classes = np.array([END if t == END_TOKEN else bucket(t) for t, _ in known], dtype=np.int64)
        mass, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
        for k, (c, n) in by_bucket.items():
            mass[FREQUENT + k], kinds[FREQUENT + k] = c, n
        for k, (t, c) in enumerate(words[:FREQUENT]):
            self.classes[self.number[t]] = k
            mass[bucket(t)] -= c
            kinds[bucket(t)] -= 1
            mass[k] = c
        if END_TOKEN in self.number:
            mass[END] = self.counts[self.number[END_TOKEN]]
        self.mass = mass
        #: log10 of what a token's c + 1 is divided by within its class; 0 for classes of one token.
        self.within = np.zeros(CLASSES)
        self.within[FREQUENT:END] = np.log10(mass[FREQUENT:END] + kinds[FREQUENT:END] + 1)

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number in the dictionary or -1, class) of each token."""
        get = self.number.get
        numbers = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
        classes = self.classes[numbers] if len(self.classes) else np.zeros(len(words), dtype=np.int64)
        for k in np.flatnonzero(numbers < 0):
            classes[k] = bucket(words[k])
        return numbers, classes


class Model:
    """Score of class w after classes (h1, h2): (first[h1] + second[h2]) . target[w] + bias[w]."""

    def __init__(self, vocabulary_mass: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        shares = (vocabulary_mass + 1.0) / (vocabulary_mass + 1.0).sum()
        self.noise = shares
        self.tables = [rng.normal(0, 0.1, (CLASSES, SIZE)).astype(np.float32) for _ in range(CONTEXT + 1)]
        self.bias = np.log(shares).astype(np.float32)
        self.normalisers: np.ndarray | None = None

    def parameters(self) -> np.ndarray:
        return np.concatenate([t.reshape(-1) for t in self.tables] + [self.bias])

    def load(self, flat: np.ndarray) -> None:
        n = CLASSES * SIZE
        self.tables = [flat[i * n : (i + 1) * n].reshape(CLASSES, SIZE).astype(np.float32) for i in range(CONTEXT + 1)]
        self.bias = flat[(CONTEXT + 1) * n :].astype(np.float32)
        self.normalisers = None

    def log_probabilities(self, line: np.ndarray) -> np.ndarray:
        """Natural logs for line[2:], each after the two classes before it."""
        first, second, target = self.tables
        h2, h1, w = line[:-2], line[1:-1], line[2:]
        codes = h1 * CLASSES + h2
        if self.normalisers is None:
            self.normalisers = np.full(CLASSES * CLASSES, np.nan, dtype=np.float32)
        seen = np.unique(codes)
        new = seen[np.isnan(self.normalisers[seen])]
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            scores = (first[part // CLASSES] + second[part % CLASSES]) @ target.T + self.bias
            top = scores.max(axis=1)
            self.normalisers[part] = top + np.log(np.exp(scores - top[:, None]).sum(axis=1))
        own = np.einsum("ij,ij->i", first[h1] + second[h2], target[w]) + self.bias[w]
        return (own - self.normalisers[codes]).astype(np.float64)


def summed_rows(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, sums of their values): `np.add.at` for rows of a matrix, by sorting them."""
    order = np.argsort(rows, kind="stable")
    line = rows[order]
    first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    return line[first], np.add.reduceat(values[order], first, axis=0)


class Trainer:
    """Noise-contrastive estimation with Adagrad; noise classes are shared by a batch."""

    def __init__(self, model: Model, seed: int):
        self.model, self.rng = model, np.random.default_rng(seed)
        self.log_noise = np.log(NOISE * model.noise).astype(np.float32)
        self.squares = [np.full_like(t, 1e-4) for t in (*model.tables, model.bias)]
        self.cumulative = np.cumsum(model.noise)
        self.seen = 0

    def learn(self, examples: np.ndarray) -> None:
        """Rows of (h2, h1, w)."""
        order = self.rng.permutation(len(examples))
        for at in range(0, len(examples), BATCH):
            self._step(examples[order[at : at + BATCH]])
        self.seen += len(examples)

    def _step(self, rows: np.ndarray) -> None:
        first, second, target = self.model.tables
        bias = self.model.bias
        h2, h1, w = rows.T
        noise = np.minimum(np.searchsorted(self.cumulative, self.rng.random(NOISE)), CLASSES - 1)
        q = first[h1] + second[h2]
        on_data = np.einsum("ij,ij->i", q, target[w]) + bias[w] - self.log_noise[w]
        on_noise = q @ target[noise].T + bias[noise] - self.log_noise[noise]
        g_data = -1 / (1 + np.exp(np.clip(on_data, -30, 30)))
        g_noise = 1 / (1 + np.exp(-np.clip(on_noise, -30, 30)))
        dq = g_data[:, None] * target[w] + g_noise @ target[noise]
        on_rows = [
            summed_rows(h1, dq), summed_rows(h2, dq),
            summed_rows(np.concatenate([w, noise]), np.concatenate([g_data[:, None] * q, g_noise.T @ q])),
            summed_rows(np.concatenate([w, noise]), np.concatenate([g_data, g_noise.sum(axis=0)])),
        ]
        # Rows that a batch doesn't touch have no gradient, and stay.
        for value, (at, grad), square in zip((first, second, target, bias), on_rows, self.squares):
            grad = grad / len(rows)
            square[at] += grad * grad
            value[at] -= RATE * grad / np.sqrt(square[at])


def with_ends(classes: np.ndarray) -> np.ndarray:
    return np.concatenate([[END] * CONTEXT, classes, [END]]).astype(np.int64)


def class_lines(texts: DataFrame, vocabulary) -> DataFrame:
    """(place, line) of a frame with `place` and `text`: the classes of a text's tokens, two bytes each, ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [with_ends(vocabulary.value.look_up(tokens(t.as_buffer().to_pybytes()))[1]).astype("<u2").tobytes() for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["place"], pa.array(lines, pa.binary())], names=["place", "line"])

    return arrow_map(texts.select("place", "text"), run, "place bigint, line binary")


def _train_round(lines: DataFrame, model: Model, parts: int, seed: int) -> np.ndarray:
    """The mean of the parameters that the parts arrive at, weighted by their examples."""
    start = lines.sparkSession.sparkContext.broadcast((model.noise, model.parameters()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, buffer, held, part = None, [], 0, None

        def learned() -> pa.RecordBatch:
            if held:
                trainer.learn(np.concatenate(buffer))
            chunks = np.array_split(trainer.model.parameters().astype("<f4"), CHUNKS)
            columns = [pa.array(range(CHUNKS), pa.int32()), pa.array([part] * CHUNKS, pa.int32()), pa.array([trainer.seen] * CHUNKS, pa.int64()), pa.array([c.tobytes() for c in chunks], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "part", "weight", "values"])

        for batch in batches:
            for number, raw in zip(batch["part"].to_pylist(), batch["line"]):
                if number != part:
                    if trainer is not None:
                        yield learned()
                    own = Model(start.value[0])
                    own.noise = start.value[0]
                    own.load(start.value[1].copy())
                    trainer, buffer, held, part = Trainer(own, seed * 1_000_003 + number), [], 0, number
                line = np.frombuffer(raw.as_buffer(), dtype="<u2").astype(np.int64)
                buffer.append(np.column_stack([line[:-2], line[1:-1], line[2:]]))
                held += len(line) - CONTEXT
                if held >= BUFFER:
                    trainer.learn(np.concatenate(buffer))
                    buffer, held = [], 0
        if trainer is not None:
            yield learned()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                total = sums.setdefault(r["chunk"], [0, 0.0])
                total[0] += r["weight"]
                total[1] = total[1] + r["weight"] * np.frombuffer(r["values"], "<f4").astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s[0] for s in sums.values()], pa.int64()), pa.array([s[1].tobytes() for s in sums.values()], pa.binary())], names=["chunk", "weight", "values"])

    dealt = lines.withColumn("part", F.pmod(F.shiftright("place", 16), F.lit(parts)).cast("int"))
    dealt = dealt.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "place").select("part", "line")
    trained = arrow_map(dealt, run, "chunk int, part int, weight bigint, values binary")
    # Sums are taken in the order of the parts, so that they are the same again.
    ordered = trained.repartition(CHUNKS, "chunk").sortWithinPartitions("chunk", "part")
    summed = arrow_map(ordered, add, "chunk int, weight bigint, values binary").collect()
    if not summed:
        return model.parameters()
    return np.concatenate([np.frombuffer(r["values"], "<f8") / r["weight"] for r in sorted(summed, key=lambda r: r["chunk"])])


def fit(docs: DataFrame) -> tuple[DataFrame, Vocabulary, Model]:
    """(counts table, vocabulary, model) from the documents outside the held-out fold."""
    texts = docs.where(~held_out()).select(text_bytes().alias("text"), F.xxhash64("doc_id", "text").alias("place"))
    counts = written(count_tokens(texts), "lm-counts")
    level = F.floor(F.log2("c") * 16).cast("int")
    levels = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c")).collect()
    total, distinct = sum(r["c"] for r in levels), sum(r["n"] for r in levels)
    least, room = 1 << 30, DICTIONARY
    for r in sorted(levels, key=lambda r: -r["level"]):
        if r["n"] > room:
            break
        least, room = r["level"], room - r["n"]
    counts = counts.withColumn("frequent", level >= least)
    table = counts.where("frequent").select("token", "c").toArrow()
    known = list(zip(table["token"].to_pylist(), table["c"].to_pylist()))
    # The end is in a class of its own, whatever its count.
    prefix = F.crc32(F.substring(F.col("token"), 1, PREFIX)) % BUCKETS
    by_bucket = counts.where(F.octet_length("token") > 0).groupBy(prefix.cast("int").alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect()
    if total and not any(t == END_TOKEN for t, _ in known):
        known.append((END_TOKEN, counts.where(F.octet_length("token") == 0).first()["c"]))
    vocabulary = Vocabulary(known, total, distinct, {r["k"]: (r["c"], r["n"]) for r in by_bucket})
    model = Model(vocabulary.mass)
    if total:
        lines = written(class_lines(texts, docs.sparkSession.sparkContext.broadcast(vocabulary)), "lm-lines")
        for k, one_in in enumerate(ROUNDS):
            chosen = lines if one_in == 1 else lines.where(F.pmod(F.shiftright("place", 8), F.lit(one_in)) == 0)
            model.load(_train_round(chosen, model, ceil(total / one_in / PART_TOKENS), k))
        discard(lines)
    return counts, vocabulary, model


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    counts, vocabulary, model = fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, model))
    divisor = float(np.log10(vocabulary.total + vocabulary.distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, model = shared.value
        logs = np.log10(vocabulary.counts + 1) if len(vocabulary.counts) else np.zeros(1)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for text in batch["text"]:
                words = [*tokens(text.as_buffer().to_pybytes()), END_TOKEN]
                numbers, classes = vocabulary.look_up(words)
                classes[-1] = END
                line = np.concatenate([[END] * CONTEXT, classes])
                known = numbers >= 0
                gained = logs[numbers[known]].sum()
                shared_class = (classes >= FREQUENT) & (classes < END)
                inside = logs[numbers[known & shared_class]].sum() - vocabulary.within[classes].sum()
                rare = Counter(words[k] for k in np.flatnonzero(~known))
                row = (len(words), int(known.sum()), gained - len(words) * divisor, model.log_probabilities(line).sum() / np.log(10) + inside, list(rare.keys()), list(rare.values()))
                for column, value in zip(out, row):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], *map(pa.array, out, kinds)], names=names)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "base", "model", "rare", "times"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base double, model double, rare array<binary>, times array<bigint>"
    texts = docs.select("doc_id", held_out().alias("held_out"), text_bytes().alias("text"))
    scored = written(arrow_map(texts, run, schema).withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("token"), F.col("r.times").alias("times"))
    found = rare.join(counts.where("NOT frequent").select("token", "c"), "token")
    more = found.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("gained"), F.sum("times").alias("known"))
    gained, known = F.coalesce("gained", F.lit(0.0)), F.coalesce("known", F.lit(0))
    return scored.drop("rare", "times").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + known).alias("n_known"), F.lit(int(vocabulary.total)).cast("bigint").alias("train_tokens"),
        (F.col("base") + gained).alias("base_score"), (F.col("model") + gained).alias("score"),
    )
