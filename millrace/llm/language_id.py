"""Language identification by interpolated Kneser-Ney character models.

One model per language, orders 1 to `ORDER`, over lower-cased letters with all else folded to one
blank. A model holds its own n-grams, 64-bit hashes in a sorted array per order, with their interpolated
log-probabilities, and its contexts with their back-off weights. A text's n-grams are hashed and counted
once and looked up in each model by binary search; the language with the lowest cross-entropy per symbol
wins. A text is rejected if that lies further above what held-out training texts of the language show
than their spread allows, or if it has no letter.

The classifier is fitted on a bounded sample: per language, windows at hash-chosen places of hash-chosen
documents, `MAX_CHARS` characters in about, and `TOTAL_CHARS` for all languages together, with shorter
windows where there are many. Every language has at least one. Scoring reads whole texts.

Defined cases: null text or text without a letter gives `und`, score 0, and is rejected; so does every
text if nothing can be learned. Rows with a null lang aren't learned from. Ties go to the language
that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, columns, crc_of_id, named

ORDER = 4
UNKNOWN = "und"
MAX_CHARS = 400_000
TOTAL_CHARS = 16_000_000
SAMPLE_WINDOW, LEAST_WINDOW = 20_000, 500
#: Windows that a language's share of the characters is dealt into, at least.
WINDOWS = 20
FOLDS, HELD_OUT = 3, 1
#: One in so many sampled texts calibrates the rejection instead of training.
CALIBRATION = 5
#: Rejection: more nats per symbol above the language's mean than MARGIN and Z deviations of the mean of n symbols.
Z, MARGIN = 2.5, 1.0
CHUNK = 1 << 20
_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


def sample_size(n_languages: int) -> tuple[int, int]:
    """(characters to learn from per language, characters of a window)."""
    chars = min(MAX_CHARS, TOTAL_CHARS // max(1, n_languages))
    return chars, min(SAMPLE_WINDOW, max(LEAST_WINDOW, chars // WINDOWS))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def symbols(text: str) -> np.ndarray:
    """Lower-cased letters as code points, each run of anything else as one 0, and 0 around."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    folded = np.zeros(len(points) + 2, dtype=np.uint64)
    folded[1:-1] = np.where(_letters()[points], points, 0)
    keep = np.ones(len(folded), dtype=bool)
    keep[1:] = (folded[1:] != 0) | (folded[:-1] != 0)
    return folded[keep]


def hashes(line: np.ndarray) -> list[np.ndarray]:
    """For n = 1 to ORDER: hashes of the n symbols that end at each position; [0] is all zero."""
    padded = np.concatenate([np.zeros(ORDER - 1, dtype=np.uint64), line])
    out, total = [np.zeros(len(line), dtype=np.uint64)], np.zeros(len(line), dtype=np.uint64)
    for back in range(ORDER):
        first = ORDER - 1 - back
        mixed = (padded[first : first + len(line)] + np.uint64(1)) * _SALTS[back]
        total = total + (mixed ^ (mixed >> np.uint64(29))) * _SALTS[(back + 3) % len(_SALTS)]
        out.append(total)
    return out


def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, found) of values in a sorted array."""
    if not len(table):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return at, table[at] == wanted


@dataclass
class Table:
    """One language's arrays by order: sorted n-grams with log-probabilities, sorted contexts with log back-off weights."""

    grams: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    backoffs: list[np.ndarray]

    def total(self, some: np.ndarray, counts: np.ndarray, before: list[np.ndarray], at: list[np.ndarray], floor: float) -> float:
        """Log-probability of the n-grams that end at positions `some`, each `counts` times."""
        out = 0.0
        for n in range(ORDER, 0, -1):
            row, found = _find(self.grams[n], at[n][some])
            out += counts[found] @ self.logs[n][row[found]] if found.any() else 0.0
            some, counts = some[~found], counts[~found]
            if not len(some):
                return out
            row, known = _find(self.contexts[n], before[n - 1][some])
            out += counts[known] @ self.backoffs[n][row[known]] if known.any() else 0.0
        return out + counts.sum() * floor


@dataclass
class Model:
    languages: list[str]
    tables: list[Table]
    floor: float
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None

    def cross_entropies(self, text: str) -> tuple[int, np.ndarray]:
        """(symbols predicted, nats per symbol in each language). The first blank isn't predicted."""
        line = symbols(text)
        total, n = np.zeros(len(self.languages)), len(line) - 1
        if n <= 0 or not line.any():
            return 0, total
        for first in range(1, len(line), CHUNK):
            lead = min(first, ORDER)
            part = hashes(line[first - lead : first + CHUNK])
            total += self._sum([h[lead - 1 : -1] for h in part], [h[lead:] for h in part])
        return n, -total / n

    def _sum(self, before: list[np.ndarray], at: list[np.ndarray]) -> np.ndarray:
        order = np.argsort(at[ORDER])
        top = at[ORDER][order]
        starts = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]]))
        counts = np.diff(np.append(starts, len(top))).astype(np.float64)
        some = order[starts]  # one position for each distinct n-gram
        return np.array([t.total(some, counts, before, at, self.floor) for t in self.tables])


def train(texts: dict[str, list[str]]) -> Model:
    """Fit on texts by language."""
    languages = sorted(texts)
    if not languages:
        return Model([], [], 0.0)
    per_language = []
    for language in languages:
        lines = [symbols(t) for t in texts[language]]
        before = [[] for _ in range(ORDER + 1)]
        at = [[] for _ in range(ORDER + 1)]
        for line in lines:
            for n, h in enumerate(hashes(line)):
                at[n].append(h[1:])
                before[n].append(h[:-1])
        join = lambda parts: [np.concatenate(p) if p else np.zeros(0, dtype=np.uint64) for p in parts]
        at, before = join(at), join(before)
        stats: dict[int, tuple] = {}
        codes, index, counts = np.unique(at[ORDER], return_index=True, return_counts=True)
        for n in range(ORDER, 0, -1):
            stats[n] = (codes, counts, before[n - 1][index], at[n - 1][index])
            if n > 1:  # lower orders count the distinct symbols that an n-gram follows
                lower, first, counts = np.unique(at[n - 1][index], return_index=True, return_counts=True)
                codes, index = lower, index[first]
        per_language.append(stats)
    alphabet = len(np.unique(np.concatenate([s[1][0] for s in per_language]))) + 1
    return Model(languages, [_table(s, 1.0 / alphabet) for s in per_language], -float(np.log(alphabet)))


def _table(stats: dict[int, tuple], lowest: float) -> Table:
    """Interpolated Kneser-Ney probabilities from (n-grams, counts, their contexts, their suffixes) by order."""
    out = Table([np.zeros(0, np.uint64)], [np.zeros(0)], [np.zeros(0, np.uint64)], [np.zeros(0)])
    shorter, probability = None, None
    for n in range(1, ORDER + 1):
        codes, counts, context_of, suffix_of = stats[n]
        ones, twos = int((counts == 1).sum()), int((counts == 2).sum())
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        contexts, slot = np.unique(context_of, return_inverse=True)
        mass, kinds = np.bincount(slot, counts, minlength=len(contexts)), np.bincount(slot, minlength=len(contexts))
        weights = discount * kinds / mass
        # A seen n-gram's suffix is among the language's shorter ones.
        below = lowest if n == 1 else probability[np.searchsorted(shorter, suffix_of)]
        shorter, probability = codes, np.maximum(counts - discount, 0) / mass[slot] + weights[slot] * below
        out.grams.append(codes)
        out.logs.append(np.log(probability).astype(np.float32))
        out.contexts.append(contexts)
        out.backoffs.append(np.log(weights).astype(np.float32))
    return out


def calibrate(model: Model, texts: dict[str, list[str]]) -> Model:
    """Mean cross-entropy of held-out texts by language, and the deviation of a single symbol's."""
    model.mean, model.spread = np.full(len(model.languages), -model.floor), np.full(len(model.languages), 1.0)
    for k, language in enumerate(model.languages):
        seen = [(n, ce[k]) for n, ce in map(model.cross_entropies, texts.get(language, [])) if n]
        if seen:
            n, ce = np.array(seen).T
            model.mean[k] = (n * ce).sum() / n.sum()
            model.spread[k] = max(0.25, float(np.sqrt(np.mean(n * (ce - model.mean[k]) ** 2))))
    return model


def predict(model: Model, text: str | None) -> tuple[str, float, bool]:
    """(language, score, accepted). The score is the winner's share of the likelihood, per up to 50 symbols."""
    n, ce = model.cross_entropies(text) if text and model.languages else (0, None)
    if not n:
        return UNKNOWN, 0.0, False
    best = int(np.argmin(ce))
    score = 1.0 / float(np.exp((ce[best] - ce) * min(n, 50)).sum())
    above = ce[best] - model.mean[best]
    return model.languages[best], score, bool(above <= MARGIN + Z * model.spread[best] / np.sqrt(n))


def held_out(id_column: str = "doc_id") -> Column:
    return F.pmod(crc_of_id(id_column), F.lit(FOLDS)) == HELD_OUT


def fit(docs: DataFrame) -> Model:
    """Learn from the labelled documents outside the held-out fold."""
    labelled = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")
    sizes = labelled.groupBy("lang").agg(F.sum(F.least(F.length("text"), F.lit(SAMPLE_WINDOW))).alias("chars"), F.count(F.lit(1)).alias("n")).collect()
    budget, window = sample_size(len(sizes))
    texts: dict[str, list[str]] = {}
    checks: dict[str, list[str]] = {}
    if sizes:
        # Hash places: a document is sampled if its hash is below its language's share.
        share = {r["lang"]: min(1.0, budget / min(r["chars"], r["n"] * window)) for r in sizes}
        shares = F.broadcast(docs.sparkSession.createDataFrame(list(share.items()), "__lang string, __share double"))
        place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
        start = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - window + 1, F.lit(1))).cast("int") + 1
        piece = F.substring(F.col("text"), start, F.lit(window)).alias("text")
        wanted = ["lang", piece, F.xxhash64("doc_id", "text", F.lit(1)).alias("h"), place.alias("place")]
        sample = labelled.join(shares, F.col("lang") == F.col("__lang")).where(place < F.col("__share")).select(*wanted).collect()
        if missing := sorted(share.keys() - {r["lang"] for r in sample}):
            rest = labelled.where(F.col("lang").isin(missing)).select(*wanted)
            sample += rest.groupBy("lang").agg(F.min_by("text", "place").alias("text"), F.min_by("h", "place").alias("h")).collect()
        for r in sorted(sample, key=lambda r: (r["lang"], r["h"], r["text"])):
            (checks if r["h"] % CALIBRATION == 0 else texts).setdefault(r["lang"], []).append(r["text"])
        for language, only in checks.items():
            texts.setdefault(language, only)
    return calibrate(train(texts), checks)


def _classified(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns `keep`, then lang_pred, score, accepted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [predict(shared.value, t.as_py()) for t in batch["__text"]]
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], names=[*keep, "__lang", "__score", "__accepted"])

    chosen = docs.select(*map(named, keep), F.col("text").alias("__text"))
    schema = T.StructType([*chosen.schema.fields[:-1], T.StructField("__lang", T.StringType()), T.StructField("__score", T.DoubleType()), T.StructField("__accepted", T.BooleanType())])
    return arrow_map(chosen, run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted for every row."""
    out = _classified(docs, fit(docs), ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"), F.col("__accepted").alias("accepted"))


def accepted(docs: DataFrame) -> DataFrame:
    """The documents whose language is identified, unchanged."""
    return _classified(docs, fit(docs), docs.columns).where("__accepted").select(*columns(docs))
