"""Operator 8, quality classifier: random Fourier features, ridge regression, isotonic calibration.

Every text becomes a row of document statistics. Random Fourier features of the standardised statistics
approximate a Gaussian kernel; each partition of the labelled rows sums its part of the normal equations,
Spark adds the parts up row by row of the matrix, and the driver solves one system whose size does not
depend on the data. Labelled rows that took no part in the sums give the isotonic calibration, from
counts in a fixed number of score bins. Labels, lang, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_arrow, quoted, slices, table, written

N_FEATURES, RIDGE, SEED, N_BINS = 256, 1e-3, 8, 512
#: Rows with this remainder of crc32(doc_id as text) by FOLDS are held out; those with CALIBRATE calibrate.
FOLDS, HELD_OUT, CALIBRATE = 5, 0, 4
#: Labelled rows that train, about: some 10 MB of ids on each executor.
TRAIN_ROWS = 400_000
#: Partitions whose sums of one row of the equations are added up in one group.
SPREAD = 1024
THRESHOLD = 0.3

STATISTICS = ("log_chars", "log_words", "word_length", "word_length_spread", "long_words", "one_char_words", "distinct_words", "top_word", "repeated_bigrams", "repeated_neighbours", "dup_lines", "words_a_line", "upper", "digits", "symbols", "pipes", "marks", "sentence_ends", "commas", "other_letters", "ends_marked", "all_upper_words")
_SYMBOLS = b"#*$%&|<>@^~_=+{}[]\\/"


def statistics(text: str | None) -> list[float]:
    """The statistics of one text; a null text is an empty one."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(raw))
    left = lambda drop: len(raw) - len(raw.translate(None, drop))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        np.log1p(len(raw)), np.log1p(len(words)), float(lengths.mean()), float(lengths.std()),
        float((lengths > 14).mean()), float((lengths == 1).mean()), len(counts) / n, max(counts.values(), default=0) / n,
        1 - pairs / max(1, len(words) - 1), sum(map(str.__eq__, words, words[1:])) / n,
        1 - len(set(lines)) / max(1, len(lines)), np.log1p(len(words) / max(1, len(lines))),
        left(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / chars, left(b"0123456789") / chars, left(_SYMBOLS) / chars, left(b"|") / n,
        left(b"!?") / n, left(b".") / n, left(b",") / n, (len(raw) - len(text)) / chars,
        sum(w[-1] in "#*$%&!" for w in words) / n, sum(map(str.isupper, words)) / n,
    ]


def _matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=np.float64).reshape(len(texts), len(STATISTICS))


def fold(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode()) % FOLDS


@dataclass
class Model:
    """Everything a score needs; its size does not depend on the data."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    edges: np.ndarray  # increasing raw scores
    values: np.ndarray  # calibrated probabilities at the edges
    seed: int = SEED

    def features(self, x: np.ndarray) -> np.ndarray:
        return fourier((x - self.mean) / self.spread, self.seed)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        return np.interp(self.features(x) @ self.weights, self.edges, self.values)


def fourier(z: np.ndarray, seed: int = SEED, n: int = N_FEATURES) -> np.ndarray:
    """Cosines whose inner products approximate a Gaussian kernel of width sqrt(dimensions), and a constant."""
    rng = np.random.default_rng(seed)
    d = z.shape[1]
    w, b = rng.normal(size=(d, n)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, n)
    return np.hstack([np.sqrt(2 / n) * np.cos(np.clip(z, -4, 4) @ w + b), np.ones((len(z), 1))])


def isotonic(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Non-decreasing means of ``y / n`` nearest to it, weighted by ``n``: pool adjacent violators."""
    blocks: list[list[float]] = []
    for a, b in zip(y, n, strict=True):
        blocks.append([a, b, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.concatenate([np.full(int(k), a / b) for a, b, k in blocks]) if blocks else np.zeros(0)


def labelled_statistics(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """fold, y, x (statistics) of the documents with a label, held-out ones left out before any text is read by Python.

    A document of several labels counts once, as good if one of them says so. Up to ``TRAIN_ROWS`` labels all train; of more,
    a part of about that many does, taken by hash. Their ids are broadcast, so no text is shuffled to find its label.
    """
    fold_of = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)).cast("int")
    told = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("y"))
    known = written(told.withColumn("fold", fold_of).where(F.col("fold") != HELD_OUT), "known")
    n = known.count()
    if n > TRAIN_ROWS:
        known = known.where(F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 20)) < int((1 << 20) * TRAIN_ROWS / n))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "fold", "y")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = _matrix(b.column(0).to_pylist())
            yield pa.RecordBatch.from_pydict({"fold": b.column(1), "y": b.column(2), "x": pa.array(list(x), pa.list_(pa.float64()))})

    return in_arrow(rows, measure, "fold int, y int, x array<double>")


def _x(batch: pa.RecordBatch) -> np.ndarray:
    return np.array(batch.column("x").values.to_numpy(zero_copy_only=False)).reshape(-1, len(STATISTICS)) if batch.num_rows else np.zeros((0, len(STATISTICS)))


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model, or None without labelled rows to train on."""
    rows = written(labelled_statistics(docs, labels), "labelled")
    # Moments of the statistics, by position: a row per statistic.
    moments = rows.where(F.col("fold") != CALIBRATE).select(F.posexplode("x")).groupBy("pos").agg(F.avg("col"), F.stddev_pop("col"), F.count("col")).collect()
    if not moments:
        return None
    order = sorted(moments)
    mean, spread = np.array([r[1] for r in order]), np.array([max(r[2], 1e-9) for r in order])
    n = order[0][3]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((N_FEATURES + 1, N_FEATURES + 2))
        for b in batches:
            z = fourier((_x(b) - mean) / spread)
            total += z.T @ np.hstack([z, np.asarray(b.column("y"))[:, None]])
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total)), pa.int32()), "v": pa.array([r.tobytes() for r in total], pa.binary())})

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, total = None, np.zeros(N_FEATURES + 2)
        for b in parts:
            i = b.column("i").slice(0, 1) if b.num_rows else i
            for v in b.column("v").to_pylist():
                total += np.frombuffer(v)
        yield pa.RecordBatch.from_pydict({"i": i, "v": pa.array([total.tobytes()], pa.binary())})

    # A part of fixed size from each partition. Row i of all parts is added up in two levels: a group of the
    # first has that row of SPREAD partitions, 2 KB each, one of the second a row for each of those groups.
    parts = rows.where(F.col("fold") != CALIBRATE).mapInArrow(sums, "i int, v binary")
    some = parts.withColumn("g", F.floor(F.spark_partition_id() / SPREAD)).groupBy("i", "g").applyInArrow(add, "i int, v binary")
    solved = sorted(some.groupBy("i").applyInArrow(add, "i int, v binary").collect())
    both = np.array([np.frombuffer(r[1]) for r in solved])
    gram, right = both[:, :-1], both[:, -1]
    weights = np.linalg.solve(gram + RIDGE * n * np.eye(len(gram)) / N_FEATURES, right)
    model = Model(mean, spread, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = model.features(_x(b)) @ weights if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_pydict({"bin": pa.array(np.clip((raw + 0.5) * N_BINS / 2, 0, N_BINS - 1).astype(np.int32)), "y": b.column("y"), "raw": pa.array(raw)})

    bins = sorted(rows.where(F.col("fold") == CALIBRATE).mapInArrow(binned, "bin int, y int, raw double").groupBy("bin").agg(F.sum("y"), F.count("y"), F.avg("raw")).collect())
    if bins:
        y, k, at = (np.array([float(r[j]) for r in bins]) for j in (1, 2, 3))
        p = isotonic(y, k)
        # A point a bin, joined by lines, with a last trace of slope so that ties of the steps keep their order.
        model.edges, model.values = at, np.clip(p * 0.999 + 0.001 * (at + 0.5) / 2, 0, 1)
    return model


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``score``, from 0 to 1. Without a model every score is 0.5. Null and empty texts are scored as empty; a column named score is replaced."""
    kept = [c for c in docs.columns if c != "score"]
    rows = docs.select(F.struct(*quoted(kept)).alias("doc"), F.col("text").alias("text"))
    kind = rows.schema["doc"].dataType

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = _matrix(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x) if model else np.full(len(x), 0.5))], names=["doc", "score"])

    out = T.StructType([T.StructField("doc", kind), T.StructField("score", T.DoubleType())])
    return in_arrow(rows, score, out).select("doc.*", "score")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with their columns."""
    return scored(docs, fit(docs, labels)).where(F.col("score") >= THRESHOLD).select(quoted(docs.columns))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT
    got = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return got.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
