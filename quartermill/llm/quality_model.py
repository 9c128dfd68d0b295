"""Quality classifier (operator 6): ordinal cumulative-link regression on graded ratings.

A document has grade 0 to 2: a point for quality, a point for not being toxic. The model has one weight for each hashed feature of the text, shared by all
grades, and ordered thresholds: P(grade >= g) = logistic(score - threshold g). The expected grade and the tail probability of
the highest grade follow. It is fitted on a bounded sample of labelled rows and scores every whole text. Features are worked out
where the texts are; the driver, which fits, gets those that enough rows of the sample have, no texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartermill.llm._common import Memo, Scratch, columns_of, map_texts, table

#: Labelled rows used to fit at most, features, rows that a feature must be in, and the share of highest-grade documents that selection may lose.
SAMPLE_ROWS = 6000
SIZE = 1 << 20
LEAST_ROWS = 8
LOSS = 0.002


def word_features(word: str) -> tuple[int, ...]:
    """Hashed: the word's letters, its marks, and whether it is in capitals."""
    letters = "".join(c for c in word if c.isalpha())
    marks = "".join(c for c in word if not c.isalnum() and c not in ".,;:")
    out = []
    if letters:
        out.append(zlib.crc32(b"w" + letters.lower().encode()) % SIZE)
        if len(letters) > 2 and letters.isupper():
            out.append(zlib.crc32(b"capitals") % SIZE)
    if marks:
        out.append(zlib.crc32(b"m" + marks.encode()) % SIZE)
        out.append(zlib.crc32(b"marks") % SIZE)
    return tuple(out)


def text_features(text: str, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Feature indices and values: the root of each feature's count, damped by the text's length; and how much the text repeats itself."""
    words = text.split()
    found = [f for own in map(memo.__getitem__, words) for f in own]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0)
    ids, counts = np.unique(np.fromiter(found, np.int64, len(found)), return_counts=True)
    lines = [x for x in text.split("\n") if x]
    repeated = zlib.crc32(f"lines {int(5 * (1 - len(set(lines)) / max(1, len(lines))))}".encode()) % SIZE
    pairs = set(zip(words, words[1:], words[2:]))
    again = zlib.crc32(f"windows {int(5 * (1 - len(pairs) / max(1, len(words) - 2)))}".encode()) % SIZE
    values = np.sqrt(counts) / len(words) ** 0.25
    return np.append(ids, [repeated, again]), np.append(values, [0.5, 0.5])


class OrdinalModel:
    def __init__(self, weights: np.ndarray, cuts: np.ndarray, keep_from: float):
        self.weights, self.cuts, self.keep_from = weights, cuts, keep_from

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= g) for g = 1, 2, ..., a row for each score."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None] - score[:, None], -60, 60)))

    @classmethod
    def fit(cls, rows: list[tuple[str, int]], grades: int = 3) -> OrdinalModel:
        """rows: texts and grades."""
        memo = Memo(400_000, word_features)
        return cls.fit_features([text_features(t, memo) for t, _ in rows], np.array([g for _, g in rows], np.int64), grades)

    @classmethod
    def fit_features(cls, every: list[tuple[np.ndarray, np.ndarray]], grade: np.ndarray, grades: int = 3) -> OrdinalModel:
        """On all rows; a model of two thirds of them, asked about the other third, sets the tail probability from which to keep."""
        held = np.arange(len(every)) % 3 == 2
        trial = cls._descend([every[i] for i in np.nonzero(~held)[0]], grade[~held], grades)
        model = cls._descend(every, grade, grades)
        best = np.nonzero(held & (grade == grades - 1))[0]
        if len(best):
            tail = trial.tails(np.array([every[i][1] @ trial.weights[every[i][0]] for i in best]))[:, -1]
            model.keep_from = max(0.5, float(np.quantile(tail, LOSS)) * 0.9)
        return model

    @classmethod
    def _descend(cls, every: list, grade: np.ndarray, grades: int, steps: int = 400, rate: float = 0.1, ridge: float = 1e-5) -> OrdinalModel:
        """Adam on the mean log-likelihood. Features in too few rows keep weight 0."""
        n = len(every)
        if not n:
            return cls(np.zeros(SIZE), np.arange(grades - 1) * 1e-3, 0.5)
        index, value = np.concatenate([x[0] for x in every]), np.concatenate([x[1] for x in every])
        row = np.repeat(np.arange(n), [len(x[0]) for x in every])
        common = np.bincount(index, minlength=SIZE) >= LEAST_ROWS
        use = common[index]
        names, index = np.unique(index[use], return_inverse=True)
        value, row, size = value[use], row[use], len(names)
        share = np.clip((grade[:, None] >= np.arange(1, grades)[None]).mean(0), 0.01, 0.99)
        cuts = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-3 * np.arange(grades - 1))
        theta = np.concatenate([np.zeros(size), cuts])
        model = cls(theta[:size], theta[size:], 0.5)
        m, v, edge = np.zeros_like(theta), np.zeros_like(theta), np.zeros((n, 1))
        for step in range(1, steps + 1):
            score = np.bincount(row, value * model.weights[index], n)
            tails = model.tails(score)
            full = np.concatenate([np.ones((n, 1)), tails, edge], 1)
            own = np.maximum(full[np.arange(n), grade] - full[np.arange(n), grade + 1], 1e-9)
            slope = np.concatenate([edge, tails * (1 - tails), edge], 1)
            low, high = slope[np.arange(n), grade] / own, slope[np.arange(n), grade + 1] / own
            to_cuts = [(low[grade == g].sum() - high[grade == g - 1].sum()) / n for g in range(1, grades)]
            gradient = np.concatenate([np.bincount(index, value * ((high - low) / n)[row], size) + ridge * model.weights, to_cuts])
            m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
            theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            model.weights, model.cuts = theta[:size], np.maximum.accumulate(theta[size:])
        weights = np.zeros(SIZE)
        weights[names] = model.weights
        return cls(weights, model.cuts, 0.5)


def fit_model(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> OrdinalModel:
    """From sample_rows labelled rows at most, chosen by a hash of doc_id.

    Labels without both ratings or a doc_id aren't used; a null text has no features. A doc_id with several labels or documents
    gives a row for each pair, sample_rows in all. No labels: a model without weights.
    """
    scratch = Scratch(docs.sparkSession, "quality-model")
    rated = labels.where("quality IS NOT NULL AND toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", (F.col("quality") + 1 - F.col("toxic")).cast("int").alias("grade"))
    order = [F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)), F.col("doc_id"), F.col("grade")]
    chosen = rated.orderBy(*order).limit(sample_rows)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).join(F.broadcast(chosen), "doc_id")  # sample_rows at most

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(300_000, word_features, lambda w: len(w) <= 100)
        for batch in batches:
            keys, hashes, grades, texts = columns_of(batch, "doc_id", "text_hash", "grade", "text")
            own = [text_features(t or "", memo) for t in texts]
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(hashes, pa.int64()), pa.array(grades, pa.int32()), pa.array([x.tolist() for x, _ in own], pa.list_(pa.int32())), pa.array([x.tolist() for _, x in own], pa.list_(pa.float64()))], names=["doc_id", "text_hash", "grade", "ids", "weights"])

    every = map_texts(rows, features, "doc_id long, text_hash long, grade int, ids array<int>, weights array<double>")
    own = scratch.keep(every.orderBy(*order, "text_hash").limit(sample_rows).drop("text_hash"))
    common = own.select(F.explode("ids").alias("id")).groupBy("id").count().where(F.col("count") >= LEAST_ROWS).select("id").collect()  # SIZE ids at most
    known = np.zeros(SIZE, bool)
    known[[r["id"] for r in common]] = True
    shipped = docs.sparkSession.sparkContext.broadcast(known)

    def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, grades, ids, weights = columns_of(batch, "doc_id", "grade", "ids", "weights")
            keep = [[k for k, x in enumerate(i) if shipped.value[x]] for i in ids]
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(grades, pa.int32()), pa.array([[i[k] for k in own] for i, own in zip(ids, keep)], pa.list_(pa.int32())), pa.array([[w[k] for k in own] for w, own in zip(weights, keep)], pa.list_(pa.float64()))], names=["doc_id", "grade", "ids", "weights"])

    taken = map_texts(own, thinned, "doc_id long, grade int, ids array<int>, weights array<double>").collect()  # sample_rows rows
    taken.sort(key=lambda r: (r["doc_id"] * 2654435761 % (1 << 32), r["grade"], r["ids"], r["weights"]))
    scratch.drop(own)
    return OrdinalModel.fit_features([(np.array(r["ids"], np.int64), np.array(r["weights"])) for r in taken], np.array([r["grade"] for r in taken], np.int64))


def rate(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """doc_id, expected_grade, tail_probability (of the highest grade), kept of every row.

    A null or empty text has score 0 and isn't kept. Rows with the same doc_id, or the same row twice, each give a row. Columns
    besides doc_id and text aren't read. An empty table gives no rows.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.cuts, model.keep_from))  # SIZE numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = OrdinalModel(*shipped.value)
        memo = Memo(300_000, word_features, lambda w: len(w) <= 100)
        for batch in batches:
            keys, texts = columns_of(batch, "doc_id", "text")
            scores, some = [], []
            for t in texts:
                index, value = text_features(t or "", memo)
                scores.append(float(value @ own.weights[index]))
                some.append(len(index) > 0)
            tails = own.tails(np.array(scores)) if scores else np.zeros((0, len(own.cuts)))
            tail = np.round(tails[:, -1], 6)
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(np.round(tails.sum(1), 6)), pa.array(tail), pa.array([bool(s and x >= round(own.keep_from, 6)) for s, x in zip(some, tail)], pa.bool_())], names=["doc_id", "expected_grade", "tail_probability", "kept"])

    return map_texts(docs.select("doc_id", "text"), run, "doc_id long, expected_grade double, tail_probability double, kept boolean")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    docs = table(spark, sf_dir, "documents")
    return rate(docs, fit_model(docs, table(spark, sf_dir, "labels")))
