"""Quality scores by regularised quadratic discriminant analysis over document statistics.

Every whole text is reduced to a fixed vector of transformed statistics. Each class is a Gaussian whose
covariance is shrunk towards the pooled one and towards its diagonal; a score is the logistic of the
difference of the classes' log densities and priors, from Mahalanobis distances by Cholesky factors that
are computed once and cached in the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.session import bounded_batches, id_crc32, materialise
from tallyfold.llm.text import blocks

FEATURES = (
    "length", "word_length", "upper", "symbols", "stops", "digits", "marked_words", "repeats", "variety",
    "repeated_lines", "non_ascii",
)

#: Weights of the pooled covariance and of the diagonal, and what is added to every variance.
POOLED, DIAGONAL, FLOOR = 0.05, 0.05, 1e-4

#: Features are whole numbers of 1 / UNIT, so that their sums are exact in whatever order rows come.
UNIT = 1 << 16

#: Rows whose moments are summed up in whole numbers at a time; they stay far below the end of a long.
SUMMED_ROWS = 1 << 20

_UPPER, _LOWER, _DIGIT, _SPACE, _STOP, _SYMBOL, _HIGH = range(7)


def _byte_kinds() -> np.ndarray:
    kinds = np.full(256, _SYMBOL, np.uint8)
    kinds[ord("A") : ord("Z") + 1], kinds[ord("a") : ord("z") + 1] = _UPPER, _LOWER
    kinds[ord("0") : ord("9") + 1], kinds[128:] = _DIGIT, _HIGH
    kinds[list(b" \t\n\v\f\r")], kinds[list(b".,;:!?'\"-()")] = _SPACE, _STOP
    return kinds


_KINDS = _byte_kinds()
_ENDS = frozenset(b"!?#$%&*|@^~=+<>_/\\")


def statistics(text: str | None) -> list[float]:
    """The FEATURES of a whole text, in order; of a null or empty one, those of no words.

    Shares are roots of counts over totals, where every total is enlarged by so many neutral cases that a
    few words can't reach the shares of a junk text. Long texts go by in blocks; of their words and lines hashes are
    kept, so that variety and repeated lines are those of the whole text too. Features are multiples of 1 / UNIT.
    """
    kinds = np.zeros(7, np.int64)
    words = chars = marked = repeats = lines = 0
    kept: list[np.ndarray] = []
    ended: list[np.ndarray] = []
    before, line = b"", xxhash.xxh3_64()
    for piece in blocks(text or ""):
        data = piece.encode()
        counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        kinds += np.bincount(_KINDS, weights=counts, minlength=7).astype(np.int64)
        found = data.split()
        words += len(found)
        chars += sum(map(len, found))
        marked += sum(w[-1] in _ENDS for w in found)
        repeats += sum(map(bytes.__eq__, found, found[1:])) + (bool(found) and found[0] == before)
        before = found[-1] if found else before
        distinct = set(found)
        kept.append(np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct)))
        first, *others = data.split(b"\n")
        line.update(first)
        if others:  # the line before ends here, the last one goes on in the next block
            whole = [line.intdigest(), *map(xxhash.xxh3_64_intdigest, others[:-1])]
            ended.append(np.array(whole, np.uint64))
            line = xxhash.xxh3_64(others[-1])
    ended.append(np.array([line.intdigest()], np.uint64))
    lines_again = variety = 0
    if words:
        lines = sum(map(len, ended))
        lines_again = lines - len(np.unique(np.concatenate(ended)))
        distinct_words = len(kept[0]) if len(kept) == 1 else len(np.unique(np.concatenate(kept)))
        variety = words * np.log(distinct_words) / np.log(words) if words > 1 else words
    letters = kinds[_UPPER] + kinds[_LOWER]
    size = max(1, int(kinds.sum()))
    share = lambda x, of, more: float(np.sqrt(x / (of + more)))
    found = [
        float(np.log1p(words)), float(np.log((chars + 55) / (words + 10))), share(kinds[_UPPER] + 3, letters, 100),
        share(kinds[_SYMBOL], size, 100), share(kinds[_STOP] + 2, size, 100), share(kinds[_DIGIT], size, 100),
        share(marked, words, 20), share(repeats, words, 20), float((variety + 20) / (words + 20)),
        share(lines_again, lines, 10), share(kinds[_HIGH], size, 100),
    ]
    return [round(x * UNIT) / UNIT for x in found]


@dataclass(frozen=True)
class Model:
    """Means, inverse Cholesky factors, half log determinants and log priors of classes 0 and 1."""

    means: np.ndarray
    inverse: np.ndarray
    half_logdet: np.ndarray
    log_prior: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 of each row of features."""
        logs = [
            self.log_prior[c] - self.half_logdet[c] - 0.5 * (((x - self.means[c]) @ self.inverse[c].T) ** 2).sum(1)
            for c in (0, 1)
        ]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def fit(counts: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> Model:
    """A model from each class's number of rows, sum of features and sum of their outer products.

    A class with no rows takes the other's mean and covariance; its prior counts it as half a row.
    """
    d = sums.shape[1]
    n = np.maximum(counts, 1)[:, None, None]
    means = sums / n[:, :, 0]
    covariances = squares / n - means[:, :, None] * means[:, None, :]
    pooled = (covariances * counts[:, None, None]).sum(0) / max(1, counts.sum())
    inverse, half = [], []
    for c in (0, 1):
        if not counts[c]:
            means[c], covariances[c] = means[1 - c], pooled
        shrunk = (1 - POOLED) * covariances[c] + POOLED * pooled
        shrunk = (1 - DIAGONAL) * shrunk + DIAGONAL * np.diag(np.diag(shrunk)) + FLOOR * np.eye(d)
        factor = np.linalg.cholesky(shrunk)
        inverse.append(np.linalg.inv(factor))
        half.append(np.log(np.diag(factor)).sum())
    prior = (counts + 0.5) / (counts.sum() + 1)
    return Model(means, np.array(inverse), np.array(half), np.log(prior))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pa.array([statistics(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], ["doc_id", "features"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Moments by class, in whole units: of each class rows of 1 + d + d * d numbers that add up to them."""
    d = len(FEATURES)

    def batch() -> pa.RecordBatch:
        rows = pa.array([0, 1], pa.int32()), pa.array(total.tolist(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays(list(rows), ["label", "moments"])

    total, n = np.zeros((2, 1 + d + d * d), np.int64), 0
    for rows in batches:
        if not rows.num_rows:
            continue
        x = rows.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        x = np.rint(x * UNIT).astype(np.int64)
        label = rows.column("label").to_numpy(zero_copy_only=False)
        for c in (0, 1):
            own = x[label == c]
            total[c] += np.concatenate(([len(own)], own.sum(0), (own.T @ own).ravel()))
        n += len(x)
        if n >= SUMMED_ROWS:
            yield batch()
            total, n = np.zeros_like(total), 0
    yield batch()


def train(features: DataFrame, labels: DataFrame) -> Model:
    """Fit to all rows of features (doc_id, features) that labels (doc_id, label 0 or 1) has.

    Moments are summed up in the tasks, in whole numbers; the driver gets one row per class and moment. Labels other
    than 0 and 1 and null ids take no part; a document with several labels counts once for each.
    """
    d = len(FEATURES)
    known = labels.where("label in (0, 1) and doc_id is not null").select("doc_id", F.col("label").cast("int"))
    parts = known.join(features, "doc_id").select("label", "features").mapInArrow(
        _moments, "label int, moments array<long>"
    )
    summed = parts.select("label", F.posexplode("moments")).groupBy("label", "pos")
    total = np.zeros((2, 1 + d + d * d))
    for row in summed.agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("sum")).collect():  # 2 * (1 + d + d * d) rows
        scale = 1 if row["pos"] == 0 else UNIT if row["pos"] <= d else UNIT * UNIT
        total[row["label"], row["pos"]] = int(row["sum"]) / scale
    return fit(total[:, 0], total[:, 1 : 1 + d], total[:, 1 + d :].reshape(2, d, d))


def held_out():
    """Rows whose labels are never learnt from."""
    return F.coalesce(id_crc32() % 5 == 0, F.lit(False))


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted (score >= least) of every row.

    Learns from the labels of rows that aren't held out; scores come from the texts alone. Null and empty
    texts are scored as texts of no words. A null doc_id isn't held out. With no label at all every score
    is 0.5 by the priors. Repeated rows are scored each; extra columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    features = materialise(narrow.mapInArrow(_features, "doc_id long, features array<double>"), "features")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("label"))
    model = train(features, known.where(~held_out()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            found = [batch.column("doc_id"), pa.array(model.scores(x))]
            yield pa.RecordBatch.from_arrays(found, ["doc_id", "score"])

    scored = features.mapInArrow(score, "doc_id long, score double")
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted")
    )
