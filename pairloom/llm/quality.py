"""Quality classifier: naive Bayes support vectors.

A text's features are indicators of n-grams of two kinds: of its bytes, and of the forms of its words (case, digits,
the marks around it, and whether it repeats the word before it). Indicators are scaled by the log-count ratio of their
n-gram between the two classes; a linear hinge loss on the scaled indicators is minimised by dual coordinate descent.
The whole fit, the log-count ratios too, is made of one sample of the labelled training rows: at most SAMPLE rows in the
order of a hash of doc_id, and of these as many as have SAMPLE_GRAMS distinct n-grams together, which bounds the fit's
memory. Scores are a logistic of the margin, fitted on the same rows.

Rows whose crc32(doc_id as text) mod `folds` is 0 are held out: their labels are never read. The score of a text uses
nothing but the text.

Defined results: null texts count as empty, which has the one indicator that every text has, so empty texts get the
score of the prior; labels repeated for a doc_id count as often as they stand; null labels are no labels; without
training rows of both classes every score is the share of label 1, or 0.5; empty tables give empty results; long texts are
read in parts, so memory follows the number of bins; other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, materialize

#: Hash bins of n-grams; rows and distinct n-grams of the fit (the bounds of its sample); cost, passes, folds and the
#: threshold of a good text.
BINS, SAMPLE, SAMPLE_GRAMS, COST, PASSES, FOLDS, THRESHOLD = 1 << 19, 6000, 40_000_000, 1.0, 12, 5, 0.3
#: Bytes or characters of a text that are read at once; words whose form is remembered, and how long they may be.
PART, KNOWN, LONG_WORD = 1 << 19, 200_000, 40
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SPACE = re.compile(r"\s")
BYTE_GRAMS, FORM_GRAMS = (2, 3, 4), (1, 2, 3)
SMOOTH = 1.0


def hashed(values: np.ndarray) -> np.ndarray:
    """Bins of 64-bit n-gram codes, by multiplication."""
    return ((values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)


#: Codes of word forms seen by this worker, by word: alone, and after itself.
_FORMS: tuple[dict[str, int], dict[str, int]] = ({}, {})


def form_code(word: str, again: int) -> int:
    """A code for a word's case, digits, the marks behind it, and whether it repeats the word before it."""
    core = word.strip(MARKS)
    case = "-" if not core else "u" if core.isupper() and len(core) > 1 else "t" if core.istitle() else "l" if core.islower() else "d" if core.isdigit() else "m"
    code = zlib.crc32(f"{case}{again}{word[len(word.rstrip(MARKS)) :][:3]}".encode("utf-8", "surrogatepass"))
    known = _FORMS[again]
    if len(known) >= KNOWN:
        known.clear()
    if len(word) <= LONG_WORD:
        known[word] = code
    return code


def word_forms(words: list[str], before: str | None = None) -> np.ndarray:
    """A code for the form of each word; before: the word that stands before them."""
    alone, after = _FORMS
    codes = [alone[w] if w in alone else form_code(w, 0) for w in words]
    for i, (a, b) in enumerate(zip([before, *words], words, strict=False)):
        if a == b:
            codes[i] = after[b] if b in after else form_code(b, 1)
    return np.array(codes, np.uint64)


def byte_grams(raw: np.ndarray) -> list[np.ndarray]:
    """Bins of the n-grams of bytes."""
    found = []
    for n in BYTE_GRAMS:
        if len(raw) >= n:
            code = np.full(len(raw) - n + 1, np.uint64(n))
            for j in range(n):
                code = code << np.uint64(8) | raw[j : len(raw) - n + 1 + j]
            found.append(hashed(code))
    return found


def form_grams(forms: np.ndarray) -> list[np.ndarray]:
    """Bins of the n-grams of word forms."""
    found = []
    for n in FORM_GRAMS:
        if len(forms) >= n:
            code = np.full(len(forms) - n + 1, np.uint64(1 << 40 | n))
            for j in range(n):
                code = code * np.uint64(0x100000001B3) ^ forms[j : len(forms) - n + 1 + j]
            found.append(hashed(code))
    return found


def features(text: str | None) -> np.ndarray:
    """The distinct bins of all n-grams of a text, and bin 0 for being a text."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    if len(data) > PART:
        return long_features(text, data)
    raw = np.frombuffer(data, np.uint8).astype(np.uint64)
    return distinct(np.concatenate([np.zeros(1, np.int64), *byte_grams(raw), *form_grams(word_forms(text.split()))]))


def long_features(text: str, data: bytes) -> np.ndarray:
    """The same bins, part by part: each part begins with the end of the one before."""
    seen = np.zeros(BINS, bool)
    seen[0] = True
    for at in range(0, len(data), PART):
        for bins in byte_grams(np.frombuffer(data[max(0, at - max(BYTE_GRAMS) + 1) : at + PART], np.uint8).astype(np.uint64)):
            seen[bins] = True
    at, before, last = 0, None, np.zeros(0, np.uint64)
    while at < len(text):
        cut = SPACE.search(text, at + PART)
        stop = cut.start() if cut else len(text)
        words = text[at:stop].split()
        forms = np.concatenate([last, word_forms(words, before)])
        for bins in form_grams(forms):
            seen[bins] = True
        at, before, last = stop, words[-1] if words else before, forms[max(0, len(forms) - max(FORM_GRAMS) + 1) :]
    return np.flatnonzero(seen)


_LAST = np.zeros(BINS, np.int32)


def distinct(bins: np.ndarray) -> np.ndarray:
    """Each bin once, without sorting: the last place that writes to a bin keeps it."""
    place = np.arange(len(bins), dtype=np.int32)
    _LAST[bins] = place
    return bins[_LAST[bins] == place]


def log_count_ratio(pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
    p, q = pos + SMOOTH, neg + SMOOTH
    return np.log((p / p.sum()) / (q / q.sum()))


def fit(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, cost: float = COST, passes: int = PASSES, seed: int = 10, least: float = 1e-4) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and dual variables of the hinge loss by dual coordinate descent; rows are scaled to unit length, and
    the rarer class costs as much in all as the other. Ends with a pass whose steps are all below `least`."""
    y = np.where(labels > 0, 1.0, -1.0)
    share = np.bincount((y > 0).astype(int), minlength=2) / len(y)
    upper = cost * np.where(y > 0, 0.5 / share[1], 0.5 / share[0])
    values = [(ratio[r] / max(1e-12, np.sqrt(np.square(ratio[r]).sum()))).astype(np.float32) for r in rows]
    weights, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        most = 0.0
        for i in rng.permutation(len(rows)).tolist():
            bins, x = rows[i], values[i]
            gradient = y[i] * (weights[bins] @ x + bias) - 1
            new = min(max(alpha[i] - gradient / 2.0, 0.0), upper[i])  # |x|^2 + 1 for the bias
            step = (new - alpha[i]) * y[i]
            if step:
                weights[bins] += step * x
                bias += step
                most = max(most, abs(step))
            alpha[i] = new
        if most < least:
            break
    return weights, bias, alpha


def margin(bins: np.ndarray, scaled: np.ndarray, ratio: np.ndarray, bias: float) -> float:
    return float(scaled[bins].sum() / max(1e-12, np.sqrt(np.square(ratio[bins]).sum())) + bias)


def logistic_of(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities; targets are drawn in, so separable classes stay finite."""
    n1, n0 = labels.sum(), (1 - labels).sum()
    target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, theta = np.column_stack([margins, np.ones(len(margins))]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target))
        theta = theta - step
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


class Model:
    """weights * ratio of every bin, the ratio, and the numbers that make a score of a margin."""

    def __init__(self, scaled: np.ndarray, ratio: np.ndarray, bias: float, slope: float, offset: float):
        self.scaled, self.ratio, self.bias, self.slope, self.offset = scaled, ratio, bias, slope, offset

    def score(self, text: str | None) -> float:
        z = self.slope * margin(features(text), self.scaled, self.ratio, self.bias) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def trained(texts: list[str | None], labels: list[int]) -> Model:
    return trained_on([features(t).astype(np.int32) for t in texts], labels)


def ratios(rows: list[np.ndarray], labels: list[int]) -> np.ndarray:
    """The log-count ratio of each bin."""
    pos, neg = np.zeros(BINS), np.zeros(BINS)
    for r, label in zip(rows, labels, strict=True):
        (pos if label else neg)[r] += 1
    return log_count_ratio(pos, neg)


def trained_on(rows: list[np.ndarray], labels: list[int]) -> Model:
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():  # nothing to tell apart: every score is the share of label 1
        share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return Model(np.zeros(BINS, np.float32), np.zeros(BINS, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    ratio = ratios(rows, labels)
    weights, bias, _ = fit(rows, y, ratio)
    scaled = weights * ratio
    margins = np.array([margin(r, scaled, ratio, bias) for r in rows])
    return Model(scaled.astype(np.float32), ratio.astype(np.float32), bias, *logistic_of(margins, y))


def held_out(doc_id, folds: int = FOLDS):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = FOLDS, grams: int = SAMPLE_GRAMS) -> Model:
    """Fit on at most `sample` labelled rows, and `grams` distinct n-grams in all, outside the held-out fold, chosen by a
    hash of doc_id.

    The sample's ids are broadcast (their number is the bound); features are made where the texts are, and only those of
    the sample are shuffled."""
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"), folds))
    order = F.xxhash64("doc_id").alias("o")
    chosen = chosen.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), order).orderBy("o", "doc_id", "quality").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(materialize(chosen)), "doc_id").select("o", "doc_id", "quality", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                found = [features(t.as_py()).astype(np.int32) for t in part["text"]]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([f.tobytes() for f in found], pa.binary())], ["o", "doc_id", "quality", "bins"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, held = [], 0
        for b in batches:
            for d, q, bins in zip(b["doc_id"].to_pylist(), b["quality"].to_pylist(), b["bins"], strict=True):
                held += bins.as_buffer().size // 4
                if held <= grams:
                    got.append((d, q, bins.as_py()))
        got.sort()
        m = trained_on([np.frombuffer(f, np.int32) for _, _, f in got], [int(q > 0) for _, q, _ in got])
        yield pa.RecordBatch.from_arrays([pa.array([m.scaled.tobytes()]), pa.array([m.ratio.tobytes()]), pa.array([[m.bias, m.slope, m.offset]], pa.list_(pa.float64()))], ["scaled", "ratio", "numbers"])

    found = map_arrow(rows, cut, "o long, doc_id long, quality int, bins binary")
    model = map_arrow(found.repartition(1).sortWithinPartitions("o", "doc_id", "quality", "bins"), run, "scaled binary, ratio binary, numbers array<double>").first()
    if model is None:  # no labelled row at all
        return trained_on([], [])
    return Model(np.frombuffer(model["scaled"], np.float32), np.frombuffer(model["ratio"], np.float32), *model["numbers"])


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD, folds: int = FOLDS) -> DataFrame:
    """All columns of docs, then score and predicted."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([model.score(t.as_py()) for t in batch.column(at)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return map_arrow(docs, run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, folds: int = FOLDS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    found = scored(docs.select("doc_id", "text"), train(docs, labels, folds=folds), threshold, folds)
    return found.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "score", "predicted")


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with their columns."""
    model = train(docs, labels)
    plain = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"))
    return scored(plain, model).where("predicted = 1").select("whole.*")
