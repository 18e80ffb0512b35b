"""Severity of toxicity by cumulative-link ordinal regression on sparse word features.

Model: grades 0 < 1 < ... < K-1 with P(grade <= k | x) = sigmoid(theta_k - w.x): one weight
vector for all thresholds, thresholds in order by construction (the first, then positive
steps). x holds log(1 + count) of the vocabulary's features: whole words, and their first 4,
5 and 6 letters, which stand for a stem with any ending. The score is the expected grade.

Fit, on at most ``sample`` labelled documents (the bound keeps driver memory fixed), each
distinct text once. Above the bound every label gets an equal part of it, or all its rows if
they are fewer; a label's rows are those whose hash of the id comes first, and they are weighted
by the share of them that was taken, so the model keeps the labels' own proportions:

* the vocabulary is the ``vocabulary`` features of greatest chi-square between the lowest and
  the other grades, in ``min_docs`` documents or more (a Spark aggregate over the sample);
* where labels say only toxic or not, severity is graded from them: 0 if not, else 1 to 3 by
  thirds of the share of words that mark toxic documents (log odds above ``marker``);
* weights and thresholds minimise the negative log likelihood with an L2 penalty, by Adam on
  the sparse design (numpy, as many entries as the sample has vocabulary words).

Scoring reads each whole text once, in tasks, without a shuffle. Null and empty texts have no
features and get the score of a document without any; rows with a null label are not fitted;
without two grades among the labels every score is 0. Repeated rows have equal results; an
empty table gives an empty one. Other columns are not read, nor changed by ``keep_mild``.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import hash_sample, text_of, written

WORDS = re.compile(r"[^\W\d_]+")


STEMS = (4, 5, 6)


def features(word: str) -> list[str]:
    return ["=" + word, *(word[:k] for k in STEMS if len(word) >= k)]


def feature_counts(text: str | None, number: dict[str, int], marks: frozenset = frozenset()) -> tuple[list, list, int]:
    """Vocabulary numbers of a text, their counts, and the number of its words with a feature of ``marks``."""
    words = Counter(WORDS.findall((text or "").lower()))
    found, marked = {}, 0
    for word, n in words.items():
        mine = [number[f] for f in features(word) if f in number]
        for f in mine:
            found[f] = found.get(f, 0) + n
        if marks and not marks.isdisjoint(mine):
            marked += n
    return list(found.keys()), list(found.values()), marked


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Sparse:
    """Rows of (column, value) lists for products with a weight vector."""

    def __init__(self, columns: list, values: list, width: int):
        self.n, self.width = len(columns), width
        self.row = np.repeat(np.arange(self.n), [len(c) for c in columns])
        self.col = np.fromiter((x for c in columns for x in c), np.int64, len(self.row))
        self.value = np.log1p(np.fromiter((x for v in values for x in v), float, len(self.row)))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.col], minlength=self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.value * g[self.row], minlength=self.width)


@dataclass
class Severity:
    """A fitted model: word numbers, shared weights, ordered thresholds."""

    number: dict
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, eta: np.ndarray) -> np.ndarray:
        """(n, K-1): P(grade > k)."""
        return 1 - sigmoid(self.thresholds[None, :] - eta[:, None])

    def eta(self, texts) -> np.ndarray:
        rows = [feature_counts(t, self.number) for t in texts]
        return Sparse([r[0] for r in rows], [r[1] for r in rows], len(self.weights)).dot(self.weights)


def cumulative_link(x: Sparse, grade: np.ndarray, grades: int, l2: float, steps: int = 300, rate: float = 0.1,
                    weight: np.ndarray | None = None):
    """Weights and thresholds of greatest penalised likelihood; ``weight`` of each row, 1 on average."""
    weight = np.ones(x.n) if weight is None else weight * x.n / weight.sum()
    share = np.cumsum(np.bincount(grade, weight, minlength=grades))[:-1] / x.n
    first = np.log(share / (1 - share))
    free = np.concatenate([np.zeros(x.width), [first[0]], np.log(np.maximum(np.diff(first), 0.05))])
    m, v = np.zeros_like(free), np.zeros_like(free)
    for t in range(1, steps + 1):
        w, theta = free[:x.width], _ordered(free[x.width:])
        cut = np.concatenate([[-np.inf], theta, [np.inf]])
        eta = x.dot(w)
        a, b = sigmoid(cut[grade + 1] - eta), sigmoid(cut[grade] - eta)
        a, b = np.where(grade + 1 == grades, 1.0, a), np.where(grade == 0, 0.0, b)
        p = np.maximum(a - b, 1e-12)
        d_theta = np.zeros(grades + 1)
        np.add.at(d_theta, grade + 1, -weight * a * (1 - a) / p)
        np.add.at(d_theta, grade, weight * b * (1 - b) / p)
        d_theta = d_theta[1:-1] / x.n
        later = np.cumsum(d_theta[::-1])[::-1]               # a step moves all later thresholds
        d_free = np.concatenate([[later[0]], later[1:] * np.exp(free[x.width + 1:])])
        g = np.concatenate([x.back(-weight * (a + b - 1)) / x.n + l2 * w, d_free])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        free = free - rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return free[:x.width], _ordered(free[x.width:])


def _ordered(free: np.ndarray) -> np.ndarray:
    return np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *,
        sample: int = 20_000, vocabulary: int = 2000, min_docs: int = 5, marker: float = 3.0, chi_square: float = 15.0,
        l2: float = 2e-5, seed: int = 23) -> Severity:
    """Fit on labelled documents; labels above 1 are grades as they are, 0/1 labels are graded."""
    known = labels.where(labels[label_col].isNotNull() & labels[id_col].isNotNull()).select(
        labels[id_col].alias("_id"), labels[label_col].cast("int").alias("label"))
    known, rarity = label_sample(known.distinct(), sample, seed)
    texts = docs.select(docs[id_col].alias("_id"), text_of(docs, text_col).alias("text"))
    # the sample's bound makes this side small whatever the tables hold
    rows = written(texts.join(F.broadcast(known), "_id").groupBy("text").agg(F.max("label").alias("label")), "severity-sample")
    words = F.filter(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+")), lambda w: w != "")
    forms = F.transform(words, lambda w: F.array(F.concat(F.lit("="), w), *[
        F.when(F.length(w) >= k, F.substring(w, 1, k)) for k in STEMS]))
    word = F.explode(F.array_distinct(F.array_compact(F.flatten(forms)))).alias("word")
    n, toxic = rows.agg(F.count(F.lit(1)), F.count_if(F.col("label") > 0)).first()
    if not 0 < toxic < n:
        return Severity({}, np.zeros(1), np.array([40.0]))
    seen = rows.select("label", word).groupBy("word").agg(
        F.count_if(F.col("label") > 0).alias("a"), F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= min_docs)
    a, d = F.col("a").cast("double"), F.col("docs").cast("double")
    chi = n * F.pow(a * (n - d - (toxic - a)) - (d - a) * (toxic - a), 2) / (F.lit(float(toxic) * (n - toxic)) * d * (n - d + 1))
    odds = F.log((a + 0.5) / (toxic - a + 0.5)) - F.log((d - a + 0.5) / (n - toxic - (d - a) + 0.5))
    words = seen.select("word", chi.alias("chi"), odds.alias("odds")).where(F.col("chi") >= chi_square).orderBy(
        F.desc("chi"), "word").limit(vocabulary).collect()
    if not words:
        return Severity({}, np.zeros(1), np.array([40.0]))
    number = {r["word"]: i for i, r in enumerate(words)}
    marks = frozenset(i for i, r in enumerate(words) if r["odds"] > marker)

    def design(batches):
        for batch in batches:
            found = [feature_counts(t.as_py(), number, marks) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([
                batch.column(1), pa.array([f[0] for f in found], pa.list_(pa.int32())),
                pa.array([f[1] for f in found], pa.list_(pa.int32())), pa.array([f[2] for f in found], pa.int64())],
                names=["label", "found", "counts", "marked"])

    table = rows.mapInArrow(design, "label int, found array<int>, counts array<int>, marked long").collect()
    grade = np.array([r["label"] for r in table])
    weight = np.array([rarity[g] for g in grade])
    if grade.max() <= 1:
        grade = graded(grade, np.array([r["marked"] for r in table]))
    x = Sparse([r["found"] for r in table], [r["counts"] for r in table], len(words))
    weights, thresholds = cumulative_link(x, grade, int(grade.max()) + 1, l2, weight=weight)
    return Severity(number, weights, thresholds)


def label_sample(known: DataFrame, sample: int, seed: int) -> tuple[DataFrame, dict[int, float]]:
    """At most ``sample`` rows of (_id, label), and how many rows each taken one of a label stands for."""
    held = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}       # as many rows as grades
    if sum(held.values()) <= sample:
        return known, dict.fromkeys(held, 1.0)
    bound, left = {}, sample
    for i, label in enumerate(sorted(held, key=lambda g: (held[g], g))):                     # what rare labels leave goes to the others
        bound[label] = min(held[label], left // (len(held) - i))
        left -= bound[label]
    parts = [hash_sample(known.where(F.col("label") == g), held[g], b, seed, "_id") for g, b in sorted(bound.items())]
    return reduce(DataFrame.unionByName, parts), {g: held[g] / max(b, 1) for g, b in bound.items()}


def graded(toxic: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """0 if not toxic; else 1 to 3 by thirds of the toxic documents' marked words."""
    cuts = np.quantile(marked[toxic > 0], [1 / 3, 2 / 3])
    return np.where(toxic > 0, 1 + np.searchsorted(cuts, marked, side="left"), 0)


def severity(docs: DataFrame, model: Severity, id_col: str = "doc_id", text_col: str = "text",
             threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, severity (expected grade), p_toxic, grade (most probable), toxic."""
    def score(batches):
        for batch in batches:
            above = model.above(model.eta(t.as_py() for t in batch.column(1)))
            edges = np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(above.sum(1)), pa.array(above[:, 0]),
                pa.array((edges[:, :-1] - edges[:, 1:]).argmax(1).astype(np.int32)), pa.array(above[:, 0] >= threshold)],
                names=["doc_id", "severity", "p_toxic", "grade", "toxic"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    return rows.mapInArrow(score, "doc_id long, severity double, p_toxic double, grade int, toxic boolean")


def keep_mild(docs: DataFrame, model: Severity, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows whose document is not toxic, with all their columns."""
    at = docs.columns.index(text_col)

    def keep(batches):
        for batch in batches:
            above = model.above(model.eta(t.as_py() for t in batch.column(at)))[:, 0]
            yield batch.filter(pa.array(above < threshold))

    return docs.mapInArrow(keep, docs.schema)
