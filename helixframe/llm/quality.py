"""Quality classifier: cumulative-link regression on graded ratings.

A document is the set of its hashed features: its lower-cased words, and bands of a few figures of its form (symbols, capitals,
digits, repetition, line and word lengths). One weight for each feature gives a score s = w.x that all grades share; ordered
thresholds t_1 < t_2 < ... turn it into P(grade >= j) = 1 / (1 + exp(t_j - s)). Weights and thresholds are fitted together
by maximum likelihood. Every document gets its expected grade and the tail probability P(grade >= ``tail``), by which it is
selected.

Grades of (quality, toxic) labels: 0 for toxic, 1 for other low quality, 2 for good.

The model is fitted on at most ``sample`` labelled documents that the table has, those with the smallest hashes of their ids,
and on no more of them than have ``sample_bytes`` of features, which is what the driver holds; features that fewer than
``least_docs`` of them have, or that do not tell grades apart, get no weight. All documents are scored, over their whole texts.

Cases: null texts and texts without words get grade 0 and tail probability 0 and are not selected; labels that are null or of
unknown documents are left out; a document with several labels counts once with its lowest grade; without any label or with
labels of one grade only, nothing can be learned and every text with words gets the highest grade seen (without any, the top
grade); rows of equal doc_id are scored each by itself; ties need no rule, as every document is judged alone; long texts are taken
whole, a feature counts once however often it comes; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch, pick, prepare
from .text import Words

BITS = 18
GRADES = 3
_KEEP = bytes(b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"()?-!"]] = True


def features(text: str | None) -> np.ndarray:
    """The distinct hashed features of a text, sorted; none for a text without words."""
    words = Words(text)
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.int32)
    raw = np.frombuffer(words.joined, dtype=np.uint8)
    plain = Words((text or "").lower().encode("utf-8", "surrogatepass").translate(_KEEP).decode("utf-8", "surrogatepass"))
    own = np.unique((plain.grams(1) >> np.uint64(64 - BITS)).astype(np.int32)) if len(plain) else np.zeros(0, dtype=np.int32)
    hashes = words.grams(1)
    letters = int(((raw | 32) >= 97).sum()) or 1
    figures = (
        _SYMBOLS[raw].sum() / n,
        ((raw >= 65) & (raw <= 90)).sum() / letters,
        ((raw >= 48) & (raw <= 57)).sum() / len(raw),
        (hashes[1:] == hashes[:-1]).sum() / n,
        (raw == 33).sum() / n,
        (raw == 124).sum() / n,
        1 - len(np.unique(hashes)) / n,
        (raw >= 128).sum() / len(raw),
    )
    bands = [int(min(7, np.floor(np.log2(1 + 64 * x)))) for x in figures]
    form = np.array([(1 << BITS) + 8 * i + b for i, b in enumerate(bands)] + [(1 << BITS) + 64 + min(15, int(np.log2(n)))], dtype=np.int32)
    return np.concatenate([own, form])


WIDTH = (1 << BITS) + 80


def _telling(owner: np.ndarray, column: np.ndarray, grades: np.ndarray, least_docs: int, least_gain: float) -> np.ndarray:
    """Which features tell grades apart: those that enough documents have, and whose share of the grades differs from the
    overall one by a log-likelihood ratio of at least ``least_gain``."""
    j = int(grades.max()) + 1
    have = np.bincount(column * j + grades[owner], minlength=WIDTH * j).reshape(WIDTH, j).astype(np.float64)
    n = have.sum(axis=1)
    total = np.bincount(grades, minlength=j).astype(np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        inside = np.where(have > 0, have * np.log(have / (n[:, None] * total / total.sum())), 0).sum(axis=1)
        rest = total - have
        outside = np.where(rest > 0, rest * np.log(rest / ((total.sum() - n)[:, None] * total / total.sum())), 0).sum(axis=1)
    return (n >= least_docs) & (2 * (inside + outside) >= least_gain)


class CumulativeLink:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights.astype(np.float64), thresholds

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ... in columns."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))

    @classmethod
    def fit(cls, rows: list[np.ndarray], grades: np.ndarray, least_docs: int = 3, least_gain: float = 16.0, l2: float = 1.0, steps: int = 400) -> CumulativeLink:
        """Maximum likelihood by full-batch steps of Adam; thresholds stay ordered as running sums of positive gaps."""
        seen = np.unique(grades)
        if len(seen) < 2:
            top = int(seen[0]) if len(seen) else GRADES - 1
            return cls(np.zeros(WIDTH), np.where(np.arange(1, GRADES) <= top, -500.0, 500.0))
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        column = np.concatenate(rows).astype(np.int64)
        keep = _telling(owner, column, grades, least_docs, least_gain)[column]
        owner, column = owner[keep], column[keep]
        used, column = np.unique(column, return_inverse=True)
        n, d, j = len(rows), len(used), GRADES - 1
        share = np.array([max(1e-3, (grades < g).mean()) for g in range(1, GRADES)])
        t0 = np.log(share / (1 - np.minimum(share, 0.999)))
        p = np.concatenate([np.zeros(d), [t0[0]], np.log(np.maximum(np.diff(t0), 0.05))])
        m, v = np.zeros_like(p), np.zeros_like(p)
        row = np.arange(n)
        for step in range(1, steps + 1):
            gaps = np.exp(p[d + 1 :])
            t = p[d] + np.concatenate([[0.0], np.cumsum(gaps)])
            score = np.bincount(owner, weights=p[column], minlength=n)
            below = np.column_stack([np.zeros(n), 1 / (1 + np.exp(np.clip(score[:, None] - t, -500, 500))), np.ones(n)])
            a, b = below[row, grades + 1], below[row, grades]
            mass = np.maximum(a - b, 1e-12)
            ds = 1 - a - b
            dt = np.zeros((n, j))
            up, low = grades < j, grades > 0
            dt[row[up], grades[up]] -= (a * (1 - a) / mass)[up]
            dt[row[low], grades[low] - 1] += (b * (1 - b) / mass)[low]
            dt = dt.mean(axis=0)
            g = np.concatenate([np.bincount(column, weights=ds[owner], minlength=d) / n + l2 / n * p[:d], [dt.sum()], np.cumsum(dt[::-1])[::-1][1:] * gaps])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            p -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weights = np.zeros(WIDTH)
        weights[used] = p[:d]
        return cls(weights, p[d] + np.concatenate([[0.0], np.cumsum(np.exp(p[d + 1 :]))]))


def grade(quality: Column, toxic: Column) -> Column:
    return F.when(toxic > 0, 0).when(quality.isNotNull() & toxic.isNotNull(), F.when(quality > 0, 2).otherwise(1)).cast("int")


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [features(t.as_py()).tobytes() for t in b.column(b.schema.names.index("text"))]
        yield pa.RecordBatch.from_arrays([b.column(b.schema.names.index("doc_id")), b.column(b.schema.names.index("grade")), pa.array(out, pa.binary())], names=["doc_id", "grade", "x"])


def learn(docs: DataFrame, labels: DataFrame, sample: int = 20_000, least_docs: int = 3, sample_bytes: int = 64 << 20) -> CumulativeLink:
    """A model from (doc_id, text) and (doc_id, quality, toxic)."""
    prepare(docs.sparkSession)
    rated = pick(labels, "doc_id", "quality", "toxic").select("doc_id", grade(F.col("quality"), F.col("toxic")).alias("grade"))
    rated = rated.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    known = rated.join(pick(docs, "doc_id").where("doc_id is not null").distinct(), "doc_id", "left_semi")
    rated = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").cast("long").alias("doc_id"), "grade")
    rows = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).join(F.broadcast(rated), "doc_id").select("doc_id", "grade", "text")
    got, size = [], 0
    work = Scratch(docs.sparkSession, "quality")
    # a range sort samples its input, so features are written before they are put in order
    made = work.table(rows.mapInArrow(_featurise, "doc_id long, grade int, x binary"), "features")
    for r in made.orderBy(F.xxhash64("doc_id"), "doc_id", "x").toLocalIterator():
        size += len(r["x"])
        if size > sample_bytes:
            break
        if len(r["x"]):
            got.append((r["grade"], np.frombuffer(r["x"], dtype=np.int32)))
    work.drop("features")
    got.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes()))
    return CumulativeLink.fit([x for _, x in got], np.array([g for g, _ in got], dtype=np.int64), least_docs)


def score(docs: DataFrame, model: CumulativeLink, tail: int = 2, least: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, tail_prob and selected (tail_prob of at least ``least``) for every row."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value.weights
        for b in batches:
            xs = [features(t.as_py()) for t in b.column(b.schema.names.index("text"))]
            s = np.array([weights[x].sum() for x in xs], dtype=np.float64)
            tails = shared.value.tails(s) * np.array([[len(x) > 0] for x in xs]).reshape(-1, 1)
            p = tails[:, tail - 1]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.names.index("doc_id")), pa.array(tails.sum(axis=1)), pa.array(p), pa.array(p >= least)], names=["doc_id", "expected_grade", "tail_prob", "selected"])

    rows = pick(docs, "doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, expected_grade double, tail_prob double, selected boolean")


def quality(docs: DataFrame, labels: DataFrame, sample: int = 20_000, tail: int = 2, least: float = 0.5) -> DataFrame:
    """Fit on the labelled documents and score all."""
    return score(docs, learn(docs, labels, sample), tail, least)
