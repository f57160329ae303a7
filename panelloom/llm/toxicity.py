"""Toxicity by non-negative positive-unlabelled learning.

Linear classifiers over hashed words and word beginnings are trained in numpy from confirmed toxic
documents (positive) and unlabelled text: the class-prior-corrected risk
``prior * R_p+ + max(0, R_u- - prior * R_p-)`` is minimised. Unlabelled text is drawn from all rows that may
be learnt from, whether they have a label or not, as the estimator assumes (a sample of the population
beside a sample of its positives). Negative labels serve for one number only, the class prior: the share
of toxic rows among the labelled ones, smoothed by half a row of each kind.

Features are chosen by their frequency among positives against that among all rows that may be learnt
from, which are all counted. Fitting uses bounded samples, ``max_positive`` and ``max_unlabelled``
documents with the least hash of their doc_id; scoring covers every document's whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm.common import NOT_WORD, lowered, prefix_hash, span_hash, table, text_slices, word_spans

BUCKETS = 1 << 18
BEGINNINGS = (4, 5, 6, 8)
#: Partitions of the bounded sample that the classifier is fitted on.
SAMPLE_PARTS = 12


def feature_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of whole words and word beginnings, with each one's row in the slice."""
    starts, ends, firsts = word_spans(data, offsets, NOT_WORD)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    prefix = prefix_hash(lowered(data).astype(np.uint64) + np.uint64(1))
    hashes, rows = [span_hash(prefix, starts, ends) ^ np.uint64(0x5bd1e995)], [row]
    for n in BEGINNINGS:
        long = ends - starts >= n
        hashes.append(span_hash(prefix, starts[long], starts[long] + n))
        rows.append(row[long])
    return (np.concatenate(hashes) >> np.uint64(46)).astype(np.int64), np.concatenate(rows)


@dataclass
class PUModel:
    """Chosen features (place of each hash bucket, -1: none), their weights and the intercept."""

    place: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        z = np.full(n, self.bias)
        if len(self.weights):
            hashes, rows = feature_hashes(data, offsets)
            place = self.place[hashes]
            has = place >= 0
            pairs = np.unique(rows[has] * len(self.weights) + place[has])
            z += np.bincount(pairs // len(self.weights), self.weights[pairs % len(self.weights)], minlength=n)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Rows:
    """A sparse 0/1 matrix (or a dense one's nonzero cells) that can be multiplied from both sides."""

    def __init__(self, row: np.ndarray, column: np.ndarray, n: int, width: int, value: np.ndarray | float = 1.0) -> None:
        self.row, self.column, self.n, self.width, self.value = row, column, n, width, value

    @classmethod
    def of(cls, x: np.ndarray) -> Rows:
        row, column = np.nonzero(x)
        return cls(row, column, *x.shape, x[row, column])

    def only(self, keep: np.ndarray) -> Rows:
        """The rows where ``keep`` holds."""
        place = np.cumsum(keep) - 1
        has = keep[self.row]
        return Rows(place[self.row[has]], self.column[has], int(keep.sum()), self.width)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column] * self.value, minlength=self.n)

    def left_times(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, g[self.row] * self.value, minlength=self.width)


def nnpu_fit(positive: Rows | np.ndarray, unlabelled: Rows | np.ndarray, prior: float, rounds: int = 200, rate: float = 0.1, decay: float = 1e-4, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier under the non-negative risk (logistic loss, Adam).

    When the corrected negative risk falls below zero the step goes up its gradient instead, as the
    estimator prescribes, so that unlabelled positives are not driven to the negative side.
    """
    positive, unlabelled = (x if isinstance(x, Rows) else Rows.of(x) for x in (positive, unlabelled))
    rng = np.random.default_rng(seed)
    width = positive.width
    w = np.concatenate((rng.normal(0, 0.01, width), [np.log(prior / (1 - prior))]))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, rounds + 1):
        zp, zu = positive.times(w[:-1]) + w[-1], unlabelled.times(w[:-1]) + w[-1]
        sp, su = sigmoid(zp), sigmoid(zu)
        negative_risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        up = prior * (sp - 1) / len(zp)
        down_p, down_u = -prior * sp / len(zp), su / len(zu)
        if negative_risk < 0:
            gp, gu = -down_p, -down_u
        else:
            gp, gu = up + down_p, down_u
        g = np.concatenate((positive.left_times(gp) + unlabelled.left_times(gu) + decay * w[:-1], [gp.sum() + gu.sum()]))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, n) of texts (column ``text``): documents of this task that have a feature in the bucket."""
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, data, offsets in text_slices(batch):
            hashes, rows = feature_hashes(data, offsets)
            counts += np.bincount(np.unique(rows * BUCKETS + hashes) % BUCKETS, minlength=BUCKETS)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(some.astype(np.int32)), "n": pa.array(counts[some])})


def document_counts(texts: DataFrame) -> np.ndarray:
    """Documents of each of BUCKETS buckets; that many numbers come to the driver, whatever the input."""
    counts = np.zeros(BUCKETS, np.int64)
    rows = texts.select("text").mapInArrow(_counter, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return counts


def _chooser(place: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in text_slices(batch):
                hashes, rows = feature_hashes(data, offsets)
                own, has = place[hashes], place[hashes] >= 0
                pairs = np.unique(rows[has] * BUCKETS + own[has])
                ends = np.searchsorted(pairs, np.arange(1, len(offsets)) * BUCKETS)
                lists = np.split((pairs % BUCKETS).astype(np.int32), ends[:-1])
                yield pa.RecordBatch.from_pydict({"kind": batch.column(0).slice(at, len(offsets) - 1), "places": pa.array(lists, pa.list_(pa.int32()))})

    return run


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, may_learn, max_positive: int = 4000, max_unlabelled: int = 12000, max_features: int = 1024, models: int = 3) -> PUModel:
    """Train on ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); may_learn is a condition on doc_id.

    Conflicting labels of a document count as toxic; null labels and labels without a document are
    ignored; of rows that repeat a doc_id all texts are learnt from. Without positives, or without any
    documents, the model scores every text with the prior.
    """
    known = labels.where(may_learn & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n, n_toxic = known.agg(F.count("*"), F.sum("toxic")).first()
    prior = ((n_toxic or 0) + 0.5) / (n + 1)
    nothing = PUModel(np.full(BUCKETS, -1, np.int32), np.zeros(0), float(np.log(prior / (1 - prior))))
    order = F.xxhash64("doc_id", F.lit(7))
    ids = docs.where(may_learn & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"))
    p = ids.join(known.where("toxic = 1"), "doc_id", "left_semi").orderBy(order, "doc_id").limit(max_positive)
    u = ids.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(max_unlabelled)
    # at most max_positive + max_unlabelled ids: bounded by parameters, so the broadcast is too
    chosen = p.distinct().withColumn("kind", F.lit(1)).union(u.distinct().withColumn("kind", F.lit(0)))
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("kind", "text").repartition(SAMPLE_PARTS)
    sample.persist()
    try:
        sizes = {r[0]: r[1] for r in sample.groupBy("kind").count().collect()}
        if not sizes.get(1) or not sizes.get(0):
            return nothing
        learnable = docs.where(may_learn & F.col("doc_id").isNotNull()).select(F.col("text").cast("string").alias("text"))
        of_positive, of_all = document_counts(sample.where("kind = 1")), document_counts(learnable)
        cp, cu = of_positive + 0.5, of_all + 0.5
        lift = np.log(cp / (sizes[1] + 1)) - np.log(cu / (learnable.count() + 1))
        strength = lift / np.sqrt(1 / cp + 1 / cu)
        best = np.argsort(-strength, kind="stable")[:max_features]
        best = best[(strength[best] > 2) & (of_positive[best] >= 2)]
        if not len(best):
            return nothing
        place = np.full(BUCKETS, -1, np.int32)
        place[best] = np.arange(len(best))
        rows = sample.mapInArrow(_chooser(place), "kind int, places array<int>").toArrow()
    finally:
        sample.unpersist()
    kind, lists = rows["kind"].to_numpy(), rows["places"].combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
    sizes_of = np.diff(lists.offsets.to_numpy())
    x = Rows(np.repeat(np.arange(len(kind)), sizes_of), lists.flatten().to_numpy(), len(kind), len(best))
    positive, unlabelled = x.only(kind == 1), x.only(kind == 0)
    part = np.random.default_rng(5).permutation(unlabelled.n) % models
    fits = [nnpu_fit(positive, unlabelled.only(part == k) if (part == k).any() else unlabelled, prior, seed=k) for k in range(models)]
    return PUModel(place, np.mean([w for w, _ in fits], axis=0), float(np.mean([b for _, b in fits])))


def scored(spark: SparkSession, docs: DataFrame, model: PUModel) -> DataFrame:
    """(doc_id, score) of every row's whole text, repeated rows each; null texts count as empty; an empty table gives no rows."""
    shared = spark.sparkContext.broadcast(model)  # BUCKETS places and max_features weights: a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for at, data, offsets in text_slices(batch):
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(at, len(offsets) - 1), "score": pa.array(own.scores(data, offsets))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; a third of doc_ids by CRC-32 is held out of training."""
    docs = table(spark, sf_dir, "documents")
    model = fit(spark, docs, table(spark, sf_dir, "labels"), ~held_out())
    return scored(spark, docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
