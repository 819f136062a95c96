"""Operator 8: toxicity by a factorization machine over hashed terms.

Terms are runs of letters, lower-cased and hashed.  The buckets that tell the labels apart best (chi-square over the sampled rows) are
the features; the machine's factors give each pair of them a weight, so that what two terms mean together need not be the
sum of what they mean apart.

Learning uses at most ``SAMPLE_ROWS`` labelled rows with crc32(doc_id) mod 3 other than 1.  Defined cases: a null text counts as
empty and gets the score of a document without known terms; labels that are null, or of ids that ``documents`` lacks, are not used;
labels that contradict each other for one id both count; without two classes of labels every score is 0; rows repeat as they do in
the input; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import FMClassifier
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindle.llm.common import cut

SAMPLE_ROWS = 16_000  #: labelled rows that the model is fitted on, at most
BUCKETS = 1 << 20
FEATURES = 512  #: hashed terms that the machine knows
MIN_ROWS = 5  #: sampled rows that a term must be in
FACTORS = 4
ITERATIONS = 80
THRESHOLD = 0.7
CACHE_WORDS = 500_000

LETTERS = re.compile(r"[^\W\d_]+")


class Buckets(dict):
    """Hash buckets of words, remembered; ``of`` maps buckets to features (identity without it)."""

    def __init__(self, of: dict[int, int] | None = None):
        super().__init__()
        self.of = of

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        bucket = xxhash.xxh64_intdigest(word.encode()) % BUCKETS
        self[word] = out = bucket if self.of is None else self.of.get(bucket, -1)
        return out


def terms(text: str | None, buckets: Buckets) -> set[int]:
    return {buckets[w] for w in LETTERS.findall((text or "").lower())}


def held_out(doc_id) -> F.Column:  # noqa: ANN001
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def sampled_terms(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``(label, terms)`` of the sampled labelled rows; the sample's ids are a table of ``SAMPLE_ROWS`` rows at most."""
    usable = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("label"))
    usable = usable.where("_id is not null and label is not null").where(~held_out("_id"))
    sample = usable.orderBy(F.xxhash64("_id"), "_id", "label").limit(SAMPLE_ROWS)

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in batches:
            found = [sorted(terms(s.as_py(), buckets)) for s in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(found, pa.list_(pa.int32()))], names=["label", "terms"])

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "_id")
    return cut(rows.select("label", "text").mapInArrow(extract, "label int, terms array<int>"), "terms")


def informative(rows: DataFrame) -> list[int]:
    """The ``FEATURES`` buckets with the largest chi-square between presence and label."""
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("label") == 1).cast("int")).alias("k")).first()
    total, toxic = n["n"], n["k"] or 0
    if not toxic or toxic == total:
        return []
    counts = rows.select("label", F.explode("terms").alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("label") == 1).cast("int")).alias("k")
    )
    expected = F.col("n") * F.lit(toxic / total)
    chi = (F.col("k") - expected) ** 2 / (expected * F.lit(1 - toxic / total) * (F.lit(1.0) - F.col("n") / F.lit(total + 1.0)))
    best = counts.where(F.col("n") >= MIN_ROWS).orderBy(chi.desc(), "term").limit(FEATURES)
    return [r["term"] for r in best.select("term").collect()]


class Machine:
    """A fitted factorization machine: score of a set of features."""

    def __init__(self, of: dict[int, int], bias: float, linear: np.ndarray, factors: np.ndarray):
        self.of, self.bias, self.linear, self.factors = of, bias, linear, factors

    def score(self, features: Iterable[int]) -> float:
        at = [k for k in features if k >= 0]
        v = self.factors[at]
        pairs = 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        x = self.bias + float(self.linear[at].sum()) + pairs
        return float(1 / (1 + np.exp(-np.clip(x, -60, 60))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine | None:
    rows = sampled_terms(docs, labels, id_col, text_col, label_col)
    chosen = informative(rows)
    if not chosen:
        return None
    of = {bucket: k for k, bucket in enumerate(chosen)}
    width = len(of)

    @F.udf(VectorUDT())
    def vector(found):  # noqa: ANN001, ANN202
        at = sorted(of[t] for t in found if t in of)
        return SparseVector(width, at, [1.0] * len(at))

    spark = docs.sparkSession
    cores = min(4, max(1, spark.sparkContext.defaultParallelism))
    train = rows.select(F.col("label").cast("double").alias("label"), vector("terms").alias("features")).coalesce(cores).persist()
    model = FMClassifier(factorSize=FACTORS, maxIter=ITERATIONS, stepSize=0.1, regParam=1e-4, initStd=0.05, seed=7).fit(train)
    train.unpersist()
    return Machine(of, float(model.intercept), model.linear.toArray(), model.factors.toArray())


def score(docs: DataFrame, machine: Machine | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted, n_terms)`` for every row."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("n_terms", T.LongType())])
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # FEATURES rows

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        buckets = Buckets(model.of if model else {})
        for batch in batches:
            found = [terms(s.as_py(), buckets) - {-1} for s in batch.column(1)]
            scores = [model.score(x) if model else 0.0 for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([len(x) for x in found], pa.int64())], names=schema.names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_terms")
