"""Toxicity by a linear classifier on character n-grams scaled by log-count ratios (operator 8).

The presence of every hashed n-gram is scaled by its naive Bayes log-count ratio between toxic and
clean training texts; n-grams whose ratio is within chance are left out; a ridge-penalised logistic
regression on the scaled features, with both classes at equal weight, gives the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemill.llm.common import bucket_of, prepare, stored, text_slices
from tidemill.llm.grams import characters, gram_ids

SIZES = (3, 4, 5)
#: n-grams are hashed to 2**BITS ids.
BITS = 22
#: Training texts per class (expected number; all of them if there are fewer).
SAMPLE_PER_CLASS = 4000
#: Features kept: in at least so many training texts, so many sigmas from chance, so many in all.
SUPPORT, SIGMAS, FEATURES = 3, 4.3, 1024
RIDGE = 1.0
THRESHOLD = 0.7
#: Bytes of text per slice; n-gram arrays take some 100 times that.
SLICE = 1 << 20


def _distinct(texts: list, sizes, bits: int, slot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, feature) pairs; with ``slot`` only features that have a column, by column."""
    codes, bounds = characters(texts)
    rows, ids = [], []
    for size in sizes:
        at, gram = gram_ids(codes, size, bits)
        if slot is not None:
            gram = slot[gram].astype(np.int64)
            hit = gram >= 0
            at, gram = at[hit], gram[hit]
        rows.append(np.searchsorted(bounds, at, side="right") - 1)
        ids.append(gram)
    key = np.unique(np.concatenate(rows) << bits | np.concatenate(ids))
    return key >> bits, key & ((1 << bits) - 1)


def _counts(batches: Iterator[pa.RecordBatch], sizes, bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in text_slices(batch, "text", SLICE):
            toxic = piece.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            row, gram = _distinct(piece.column("text").to_pylist(), sizes, bits)
            key, n = np.unique(gram << 1 | toxic[row], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key >> 1), pa.array(np.where(key & 1, n, 0)), pa.array(np.where(key & 1, 0, n))],
                names=["gram", "toxic", "clean"],
            )


def _present(batches: Iterator[pa.RecordBatch], sizes, bits: int, slot) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in text_slices(batch, "text", SLICE):
            row, column = _distinct(piece.column("text").to_pylist(), sizes, bits, slot.value)
            cuts = np.searchsorted(row, np.arange(piece.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [piece.column("toxic"), pa.ListArray.from_arrays(pa.array(cuts), pa.array(column))], names=["toxic", "columns"]
            )


def _score(batches: Iterator[pa.RecordBatch], sizes, bits: int, model) -> Iterator[pa.RecordBatch]:
    slot, weight, intercept = model.value
    for batch in batches:
        for piece in text_slices(batch, "text", SLICE):
            row, column = _distinct(piece.column("text").to_pylist(), sizes, bits, slot)
            total = intercept + np.bincount(row, weight[column], minlength=piece.num_rows)
            score = 1 / (1 + np.exp(-np.clip(total, -500, 500)))
            yield pa.RecordBatch.from_arrays([piece.column("key"), pa.array(score)], names=["key", "score"])


def _sigmas(toxic: Column, clean: Column, all_toxic: int, all_clean: int) -> Column:
    """Root of the likelihood-ratio statistic of presence against class."""
    both, present = all_toxic + all_clean, toxic + clean
    cells = [
        (toxic, present, all_toxic), (clean, present, all_clean),
        (F.lit(all_toxic) - toxic, F.lit(both) - present, all_toxic), (F.lit(all_clean) - clean, F.lit(both) - present, all_clean),
    ]
    total = F.lit(0.0)
    for seen, row, column in cells:
        total = total + F.when(seen > 0, seen * F.log(seen * float(both) / (row * float(column)))).otherwise(0.0)
    return F.sqrt(F.greatest(2 * total, F.lit(0.0)))


def _class_weights(y: np.ndarray) -> np.ndarray:
    """Weights of rows with which both classes weigh the same and all rows their number."""
    sizes = np.array([(y == 0).sum(), (y == 1).sum()])
    return (len(y) / (2 * np.maximum(sizes, 1)))[y.astype(np.int64)]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Newton steps on the penalised likelihood; the intercept is not penalised.

    Rows are weighted by the inverse of their class's number, so how many of each class were
    sampled does not move the scores.
    """
    weight = _class_weights(y)
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (y - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w[:-1], float(w[-1])


def training_rows(docs: DataFrame, labels: DataFrame, train: Column, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """toxic and text of a bounded sample of labelled documents.

    A label's row needs an id and 0 or 1; a document that any row calls toxic is toxic.  Each class
    keeps the ids whose hash falls below per_class / its number of ids, so all of a smaller class.
    One text is taken per id.  The sampled ids are at most about 2 * per_class, so they are broadcast.
    """
    marked = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).where(train)
        .groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    )
    sizes = marked.groupBy(F.col("toxic").alias("class")).agg(F.count("*").alias("class_size"))
    place = F.pmod(F.xxhash64("label_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    chosen = marked.join(F.broadcast(sizes), F.col("toxic") == F.col("class")).where(place < per_class / F.col("class_size"))
    return (
        docs.select("doc_id", "text").join(F.broadcast(chosen.select("label_id", "toxic")), F.col("doc_id") == F.col("label_id"))
        .groupBy("label_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
        .select("toxic", "text")
    )


class ToxicityModel:
    """Fixed-size tables: the column of every hashed n-gram, the weights and the intercept."""

    def __init__(self, slot: np.ndarray, weight: np.ndarray, intercept: float, sizes=SIZES, bits: int = BITS):
        self.slot, self.weight, self.intercept, self.sizes, self.bits = slot, weight, intercept, sizes, bits

    @classmethod
    def fit(
        cls, rows: DataFrame, sizes=SIZES, bits: int = BITS, ridge: float = RIDGE,
        support: int = SUPPORT, sigmas: float = SIGMAS, features: int | None = FEATURES,
    ) -> ToxicityModel:
        """Train on rows (toxic 0/1, text).  Without both classes every score is 0.5.

        Features are the n-grams of at least ``support`` training texts whose presence is at least
        ``sigmas`` from chance, the surest ``features`` of them; None lifts that limit.
        """
        spark = rows.sparkSession
        prepare(spark)
        rows = stored(rows, "labelled")
        number = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        slot = np.full(1 << bits, -1, np.int16 if features is not None and features < 1 << 15 else np.int32)
        if not number.get(0) or not number.get(1):
            return cls(slot, np.zeros(0), 0.0, sizes, bits)
        counted = stored(
            rows.mapInArrow(lambda it: _counts(it, sizes, bits), "gram long, toxic long, clean long")
            .groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
            .where(F.col("toxic") + F.col("clean") >= support),
            "grams",
        )
        whole = counted.agg(F.sum(F.col("toxic") + 1).alias("p"), F.sum(F.col("clean") + 1).alias("q")).first()
        if whole["p"] is None:
            return cls(slot, np.zeros(0), 0.0, sizes, bits)
        ratio = F.log((F.col("toxic") + 1) / F.lit(float(whole["p"]))) - F.log((F.col("clean") + 1) / F.lit(float(whole["q"])))
        away = _sigmas(F.col("toxic"), F.col("clean"), number[1], number[0])
        sure = counted.select("gram", ratio.alias("ratio"), away.alias("sigmas")).where(F.col("sigmas") >= sigmas).orderBy(F.desc("sigmas"), "gram")
        best = (sure if features is None else sure.limit(features)).collect()
        if not best:
            return cls(slot, np.zeros(0), 0.0, sizes, bits)
        ratios = np.array([r["ratio"] for r in best])
        slot[[r["gram"] for r in best]] = np.arange(len(best), dtype=slot.dtype)
        sent = spark.sparkContext.broadcast(slot)
        found = rows.mapInArrow(lambda it: _present(it, sizes, bits, sent), "toxic int, columns array<long>").collect()
        x = np.zeros((len(found), len(best)))
        for k, r in enumerate(found):
            x[k, r["columns"]] = ratios[r["columns"]]
        weight, intercept = _logistic(x, np.array([r["toxic"] for r in found], float), ridge)
        return cls(slot, weight * ratios, intercept, sizes, bits)

    def score(self, rows: DataFrame) -> DataFrame:
        """key and score of rows (key, text), every text as a whole; null counts as empty."""
        prepare(rows.sparkSession)
        sizes, bits = self.sizes, self.bits
        sent = rows.sparkSession.sparkContext.broadcast((self.slot, self.weight, self.intercept))
        schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("score", T.DoubleType())])
        return rows.select("key", "text").mapInArrow(lambda it: _score(it, sizes, bits, sent), schema)


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> ToxicityModel:
    """A model from the labels outside the held-out third (crc32 of the id modulo 3 is 1)."""
    return ToxicityModel.fit(training_rows(docs, labels, bucket_of("doc_id", 3) != 1, per_class))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted.

    Whole texts are scored; null counts as empty, and texts without n-grams get the score of no
    evidence.  Ties and repeated rows get equal scores.  Labels, languages, sources and ids are no
    inputs of a score.  Without labels of both classes every score is 0.5; an empty table gives an
    empty result; other columns are ignored.
    """
    model = fit_toxicity(docs, labels)
    scored = model.score(docs.select(F.struct("doc_id").alias("key"), "text"))
    return scored.select(
        "key.doc_id", (bucket_of("key.doc_id", 3) == 1).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents scored below the threshold, with all their columns."""
    model = fit_toxicity(docs, labels)
    scored = model.score(docs.select(F.struct("*").alias("key"), "text"))
    return scored.where(F.col("score") < threshold).select("key.*")
