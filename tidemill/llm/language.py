"""Language identification by nearest centroids (operator 7).

A text is the TF-IDF vector of its hashed character n-grams, normalised.  Every language has several
centroids, found by clustering its training vectors on the sphere; a text takes the language of the
centroid with the largest cosine and is rejected when it is farther from it than the farthest
training texts of that centroid, plus a margin.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemill.llm.common import bucket_of, if_small, prepare, stored, text_slices
from tidemill.llm.grams import characters, gram_ids

SIZES = (1, 2, 3)
#: n-grams are hashed to 2**BITS ids.
BITS = 12
#: Distinct training texts per language (expected number; all of them if there are fewer).
SAMPLE_PER_LANGUAGE = 400
CENTROIDS = 4
ROUNDS = 12
#: A text is rejected when its distance exceeds that of all but this share of the centroid's training texts, and a margin.
OUTLIERS, MARGIN = 0.01, 0.15
UNKNOWN = "und"
#: Texts per dense block in a task.
ROWS = 256
#: Bytes of text per slice; n-gram arrays take some 100 times that.
SLICE = 1 << 20


def _term_counts(texts: list, sizes, bits: int) -> np.ndarray:
    codes, bounds = characters(texts)
    width = 1 << bits
    out = np.zeros(len(texts) * width, np.float32)
    for size in sizes:
        at, gram = gram_ids(codes, size, bits)
        row = np.searchsorted(bounds, at, side="right") - 1
        out += np.bincount(row * width + gram, minlength=len(out)).astype(np.float32)
    return out.reshape(len(texts), width)


def _vectors(texts: list, sizes, bits: int, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(_term_counts(texts, sizes, bits)) * idf
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def _blocks(texts: list) -> Iterator[list]:
    for at in range(0, len(texts), ROWS):
        yield texts[at : at + ROWS]


def _frequencies(batches: Iterator[pa.RecordBatch], sizes, bits: int) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(1 << bits, np.int64), 0
    for batch in batches:
        for piece in text_slices(batch, "text", SLICE):
            for texts in _blocks(piece.column("text").to_pylist()):
                total += (_term_counts(texts, sizes, bits) > 0).sum(axis=0)
                n += len(texts)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total) + 1)), pa.array(np.append(total, n))], names=["gram", "n"])


def _sample_vectors(batches: Iterator[pa.RecordBatch], sizes, bits: int, idf) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in text_slices(batch, "text", SLICE):
            at = 0
            for texts in _blocks(piece.column("text").to_pylist()):
                x = _vectors(texts, sizes, bits, idf.value).astype(np.float16)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("lang").slice(at, len(texts)), pa.array([v.tobytes() for v in x], pa.binary())], names=["lang", "vector"]
                )
                at += len(texts)


def _predict(batches: Iterator[pa.RecordBatch], sizes, bits: int, model) -> Iterator[pa.RecordBatch]:
    idf, centroids, owner, reach, names = model.value
    for batch in batches:
        for piece in text_slices(batch, "text", SLICE):
            lang, score, far = [], [], []
            for texts in _blocks(piece.column("text").to_pylist()):
                close = _vectors(texts, sizes, bits, idf) @ centroids.T
                best = close.argmax(axis=1)
                cosine = np.clip(close[np.arange(len(texts)), best], 0, 1)
                lang += [names[owner[k]] for k in best]
                score.append(cosine)
                far.append(1 - cosine > reach[best])
            yield pa.RecordBatch.from_arrays(
                [piece.column("key"), pa.array(lang, pa.string()), pa.array(np.concatenate(score).astype(np.float64)), pa.array(np.concatenate(far))],
                names=["key", "lang", "cosine", "rejected"],
            )


def _cluster(x: np.ndarray, count: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from far-apart starts; centroids and the cluster of each row."""
    chosen = [int((x @ x.mean(axis=0)).argmax())]
    while len(chosen) < min(count, len(x)):
        chosen.append(int((x @ x[chosen].T).max(axis=1).argmin()))
    centroids = x[chosen]
    for _ in range(rounds):
        member = (x @ centroids.T).argmax(axis=1)
        sums = np.stack([x[member == k].sum(axis=0) if (member == k).any() else centroids[k] for k in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids, (x @ centroids.T).argmax(axis=1)


class LanguageModel:
    """IDF weights and centroids; their size depends on the languages and parameters alone."""

    def __init__(self, idf, centroids, owner, reach, names, sizes, bits):
        self.idf, self.centroids, self.owner, self.reach, self.names = idf, centroids, owner, reach, names
        self.sizes, self.bits = sizes, bits

    @classmethod
    def fit(cls, rows: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, sizes=SIZES, bits: int = BITS,
            count: int = CENTROIDS, rounds: int = ROUNDS, outliers: float = OUTLIERS, margin: float = MARGIN) -> LanguageModel | None:
        """Train on rows (lang, text) with non-null languages; None without any.

        Each language keeps the texts whose hash falls below per_language / its number of distinct texts.
        Only vectors of this sample, a fixed number of bytes each, reach the driver.
        """
        spark = rows.sparkSession
        prepare(spark)
        rows = rows.where(F.col("lang").isNotNull() & has_letter(F.col("text")))
        # one row per language, counted before it is broadcast: texts must not be dealt by language
        drawn = F.xxhash64("text", F.lit(13))
        texts = rows.select(F.col("lang").alias("of"), drawn.alias("drawn")).distinct()
        known = if_small(texts.groupBy("of").agg(F.count("*").alias("n")), "language-sizes")
        place = F.pmod(drawn, F.lit(1 << 30)) / float(1 << 30)
        sample = stored(
            rows.join(known, F.col("lang") == F.col("of")).where(place < per_language / F.col("n")).select("lang", "text").distinct(), "languages"
        )
        seen = {r["gram"]: r["n"] for r in sample.select("text").mapInArrow(lambda it: _frequencies(it, sizes, bits), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()}
        if not seen:
            return None
        total = seen.pop(1 << bits)
        frequency = np.array([seen.get(k, 0) for k in range(1 << bits)])
        idf = (np.log((total + 1) / (frequency + 1)) + 0.1).astype(np.float32)
        sent = spark.sparkContext.broadcast(idf)
        vectors: dict[str, list] = {}
        for r in sample.mapInArrow(lambda it: _sample_vectors(it, sizes, bits, sent), "lang string, vector binary").toLocalIterator():
            vectors.setdefault(r["lang"], []).append(np.frombuffer(r["vector"], np.float16))
        centroids, owner, reach, names = [], [], [], sorted(vectors)
        for k, name in enumerate(names):
            x = np.stack(sorted(vectors[name], key=lambda v: v.tobytes())).astype(np.float32)
            found, member = _cluster(x, count, rounds)
            distance = 1 - (x * found[member]).sum(axis=1)
            for c in range(len(found)):
                inside = distance[member == c]
                centroids.append(found[c])
                owner.append(k)
                reach.append((np.quantile(inside, 1 - outliers) if len(inside) else 0.0) + margin)
        return cls(idf, np.stack(centroids).astype(np.float32), np.array(owner), np.array(reach), names, sizes, bits)

    def predict(self, rows: DataFrame) -> DataFrame:
        """key, lang, cosine and rejected of rows (key, text)."""
        prepare(rows.sparkSession)
        sizes, bits = self.sizes, self.bits
        sent = rows.sparkSession.sparkContext.broadcast((self.idf, self.centroids, self.owner, self.reach, self.names))
        schema = T.StructType([
            T.StructField("key", rows.schema["key"].dataType), T.StructField("lang", T.StringType()),
            T.StructField("cosine", T.DoubleType()), T.StructField("rejected", T.BooleanType()),
        ])
        return rows.select("key", "text").mapInArrow(lambda it: _predict(it, sizes, bits, sent), schema)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (cosine), rejected.

    Learns from texts and languages of documents whose crc32 of the id modulo 4 is not 2.  Null
    texts and texts without a letter are ``und`` with score 0; every other text gets a learned
    language, and ``rejected`` tells that it is too far from all centroids of the training texts to
    be trusted.  Without training rows everything is ``und``.  Ties go to the first language by
    name; repeated rows get equal results; an empty table gives an empty result; other columns are
    ignored.
    """
    held_out = bucket_of("doc_id", 4) == 2
    model = LanguageModel.fit(docs.where(~held_out).select("lang", "text"))
    key = F.struct("doc_id", has_letter(F.col("text")).alias("letters"))
    rows = docs.select(key.alias("key"), "text")
    if model is None:
        found = rows.select("key", F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("cosine"), F.lit(True).alias("rejected"))
    else:
        found = model.predict(rows)
    letters = F.col("key.letters")
    return found.select(
        "key.doc_id", (bucket_of("key.doc_id", 4) == 2).alias("held_out"),
        F.when(letters, F.col("lang")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(letters, F.col("cosine")).otherwise(0.0).alias("score"),
        (F.col("rejected") | ~letters).alias("rejected"),
    )
