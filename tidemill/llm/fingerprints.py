"""I-Match fingerprints with several randomised lexicon subsets (operator 10).

The lexicon holds the terms whose document frequency lies in a chosen band.  A document's distinct
lexicon terms are sorted and every randomised subset of the lexicon gives a hash of those that
belong to it.  Subsets come in sizes that halve; a document uses three sizes around the one that
keeps one of its terms on average, so a change of some terms leaves the hashes of many subsets alone
and texts whose numbers of terms differ up to fourfold can be compared.  A text with fewer than
LEAST_TERMS lexicon terms takes that many by adding others, the same ones for equal texts.

Document frequencies are counted over all distinct texts in 2**BITS hashed counters, so the lexicon
is a bitmap of fixed size whatever the vocabulary; terms that share a counter share its frequency.
With v terms that adds v / 2**BITS single occurrences to a counter, far below the band's upper edge.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tidemill.llm.common import ordered, prepare, stored, text_slices
from tidemill.llm.shingles import Words, distinct_per_document, mix

BITS = 24
#: The band: terms of at least so many distinct texts and at most this share of them.  The rarest belong
#: to it: a text with many copies counts once, and its own terms are what tells it apart.
LEAST_DOCUMENTS, LARGEST_SHARE = 1, 0.1
#: Lexicon subsets per size, and sizes of a document.
SUBSETS, STEPS = 32, 3
#: A text with fewer lexicon terms adds terms from outside the band, those with the smallest hashes.
LEAST_TERMS = 16
#: Digests of repeated texts are broadcast up to this many, 12 bytes each; beyond, copies are removed by a shuffle.
MOST_REPEATED = 1 << 23
#: Counters per row of the frequency table.
SEGMENT = 1 << 14
_SEEDS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words = Words(texts)
    return distinct_per_document(words.hashes, words.first)


def _frequencies(batches: Iterator[pa.RecordBatch], bits: int, sent) -> Iterator[pa.RecordBatch]:
    """Rows per counter; each of n copies of a text counts 1 / n, kept apart in ``shares``."""
    repeated, copies = sent.value
    total, shares = np.zeros(1 << bits, np.uint32), None
    for batch in batches:
        for piece in text_slices(batch, "text"):
            hashes, bounds = _terms(piece.column("text"))
            counter = (hashes >> np.uint64(64 - bits)).astype(np.int64)
            if len(repeated):
                digest = piece.column("digest").to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(repeated, digest), len(repeated) - 1)
                times = np.repeat(np.where(repeated[at] == digest, copies[at], 1), np.diff(bounds))
                many = times > 1
                if many.any():
                    shares = np.zeros(1 << bits) if shares is None else shares
                    place, back = np.unique(counter[many], return_inverse=True)
                    shares[place] += np.bincount(back, 1 / times[many])
                counter = counter[~many]
            counter, n = np.unique(counter, return_counts=True)
            total[counter] += n.astype(np.uint32)
    width = min(SEGMENT, len(total))
    for k, part in enumerate(total.reshape(-1, width)):
        share = None if shares is None else shares[k * width : (k + 1) * width]
        share = None if share is None or not share.any() else zlib.compress(share.tobytes(), 1)
        if part.any() or share is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k]), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary()), pa.array([share], pa.binary())],
                names=["segment", "counts", "shares"],
            )


def _bands(batches: Iterator[pa.RecordBatch], least: int, most: float) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for segment, counts, shares in zip(*(batch.column(c).to_pylist() for c in ("segment", "counts", "shares"))):
            part = np.frombuffer(zlib.decompress(counts), np.uint32).astype(np.float64)
            if shares is not None:
                part = part + np.frombuffer(zlib.decompress(shares), np.float64)
            if segment in sums:
                sums[segment] += part
            else:
                sums[segment] = part
    for segment, total in sums.items():
        total = np.rint(total)
        inside = np.packbits((total >= least) & (total <= most))
        yield pa.RecordBatch.from_arrays([pa.array([segment]), pa.array([inside.tobytes()], pa.binary())], names=["segment", "inside"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digest, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("digest", "n"))
        yield pa.RecordBatch.from_arrays(
            [pa.array([digest.astype(np.int64).tobytes()], pa.binary()), pa.array([n.astype(np.uint32).tobytes()], pa.binary())], names=["digests", "ns"]
        )


def lexicon(
    docs: DataFrame, least: int = LEAST_DOCUMENTS, share: float = LARGEST_SHARE, bits: int = BITS, most_repeated: int = MOST_REPEATED
) -> np.ndarray:
    """The band as packed bits, one per counter, from whole texts (column ``text``), each distinct text once."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select("text", F.xxhash64("text").alias("digest"))
    counted = stored(docs.groupBy("digest").agg(F.count("*").alias("n")), "text-digests")
    sizes = counted.agg(F.count("*").alias("distinct"), F.count_if(F.col("n") > 1).alias("repeated")).first()
    digests, ns = np.empty(0, np.int64), np.empty(0, np.uint32)
    if sizes["repeated"] > most_repeated:
        docs = docs.dropDuplicates(["digest"])
    elif sizes["repeated"]:
        packed = counted.where("n > 1").mapInArrow(_packed, "digests binary, ns binary").collect()
        digests = np.concatenate([np.frombuffer(r["digests"], np.int64) for r in packed])
        ns = np.concatenate([np.frombuffer(r["ns"], np.uint32) for r in packed])
    order = np.argsort(digests)
    sent = spark.sparkContext.broadcast((digests[order], ns[order]))
    most = max(share * sizes["distinct"], least)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = (
        docs.mapInArrow(lambda it: _frequencies(it, bits, sent), "segment long, counts binary, shares binary")
        .repartition(n, "segment").mapInArrow(lambda it: _bands(it, least, most), "segment long, inside binary").collect()
    )
    width = min(SEGMENT, 1 << bits) // 8
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in found:
        out[r["segment"] * width : (r["segment"] + 1) * width] = np.frombuffer(r["inside"], np.uint8)
    return out


class Prints(NamedTuple):
    """Per text its size class and (STEPS, subsets) hashes of 16 bits; 0 stands for a subset without terms of the text."""

    size: np.ndarray
    table: np.ndarray

    def then(self, other: Prints) -> Prints:
        """Without the first text, followed by the other's."""
        return Prints(*(np.concatenate([a[1:], b]) for a, b in zip(self, other)))


def fingerprints(texts: list, inside: np.ndarray, bits: int, subsets: int) -> Prints:
    hashes, bounds = _terms(pa.array(texts, pa.string()))
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    known = inside[(hashes >> np.uint64(64 - bits)).astype(np.int64)]
    missing = LEAST_TERMS - np.bincount(owner[known], minlength=len(texts))
    others = np.flatnonzero(~known)
    place = np.arange(len(others)) - np.searchsorted(owner[others], owner[others])
    known[others] = place < missing[owner[others]]
    hashes, owner = hashes[known], owner[known]
    size = np.round(np.log2(np.maximum(np.bincount(owner, minlength=len(texts)), 1))).astype(np.int64)
    out = np.zeros((len(texts), STEPS, subsets), np.uint16)
    kept = [(np.uint64(1) << (size[owner] + j).astype(np.uint64)) - np.uint64(1) for j in range(STEPS)]
    for k in range(subsets):
        drawn = mix(hashes ^ _SEEDS[k])
        for j in range(STEPS):
            member = np.flatnonzero((drawn & kept[j]) == 0)
            if len(member):
                at = owner[member]
                first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                value = np.add.reduceat(mix(drawn[member] + np.uint64(k)), first)
                out[at[first], j, k] = np.maximum(value >> np.uint64(48), 1).astype(np.uint16)
    return Prints(size, out)


def likeness(a: Prints, b: Prints) -> np.ndarray:
    """Share of equal hashes among the subsets, of all sizes both use, that hold terms of either text."""
    equal, either = np.zeros(len(a.size)), np.zeros(len(a.size))
    for i in range(STEPS):
        for j in range(STEPS):
            x, y = a.table[:, i], b.table[:, j]
            same_size = a.size + i == b.size + j
            either += np.where(same_size, ((x != 0) | (y != 0)).sum(axis=1), 0)
            equal += np.where(same_size, ((x == y) & (x != 0)).sum(axis=1), 0)
    same = (a.size == b.size) & (a.table == b.table).all(axis=(1, 2))
    return np.where(same, 1.0, equal / np.maximum(either, 1))


def _packed_prints(prints: Prints) -> pa.Array:
    """A byte for the size class, then two per hash."""
    return pa.array([bytes([s]) + x.astype(">u2").tobytes() for s, x in zip(prints.size.tolist(), prints.table)], pa.binary())


def _pairs(texts: list, following: list, inside, bits: int, subsets: int) -> list[pa.Array]:
    """The result columns of texts next to the texts that follow them."""
    texts, following = [t or "" for t in texts], [t or "" for t in following]
    edited = [t[: len(t) - len(t) // 3] + f[: len(t) // 3] for t, f in zip(texts, following)]
    own = fingerprints(texts, inside, bits, subsets)
    changed = fingerprints(edited, inside, bits, subsets)
    shifted = all(f is t for f, t in zip(following[:-1], texts[1:]))
    after = fingerprints(following[-1:] if shifted else following, inside, bits, subsets)
    return [
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).digest() for e in edited], pa.binary()),
        _packed_prints(own), _packed_prints(changed),
        pa.array(likeness(own, changed)), pa.array(likeness(own, own.then(after) if shifted else after)),
    ]


_RESULT = [
    T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.BinaryType()), T.StructField("fingerprint", T.BinaryType()),
    T.StructField("edited_fingerprint", T.BinaryType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
]
_NAMES = [f.name for f in _RESULT]
#: Columns stored as bytes and shown in hexadecimal.
_BYTES = [f.name for f in _RESULT if f.dataType == T.BinaryType()]


def _follow(batches: Iterator[pa.RecordBatch], bits: int, subsets: int, packed) -> Iterator[pa.RecordBatch]:
    """Results of all but a partition's last row; its first and last rows with their texts."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    inside = np.unpackbits(packed.value).astype(bool)
    held = None
    kind_of_id = None

    def end(kind: str, row) -> pa.RecordBatch:
        values = [pa.array([part], pa.int32()), pa.array([kind]), pa.array([row[0]], kind_of_id), pa.array([row[1]], pa.string())]
        return pa.RecordBatch.from_arrays(
            [*values, pa.nulls(1, pa.int64()), *(pa.nulls(1, pa.binary()) for _ in range(3)), *(pa.nulls(1, pa.float64()) for _ in range(2))],
            names=["part", "kind", "doc_id", "text", *_NAMES],
        )

    for batch in batches:
        for piece in text_slices(batch, "text"):
            kind_of_id = piece.column("doc_id").type
            rows = list(zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()))
            if held is None:
                yield end("first", rows[0])
            else:
                rows = [held, *rows]
            held = rows[-1]
            if len(rows) > 1:
                texts = [t or "" for _, t in rows]
                done = _pairs(texts[:-1], texts[1:], inside, bits, subsets)
                n = len(rows) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, np.int32)), pa.array(["row"] * n), pa.array([r[0] for r in rows[:-1]], kind_of_id), pa.nulls(n, pa.string()), *done],
                    names=["part", "kind", "doc_id", "text", *_NAMES],
                )
    if held is not None:
        yield end("last", held)


def _join_ends(batches: Iterator[pa.RecordBatch], bits: int, subsets: int, packed) -> Iterator[pa.RecordBatch]:
    inside = np.unpackbits(packed.value).astype(bool)
    for batch in batches:
        for piece in text_slices(batch, "text"):
            if piece.num_rows:
                done = _pairs(piece.column("text").to_pylist(), piece.column("next_text").to_pylist(), inside, bits, subsets)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *done], names=["doc_id", *_NAMES])


def fingerprint_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_DOCUMENTS,
    share: float = LARGEST_SHARE, bits: int = BITS, subsets: int = SUBSETS,
) -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Rows follow each other by descending id (null last; ties by a hash of the text), the first after
    the last.  The edited text has its last third replaced by the beginning of the next text.
    Null counts as empty; texts without words share the empty fingerprint.  Equal texts have equal
    fingerprints.  A single row is its own next.  An empty table gives an empty result; other
    columns are ignored.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    packed = spark.sparkContext.broadcast(lexicon(plain, least, share, bits))
    id_field = T.StructField("doc_id", plain.schema["doc_id"].dataType)
    sorted_rows = ordered(plain, F.desc_nulls_last("doc_id"), F.xxhash64("text"))
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("kind", T.StringType()), id_field, T.StructField("text", T.StringType()), *_RESULT,
    ])
    rows = stored(sorted_rows.mapInArrow(lambda it: _follow(it, bits, subsets, packed), schema), "fingerprints")
    # two rows per partition: the last row of each meets the first of the next one that has rows
    place = F.row_number().over(Window.orderBy("part"))
    firsts = rows.where("kind = 'first'").select(place.alias("at"), F.col("text").alias("next_text"))
    lasts = rows.where("kind = 'last'").select("doc_id", "text", place.alias("place"), F.count("*").over(Window.partitionBy(F.lit(0))).alias("n"))
    ends = lasts.join(firsts, F.col("place") % F.col("n") + 1 == F.col("at")).select("doc_id", "text", "next_text")
    joined = ends.mapInArrow(lambda it: _join_ends(it, bits, subsets, packed), T.StructType([id_field, *_RESULT]))
    every = rows.where("kind = 'row'").select("doc_id", *_NAMES).unionByName(joined)
    return every.withColumns({c: F.lower(F.hex(c)) for c in _BYTES})
