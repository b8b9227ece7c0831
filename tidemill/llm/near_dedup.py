"""MinHash near-duplicates with sequential Bayesian verification (operator 6).

Documents with equal shingle sets form one class, so copies never multiply.  Signatures of the
classes are banded.  In every bucket the most central member is compared with the others first;
members joined through it need no comparison among themselves.  What remains, pairs of different
components within a bucket, is compared in blocks of bounded size inside the tasks, which emit only
survivors.  Every comparison reads signature batches in turn and drops a pair as soon as the
posterior chance of reaching the threshold falls below the chosen miss probability.  Survivors are
confirmed on their full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemill.llm.common import numbered, prepare, release, stored, text_slices
from tidemill.llm.graph import components
from tidemill.llm.shingles import Words, distinct_per_document, minhash, mix, shingle_hashes

SHINGLE = 5
#: Linked when 100 * intersection >= PERCENT * union.
PERCENT = 75
#: 32 bands of 4 minima miss a pair at the threshold with probability 5e-6.
BANDS, ROWS = 32, 4
#: Minima per signature (16 bits each), read in batches.
SIGNATURE, BATCH = 256, 32
#: Further minima (8 bits each) for the pairs that remain within a bucket after its pivot.
LONGER = 512
#: Bits of the table that tells whose texts are read again; a full table only reads more of them.
FILTER_BITS = 26
#: A pair is dropped when its posterior chance of reaching the threshold is below this.
MISS = 1e-5
#: Components of more than 1 / HEAVY of all classes are named by a broadcast of their heads, at most HEAVY rows.
HEAVY = 4096
#: Members of a block when a bucket's remaining pairs are compared.
BLOCK = 256


def _log_binomial(n: int, k: int, p: float) -> float:
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log1p(-p)


@lru_cache
def least_matches(threshold: float, miss: float, count: int, batch: int) -> tuple[tuple[int, int], ...]:
    """After n minima a pair with fewer matches is dropped: (n, least matches) per batch.

    With a uniform prior the similarity given m matches of n is Beta(m + 1, n - m + 1), so its chance
    of reaching the threshold is that of at most m successes in n + 1 draws at the threshold.
    """
    out = []
    for n in range(batch, count + 1, batch):
        chance, m = 0.0, 0
        while m <= n:
            chance += np.exp(_log_binomial(n + 1, m, threshold))
            if chance >= miss:
                break
            m += 1
        out.append((n, m))
    return tuple(out)


def _surviving(a: np.ndarray, b: np.ndarray, percent: int, miss: float, batch: int) -> np.ndarray:
    """Row numbers of the pairs a[i], b[i] that no batch drops."""
    left = np.arange(len(a))
    matches = np.zeros(len(a), np.int32)
    for n, least in least_matches(percent / 100, miss, a.shape[1], batch):
        if not len(left):
            break
        part = slice(n - batch, n)
        matches = matches + (a[left, part] == b[left, part]).sum(axis=1)
        keep = matches >= least
        left, matches = left[keep], matches[keep]
    return left


def _matrix(column: pa.Array, width: int, kind=np.uint16) -> np.ndarray:
    """A binary column of equally long values as rows of numbers."""
    column = column.cast(pa.large_binary())
    first, n, bytes_each = column.offset, len(column), np.dtype(kind).itemsize
    offsets = np.frombuffer(column.buffers()[1], np.int64)[first : first + n + 1] // bytes_each
    return np.frombuffer(column.buffers()[2], kind)[offsets[0] : offsets[-1]].reshape(n, width)


def _binary_rows(table: np.ndarray) -> pa.Array:
    table = np.ascontiguousarray(table)
    width = table.shape[1] * table.itemsize
    offsets = np.arange(len(table) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(table), [None, pa.py_buffer(offsets), pa.py_buffer(table)])


def _binary_runs(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    offsets = (bounds * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]
    )


def _set_digest(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over each set."""
    out = []
    for salt in (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)):
        total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(mix(hashes ^ salt), out=total[1:])
        out.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band from its 16-bit minima and the band's number."""
    out = np.empty((len(signature), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(signature), band + 1, np.uint64)
        for r in range(rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + signature[:, band * rows + r])
        out[:, band] = key
    return out.view(np.int64)


def _features(batches: Iterator[pa.RecordBatch], size: int, count: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in text_slices(batch, "text"):
            hashes, bounds = distinct_per_document(*shingle_hashes(Words(piece.column("text")), size))
            d1, d2 = _set_digest(hashes, bounds)
            signature = (minhash(hashes, bounds, count) & np.uint32(0xFFFF)).astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [piece.column("uid"), piece.column("doc_id"), pa.array(np.diff(bounds).astype(np.int64)),
                 pa.array(d1), pa.array(d2), _binary_rows(signature)],
                names=["uid", "doc_id", "n_shingles", "d1", "d2", "signature"],
            )


def _bands(batches: Iterator[pa.RecordBatch], count: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = band_keys(_matrix(batch.column("signature"), count), bands, rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column("cid").to_numpy(zero_copy_only=False), bands)), pa.array(keys.ravel())],
                names=["cid", "key"],
            )


def _sets(batches: Iterator[pa.RecordBatch], size: int, wanted) -> Iterator[pa.RecordBatch]:
    """Digests and sets of the texts whose place in the filter is taken."""
    bits = wanted.value
    for batch in batches:
        place = batch.column("place").to_numpy(zero_copy_only=False) - 1
        batch = batch.take(pa.array(np.flatnonzero(bits[place >> 3] >> (place & 7).astype(np.uint8) & 1)))
        for piece in text_slices(batch, "text"):
            hashes, bounds = distinct_per_document(*shingle_hashes(Words(piece.column("text")), size))
            d1, d2 = _set_digest(hashes, bounds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(d1), pa.array(d2), _binary_runs(hashes, bounds)], names=["d1", "d2", "shingles"]
            )


def _longer(batches: Iterator[pa.RecordBatch], count: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            column = batch.column("shingles").cast(pa.large_binary())
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // 8
            hashes = np.frombuffer(column.buffers()[2], np.uint64)[offsets[0] : offsets[-1]]
            minima = (minhash(hashes, offsets - offsets[0], count, seed=2) & np.uint32(0xFF)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("cid"), _binary_rows(minima)], names=["cid", "longer"])


def _prune(batches: Iterator[pa.RecordBatch], count: int, percent: int, miss: float, step: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            left = _surviving(_matrix(batch.column("sa"), count), _matrix(batch.column("sb"), count), percent, miss, step)
            yield batch.select(["a", "b"]).take(pa.array(left))


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = []
        for k, (x, y) in enumerate(zip(batch.column("xs"), batch.column("ys"))):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            at = np.searchsorted(x, y)
            both = int((x[np.minimum(at, len(x) - 1)] == y).sum()) if len(x) else 0
            if 100 * both >= percent * (len(x) + len(y) - both):
                linked.append(k)
        yield batch.select(["a", "b"]).take(pa.array(linked, pa.int64()))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of the same cell, which may span batches, together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "ci", "cj")])
        edges = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        if held:
            last = held[-1].slice(held[-1].num_rows - 1)
            if tuple(int(last.column(c)[0].as_py()) for c in ("key", "ci", "cj")) != tuple(key[:, 0]):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
        at = 0
        for edge in edges:
            held.append(batch.slice(at, edge - at))
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, at = [], int(edge)
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _compare(
    batches: Iterator[pa.RecordBatch], count: int, longer: int, bands: int, rows: int, percent: int, miss: float, step: int
) -> Iterator[pa.RecordBatch]:
    for cell in _cells(batches):
        ci, cj = cell.column("ci")[0].as_py(), cell.column("cj")[0].as_py()
        key = cell.column("key")[0].as_py()
        block = cell.column("block").to_numpy(zero_copy_only=False)
        label = cell.column("label").to_numpy(zero_copy_only=False)
        cid = cell.column("cid").to_numpy(zero_copy_only=False)
        pivot = cell.column("pivot")[0].as_py()
        signature = _matrix(cell.column("signature"), count)
        minima = np.hstack([signature, _matrix(cell.column("longer"), longer, np.uint8)])
        one = np.flatnonzero(block == ci)
        two = np.flatnonzero(block == cj)
        found_a, found_b = [], []
        for i in one:
            others = two[two > i] if ci == cj else two
            others = others[(label[others] != label[i]) & (cid[others] != pivot)]
            if cid[i] == pivot or not len(others):
                continue
            left = others[_surviving(np.broadcast_to(minima[i], (len(others), count + longer)), minima[others], percent, miss, step)]
            if len(left):
                found_a.append(np.full(len(left), i))
                found_b.append(left)
        if found_a:
            a, b = np.concatenate(found_a), np.concatenate(found_b)
            # a pair that meets in several buckets belongs to the first of them
            same = band_keys(signature[a], bands, rows) == band_keys(signature[b], bands, rows)
            first = band_keys(signature[a], bands, rows)[np.arange(len(a)), same.argmax(axis=1)] == key
            a, b = cid[a[first]], cid[b[first]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"]
            )


class Search:
    """The parameters of one run and its steps."""

    def __init__(self, shingle=SHINGLE, percent=PERCENT, bands=BANDS, rows=ROWS, signature=SIGNATURE, batch=BATCH, miss=MISS, block=BLOCK, longer=LONGER, heavy=HEAVY):
        if bands * rows > signature or signature % batch or longer % batch:
            raise ValueError("bands * rows must fit the signature, and batches must divide it")
        self.shingle, self.percent, self.bands, self.rows = shingle, percent, bands, rows
        self.signature, self.batch, self.miss, self.block, self.longer, self.heavy = signature, batch, miss, block, longer, heavy

    def features(self, texts: DataFrame) -> DataFrame:
        """uid, doc_id, n_shingles, set digest and signature of rows (uid, doc_id, text)."""
        size, count = self.shingle, self.signature
        kind = texts.schema["doc_id"].dataType.simpleString()
        return texts.mapInArrow(
            lambda it: _features(it, size, count),
            f"uid long, doc_id {kind}, n_shingles long, d1 long, d2 long, signature binary",
        )

    def prune(self, pairs: DataFrame, signatures: DataFrame) -> DataFrame:
        count, percent, miss, step = self.signature, self.percent, self.miss, self.batch
        sa = signatures.select(F.col("cid").alias("a"), F.col("signature").alias("sa"))
        sb = signatures.select(F.col("cid").alias("b"), F.col("signature").alias("sb"))
        return pairs.join(sa, "a").join(sb, "b").select("a", "b", "sa", "sb").mapInArrow(
            lambda it: _prune(it, count, percent, miss, step), "a long, b long"
        )

    def confirm(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        percent = self.percent
        xs = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("xs"))
        ys = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("ys"))
        return pairs.join(xs, "a").join(ys, "b").select("a", "b", "xs", "ys").mapInArrow(
            lambda it: _confirm(it, percent), "a long, b long"
        )

    def buckets(self, classes: DataFrame) -> DataFrame:
        """(key, cid, n) of all buckets with at least two classes."""
        count, bands, rows = self.signature, self.bands, self.rows
        banded = classes.select("cid", "signature").mapInArrow(lambda it: _bands(it, count, bands, rows), "cid long, key long")
        shared = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        return banded.join(shared, "key")

    def pivots(self, buckets: DataFrame) -> DataFrame:
        """Per bucket the member that shares most bucket places with others."""
        central = buckets.groupBy("cid").agg(F.sum(F.col("n") - 1).alias("central"))
        return (
            buckets.join(central, "cid")
            .groupBy("key")
            .agg(F.max(F.struct("central", (-F.col("cid")).alias("less"))).alias("top"))
            .select("key", (-F.col("top.less")).alias("pivot"))
        )

    def rest(self, buckets: DataFrame, pivots: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
        """Surviving pairs of different components that meet in a bucket and exclude its pivot."""
        count, bands, rows, block = self.signature, self.bands, self.rows, self.block
        percent, miss, step, longer = self.percent, self.miss, self.batch, self.longer
        named = (
            buckets.where("n > 2")
            .join(labels.withColumnRenamed("node", "cid"), "cid", "left")
            .select("key", "cid", "n", F.coalesce("root", "cid").alias("label"))
        )
        mixed = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
        blocks = F.ceil(F.col("n") / block).cast("int")
        remaining = stored(named.join(mixed, "key").join(pivots, "key"), "remaining")
        more = (
            sets.join(remaining.select("cid").distinct(), "cid", "left_semi").select("cid", "shingles")
            .mapInArrow(lambda it: _longer(it, longer), "cid long, longer binary")
        )
        signatures = classes.select("cid", "signature").join(more, "cid")
        placed = (
            remaining
            .withColumn("block", F.pmod(F.xxhash64("cid", F.lit(7)), blocks).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            .select("key", F.least("block", "other").alias("ci"), F.greatest("block", "other").alias("cj"), "block", "cid", "label", "pivot")
            .join(signatures, "cid")
        )
        parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return (
            placed.repartition(parts, "key", "ci", "cj")
            .sortWithinPartitions("key", "ci", "cj")
            .mapInArrow(lambda it: _compare(it, count, longer, bands, rows, percent, miss, step), "a long, b long")
        )

    def sets(self, texts: DataFrame, wanted: DataFrame) -> DataFrame:
        """(cid, shingles) of the wanted classes, read again from the texts.

        A bitmap of fixed size over hashed ids tells which texts to look at; the digest of its set
        tells the class of a text, so chance hits and repeated ids do no harm.
        """
        spark, size = texts.sparkSession, self.shingle
        place = lambda name: F.pmod(F.xxhash64(name), F.lit(1 << FILTER_BITS)) + 1
        segments = (
            wanted.select(place("first_id").alias("place"))
            .groupBy(F.bitmap_bucket_number("place").alias("segment"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
        )
        bits = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
        for r in segments.toLocalIterator():
            # segment 1 holds the places 1 to 32768, one bit each
            bits[(r["segment"] - 1) * 4096 : r["segment"] * 4096] = np.frombuffer(r["bits"], np.uint8)
        sent = spark.sparkContext.broadcast(bits)
        found = texts.select(place("doc_id").alias("place"), "text").mapInArrow(
            lambda it: _sets(it, size, sent), "d1 long, d2 long, shingles binary"
        )
        once = F.row_number().over(Window.partitionBy("d1", "d2").orderBy("cid"))
        return (
            found.join(wanted.select("cid", "d1", "d2"), ["d1", "d2"])
            .withColumn("copy", once).where("copy = 1").select("cid", "shingles")
        )

    def run(self, texts: DataFrame) -> DataFrame:
        """uid, doc_id, n_shingles, component_id, kept of rows (uid, doc_id, text)."""
        prepare(texts.sparkSession)
        features = stored(self.features(texts), "features")
        narrow = features.select("uid", "doc_id", "n_shingles", "d1", "d2")
        filled = narrow.where("n_shingles > 0")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid"))
        groups = stored(
            filled.groupBy("d1", "d2").agg(first.alias("first")).select(
                "d1", "d2", F.col("first.uid").alias("cid"), F.col("first.doc_id").alias("first_id")
            ),
            "classes",
        )
        classes = stored(features.select(F.col("uid").alias("cid"), "signature").join(groups.select("cid", "d1", "d2", "first_id"), "cid"), "signatures")
        buckets = stored(self.buckets(classes), "buckets")
        pivots = stored(self.pivots(buckets), "pivots")
        met = buckets.select("cid").distinct()
        wanted = stored(classes.join(met, "cid", "left_semi"), "wanted")
        release(texts.sparkSession)
        sets = stored(self.sets(texts, wanted), "sets")
        release(texts.sparkSession)
        star = (
            buckets.join(pivots, "key").where("cid <> pivot")
            .select(F.least("cid", "pivot").alias("a"), F.greatest("cid", "pivot").alias("b")).distinct()
        )
        links = stored(self.confirm(stored(self.prune(star, wanted), "star"), sets), "links")
        labels = components(links)
        release(texts.sparkSession)
        more = stored(self.rest(buckets, pivots, labels, wanted, sets), "rest")
        extra = stored(self.confirm(more, sets), "links")
        labels = components(links.unionByName(extra))
        return self.members(narrow, groups, labels)

    def members(self, narrow: DataFrame, groups: DataFrame, labels: DataFrame) -> DataFrame:
        """Every document with the head of its component; no task gets all classes of a heavy component."""
        rooted = stored(
            groups.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("d1", "d2", "first_id", "cid", "root"), "rooted"
        )
        order = F.struct(F.col("first_id").isNull().alias("no_id"), F.col("first_id").alias("id"), F.col("cid").alias("uid"))
        # combined before the shuffle, so a heavy component costs one row per task
        heads = stored(
            rooted.where("root IS NOT NULL").groupBy("root").agg(F.min(order).alias("head"), F.count("*").alias("classes"))
            .select("root", F.col("head.id").alias("head_id"), F.col("head.uid").alias("head_uid"), "classes"),
            "heads",
        )
        is_heavy = F.col("classes") * self.heavy > rooted.count()
        tagged = rooted.join(F.broadcast(heads.where(is_heavy).drop("classes")), "root", "left")
        done = F.col("root").isNull() | F.col("head_uid").isNotNull()
        apart = tagged.where(done).select(
            "d1", "d2", F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("head_id")).alias("head_id"),
            F.coalesce("head_uid", "cid").alias("head_uid"),
        )
        rest = tagged.where(~done).select("d1", "d2", "root").join(heads.where(~is_heavy).drop("classes"), "root")
        named = apart.unionByName(rest.select("d1", "d2", "head_id", "head_uid"))
        linked = narrow.where("n_shingles > 0").join(named, ["d1", "d2"]).select(
            "uid", "doc_id", "n_shingles", F.col("head_id").alias("component_id"), (F.col("uid") == F.col("head_uid")).alias("kept")
        )
        alone = narrow.where("n_shingles = 0").select(
            "uid", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")
        )
        return linked.unionByName(alone)


def _texts(docs: DataFrame, id_col: str, text_col: str, row_number) -> DataFrame:
    return docs.select(row_number.alias("uid"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id reachable over links), kept.

    Words are runs without ASCII white space, A-Z in lower case; the set of a document holds its
    distinct runs of five words, or its whole sequence if it has fewer.  Null, empty and blank
    texts have an empty set, are linked with nothing and are kept.  Ties and repeated rows fall
    into one class; its smallest id represents it (null last) and exactly one row is kept.  An
    empty table gives an empty result; other columns are ignored.
    """
    run = Search(**parameters).run(_texts(docs, id_col, text_col, F.monotonically_increasing_id()))
    return run.drop("uid")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """One row of each component, with all its columns."""
    table = numbered(docs, "near-rows")
    kept = Search(**parameters).run(_texts(table, f"row.{id_col}", f"row.{text_col}", F.col("uid"))).where("kept").select("uid")
    return table.join(kept.hint("shuffle_hash"), "uid", "left_semi").select("row.*")
