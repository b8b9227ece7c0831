"""Grouping spelling variants with a bit-sliced position index (operator 13).

Words one inserted, deleted or replaced code point apart share their first or their last ``anchor``
code points, because a word has at least twice as many.  So words meet in blocks by one of the two
ends and by length: a block holds the words of length k and those of length k - 1.  Within a block the
words of length k are indexed by bits: for every position and letter one bitset says which words
have that letter there.  A word is looked up against all of them together, letter by letter: one
bitset holds the words that agree so far, another those that differ once, and a few word-parallel
operations take both to the next letter.  A shorter word reads the position one further along once
it has skipped a letter.  Large blocks are cut into tiles of bounded size, so no task holds a block,
and only links leave a tile: per word the number of its near words and the best of them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tidemill.llm.common import if_small, prepare, stored, text_slices

LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
LETTERS = "A-Za-zÀ-ÿ"
#: Words, and letters of words, in a tile of a block; small blocks are one tile.
TILE_WORDS, TILE_LETTERS = 4096, 1 << 17
#: Distinct words that a task counts before it hands them on, and runs read at once from a long text.
HELD_WORDS, READ_RUNS = 300_000, 1 << 18
_LOWER = {c: c + 32 for c in range(65, 91)}


def _count(batches: Iterator[pa.RecordBatch], length: int, every: int | None) -> Iterator[pa.RecordBatch]:
    runs = re.compile(f"[{LETTERS}]{{{length},}}").finditer
    total: Counter = Counter()

    def counted() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

    for batch in batches:
        for piece in text_slices(batch, "text"):
            for doc, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()):
                found = runs(text or "")
                salt = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                while some := Counter(m[0] for m in islice(found, READ_RUNS)):
                    for run, n in some.items():
                        word = run.lower() if run.isascii() else run.translate(_LOWER)
                        if every:
                            h = zlib.crc32(word.encode(), salt)
                            if h % every == 0:
                                k = h % len(word)
                                word = word[:k] + word[k + 1 :]
                                if len(word) < length:
                                    continue
                        total[word] += n
                    if len(total) > HELD_WORDS:
                        yield counted()
                        total.clear()
    yield counted()


def count_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT, damaged: int | None = None,
) -> DataFrame:
    """word, n: maximal runs of Latin letters, A-Z lower-cased, of at least ``least_length`` code points and ``least_count`` occurrences.

    With ``damaged`` a run loses one code point in every document where the crc32 of
    ``<id>:<run>`` is a multiple of it, for measuring how typing errors are found again.  Null texts
    hold no words and a null id counts as empty text; repeated rows count each time; an empty table
    has no words; other columns are ignored.  Texts of any length are read in parts.
    """
    prepare(docs.sparkSession)
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counted = plain.mapInArrow(lambda it: _count(it, least_length, damaged), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _codes(words: list[str]) -> np.ndarray:
    """One row of code points per word; all words have the same length."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)


class PositionIndex:
    """Bitsets of the words that have a letter at a position; words of one length."""

    def __init__(self, codes: np.ndarray):
        self.size, self.length = codes.shape
        self.letters = np.unique(codes)
        same = codes.T[:, None, :] == self.letters[None, :, None]
        packed = np.packbits(same, axis=2, bitorder="little")
        lanes = -(-self.size // 64)
        #: (position, letter, lane); the last letter stands for all others and has no words
        self.bits = np.zeros((self.length, len(self.letters) + 1, lanes), np.uint64)
        self.bits.view(np.uint8)[:, :-1, : packed.shape[2]] = packed
        whole = np.zeros(lanes * 64, bool)
        whole[: self.size] = True
        self.all = np.packbits(whole, bitorder="little").view(np.uint64)

    def _letters(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        return np.where(self.letters[at] == codes, at, len(self.letters))

    def replaced(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) pairs of equal length that differ in one position."""
        letter = self._letters(codes)
        none, one = np.broadcast_to(self.all, (len(codes), len(self.all))), np.zeros((len(codes), len(self.all)), np.uint64)
        for j in range(self.length):
            here = self.bits[j][letter[:, j]]
            one = (one & here) | (none & ~here)
            none = none & here
        return self._pairs(one)

    def inserted(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) pairs where the word has one letter more than the query."""
        letter = self._letters(codes)
        none, one = np.broadcast_to(self.all, (len(codes), len(self.all))), np.zeros((len(codes), len(self.all)), np.uint64)
        for j in range(self.length - 1):
            one = (one | none) & self.bits[j + 1][letter[:, j]]
            none = none & self.bits[j][letter[:, j]]
        return self._pairs(one | none)

    def _pairs(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        query, lane = np.nonzero(found)
        k, bit = np.nonzero(np.unpackbits(found[query, lane][:, None].view(np.uint8), axis=1, bitorder="little"))
        return query[k], lane[k] * 64 + bit


def _links(words: list[str], first: np.ndarray, length: int, within: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of near words, each once: words of ``length`` with each other and with those one shorter.

    ``first`` names the words of the tile's first part; a tile of two parts (not ``within``) links only words of different parts.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    upper, lower = np.flatnonzero(sizes == length), np.flatnonzero(sizes != length)
    if not len(upper):
        return upper, upper
    codes = _codes([words[k] for k in upper])
    index = PositionIndex(codes)
    asked = np.arange(len(upper)) if within else np.flatnonzero(first[upper])
    a, b = index.replaced(codes[asked])
    a, b = upper[asked[a]], upper[b]
    keep = a < b if within else ~first[b]
    pairs = [(a[keep], b[keep])]
    if len(lower):
        a, b = index.inserted(_codes([words[k] for k in lower]))
        a, b = lower[a], upper[b]
        keep = slice(None) if within else first[a] != first[b]
        pairs.append((a[keep], b[keep]))
    return tuple(np.concatenate(side) for side in zip(*pairs))


def _tile(words: list[str], n: np.ndarray, first: np.ndarray, length: int, anchor: int, by_end: bool, within: bool) -> pa.RecordBatch | None:
    """Per word with near words in the tile: their number and the most frequent one."""
    a, b = _links(words, first, length, within)
    if by_end and len(a):  # words that also share their first letters meet there
        start = _codes([w[:anchor] for w in words])
        new = (start[a] != start[b]).any(axis=1)
        a, b = a[new], b[new]
    if not len(a):
        return None
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.lexsort((np.array(words), -n))
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    best = np.full(len(words), len(words))
    np.minimum.at(best, a, place[b])
    some = np.flatnonzero(best < len(words))
    near = order[best[some]]
    return pa.RecordBatch.from_arrays(
        [pa.array([words[k] for k in some]), pa.array(n[some]), pa.array(np.bincount(a, minlength=len(words))[some]),
         pa.array([words[k] for k in near]), pa.array(n[near])],
        names=["word", "n", "n_near", "best", "best_n"],
    )


def _near(batches: Iterator[pa.RecordBatch], anchor: int) -> Iterator[pa.RecordBatch]:
    """Results of all tiles; a tile's rows follow each other, over batches as well."""

    def tiles() -> Iterator[tuple]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            names = batch.column("tile")
            opens = np.flatnonzero(np.append(True, pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False))) if batch.num_rows else []
            for lo, hi in zip(opens, [*opens[1:], batch.num_rows]):
                part = batch.slice(lo, hi - lo)
                if held and held[0].column("tile")[0] != part.column("tile")[0]:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(part)
        if held:
            yield pa.Table.from_batches(held)

    for tile in tiles():
        if tile.num_rows > 1:
            row = tile.slice(0, 1).to_pylist()[0]
            done = _tile(
                tile.column("word").to_pylist(), tile.column("n").to_numpy(), tile.column("first").to_numpy(),
                row["length"], anchor, row["by_end"], row["within"],
            )
            if done is not None:
                yield done


def near_words(words: DataFrame, least_length: int = LEAST_LENGTH, tile_words: int = TILE_WORDS, tile_letters: int = TILE_LETTERS) -> DataFrame:
    """word, n, n_near, best, best_n in parts: a row per word and tile in which it has near words."""
    anchor = least_length // 2
    size = F.char_length("word")

    def block(by_end: bool, length: Column) -> Column:
        gram = F.right("word", F.lit(anchor)) if by_end else F.left("word", F.lit(anchor))
        return F.struct(gram.alias("gram"), F.lit(by_end).alias("by_end"), length.alias("length"))

    met = words.select(
        "word", "n", F.explode(F.array(*(block(end, size + more) for end in (False, True) for more in (0, 1)))).alias("block")
    ).select("word", "n", "block.*")
    keys = ["gram", "by_end", "length"]
    parts = F.ceil(F.greatest(F.col("size") / tile_words, F.col("size") * F.col("length") / tile_letters))
    large = met.groupBy(*keys).agg(F.count("*").alias("size")).select(*keys, parts.alias("parts")).where("parts > 1")
    # at most 4 / tile_words of the vocabulary's rows, broadcast only if counted to be small
    dealt = met.join(if_small(large, "large-blocks"), keys, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")))
    tiled = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(
        F.concat_ws(":", "gram", "by_end", "length", F.least("part", "other"), F.greatest("part", "other")).alias("tile"),
        "word", "n", "length", "by_end", (F.col("part") <= F.col("other")).alias("first"), (F.col("part") == F.col("other")).alias("within"),
    )
    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tiled.repartition(n, "tile").sortWithinPartitions("tile").mapInArrow(
        lambda it: _near(it, anchor), "word string, n long, n_near long, best string, best_n long"
    )


def group_variants(
    words: DataFrame, least_length: int = LEAST_LENGTH, ratio: int = RATIO, tile_words: int = TILE_WORDS, tile_letters: int = TILE_LETTERS
) -> DataFrame:
    """A row per word: word, form, root, n, n_near, form_n.

    ``words`` are distinct (word, n) rows; null words and those of fewer than ``least_length`` code
    points are left out.  Near words are one inserted, deleted or replaced code point apart.  A word's
    form is its near word with the largest n (ties: the first in code-point order) if that is at
    least ``ratio`` times its own; the root follows forms to the end, or is the word itself.  Forms
    grow in n, so chains are short and end.  An empty table gives an empty result.
    """
    if ratio < 2:
        raise ValueError("forms must be more frequent than their variants")
    prepare(words.sparkSession)
    known = stored(words.select("word", F.col("n").cast("long").alias("n")).where(F.char_length("word") >= least_length), "vocabulary")
    nothing = known.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("best"), F.lit(None).cast("long").alias("best_n"))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("rank"), "best"))).alias("top")
    joined = nothing.unionByName(near_words(known, least_length, tile_words, tile_letters)).groupBy("word").agg(
        F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best
    )
    is_form = -F.col("top.rank") >= ratio * F.col("n")
    formed = stored(joined.select(
        "word", "n", "n_near", F.when(is_form, F.col("top.best")).alias("form"), F.when(is_form, -F.col("top.rank")).alias("form_n")
    ), "forms")
    # every round doubles the steps that a pointer has followed
    pointers, moved = formed.where("form is not null").select("word", F.col("form").alias("root")), 1
    while moved:
        onward = pointers.select(F.col("word").alias("root"), F.col("root").alias("further"))
        pointers = stored(pointers.join(onward, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
        ), "roots")
        moved = pointers.where("moved").limit(1).count()
        pointers = pointers.drop("moved")
    return formed.join(pointers, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def document_variants(docs: DataFrame, damaged: int | None = None) -> DataFrame:
    """``group_variants`` of the words of ``docs``."""
    return group_variants(count_words(docs, damaged=damaged))
