"""Best-fit packing by a configuration linear program over the histogram of lengths (operator 12).

Only the histogram, at most one number per possible length, reaches the driver.  A configuration is
a multiset of lengths that fits a sequence; the linear program asks how often to use each so that
every length is covered with the fewest sequences.  It is solved by multiplicative weights: each
length has a weight that falls exponentially with the share of it that is covered, a knapsack
dynamic program prices all configurations at once (for every length the best one that holds it), and
those near the best price are used a little more.  The fractional solution is rounded to whole
sequences, and what rounding leaves over goes best-fit, longest first, into the gaps and into new
sequences.  A piece's place then follows from its length and its rank among pieces of that length.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemill.llm.common import prepare, running_totals, text_slices
from tidemill.llm.tokens import added_tokens

WINDOW = 2048
#: The id that ends each document.
END = 0
#: Rounds of multiplicative weights, the share of a length's demand that a round may cover, how fast
#: covered lengths lose weight, how far below the best price a configuration may lie, and the noise.
ROUNDS, STEP, RATE, SLACK, NOISE = 96, 0.15, 0.5, 0.05, 0.005

#: Shares of the fractional solution that rounding tries to keep; the fewest sequences win.
KEPT = (1.0, 0.7, 0.4, 0.2, 0.1)


def price(lengths: np.ndarray, value: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack: the best value of every capacity up to ``window``, and the item it adds (-1: none, leave one unit free)."""
    best, item = np.zeros(window + 1), np.full(window + 1, -1)
    upto = np.searchsorted(lengths, np.arange(window + 1), side="right")
    for c in range(int(lengths[0]), window + 1):
        n = upto[c]
        gain = best[c - lengths[:n]] + value[:n]
        k = int(gain.argmax())
        if gain[k] > best[c - 1]:
            best[c], item[c] = gain[k], k
        else:
            best[c] = best[c - 1]
    return best, item


def _holding(k: int, item: list[int], lengths: list[int], window: int) -> dict[int, int]:
    """The best configuration with item ``k``: copies per item."""
    out, capacity = {k: 1}, window - lengths[k]
    while capacity > 0:
        k = item[capacity]
        if k < 0:
            capacity -= 1
        else:
            out[k] = out.get(k, 0) + 1
            capacity -= lengths[k]
    return out


def fractional(lengths: np.ndarray, demand: np.ndarray, window: int, rounds: int = ROUNDS) -> dict[tuple, float]:
    """Configurations, as sorted (index of length, copies) pairs, and how often the linear program uses them."""
    used: dict[tuple, float] = defaultdict(float)
    size, need = lengths.tolist(), demand.tolist()
    covered = [0.0] * len(size)
    rng = np.random.default_rng(0)
    for _ in range(rounds):
        done = np.array(covered)
        if done.min() > 1 - 1e-9:
            break
        # the noise decides between configurations of equal price
        weight = np.exp(-RATE * (done - done.min())) * rng.uniform(1 - NOISE, 1, len(size))
        value = lengths / window * weight
        best, item = price(lengths, value, window)
        price_of, chosen = value + best[window - lengths], item.tolist()
        room = np.minimum(STEP, 1 - done).tolist()
        for k in np.argsort(-price_of, kind="stable").tolist():
            if price_of[k] < (1 - SLACK) * best[window]:
                break
            if room[k] <= 0:
                continue
            config = _holding(k, chosen, size, window)
            if any(room[i] <= 0 or n > need[i] for i, n in config.items()):
                continue
            amount = min(room[i] * need[i] / n for i, n in config.items())
            used[tuple(sorted(config.items()))] += amount
            for i, n in config.items():
                share = amount * n / need[i]
                covered[i] += share
                room[i] = room[i] - share if room[i] - share > 1e-9 else 0.0
    return used


class Group(NamedTuple):
    """``bins`` sequences that all hold the same (length, copies) pairs in this order."""

    bins: int
    items: tuple


def _best_fit(lengths: np.ndarray, left: np.ndarray, window: int, groups: list[Group]) -> list[Group]:
    """Put ``left`` items, longest first, where the gap is smallest: a sequence is filled with a length before the next."""
    by_gap: dict[int, list[Group]] = defaultdict(list)
    has = np.zeros(window + 1, bool)

    def put(group: Group) -> None:
        if group.bins:
            gap = window - sum(length * n for length, n in group.items)
            by_gap[gap].append(group)
            has[gap] = True

    for group in groups:
        put(group)
    for k in np.argsort(-lengths):
        length, rest = int(lengths[k]), int(left[k])
        while rest:
            at = int(has[length:].argmax()) + length
            if has[at]:
                open_ = by_gap[at].pop()
                has[at] = bool(by_gap[at])
            else:
                at, open_ = window, Group(rest, ())
            most = at // length
            full = min(open_.bins, rest // most)
            part = min(rest - full * most, most) if full < open_.bins else 0
            put(Group(full, (*open_.items, (length, most))))
            if part:
                put(Group(1, (*open_.items, (length, part))))
            unused = open_.bins - full - bool(part)
            if open_.items:
                put(Group(unused, open_.items))
            rest -= full * most + part
    return [g for listed in by_gap.values() for g in listed]


def solve(histogram: Mapping[int, int], window: int = WINDOW, rounds: int = ROUNDS) -> list[Group]:
    """Groups of sequences that hold every length as often as ``histogram`` says."""
    whole = [Group(int(histogram[window]), ((window, 1),))] if histogram.get(window) else []
    shorter = sorted(length for length, n in histogram.items() if n and length < window)
    if not shorter:
        return whole
    lengths = np.array(shorter)
    demand = np.array([int(histogram[x]) for x in shorter], np.int64)
    used = sorted(fractional(lengths, demand, window, rounds).items(), key=lambda c: (-c[1], c[0]))
    trials = (_rounded(used, share, lengths, demand, window) for share in KEPT)
    return whole + min(trials, key=lambda groups: sum(g.bins for g in groups))


def _rounded(used: list, share: float, lengths: np.ndarray, demand: np.ndarray, window: int) -> list[Group]:
    """Whole sequences for ``share`` of the fractional solution, most used first, and best-fit for what they leave."""
    left, groups = demand.copy(), []
    for config, amount in used:
        which, copies = np.array(config).T
        bins = min(int(share * amount + 0.5), int((left[which] // copies).min()))
        if bins:
            left[which] -= bins * copies
            groups.append(Group(bins, tuple((int(lengths[k]), int(n)) for k, n in config[::-1])))
    return _best_fit(lengths, left, window, groups)


class Plan:
    """Where the piece of a length and rank goes."""

    def __init__(self, groups: list[Group], window: int):
        rows, first = [], 0
        for group in groups:
            offset = 0
            for length, copies in group.items:
                rows.append((length, first, copies, offset, group.bins * copies))
                offset += length * copies
            first += group.bins
        rows.sort()
        self.length, self.first, self.copies, self.offset, count = np.array(rows, np.int64).reshape(-1, 5).T
        self.start = np.cumsum(count) - count
        #: pieces of smaller lengths
        self.base = np.append(0, np.cumsum(np.bincount(self.length, count, window + 1).astype(np.int64)))
        self.total = int(count.sum())

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.base[length] + rank
        entry = np.searchsorted(self.start, at, side="right") - 1
        if len(at) and ((self.length[entry] != length).any() or at.max() >= self.total):
            raise ValueError("a length has more pieces than were counted")
        q = at - self.start[entry]
        return self.first[entry] + q // self.copies[entry], self.offset[entry] + q % self.copies[entry] * length


def _pieces(batches: Iterator[pa.RecordBatch], ranks: str, pattern: str, added, end: int, window: int) -> Iterator[pa.RecordBatch]:
    from tidemill.llm.tokens import encoder

    encode = encoder(ranks, pattern, added).encode
    last = np.array([end], "<u4").tobytes()
    for batch in batches:
        for part in text_slices(batch, "text"):
            row, piece, start, ids = [], [], [], []
            for k, text in enumerate(part.column("text").to_pylist()):
                data = encode(text or "") + last
                head = len(data) // 4 % window or window
                cuts = [0, *range(head, len(data) // 4, window), len(data) // 4]
                row += [k] * (len(cuts) - 1)
                piece += range(len(cuts) - 1)
                start += cuts[:-1]
                ids += [data[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([1] * len(ids), pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids", "one"],
            )


def _placed(batches: Iterator[pa.RecordBatch], plan) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "before"))
        sequence, offset = plan.value.place(length, rank)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "piece", "start", "length")), pa.array(sequence), pa.array(offset), batch.column("ids")],
            names=["doc_id", "piece", "start", "length", "sequence_id", "offset", "ids"],
        )


def best_fit_pack(
    docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
    window: int = WINDOW, end: int = END, rounds: int = ROUNDS, added: Mapping[str, int] | None = None,
) -> DataFrame:
    """Pieces of sequences: doc_id, piece, start, length, sequence_id, offset, ids.

    ``vocabulary`` names a file of token ranks, ``added`` strings that are one id each.  A document
    is its ids and ``end``; only one longer than ``window`` is cut, into whole windows after a first
    piece of what remains.  Sequences have no gaps before their end.  Null texts are a single end
    token; null ids and repeated rows are documents like any other; an empty table gives no pieces;
    other columns are ignored.  Pieces are stored once, so ranks and places stay as they are.
    """
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(texts.dtypes)["doc_id"]
    pieces = texts.mapInArrow(
        lambda it: _pieces(it, vocabulary, pattern, added, end, window),
        f"doc_id {kind}, piece int, start long, length long, ids binary, one long",
    )
    # a hot length is ranked like any other: one sum per partition and length
    ranked = running_totals(pieces, "one", "length", "pieces")
    histogram = {r["length"]: r["n"] for r in ranked.groupBy("length").agg(F.sum("one").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(Plan(solve(histogram, window, rounds), window))
    return ranked.select("doc_id", "piece", "start", "length", "ids", "before").mapInArrow(
        lambda it: _placed(it, plan),
        f"doc_id {kind}, piece int, start long, length long, sequence_id long, offset long, ids binary",
    )


def best_fit_documents(docs: DataFrame, **names) -> DataFrame:
    """``best_fit_pack`` with the 50k byte-level vocabulary that the machine's public tokenizers provide."""
    import public_tokenizers

    added = added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return best_fit_pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added=added, **names)


def best_fit_digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
