"""Mixture-controlled packing by deficit round-robin over source queues (operator 4).

A source's documents form one stream of tokens.  Every window gives each source a quantum, its
target share of the window; what has been earned and not yet served is the source's deficit and is
carried on.  Sources are served whole grains of ``grain`` tokens, each in the round by which half
of it is earned, so after any round a source that has tokens left is at most half a grain from its
target.  Rounds follow each other without gaps and are cut into full windows.  The round in which a grain is served follows from its place in the stream alone, so no window has
to wait for the one before, and deficits carry across partitions without any state.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemill.llm.common import ordered, prepare, running_totals, stored, text_slices
from tidemill.llm.tokens import CACHE, added_tokens

WINDOW = 2048
#: Tokens that a source is served at a time.
GRAIN = 128
#: Up to so many sources their table is broadcast and pieces are placed by formula; beyond, by a range sort.  Results agree.
MOST_QUEUES = 4096
#: The id that ends each document.
END = 1


def _encode(batches: Iterator[pa.RecordBatch], ranks: str, pattern: str, added: Mapping[str, int] | None, end: int, cache: int) -> Iterator[pa.RecordBatch]:
    from tidemill.llm.tokens import encoder

    encode = encoder(ranks, pattern, added, cache).encode
    last = np.array([end], "<u4").tobytes()
    for batch in batches:
        for piece in text_slices(batch, "text"):
            ids = [encode(t or "") + last for t in piece.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), piece.column("source"), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())],
                names=["doc_id", "source", "ids", "doc_tokens"],
            )


def _turn(k: np.ndarray, grain: int, quantum: np.ndarray) -> np.ndarray:
    """The round that serves a source's grain k: the first by whose end half of it is earned."""
    return np.ceil((k + 0.5) * grain / quantum).astype(np.int64) - 1


class Queues:
    """Quantum and length of every source, in order; closed forms of what rounds have served."""

    def __init__(self, rank: np.ndarray, quantum: np.ndarray, tokens: np.ndarray, grain: int):
        order = np.argsort(rank)
        self.quantum, self.tokens, self.grain = quantum[order], tokens[order], grain

    def served(self, rounds: np.ndarray) -> np.ndarray:
        """(round, source) tokens served before each round: its grains of earlier turns, as far as there are any."""
        count = np.floor(rounds[:, None] * self.quantum / self.grain + 0.5).astype(np.int64)
        count -= (count > 0) & (_turn(count - 1, self.grain, self.quantum) >= rounds[:, None])
        count += _turn(count, self.grain, self.quantum) < rounds[:, None]
        return np.minimum(count * self.grain, self.tokens)

    def offsets(self, turn: np.ndarray, rank: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where in the packed stream the token at ``place`` of source ``rank``, served in round ``turn``, lies."""
        out = np.empty(len(turn), np.int64)
        rounds, which = np.unique(turn, return_inverse=True)
        step = max(1, (1 << 21) // max(1, len(self.tokens)))
        for at in range(0, len(rounds), step):
            part = rounds[at : at + step]
            before, after = self.served(part), self.served(part + 1)
            ahead = np.cumsum(after - before, axis=1) - (after - before)
            mine = np.flatnonzero((which >= at) & (which < at + step))
            row, column = which[mine] - at, rank[mine]
            out[mine] = before.sum(axis=1)[row] + ahead[row, column] + place[mine] - before[row, column]
        return out


def _grains(batches: Iterator[pa.RecordBatch], grain: int, queues) -> Iterator[pa.RecordBatch]:
    """Cut documents where the round of their grains changes; place the pieces if all queues are known."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        before = batch.column("before").to_numpy(zero_copy_only=False)
        count = batch.column("doc_tokens").to_numpy(zero_copy_only=False)
        quantum = batch.column("quantum").to_numpy(zero_copy_only=False)
        first, last = before // grain, (before + count - 1) // grain
        grains = last - first + 1
        row = np.repeat(np.arange(n), grains)
        k = np.arange(len(row)) - np.repeat(np.cumsum(grains) - grains, grains) + first[row]
        turn = _turn(k, grain, quantum[row])
        opens = np.ones(len(row), bool)
        opens[1:] = (row[1:] != row[:-1]) | (turn[1:] != turn[:-1])
        at, owner = np.flatnonzero(opens), row[opens]
        start = np.maximum(k[at] * grain - before[owner], 0)
        follows = np.append(owner[1:] == owner[:-1], False)
        stop = np.where(follows, np.append(start[1:], 0), count[owner])
        ids = batch.column("ids").cast(pa.large_binary())
        offsets = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + n + 1]
        data = ids.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
        cuts = np.append(offsets[owner] - offsets[0] + 4 * start, offsets[-1] - offsets[0]).astype(np.int32)
        sliced = pa.Array.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer(cuts), data])
        index = pa.array(owner)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(index), batch.column("source").take(index), pa.array(turn[at]),
             pa.array(before[owner] + start), pa.array(start), pa.array(stop - start),
             batch.column("doc_tokens").take(index), sliced, batch.column("rank").take(index),
             pa.array(queues.value.offsets(turn[at], batch.column("rank").to_numpy(zero_copy_only=False)[owner], before[owner] + start))
             if queues else pa.nulls(len(owner), pa.int64())],
            names=["doc_id", "source", "turn", "place", "start", "length", "doc_tokens", "ids", "rank", "before"],
        )


def pack(
    docs: DataFrame, vocabulary: str, pattern: str, weights: DataFrame | None = None,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    window: int = WINDOW, grain: int = GRAIN, end: int = END, most_queues: int = MOST_QUEUES, added: Mapping[str, int] | None = None,
    cache: int = CACHE,
) -> DataFrame:
    """Pieces of sequences: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    ``vocabulary`` names a file of token ranks, ``added`` strings that are one id each,
    and ``cache`` is how many word parts a Python worker keeps encoded.  ``weights`` (source, weight) are the target token
    proportions; by default each source's own share, so that every window mirrors the whole and all
    queues run dry together.  A source with a positive weight earns weight / sum of weights of a
    window per round; when a queue is empty the others fill the windows.  Sequences are full but
    for the last one.  Null texts are a single end token; null sources form one queue; repeated
    rows are packed as often as they occur; an empty table gives no pieces.
    """
    prepare(docs.sparkSession)
    kinds = dict(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source")).dtypes)
    lead = f"doc_id {kinds['doc_id']}, source {kinds['source']}"
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    encoded = texts.mapInArrow(
        lambda it: _encode(it, vocabulary, pattern, added, end, cache), f"{lead}, ids binary, doc_tokens long"
    )
    streams = running_totals(encoded, "doc_tokens", "source", "tokens")
    totals = streams.groupBy("source").agg(F.sum("doc_tokens").alias("tokens"))
    if weights is not None:
        given = weights.groupBy(F.col("source").alias("named")).agg(F.sum("weight").cast("double").alias("weight"))
        totals = totals.join(given, F.col("source").eqNullSafe(F.col("named")), "left")
        if totals.where("weight is null or weight <= 0").limit(1).count():
            raise ValueError("every source needs a positive weight")
    else:
        totals = totals.withColumn("weight", F.col("tokens").cast("double"))
    all_weight = totals.agg(F.sum("weight")).first()[0] or 1.0
    # the quantum of a source is its share of a window
    quanta = stored(
        totals.select(
            F.col("source").alias("queue"), (F.col("weight") / all_weight * window).alias("quantum"), "tokens",
            (F.row_number().over(Window.orderBy(F.asc_nulls_first("source"))) - 1).cast("long").alias("rank"),
        ),
        "queues",
    )
    few = quanta.count() <= most_queues
    queues = None
    if few:
        known = quanta.drop("queue").toPandas()
        queues = docs.sparkSession.sparkContext.broadcast(
            Queues(known["rank"].to_numpy(), known["quantum"].to_numpy(), known["tokens"].to_numpy(), grain)
        )
    earned = streams.join(F.broadcast(quanta) if few else quanta, F.col("source").eqNullSafe(F.col("queue")))
    pieces = earned.select("doc_id", "source", "ids", "doc_tokens", "before", "quantum", "rank").mapInArrow(
        lambda it: _grains(it, grain, queues),
        f"{lead}, turn long, place long, start long, length long, doc_tokens long, ids binary, rank long, before long",
    )
    if few:
        placed = pieces
    else:
        served = ordered(pieces.drop("before"), F.col("turn"), F.col("rank"), F.col("place"))
        placed = running_totals(served, "length", None, "pieces")
    stop = F.col("before") + F.col("length")
    cut = placed.withColumn(
        "sequence_id", F.explode(F.sequence(F.floor(F.col("before") / window), F.floor((stop - 1) / window)))
    )
    begin = F.greatest("before", F.col("sequence_id") * window)
    upto = F.least(stop, (F.col("sequence_id") + 1) * window)
    skipped = begin - F.col("before")
    return cut.select(
        "doc_id", (F.col("start") + skipped).alias("start"), (upto - begin).alias("length"), "doc_tokens",
        "sequence_id", (begin - F.col("sequence_id") * window).alias("offset"), "source",
        F.substring("ids", (4 * skipped + 1).cast("int"), (4 * (upto - begin)).cast("int")).alias("ids"),
    )


def pack_documents(docs: DataFrame, **names) -> DataFrame:
    """``pack`` with the 50k byte-level vocabulary that the machine's public tokenizers provide."""
    import public_tokenizers

    added = added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added=added, **names)


def packing_digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
