"""K-means with several starts at once: one job over the data per step.

Starts are seeded from all rows.  Every round draws, for each start, a few rows with probability
proportional to their squared distance from what the start has drawn before; the draw is a race
(each row's key is the logarithm of a hash-based number over its weight, the largest keys win), so
a round is one pass and needs no total first.  The candidates, weighted by the rows nearest to them,
are reduced to k centres on the driver, and Lloyd's iterations follow.  Tasks add up their rows per
start and cluster, so the driver receives starts x clusters rows whatever the size of the data.

There are some hundred passes, so the rows are packed once: blocks of numbers, kept in as many
partitions as their size (and the cores) ask for, however many the shuffle before had.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.storagelevel import StorageLevel

from tidemill.plans.session import ship_package

#: Rounds of drawing candidates, and candidates per round and wanted centre.
ROUNDS, OVERSAMPLING = 4, 2
#: Distances that a task holds at a time.
BLOCK = 1 << 21
#: Numbers of a packed block, and of a partition if there are more of them than cores.
PACKED, PART = 1 << 18, 1 << 22
#: Results of tasks come to the driver as they are up to so many rows of 16 numbers; beyond, they are merged by a shuffle first.
DIRECT_ROWS = 100_000


def _pack(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Blocks of rows as bytes: their hashes, weights and coordinates."""
    step = max(1, PACKED // (width + 2))
    for batch in batches:
        hashes, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("hash", "n"))
        x = np.column_stack([batch.column(f"z{i}").to_numpy(zero_copy_only=False) for i in range(width)])
        for at in range(0, len(x), step):
            some = slice(at, at + step)
            yield pa.RecordBatch.from_pydict({"block": [hashes[some].tobytes() + n[some].tobytes() + x[some].tobytes()]})


def _blocks(rows: DataFrame, width: int, count: int) -> RDD:
    """The rows (at most ``count``) packed."""
    context = rows.sparkSession.sparkContext
    parts = max(context.defaultParallelism, -(-count * (width + 2) // PART))
    packed = rows.coalesce(parts).mapInArrow(partial(_pack, width=width), "block binary")
    return packed.rdd.map(lambda r: bytes(r["block"]))


def _points(blocks: Iterator[bytes], width: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes, weights and coordinates, in pieces whose distances to ``most`` centres fit BLOCK."""
    step = max(1, BLOCK // max(1, most))
    for block in blocks:
        size = len(block) // (8 * (width + 2))
        hashes, n = np.frombuffer(block, np.int64, 2 * size).reshape(2, size)
        x = np.frombuffer(block, np.float64, size * width, 16 * size).reshape(size, width)
        for at in range(0, size, step):
            yield hashes[at : at + step], n[at : at + step], x[at : at + step]


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distance = _distances(x, centres)
    member = distance.argmin(axis=1)
    return member, np.maximum(distance[np.arange(len(x)), member], 0)


def _uniform(hashes: np.ndarray, salt: int) -> np.ndarray:
    """A number between 0 and 1 per hash, another one for every salt."""
    x = hashes.view(np.uint64) ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53 + 2.0**-54


def _winners(one: tuple, other: tuple, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of two lots of keys, hashes and rows the ``count`` with the largest keys, in that order."""
    key, names, rows = (np.concatenate(both) for both in zip(one, other))
    first = np.lexsort((names, -key))[:count]
    return key[first], names[first], rows[first]


def _race(blocks: Iterator[bytes], width: int, chosen: list[np.ndarray], count: int, salt: int) -> Iterator[tuple[int, tuple]]:
    """Of a task's rows the ``count`` with the largest keys, for every start."""
    best = [(np.empty(0), np.empty(0, np.int64), np.empty((0, width)))] * len(chosen)
    for hashes, n, x in _points(blocks, width, max(map(len, chosen))):
        for s, centres in enumerate(chosen):
            weight = n * (_nearest(x, centres)[1] if len(centres) else 1.0)
            some = np.flatnonzero(weight > 1e-12)
            key = np.log(_uniform(hashes[some], salt * len(chosen) + s)) / weight[some]
            best[s] = _winners(best[s], (key, hashes[some], x[some]), count)
    yield from enumerate(best)


def _sums(blocks: Iterator[bytes], width: int, starts: list[np.ndarray]) -> Iterator[tuple[int, tuple]]:
    """Rows, cost and coordinate sums of a task per start and nearest centre."""
    centres, ends = np.concatenate(starts), np.cumsum([len(c) for c in starts]).tolist()
    spans = [slice(end - len(c), end) for c, end in zip(starts, ends)]
    n, cost, total = np.zeros(len(centres), np.int64), np.zeros(len(centres)), np.zeros((len(centres), width))
    for _, weight, x in _points(blocks, width, len(centres)):
        distance, each = _distances(x, centres), np.arange(len(x))
        belongs = np.zeros_like(distance)
        for span in spans:
            member = distance[:, span].argmin(axis=1)
            nearest = np.maximum(distance[each, span.start + member], 0)
            n[span] += np.bincount(member, weight, span.stop - span.start).astype(np.int64)
            cost[span] += np.bincount(member, nearest * weight, span.stop - span.start)
            belongs[each, span.start + member] = weight
        total += belongs.T @ x
    for s, span in enumerate(spans):
        yield s, (n[span], cost[span], total[span])


def _added(one: tuple, other: tuple) -> tuple:
    return tuple(a + b for a, b in zip(one, other))


def _reduced(candidates: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k centres of weighted candidates: far-apart ones first, then Lloyd's iterations among the candidates."""
    order = np.lexsort(candidates.T)
    candidates, weight = candidates[order], weight[order].astype(float)
    chosen, far = [], np.ones(len(candidates))
    for _ in range(k):
        mass = weight * far
        mass = mass if mass.sum() > 0 else np.ones(len(candidates))
        chosen.append(int(rng.choice(len(candidates), p=mass / mass.sum())))
        distance = ((candidates - candidates[chosen[-1]]) ** 2).sum(axis=1)
        far = distance if len(chosen) == 1 else np.minimum(far, distance)
    centres = candidates[chosen].copy()
    for _ in range(100):
        member, _ = _nearest(candidates, centres)
        n = np.bincount(member, weight, k)
        moved = centres.copy()
        for i in range(candidates.shape[1]):
            total = np.bincount(member, candidates[:, i] * weight, k)
            moved[n > 0, i] = total[n > 0] / n[n > 0]
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def kmeans(
    rows: DataFrame, count: int, width: int, k: int, starts: int, seed: int, iterations: int = 300, tolerance: float = 1e-4
) -> tuple[np.ndarray, float]:
    """Centres (in the order of their coordinates) and cost of the best start over at most ``count`` distinct rows (hash, n, z0, z1, ...).

    ``n`` counts a row's copies.  Draws depend on the hashes of the rows alone, not on their order or
    partitions.  A start rests when its centres together move at most ``tolerance`` (squared), and
    goes when its centres are those of another; a cluster that loses all rows keeps its centre.
    """
    ship_package(rows.sparkSession)
    blocks = _blocks(rows, width, count).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _best(blocks, width, k, starts, seed, iterations, tolerance)
    finally:
        blocks.unpersist()


def _best(blocks: RDD, width: int, k: int, starts: int, seed: int, iterations: int, tolerance: float) -> tuple[np.ndarray, float]:
    parts = blocks.getNumPartitions()

    def passed(task: Callable, merge: Callable, most: int) -> list[tuple]:
        """Per start what the tasks found, merged; ``most`` rows come from a task."""
        found = blocks.mapPartitions(task)
        if parts * most * width > 16 * DIRECT_ROWS:
            found = found.reduceByKey(merge, min(starts, 64))
        by_start: dict[int, list[tuple]] = {}
        for s, value in found.collect():
            by_start.setdefault(s, []).append(value)
        return [reduce(merge, by_start[s]) for s in sorted(by_start)]

    def drawn(chosen: list[np.ndarray], count: int, salt: int) -> list[np.ndarray]:
        task = partial(_race, width=width, chosen=chosen, count=count, salt=salt)
        # in the order of the race, so that nothing depends on partitions
        won = passed(task, partial(_winners, count=count), starts * count)
        return [np.vstack([c, new]) for c, (_, _, new) in zip(chosen, won)]

    def added(centres: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per start the rows, cost and coordinate sums of its centres."""
        return passed(partial(_sums, width=width, starts=centres), _added, sum(map(len, centres)))

    candidates = drawn([np.empty((0, width))] * starts, 1, seed)
    for r in range(1, ROUNDS + 1):
        candidates = drawn(candidates, OVERSAMPLING * k, seed + r)
    members = [n for n, _, _ in added(candidates)]
    centres = np.stack([_reduced(c, n, k, np.random.default_rng([seed, s])) for s, (c, n) in enumerate(zip(candidates, members))])

    def advance(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        moved, cost = centres[which].copy(), np.zeros(len(which))
        for s, (n, costs, totals) in enumerate(added(list(centres[which]))):
            cost[s] = costs.sum()
            moved[s][n > 0] = totals[n > 0] / n[n > 0, None]
        return moved, cost

    def distinct(which: np.ndarray) -> np.ndarray:
        sets = [centres[s][np.lexsort(centres[s].T[::-1])] for s in which]
        return np.array([s for i, s in enumerate(which) if not any(np.allclose(sets[i], other, atol=1e-6) for other in sets[:i])], int)

    going, resting = distinct(np.arange(starts)), []
    for _ in range(iterations):
        moved, _ = advance(going)
        shift = ((moved - centres[going]) ** 2).sum(axis=(1, 2))
        centres[going] = moved
        resting += going[shift <= tolerance].tolist()
        going = distinct(going[shift > tolerance])
        if not len(going):
            break
    ended = distinct(np.array([*resting, *going], int))
    _, cost = advance(ended)
    best = centres[ended[cost.argmin()]]
    return best[np.lexsort(best.T[::-1])], float(cost.min())
