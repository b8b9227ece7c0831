"""Best-fit packing: whole documents, gapless sequences, and how few they are."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from tidemill.llm import bestfit

SCHEMA = "doc_id long, text string, length long, ids string, piece string, one int, before string, part int"


def _best_fit_count(lengths, window):
    """One piece at a time, longest first, into the fullest sequence that has room."""
    gaps = []
    for x in sorted(lengths, reverse=True):
        room = [g for g in gaps if g >= x]
        if room:
            gaps.remove(min(room))
            gaps.append(min(room) - x)
        else:
            gaps.append(window - x)
    return len(gaps)


def _held(groups, window):
    out = Counter()
    for g in groups:
        assert g.bins > 0 and sum(x * n for x, n in g.items) <= window
        for x, n in g.items:
            out[x] += n * g.bins
    return out


def test_knapsack_prices_are_the_best():
    lengths, value = np.array([3, 5, 7]), np.array([2.0, 4.0, 5.9])
    best, _ = bestfit.price(lengths, value, 20)
    for c in range(21):
        assert best[c] == pytest.approx(max(
            2.0 * i + 4.0 * j + 5.9 * k for i in range(7) for j in range(5) for k in range(3) if 3 * i + 5 * j + 7 * k <= c
        ))


def test_fractional_solution_never_covers_more_than_asked():
    lengths, demand = np.array([23, 26, 27, 51]), np.array([1200, 600, 600, 600])
    covered = np.zeros(4)
    for config, amount in bestfit.fractional(lengths, demand, 101).items():
        assert sum(lengths[k] * n for k, n in config) <= 101 and amount > 0
        for k, n in config:
            covered[k] += amount * n
    assert (covered <= demand * (1 + 1e-6)).all() and covered.sum() > 0.5 * demand.sum()


@pytest.mark.parametrize("seed", range(6))
def test_every_length_is_held_and_few_sequences_are_used(seed):
    rng = random.Random(seed)
    window = [101, 60, 2048, 2048, 7, 1][seed]
    low, high = [(1, 101), (15, 40), (500, 1100), (1, 2048), (1, 7), (1, 1)][seed]
    lengths = [rng.randint(low, high) for _ in range(600)]
    groups = bestfit.solve(Counter(lengths), window)
    assert _held(groups, window) == Counter(lengths)
    assert sum(g.bins for g in groups) <= 1.01 * _best_fit_count(lengths, window) + 1


def test_configurations_beat_longest_first():
    """Three lengths that fill a sequence exactly, which longest first spoils."""
    histogram = {34: 300, 33: 600, 50: 100, 17: 100}
    lengths = [x for x, n in histogram.items() for _ in range(n)]
    assert sum(g.bins for g in bestfit.solve(histogram, 101)) < _best_fit_count(lengths, 101)


def test_places_of_all_ranks():
    histogram = {5: 7, 3: 11, 2: 40, 10: 2}
    groups = bestfit.solve(histogram, 10)
    plan = bestfit.Plan(groups, 10)
    length = np.repeat(list(histogram), list(histogram.values()))
    rank = np.concatenate([np.arange(n) for n in histogram.values()])
    sequence, offset = plan.place(length, rank)
    used = defaultdict(list)
    for s, o, x in zip(sequence.tolist(), offset.tolist(), length.tolist()):
        used[s].append((o, x))
    assert sorted(used) == list(range(sum(g.bins for g in groups)))
    for pieces in used.values():
        at = 0
        for o, x in sorted(pieces):
            assert o == at
            at += x
        assert at <= 10
    with pytest.raises(ValueError):
        plan.place(np.array([5]), np.array([7]))
    assert bestfit.solve({}, 10) == [] and bestfit.Plan([], 10).total == 0


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["alpha", "beta", "It's", "漢字", "x" * 9, "\n", "  ", "9", "<|endoftext|>"]
    out = [(1, None), (2, ""), (3, " \t"), (None, "no id"), (4, "hi <|endoftext|> x"), (5, "y" * 50_000)]
    out += [(6, "the same row")] * 3 + [(7, "the same id"), (7, "another text")]
    out += [(10 + k, " ".join(rng.choice(words) for _ in range(rng.choice([3, 40, 300, 2500, 9000])))) for k in range(60)]
    return [(i, t, 1, "i", "p", 2, "b", 3) for i, t in out]


def test_best_fit_documents(spark, texts):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    expected, total, lengths = Counter(), 0, []
    for doc, text, *_ in texts:
        ids = np.array(encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        head = len(ids) % 2048 or 2048
        for k, (a, b) in enumerate(zip([0, *range(head, len(ids), 2048)], [*range(head, len(ids), 2048), len(ids)])):
            expected[doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
            lengths.append(b - a)
        total += len(ids)
    docs = spark.createDataFrame(texts, SCHEMA).repartition(3)
    found = bestfit.best_fit_digest(bestfit.best_fit_documents(docs)).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == expected
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert -(-total // 2048) <= len(sequences) <= _best_fit_count(lengths, 2048) + 1


def test_empty_table(spark):
    assert bestfit.best_fit_documents(spark.createDataFrame([], SCHEMA)).count() == 0
