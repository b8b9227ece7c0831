"""The prefix trie against a plain version, and its parts."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemill.llm import scans, trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, part string, last string"


def _md5(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def _turns(rows):
    out = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            out[conv].append((turn is not None, turn or 0, _md5(role or "", text or ""), role or "", text or ""))
    return {c: [t[3:] for t in sorted(v)] for c, v in out.items()}


def _opened(turns):
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = turns.get(c - c % 100, [])[:h] + own[h:]
    return out


def _trie(turns):
    members = defaultdict(list)
    for c, listed in turns.items():
        for d in range(len(listed) + 1):
            members[tuple(listed[:d])].append(c)
    out = Counter()
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(m[: len(n)] == n and len(m) == len(n) + 1 for m in below)]
        ends = sorted(c for c in convs if len(turns[c]) == len(node))
        out[
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children), len(leaves),
            sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ] += 1
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    out = []
    for c in [*range(0, 40), *range(100, 130), 207, 305, 306]:
        for t in range(rng.choice([1, 1, 3, 6, 9])):
            out.append((c, rng.choice([t, t, None, 2]), rng.choice(["user", "assistant", None, "a:b"]), rng.choice(["hi", "", None, "é" * 9, "z:1"])))
    out += [(50 + k, t, "user", f"line {t}") for k in range(12) for t in range(4)]  # equal conversations
    out += [(90, t, "user", "again") for t in range(70)] + [(91, t, "user", "again") for t in range(66)] + [(92, 0, "user", "again")] * 40
    out += [(None, 1, "user", "no conversation"), (300, 0, "system", "x" * 100_000)]
    return [(*r, 1, "p", "l") for r in out]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def _found(df):
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("height", [8, 2])
def test_trie_equals_the_plain_version(table, rows, height):
    assert _found(trie.conversation_trie(table, height)) == _trie(_turns(rows))


@pytest.mark.parametrize("height", [8, 3])
def test_shared_openings(table, rows, height):
    opened = _opened(_turns(rows))
    assert any(not t for t in opened.values()) and any(t != _turns(rows)[c] for c, t in opened.items())
    assert _found(trie.opening_trie(table, height=height)) == _trie(opened)


def test_ids_of_a_node_are_joined_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie, "ID_BLOCK", 4)
    ids = [-9, -1, 0, 3, 4, 5, 11, 1000]
    found = trie.conversation_trie(spark.createDataFrame([(c, 0, "user", "hi") for c in ids], "conv_id long, turn long, role string, text string"))
    expected = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert expected in {r["ends_sha256"] for r in found.collect()}


def test_ranks_and_running_values_cross_partitions(spark):
    rows = [(1, k, 3 * k + 1) for k in range(500)] + [(2, k, k) for k in range(3)] + [(3, 7, 5)] * 200
    table = spark.createDataFrame(rows, "g long, k long, x long").repartition(7)
    found = scans.scan(table, "g", [F.col("k")], ["x"]).collect()
    for g in (1, 2, 3):
        upto, listed = 0, sorted((r["place"], r["x"]) for r in found if r["g"] == g)
        for at, (_, _, x) in enumerate(sorted(r for r in rows if r[0] == g)):
            upto ^= x
            assert listed[at] == (at, upto)


def test_heavy_keys_join_without_a_shuffle_of_their_rows(spark):
    left = spark.createDataFrame([(1,)] * 5000 + [(k,) for k in range(2, 60)] + [(None,)], "k long")
    right = spark.createDataFrame([(1, "one", 5000)] + [(k, str(k), 1) for k in range(2, 50)], "id long, name string, weight long")
    for rows in (5059, 10**9):
        found = Counter(map(tuple, scans.join_heavy(left, right, {"k": "id"}, "weight", rows).select("k", "name").collect()))
        assert found == Counter({(1, "one"): 5000, (None, None): 1, **{(k, str(k) if k < 50 else None): 1 for k in range(2, 60)}})


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trie.conversation_trie(empty).count() == 0 and trie.opening_trie(empty).count() == 0
