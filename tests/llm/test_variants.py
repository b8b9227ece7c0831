"""Spelling variants against plain versions of the same rules."""

import random
import re
import zlib
from collections import Counter

import pytest

from tidemill.llm import variants


def _near(a, b):
    """One inserted, deleted or replaced code point apart."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def _grouped(words, ratio=5, least=6):
    n = {w: c for w, c in words.items() if w is not None and len(w) >= least}
    out, form = {}, {}
    for w in n:
        near = [v for v in n if _near(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
        out[w] = (form[w], len(near), n[form[w]] if form[w] else None)
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (out[w][0], root, n[w], *out[w][1:])
    return out


@pytest.fixture(scope="module")
def words():
    rng = random.Random(4)
    out = {"abcdef": 1000, "bcdefg": 40, "abcde": 900, "x" * 3000: 50, "x" * 2999: 2, "x" * 3001: 9}
    stems = ["".join(rng.choice("abcdeéß×") for _ in range(rng.randint(6, 12))) for _ in range(60)] + ["prefix" + "".join(rng.choice("ab") for _ in range(6)) for _ in range(40)]
    for w in stems:
        out[w] = rng.choice([1, 30, 30, 900, 40_000])
        for _ in range(6):
            k = rng.randrange(len(w) + 1)
            v = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abçz") + w[k:], w[:k] + rng.choice("abçz") + w[k + 1 :]])
            out.setdefault(v, rng.choice([1, 5, 6, 30, 150]))
    return out


@pytest.mark.parametrize("tile", [4096, 7])
def test_groups_equal_the_plain_version(spark, words, tile):
    rows = [(w, n, "b", 1, "r") for w, n in words.items()] + [(None, 7, "b", 1, "r")]
    table = spark.createDataFrame(rows, "word string, n long, best string, part int, root string").repartition(3)
    found = variants.group_variants(table, tile_words=tile).collect()
    expected = _grouped(words)
    assert len(found) == len(expected)
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found} == expected
    assert sum(v[0] is not None for v in expected.values()) > 100 and any(v[1] != v[0] for v in expected.values() if v[0])


def test_words_of_documents(spark):
    run = "[A-Za-zÀ-ÿ]+"
    rng = random.Random(8)
    vocabulary = ["Straße", "straße", "ÀÉÎõü÷", "Réseaux", "abcdefg", "ABCDEFg", "short", "niño", "letterletter", "x" * 70]
    texts = [(1, None), (2, ""), (None, "abcdefg abcdefg"), (3, "abc_defghi abcdefgh1abcdefg"), (4, "日本abcdefg日本")]
    texts += [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 9, 40])))) for k in range(10, 300)] * 2
    expected = Counter()
    for doc, text in texts:
        for w in re.findall(run, text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 7 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            expected[w] += 1
    docs = spark.createDataFrame([(d, t, 1, "w") for d, t in texts], "doc_id long, text string, n int, word string").repartition(4)
    found = {r["word"]: r["n"] for r in variants.count_words(docs, damaged=7).collect()}
    assert found == {w: n for w, n in expected.items() if len(w) >= 6 and n >= 5} and "letteletter" in found
    assert variants.count_words(docs).where("word = 'letteletter'").count() == 0


def test_a_long_text_is_read_in_parts(spark, monkeypatch):
    batch = __import__("pyarrow").RecordBatch.from_pydict({"doc_id": [1], "text": ["abcdef ghijkl " * 50]})
    monkeypatch.setattr(variants, "READ_RUNS", 7)
    monkeypatch.setattr(variants, "HELD_WORDS", 1)
    total = Counter()
    for part in variants._count(iter([batch]), 6, None):
        total.update(dict(zip(part.column("word").to_pylist(), part.column("n").to_pylist())))
    assert total == {"abcdef": 50, "ghijkl": 50}


def test_empty_tables(spark):
    assert variants.group_variants(spark.createDataFrame([], "word string, n long")).count() == 0
    assert variants.document_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
