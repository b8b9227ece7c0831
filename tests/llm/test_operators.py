"""Every operator on awkward rows, against plain versions of the same rules."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import public_tokenizers
from tidemill.llm import chat, exact_dedup, fingerprints, graph, language, licenses, mixing, near_dedup, packing, sharding, tokens, toxicity

SPACE = re.compile("[\x20\x09-\x0d]")
WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, key string, row int, part string, label string"
NOTICE = "Licensed under the Apache License, Version 2.0."


def _text(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "Gamma", "delta", "eps", "zeta", "ete", "theta"]) + str(rng.randrange(60)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = _text(rng, 120)
    words = base.split()
    out = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n\x0b\x0c\r", "en", "a"), (4, "one two", "en", None),
        (5, base, "en", "a"), (6, base.replace(" ", "\n"), "en", "a"), (7, base + "  ", "en", "b"), (None, base, "en", "b"),
        (8, " ".join(words[:100] + ["new"] * 2 + words[102:]), "en", "b"), (9, " ".join(words[:70] + words[90:]), "de", "b"),
        (10, _text(rng, 30_000), "en", "c"), (11, "ünï 漢字 \U0001f600 it's <|endoftext|> x y  z  ", "fr", "c"),
        (12, f"{_text(rng, 9)} {NOTICE} {_text(rng, 9)}", "en", "c"), (12, _text(rng, 50), "en", "c"), (12, _text(rng, 50).upper(), None, "c"),
        (13, "same text again", "en", "d"), (13, "same text again", "en", "d"), (14, "x" * 5000, "en", "d"),
    ]
    out += [(20 + k, _text(rng, 5 + 7 * k), "en", "abcd"[k % 4]) for k in range(20)]
    return [(*r, None, "u", "k", 1, None, "l") for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, rows, empty):
    groups = defaultdict(list)
    for r in rows:
        groups[hashlib.sha256(SPACE.sub("", r[1] or "").encode()).hexdigest()].append(r)
    for share in (4096, 4):  # ordinary groups, then map-side ones
        found = exact_dedup.mark_copies(docs, share=share).collect()
        assert len(found) == len(rows)
        for digest, members in groups.items():
            got = [f for f in found if f["text_sha256"] == digest]
            best = min(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
            assert len(got) == len(members) and sum(f["kept"] for f in got) == 1
            assert all(f["keep_id"] == best[0] and f["group_size"] == len(members) for f in got)
            assert [f["doc_id"] for f in got if f["kept"]] == [best[0]]
        kept = exact_dedup.drop_copies(docs, share=share)
        assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.mark_copies(empty).count() == 0 and exact_dedup.drop_copies(empty).count() == 0


def _sets(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def test_near_dedup(docs, rows, empty):
    sets = [_sets(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    expected = Counter()
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        expected[r[0], len(sets[i]), min(ids) if sets[i] and ids else r[0]] += 1
    # all components named by the broadcast, none, and those above the default share
    for heavy in (10**6, 0, near_dedup.HEAVY):
        found = near_dedup.near_components(docs, heavy=heavy).collect()
        assert Counter((f["doc_id"], f["n_shingles"], f["component_id"]) for f in found) == expected
    kept = near_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({find(i) for i in range(len(rows)) if sets[i]}) + sum(not s for s in sets)
    assert near_dedup.near_components(empty).count() == 0


def test_pairs_beyond_the_pivot_are_found(spark):
    """A chain of near copies: most links do not touch the bucket's pivot."""
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    texts = []
    for k in range(24):
        texts.append((k, " ".join(words)))
        for _ in range(4):
            words[rng.randrange(400)] = f"n{rng.randrange(10**6)}"
    found = near_dedup.near_components(spark.createDataFrame(texts, "doc_id long, text string"), block=4).collect()
    assert {f["component_id"] for f in found} == {0}


def test_least_matches_keeps_the_miss_probability():
    for n, least in near_dedup.least_matches(0.75, 1e-5, 256, 32):
        below = sum(math.comb(n + 1, m) * 0.75**m * 0.25 ** (n + 1 - m) for m in range(least))
        assert below < 1e-5 <= below + math.comb(n + 1, least) * 0.75**least * 0.25 ** (n + 1 - least)


def test_components_of_long_paths(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40) if k != 20] + [(7, 3)], "a long, b long")
    found = {r["node"]: r["root"] for r in graph.components(links).collect()}
    assert found == {k: 0 if k <= 20 else 21 for k in range(41)}


def test_mixing(docs, rows, empty):
    found = mixing.mix_report(docs).collect()
    size = lambda t: len(WORD.findall(t or ""))
    names = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    sizes = {s: sum(size(r[1]) for r in rows if r[3] == s) for s in names}
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 3 * sizes[s] <= level * weight[s]}
        if not full:
            break
        target.update({s: 3.0 * sizes[s] for s in full})
        left -= sum(3 * sizes[s] for s in full)
        open_ -= full
    target.update({s: level * weight[s] for s in open_})
    assert Counter((f["doc_id"], f["size"], f["source_size"]) for f in found) == Counter((r[0], size(r[1]), sizes[r[3]]) for r in rows)
    by_size = {v: k for k, v in sizes.items()}
    taken = Counter()
    for f in found:
        s = by_size[f["source_size"]]
        assert math.isclose(f["target"], target[s]) and f["taken"] <= 3 * f["size"]
        taken[s] += f["taken"]
    longest = {s: max(size(r[1]) for r in rows if r[3] == s) for s in names}
    assert sum(taken.values()) <= sum(sizes.values())
    assert all(target[s] - taken[s] <= max(longest.values()) for s in names)
    again = mixing.mix_report(docs.repartition(7)).collect()
    assert Counter(map(tuple, found)) == Counter(map(tuple, again))
    assert mixing.mix_documents(docs).columns == docs.columns
    assert mixing.mix_documents(docs).count() == sum(f["taken"] // f["size"] for f in found if f["size"])
    assert mixing.mix_report(empty).count() == 0 and mixing.mix_documents(empty).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_tokens_equal_the_library(rows, tokenizer):
    added = tokens.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    encode = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added).encode
    rng = random.Random(2)
    pieces = ["a", "It's", " ", "  ", "\n", "\t", " ", " ", "\x1c", "9", "é", "漢", "!", "<|endoftext|>", "_", "́", "²"]
    texts = [r[1] or "" for r in rows] + ["".join(rng.choice(pieces) for _ in range(rng.randrange(30))) for _ in range(800)]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("most", [4096, 1])
def test_packing(docs, rows, empty, tokenizer, most):
    ids = [tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1] for r in rows]
    found = packing.pack_documents(docs, most_queues=most).collect()
    place = lambda f: f["sequence_id"] * 2048 + f["offset"]
    found.sort(key=place)
    at = 0
    for f in found:
        assert place(f) == at and f["offset"] + f["length"] <= 2048
        at += f["length"]
    assert at == sum(map(len, ids))
    pieces = Counter((f["doc_id"], f["start"], bytes(f["ids"])) for f in found)
    whole = defaultdict(list)
    for (doc, start, data), n in pieces.items():
        whole[doc] += [(start, data)] * n
    for doc in whole:
        assert Counter(np.concatenate([np.frombuffer(d, "<u4") for _, d in whole[doc]]).tolist()) == Counter(sum((i for r, i in zip(rows, ids) if r[0] == doc), []))
    for f in packing.packing_digest(packing.pack_documents(docs, most_queues=most)).collect():
        text_ids = [i for r, i in zip(rows, ids) if r[0] == f["doc_id"]]
        cut = [zlib.crc32(np.array(i[f["start"] : f["start"] + f["length"]], "<u4").tobytes()) for i in text_ids if len(i) == f["doc_tokens"]]
        assert f["ids_crc32"] in cut
    total = Counter()
    share = Counter()
    for r, i in zip(rows, ids):
        share[r[3]] += len(i) / at
    for f in found:
        total[f["source"]] += f["length"]
        if f["offset"] + f["length"] == 2048:
            done = (f["sequence_id"] + 1) * 2048
            assert all(abs(total[s] - share[s] * done) <= packing.GRAIN * (1 + len(share) / 2) + 2 for s in share)
    assert packing.pack_documents(empty).count() == 0


def test_toxicity(spark, docs, empty):
    rng = random.Random(3)
    data, labels = [], []
    for k in range(400):
        toxic = k % 4 == 0
        words = _text(rng, 40).split()
        if toxic:
            words[10] = words[30] = "scumbag"
        data.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    labelled = spark.createDataFrame(labels + [(None, 1), (5, None), (1, 0)], "doc_id long, toxic int")
    table = spark.createDataFrame(data, "doc_id long, text string")
    found = {r["doc_id"]: r for r in toxicity.toxicity_scores(table, labelled).collect()}
    for k, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) and r["predicted"] == int(k % 4 == 0) and 0 <= r["score"] <= 1
    model = toxicity.fit_toxicity(table, labelled)
    scored = model.score(docs.selectExpr("doc_id as key", "text"))
    assert scored.count() == docs.count() and scored.where("score is null").count() == 0
    assert toxicity.drop_toxic(table, labelled).count() == 300
    assert toxicity.toxicity_scores(empty, labelled).count() == 0
    unknown = toxicity.toxicity_scores(docs, labelled.where("toxic = 0")).collect()
    assert {r["score"] for r in unknown} == {0.5} and len(unknown) == docs.count()


def test_toxicity_threshold_does_not_depend_on_the_sample(spark):
    """One table, sampled to about 1:9 and to about 1:1."""
    rng = random.Random(12)
    data, labels = [], []
    for k in range(6000):
        words = _text(rng, 12).split()
        if rng.random() < (0.7 if k % 10 == 0 else 0.05):
            words[5] = "scumbag"
        data.append((k, " ".join(words)))
        labels.append((k, int(k % 10 == 0)))
    table = spark.createDataFrame(data, "doc_id long, text string")
    labelled = spark.createDataFrame(labels, "doc_id long, toxic int")
    probe = spark.createDataFrame([("no", "alpha1 beta2"), ("yes", "alpha1 scumbag beta2")], "key string, text string")
    logits = []
    for per_class in (8000, 600):
        scores = {r["key"]: r["score"] for r in toxicity.fit_toxicity(table, labelled, per_class).score(probe).collect()}
        logits.append([math.log(scores[k] / (1 - scores[k])) for k in ("no", "yes")])
    assert np.abs(np.subtract(*logits)).max() < 1, logits


def test_language(spark, docs, empty):
    rng = random.Random(4)
    spell = {"xx": ["kra", "tok", "zul"], "yy": ["mio", "lae", "nua"]}
    data = [(k, " ".join("".join(rng.choice(spell[s]) for _ in range(3)) for _ in range(20)), s) for k in range(200) for s in [("xx", "yy")[k % 2]]]
    table = spark.createDataFrame([*data, (900, None, "xx"), (901, "12 !?", "yy"), (902, "kratok", None)], "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in language.identify(table).collect()}
    assert all(found[k]["lang_pred"] == s for k, _, s in data)
    assert found[900]["lang_pred"] == found[901]["lang_pred"] == "und" and found[902]["lang_pred"] == "xx"
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in found.items())
    model = language.LanguageModel.fit(table.select("lang", "text"))
    far = spark.createDataFrame([("f", "qqqq wwww 漢字漢字 qqqq")], "key string, text string")
    assert model.predict(far).first()["rejected"]
    assert language.identify(docs).count() == docs.count() and language.identify(empty).count() == 0
    assert {r["lang_pred"] for r in language.identify(table.where("lang is null")).collect()} == {"und"}


def test_language_sample_counts_distinct_texts(spark):
    """A language with ten texts besides 3990 copies of another keeps all of them."""
    rng = random.Random(13)
    made = lambda kinds: " ".join("".join(rng.choice(kinds) for _ in range(3)) for _ in range(20))
    few = [("xx", made(["kra", "tok", "zul"])) for _ in range(11)]
    many = [("yy", made(["mio", "lae", "nua"])) for _ in range(100)]
    model = language.LanguageModel.fit(spark.createDataFrame(few + few[:1] * 3989 + many, "lang string, text string").repartition(4))
    assert model.names == ["xx", "yy"] and Counter(model.owner.tolist()) == {0: language.CENTROIDS, 1: language.CENTROIDS}


def test_sharding(docs, rows, empty):
    for limits in ({}, {"large": 2, "bundles": 8}):
        found = sharding.shard(docs, shards=4, **limits).collect()
        expected = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
        assert Counter((f["doc_id"], f["size"], f["text_crc32"]) for f in found) == expected
        where = defaultdict(set)
        for f in found:
            if f["size"] > 8:
                where[f["text_crc32"]].add(f["shard"])
        assert all(len(s) == 1 for s in where.values())
        for s in range(4):
            slots = sorted(f["slot"] for f in found if f["shard"] == s)
            assert slots == list(range(len(slots)))
    assert sharding.longest_first([("a", 7), ("b", 6), ("c", 5), ("d", 4)], 2) == {"a": 0, "b": 1, "c": 1, "d": 0}
    assert sharding.shard(empty).count() == 0


def test_fingerprints(spark, empty):
    rng = random.Random(6)
    data = [(k, _text(rng, 150)) for k in range(12)] + [(50, "same words here"), (51, "same words here"), (60, None), (61, "ab")]
    table = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    found = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(table, bits=16).collect()}
    order = sorted(data, reverse=True)
    for (doc, text), (_, following) in zip(order, order[1:] + order[:1]):
        text, following = text or "", following or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        assert found[doc]["n_chars"] == len(text) and found[doc]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= found[doc]["near_edited"] <= 1 and 0 <= found[doc]["near_next"] <= 1
    assert found[50]["fingerprint"] == found[51]["fingerprint"] and found[51]["near_next"] == 1
    assert len({found[k]["fingerprint"] for k in range(12)}) == 12
    assert np.mean([found[k]["near_edited"] for k in range(12)]) > np.mean([found[k]["near_next"] for k in range(12)])
    one = fingerprints.fingerprint_documents(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string"), bits=16).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()
    assert fingerprints.fingerprint_documents(empty, bits=16).count() == 0


def _prints(terms, subsets=32):
    """Size class, and per (step, subset) the sorted terms of a text that belong to the subset, hashed together."""
    mixed = lambda x: int(fingerprints.mix(np.array([x & 2**64 - 1], np.uint64))[0])
    size = round(math.log2(max(len(terms), 1)))
    table = []
    for j in range(3):
        for k in range(subsets):
            drawn = [mixed(t ^ int(fingerprints._SEEDS[k])) for t in sorted(terms)]
            inside = [d for d in drawn if d % 2 ** (size + j) == 0]
            table.append(max(sum(mixed(d + k) for d in inside) % 2**64 >> 48, 1) if inside else 0)
    return size, table


def _alike(a, b):
    pairs = [(x, y) for i in range(3) for j in range(3) if a[0] + i == b[0] + j for x, y in zip(a[1][32 * i : 32 * i + 32], b[1][32 * j : 32 * j + 32])]
    return 1.0 if a == b else sum(x == y != 0 for x, y in pairs) / max(sum(x != 0 or y != 0 for x, y in pairs), 1)


def test_fingerprints_equal_a_plain_version(docs, rows):
    """Prints and likeness on the awkward rows: null ids, very long texts, repeated rows, extra columns."""
    word_hash = lambda w: int(fingerprints.Words(fingerprints.pa.array([w])).hashes[0])
    sets = [{word_hash(w.lower()) for w in set(WORD.findall(r[1] or ""))} for r in rows]
    distinct = {r[1] or "": s for r, s in zip(rows, sets)}
    frequency = Counter(t >> 40 for s in distinct.values() for t in s)
    band = {c for c, n in frequency.items() if n <= max(0.1 * len(distinct), 1)}

    def terms(text):
        found = {word_hash(w.lower()) for w in set(WORD.findall(text))}
        known = {t for t in found if t >> 40 in band}
        return known | set(sorted(found - known)[: max(fingerprints.LEAST_TERMS - len(known), 0)])

    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    found = fingerprints.fingerprint_documents(docs).collect()
    assert len(found) == len(rows)
    alone = [r for r in order if sum(x[0] == r[0] for x in rows) == 1]
    for r in alone:
        got = next(f for f in found if f["doc_id"] == r[0])
        text, at = r[1] or "", order.index(r)
        plain = _prints(terms(text))
        assert got["fingerprint"] == bytes([plain[0]]).hex() + "".join(f"{x:04x}" for x in plain[1])
        after = order[(at + 1) % len(order)]
        if sum(x[0] == after[0] for x in rows) == 1:
            following, cut = after[1] or "", len(text) // 3
            assert got["near_next"] == pytest.approx(_alike(plain, _prints(terms(following))))
            assert got["near_edited"] == pytest.approx(_alike(plain, _prints(terms(text[: len(text) - cut] + following[:cut]))))


def test_fingerprints_with_a_third_of_copies(spark):
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(1500)}"
    hot = " ".join(f"hot{k}" for k in range(90))
    plain = [" ".join(word() for _ in range(90)) for _ in range(80)]
    data = [(k, hot if k % 3 == 0 else plain[k - k // 3 - 1]) for k in range(120)]
    table = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(table, bits=20).collect()}
    edited = [found[k]["near_edited"] for k in range(3, 120, 3)]
    assert min(edited) > 0.2 and abs(np.mean(edited) - 0.5) < 0.15
    assert max(found[k]["near_next"] for k in range(3, 120, 3)) < 0.1
    once = fingerprints.lexicon(table.select("text").distinct(), bits=20)
    frequency = Counter(w for t in {hot, *plain} for w in set(t.split()))
    inside = sum(n <= 8.1 for n in frequency.values())
    assert abs(int(np.unpackbits(once).sum()) - inside) <= 3  # terms in one counter
    twice = table.unionAll(table.where("doc_id % 5 = 0"))
    for most in (fingerprints.MOST_REPEATED, 1):
        assert (fingerprints.lexicon(twice.select("text"), bits=20, most_repeated=most) == once).all()


def test_licenses(docs, rows, empty):
    found = {(r["doc_id"], r["license_id"]): r for r in licenses.scan_licenses(docs).collect()}
    assert set(found) == {(12, "Apache-2.0")} and found[12, "Apache-2.0"]["containment"] == 1 and found[12, "Apache-2.0"]["first_word"] == 9
    known = licenses.Templates(licenses.TEMPLATES | licenses.FULL_TEXTS)
    for name, held in zip(known.names, known.sets):
        half, shared = licenses.half_window(len(held)), math.ceil(0.75 * len(held))
        assert half >= 1.25 * len(held) and (1 - shared / (2 * half + len(held) - shared)) ** known.bands <= 1e-5, name
    assert licenses.scan_licenses(empty).count() == 0 and licenses.scan_licenses(docs, {}).count() == 0


def test_licenses_in_other_punctuation(spark):
    """Short lines, other marks at word edges and comment prefixes, against containment by brute force."""
    rng = random.Random(8)
    strip = lambda w: re.sub("^[^0-9a-z]+|[^0-9a-z]+$", "", w.lower())
    known = licenses.TEMPLATES | licenses.FULL_TEXTS | licenses.SHORT_TEMPLATES
    data, planted = [], []
    for name, notice in known.items():
        bare = notice.rstrip(".:")
        half = len(bare.split()) // 2
        wrapped = "\n# ".join([" ".join(bare.split()[:half]), " ".join(bare.split()[half:])])
        forms = [notice, bare, bare + ",", f"({bare})", f"\u201c{bare}\u201d", bare.upper() + "!", f"# {wrapped}\n", f"// {bare} */", f"{bare} \u2014"]
        for form in forms:
            planted.append((len(data), name))
            data.append((len(data), f"{_text(rng, rng.randrange(12))} {form} {_text(rng, rng.randrange(12))}"))
    data += [(1000, "all rights are reserved"), (1001, "rights reserved."), (1002, "All rights reserved"), (1003, "# -- ."), (1004, "all - rights, reserved")]
    found = {(r["doc_id"], r["license_id"]): r for r in licenses.scan_licenses(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert set(planted) <= set(found)
    sets = {}
    for name, notice in known.items():
        words = [strip(w) for w in notice.split()]
        sets[name] = {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))}
    expected = set()
    for doc, text in data:
        words = [strip(w) for w in WORD.findall(text) if strip(w)]
        for name, wanted in sets.items():
            n = len(next(iter(wanted)))
            held = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
            if 100 * len(held & wanted) >= licenses.PERCENT * len(wanted):
                expected.add((doc, name))
    assert set(found) == expected
    row = found[1002, "all-rights-reserved-line"]
    assert row["first_word"] == 0 and row["containment"] == 1 and (1004, "all-rights-reserved-line") in found
    for doc, text in data[:-5]:
        words = [strip(w) for w in WORD.findall(text)]
        for name in known:
            if (doc, name) in found and found[doc, name]["containment"] == 1:
                assert words[found[doc, name]["first_word"]] == strip(known[name].split()[0])


def test_edited_licence_texts(spark):
    """Whole licence texts with words replaced, added and left out, inside long texts: found by bands as by brute force."""
    rng = random.Random(15)
    strip = lambda w: re.sub("^[^0-9a-z]+|[^0-9a-z]+$", "", w.lower())
    shingles = lambda words: {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    wanted = {n: shingles([strip(w) for w in t.split()]) for n, t in licenses.FULL_TEXTS.items()}
    data, expected = [], {}
    for name, text in licenses.FULL_TEXTS.items():
        for edits in (0, 1, 2, 4, 6, 8, 12, 30):
            for _ in range(4):
                words = text.split()
                for _ in range(edits):
                    at = rng.randrange(len(words))
                    words[at : at + rng.randrange(2)] = [f"w{rng.randrange(10**6)}"] * rng.randrange(2)
                body = f"{_text(rng, rng.randrange(3000))} {' '.join(words)} {_text(rng, rng.randrange(300))}"
                held = shingles([strip(w) for w in body.split() if strip(w)])
                for n, known in wanted.items():
                    if 100 * len(held & known) >= 75 * len(known):
                        expected[len(data), n] = len(held & known) / len(known)
                data.append((len(data), body))
    found = {(r["doc_id"], r["license_id"]): r["containment"] for r in licenses.scan_licenses(spark.createDataFrame(data, "doc_id long, text string"), licenses.FULL_TEXTS).collect()}
    assert found == pytest.approx(expected)
    assert len(expected) > 80 and min(expected.values()) < 0.85 and len({d for d, _ in expected}) < len(data)


def test_licence_windows_of_many_texts_and_levels():
    """Windows never span texts, and every level's minima are those of the shingles themselves."""
    rng = np.random.default_rng(2)
    bounds = np.append(0, np.cumsum([0, 1, 37, 2, 0, 300, 5]))
    hashes = rng.integers(0, 2**63, bounds[-1], dtype=np.uint64)
    least = hashes
    for half, first, doc, place in licenses._levels(bounds, [2, 64]):
        least = np.minimum.reduceat(least, place)
        assert (least == [hashes[f : min(f + half, bounds[d + 1])].min() for f, d in zip(first, doc)]).all()
    assert half == 64


def test_chat(spark):
    rng = random.Random(7)
    data = [(1, 0, "system", "Be brief."), (2, None, "user", None), (2, 0, None, "<|x <\\| \\ <|im_end|>"), (None, 1, "assistant", "a"), (None, 1, "assistant", "a")]
    data += [(1, 1 + k, ("user", "assistant")[k % 2], _text(rng, rng.choice([3, 40, 900]))) for k in range(300)]
    data += [(3, 0, "assistant\n<|im_start|>\\n", "odd role")]
    table = spark.createDataFrame([(*r, "extra") for r in data], "conv_id long, turn long, role string, text string, span string")
    made = chat.windows(table).collect()
    got = {r["conv_id"]: r for r in chat.read_back(chat.windows(table)).collect()}
    for conv in (1, 2, 3, None):
        turns = sorted((r for r in data if r[0] == conv), key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or ""))
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        plain = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        assert got[conv]["n_turns"] == len(turns) and got[conv]["turns_sha256"] == hashlib.sha256(plain.encode()).hexdigest()
        assert got[conv]["loss_chars"] == len(loss) and got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    for w in (w for w in made if w["conv_id"] == 1):
        turns = w["formatted"].split("<|im_start|>")[1:]
        sizes = [math.ceil(len(t.split("\n", 1)[1].removesuffix("<|im_end|>\n").encode()) / 4) + 4 for t in turns]
        assert turns[0].startswith("system\nBe brief.") and (sum(sizes) <= chat.BUDGET or len(turns) - w["repeated"] == 1)
        assert sum(sizes[1 : w["repeated"]]) <= chat.HISTORY
    assert sum(w["repeated"] for w in made if w["conv_id"] == 1) > len([w for w in made if w["conv_id"] == 1])
    assert chat.read_back(chat.windows(table.where("false"))).count() == 0


def test_pipeline(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, folder), f"test-{name}")
        assert docs.columns == columns
        seen.append(docs.count())
    assert seen[0] >= seen[1] > seen[2] >= seen[3] > 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert pieces.count() == corpus_pipeline.run(spark, folder).count() > 0
