"""Operators without an SQL form next to plain versions of the same rules, and the stages of the pipeline chained."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import language, sharding, toxicity

MASK = (1 << 64) - 1
WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, key string, gram long, shard int"


def _grams(text, sizes, bits):
    """Hashed ids of all character n-grams, one by one."""
    codes, out = [ord(c) for c in (text or "").lower()], []
    for size in sizes:
        for at in range(len(codes) - size + 1):
            value = size
            for code in codes[at : at + size]:
                value = (value ^ code) * 0x9E3779B97F4A7C15 & MASK
                value ^= value >> 29
            if 0 not in codes[at : at + size]:
                out.append((value * 0xD6E8FEB86659FD93 & MASK) >> (64 - bits))
    return out


def _awkward(rng, spell):
    return [
        (900, None), (901, ""), (902, "12 !? \n"), (None, "kra tok zul"), (903, "ß" * 40), (904, "x\0y kra tok"),
        (905, " ".join(rng.choice(spell) for _ in range(20_000))), (906, "mio lae"), (906, "mio lae"),
    ]


def test_language_equals_a_plain_version(spark):
    rng = random.Random(21)
    spell = {"xx": ["kra", "tok", "zul"], "yy": ["mio", "lae", "nua"], "zz": ["ßer", "üng", "ött"]}
    names = sorted(spell)
    data = [(k, " ".join("".join(rng.choice(spell[names[k % 3]]) for _ in range(3)) for _ in range(15)), names[k % 3]) for k in range(120)]
    data += [(d, t, None) for d, t in _awkward(rng, spell["yy"])]
    table = spark.createDataFrame([(*r, "s", "k", 1, 2) for r in data], SCHEMA).repartition(4)
    trained = [t for d, t, lang in data if lang and zlib.crc32(str(d).encode()) % 4 != 2]
    seen = Counter(g for t in set(trained) for g in set(_grams(t, language.SIZES, language.BITS)))
    idf = [math.log((len(set(trained)) + 1) / (seen[g] + 1)) + 0.1 for g in range(1 << language.BITS)]
    model = language.LanguageModel.fit(table.where("not (pmod(crc32(cast(coalesce(cast(doc_id as string), '') as binary)), 4) = 2)").select("lang", "text"))
    np.testing.assert_allclose(model.idf, idf, rtol=1e-5)
    found = Counter()
    for r in language.identify(table).collect():
        found[r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 2), r["rejected"]] += 1
    expected = Counter()
    for doc, text, _ in data:
        held_out = zlib.crc32(("" if doc is None else str(doc)).encode()) % 4 == 2
        if not any(c.isalpha() for c in text or ""):
            expected[doc, held_out, "und", 0.0, True] += 1
            continue
        vector = {g: math.log1p(n) * idf[g] for g, n in Counter(_grams(text, language.SIZES, language.BITS)).items()}
        norm = math.sqrt(sum(v * v for v in vector.values()))
        cosines = [sum(v * float(c[g]) for g, v in vector.items()) / norm for c in model.centroids]
        best = max(range(len(cosines)), key=lambda k: cosines[k])
        expected[doc, held_out, names[model.owner[best]], round(min(max(cosines[best], 0), 1), 2), bool(1 - cosines[best] > model.reach[best])] += 1
    wrong = sum((found - expected).values())
    assert wrong <= 2 and sum(found.values()) == len(data), (list((found - expected).items())[:4], list((expected - found).items())[:4])
    assert {k[:3] for k in found} == {k[:3] for k in expected}


def test_toxicity_equals_a_plain_version(spark):
    rng = random.Random(22)
    data, labels = [], []
    for k in range(240):
        words = [rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(40)) for _ in range(25)]
        if k % 4 == 0:
            words[7] = rng.choice(["scumbag", "idiot"])
        data.append((k, " ".join(words)))
        labels.append((k, int(k % 4 == 0 or k % 31 == 0)))
    data += _awkward(rng, ["alpha", "beta"])
    table = spark.createDataFrame([(d, t, "en", "s", "k", 1, 2) for d, t in data], SCHEMA).repartition(4)
    labelled = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit_toxicity(table, labelled)
    text_of, class_of = dict(data), dict(labels)
    train = [k for k in class_of if zlib.crc32(str(k).encode()) % 3 != 1]
    sets = {k: set(_grams(text_of[k], toxicity.SIZES, toxicity.BITS)) for k in train}
    seen = [Counter(), Counter()]
    for k in train:
        seen[class_of[k]].update(sets[k])
    clean, toxic = seen
    known = [g for g in set(clean) | set(toxic) if clean[g] + toxic[g] >= toxicity.SUPPORT]
    p, q = (sum(c[g] + 1 for g in known) for c in (toxic, clean))
    size = [sum(class_of[k] == c for k in train) for c in (0, 1)]

    def sigmas(g):
        total, both = 0.0, len(train)
        for c in (0, 1):
            for present in (True, False):
                cell = seen[c][g] if present else size[c] - seen[c][g]
                row = clean[g] + toxic[g] if present else both - clean[g] - toxic[g]
                total += cell * math.log(cell * both / (row * size[c])) if cell else 0
        return math.sqrt(max(2 * total, 0))

    chosen = {g for g in known if sigmas(g) >= toxicity.SIGMAS + 1e-9}
    assert 0 < len(chosen) < toxicity.FEATURES and set(np.flatnonzero(model.slot >= 0).tolist()) == chosen
    ratio = {g: math.log((toxic[g] + 1) / p) - math.log((clean[g] + 1) / q) for g in chosen}
    weight = {g: float(model.weight[model.slot[g]]) for g in chosen}
    # at the optimum the gradient of the penalised likelihood, classes weighing the same, is zero
    score = lambda grams: 1 / (1 + math.exp(-model.intercept - sum(weight[g] for g in sorted(grams & chosen))))
    for g in sorted(chosen)[:40]:
        pull = sum(len(train) / (2 * size[class_of[k]]) * (class_of[k] - score(sets[k])) * ratio[g] for k in train if g in sets[k])
        assert pull == pytest.approx(toxicity.RIDGE * weight[g] / ratio[g], abs=1e-2)
    found = toxicity.toxicity_scores(table, labelled).collect()
    assert len(found) == len(data)
    for r in found:
        texts = [t for d, t in data if d == r["doc_id"]]
        assert r["score"] == pytest.approx(score(set(_grams(texts[0], toxicity.SIZES, toxicity.BITS))), abs=1e-9)
        assert r["predicted"] == int(r["score"] >= 0.7)
    few = toxicity.ToxicityModel.fit(toxicity.training_rows(table, labelled, F.col("doc_id").isNotNull()), features=5)
    every = toxicity.ToxicityModel.fit(toxicity.training_rows(table, labelled, F.col("doc_id").isNotNull()), sigmas=0.0, features=None)
    assert len(few.weight) == 5 and len(every.weight) > len(chosen)
    kept = toxicity.drop_toxic(table, labelled)
    assert kept.columns == table.columns and kept.count() == sum(r["score"] < 0.7 for r in found)
    assert toxicity.drop_toxic(table.where("false"), labelled).count() == 0


def test_sharding_equals_plain_scheduling(spark):
    rng = random.Random(23)
    texts = ["w" * int(2 ** rng.uniform(0, 14)) + str(k) for k in range(300)]
    data = [(k, t) for k, t in enumerate(texts)] + [(k, "the same text" * 40) for k in range(1000, 1100)] + [(None, None), (7, ""), (7, "")]
    table = spark.createDataFrame([(d, t, "en", "s", "k", 1, 2) for d, t in data], SCHEMA).repartition(5)
    groups = Counter()
    for _, t in data:
        groups[t] += len((t or "").encode()) + 8
    loads = [0] * 24
    heapq.heapify(loads)
    for size in sorted(groups.values(), reverse=True):
        heapq.heappush(loads, heapq.heappop(loads) + size)
    for limits in ({}, {"large": 64, "bundles": 256}):
        got = Counter()
        for r in sharding.shard(table, **limits).collect():
            got[r["shard"]] += r["size"]
        if not limits:
            assert sorted(got.values()) == sorted(loads)
        # the least loaded shard takes the next item: no shard is ahead by more than one
        assert max(got.values()) - min(got.get(s, 0) for s in range(24)) <= max(groups.values())


def _near(a, b):
    both = len(a & b)
    return both and 100 * both >= 75 * len(a | b)


def _shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def _mixed(rows):
    """Copies per document of weighted fair queueing over shuffled documents."""
    size = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in rows}
    names = sorted({r["source"] for r in rows if r["source"] is not None}) + [None] * any(r["source"] is None for r in rows)
    total = {s: sum(size[r["doc_id"]] for r in rows if r["source"] == s) for s in names}
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, open_, left = {}, list(names), float(sum(total.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if 3 * total[s] <= level * weight[s]]
        if not full:
            target.update({s: level * weight[s] for s in open_})
            break
        target.update({s: 3.0 * total[s] for s in full})
        left -= sum(3 * total[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    queue = []
    for s in names:
        order = sorted((hashlib.md5(f"mix-0:{r['doc_id']}".encode()).hexdigest(), r["doc_id"]) for r in rows if r["source"] == s and size[r["doc_id"]])
        before = 0
        for epoch in range(3):
            for key, doc in order:
                if before < target[s]:
                    queue.append(((before + size[doc]) / target[s], names.index(s), key, doc))
                before += size[doc]
    taken, used = Counter(), 0
    for *_, doc in sorted(queue):
        used += size[doc]
        if used > sum(total.values()):
            break
        taken[doc] += 1
    return taken


def test_pipeline_equals_plain_stages(spark, folder):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = [r.asDict() for r in docs.collect()]
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs, labels).collect()}

    def after(name, table, expected):
        table = corpus_pipeline.stored(stages[name](spark, table, folder), f"plain-{name}")
        assert table.columns == docs.columns
        assert Counter(r["doc_id"] for r in table.collect()) == expected, name
        return table

    rows = [r for r in rows if scores[r["doc_id"]] < 0.7]
    table = after("toxicity", docs, Counter(r["doc_id"] for r in rows))
    best = {}
    for r in rows:
        key = re.sub("[\x20\x09-\x0d]", "", r["text"] or "")
        if key not in best or (-len(r["text"] or ""), r["doc_id"]) < (-len(best[key]["text"] or ""), best[key]["doc_id"]):
            best[key] = r
    rows = list(best.values())
    table = after("exact_dedup", table, Counter(r["doc_id"] for r in rows))
    rows.sort(key=lambda r: r["doc_id"])
    sets, root = [_shingles(r["text"]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if _near(sets[i], sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    rows = [r for i, r in enumerate(rows) if root[i] == i]
    table = after("near_dedup", table, Counter(r["doc_id"] for r in rows))
    taken = _mixed(rows)
    table = after("mixing", table, taken)
    pieces = corpus_pipeline.run(spark, folder).collect()
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    ids = {r["doc_id"]: np.array(encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4") for r in rows}
    packed, at = Counter(), 0
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["sequence_id"] * 2048 + r["offset"] == at and r["offset"] + r["length"] <= 2048
        at += r["length"]
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        packed[r["doc_id"]] += r["length"]
    assert packed == Counter({d: n * len(ids[d]) for d, n in taken.items()})


def test_stages_on_awkward_rows(spark, folder):
    """Nulls, repeated rows, ties, long texts, clashing columns and empty tables pass every stage."""
    import corpus_pipeline

    rng = random.Random(24)
    data = _awkward(rng, ["alpha", "beta"]) + [(1, "one text of some words in all"), (1, "one text of some words in all"), (2, "one text of some words in all")]
    table = spark.createDataFrame([(d, t, "en" if d else None, "s" if t else None, "k", 1, 2) for d, t in data], SCHEMA).repartition(3)
    for docs in (table, table.where("false")):
        left = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            left = corpus_pipeline.stored(stage(spark, left, folder), f"awkward-{name}")
            assert left.columns == docs.columns, name
        pieces = corpus_pipeline.STAGES[-1][1](spark, left, folder)
        assert pieces.count() >= (docs.count() > 0)
