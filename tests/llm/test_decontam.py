import random
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("rollcall.llm")
from rollcall.llm import decontam

SF = "/root/testdata/sf0.001"


def bag(words, k):
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(docs, items):
    """Every window of every item's size, no fingerprints."""
    bags = {}
    for item, text in items:
        w = re.findall(r"\w+", (text or "").lower())
        if w:
            bags[item] = (len(w), min(5, len(w)), bag(w, min(5, len(w))))
    out = {}
    for key, text in docs:
        w = re.findall(r"\w+", (text or "").lower())
        for item, (n, k, b) in bags.items():
            if not bag(w, k).keys() & b.keys():
                continue
            best = 0
            for i in range(len(w) - n + 1):
                o = bag(w[i : i + n], k)
                low = sum((b & o).values())
                high = sum((b | o).values())
                best = max(best, low / high)
            if best >= 0.8 - 1e-12:
                out[key, item] = best
    return out


def test_like_brute_force_on_whole_tables(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.leaks(docs, items).collect()}
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert want and got == pytest.approx(want)


def test_edited_passages_around_the_threshold(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 5, 8, 20, 40, 40, 60])))) for i in range(40)]
    docs = []
    for i in range(300):
        w = items[i % 40][1].split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            w.insert(rng.randrange(len(w)), "extra")
        docs.append((i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 50)) + w + rng.choices(vocabulary, k=rng.randint(0, 50)))))
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == pytest.approx(brute(docs, items))


def test_nulls_repeats_blocks_and_clean(spark, monkeypatch):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    items = spark.createDataFrame([(1, passage), (1, passage), (2, None), (3, ""), (4, "lone words")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {passage.upper()}! y", "a"), (1, f"x {passage.upper()}! y", "a"), (2, None, "b"), (3, "", "b"), (4, "some lone words", "c"), (None, "x " * 60_000, "d")], "doc_id long, text string, key string")
    rows = sorted((r.doc_id, r.item_id, r.first_word, r.n_words) for r in decontam.leaks(docs, items).collect())
    assert rows == [(1, 1, 1, 12), (1, 1, 1, 12), (4, 4, 1, 2)]
    kept = decontam.clean(docs, items)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "None"]
    assert decontam.leaks(docs.limit(0), items).collect() == [] and decontam.leaks(docs, items.limit(0)).collect() == []
    assert decontam.clean(docs, items.limit(0)).count() == docs.count()
    monkeypatch.setattr(decontam, "ITEM_WORDS", 3)
    assert sorted((r.doc_id, r.item_id) for r in decontam.leaks(docs, items).collect()) == [(1, 1), (1, 1), (4, 4)]
    assert sorted(str(r.doc_id) for r in decontam.clean(docs, items).collect()) == ["2", "3", "None"]


def test_blocks_propose_every_fingerprint_within_the_radius():
    rng = random.Random(1)
    size = decontam.Size(9, [(i, Counter({rng.getrandbits(64): 1 for _ in range(5)})) for i in range(30)])
    prints = size.prints.copy()
    for i in range(30):
        for b in rng.sample(range(decontam.BITS), decontam.RADIUS):
            prints[i, b // 32] ^= np.uint32(1 << b % 32)
    found = set(zip(*(v.tolist() for v in size.near(prints, np.arange(30)))))
    assert {(i, i) for i in range(30)} <= found


def test_blocks_propose_few_unrelated_fingerprints():
    x, y = (np.random.default_rng(k).integers(0, 1 << 32, (2000, decontam.BLOCKS), dtype=np.uint32) for k in (1, 2))
    least = np.bitwise_count(x[:, None] ^ y[None]).min(axis=2)
    assert np.mean(least <= decontam.RADIUS // decontam.BLOCKS) < 0.01


def test_windows_at_the_threshold_are_within_the_radius():
    rng = np.random.default_rng(4)
    apart = []
    for _ in range(4000):
        n = int(rng.integers(9, 56))
        common = -(-8 * n // 9)  # 0.8 at least
        x = rng.integers(0, 1 << 63, 2 * n - common, dtype=np.uint64)
        a, b = (decontam.packed(decontam.signs(v).sum(axis=0)[None]) for v in (x[:n], x[n - common :]))
        apart.append(np.bitwise_count(a ^ b).sum())
    assert max(apart) <= decontam.RADIUS


def test_texts_shorter_than_the_item(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([3, 4, 5, 6, 9, 15, 24, 40, 55, 59])]
    docs = []
    for _, text in items:
        w = text.split()
        for less in range(1, len(w)):
            docs += [(len(docs), " ".join(w[:-less])), (len(docs) + 1, " ".join(w[less:]))]
            docs.append((len(docs), " ".join(w[: less // 2] + ["other"] + w[less // 2 + 2 :])))
    want = brute(docs, items)
    for key, text in docs:
        w = text.split()
        for item, full in items:
            n, k = len(full.split()), min(5, len(full.split()))
            if len(w) < n:
                a, b = bag(w, k), bag(full.split(), k)
                s = sum((a & b).values()) / sum((a | b).values())
                if s >= 0.8 - 1e-12:
                    want[key, item] = s
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = decontam.leaks(docs, items).collect()
    assert len(rows) > 50 and {(r.doc_id, r.item_id): r.similarity for r in rows} == pytest.approx(want)
    words = {r.doc_id: len(r.text.split()) for r in docs.collect()}
    assert all(r.first_word + r.n_words <= words[r.doc_id] for r in rows)
    assert decontam.clean(docs, items).count() == docs.count() - len({r.doc_id for r in rows})
