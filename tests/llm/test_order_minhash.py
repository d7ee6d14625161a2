import random
import re

import numpy as np
import pytest

pytest.importorskip("rollcall.llm")
from rollcall.llm import order_minhash as om

SF = "/root/testdata/sf0.001/documents.parquet"


def shingles(text):
    w = re.findall(r"\w+", (text or "").lower())
    k = min(5, len(w))
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if w else []


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
    return row[-1]


def brute(texts):
    """Classes by comparing all pairs."""
    part = list(range(len(texts)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    all_shingles = [shingles(t) for t in texts]
    for i, a in enumerate(all_shingles):
        for j, b in enumerate(all_shingles[:i]):
            if not a or not b:
                same = not a and not b and (texts[i] or "") == (texts[j] or "")
            else:
                n = len(a) + len(b)
                same = a == b or (len({*a} & {*b}) and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and (c := lcs(a, b)) / (n - c) >= 0.8 - 1e-9)
            if same:
                x, y = root(i), root(j)
                part[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(texts))]


def edited(rng, words, changes):
    w = list(words)
    for _ in range(changes):
        k = rng.randrange(len(w))
        w[k : k + 1] = rng.choice([[], [f"n{rng.randrange(999)}"], [w[k], "extra"]])
    return " ".join(w)


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    boiler = [word() for _ in range(60)]
    out = []
    for _ in range(n):
        base = [word() for _ in range(rng.choice([1, 3, 4, 6, 9, 15, 40, 120]))]
        if rng.random() < 0.4:
            base = base + boiler
        out += [edited(rng, base, rng.randint(0, 1 + len(base) // 60)) for _ in range(rng.randint(1, 5))]
    return out


def run(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.class_id for r in om.report(df).collect()}
    return [got[i] for i in range(len(texts))]


def test_alignment_like_the_full_table():
    rng = random.Random(1)
    for _ in range(400):
        a = [rng.randrange(8) for _ in range(rng.randint(1, 40))]
        b = [rng.randrange(8) for _ in range(rng.randint(1, 40))]
        assert om.aligned(a, b, 100) == lcs(a, b)
        band = rng.randint(0, 6)
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = max(table[i, j + 1], table[i + 1, j], table[i, j] + 1 if x == y and abs(i - j) <= band else 0)
        assert om.aligned(a, b, band) == table[-1, -1]


def test_similarity_where_it_matters():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.randrange(60) for _ in range(rng.randint(1, 60))]
        b = list(a)
        for _ in range(rng.randint(0, 8)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randint(0, 1)] = [rng.randrange(60)] * rng.randint(0, 1)
        if b:
            c = lcs(a, b)
            want = c / (len(a) + len(b) - c)
            got = om.similarity(np.array(a, np.uint64), np.array(b, np.uint64))
            assert got == pytest.approx(want) if want >= 0.8 else got < 0.8


def test_sketches_agree_with_about_the_expected_chance():
    rng = np.random.default_rng(3)
    agree = []
    for _ in range(60):
        x = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
        agree.append(np.mean(om.sketches(om.labelled(x[:800])) == om.sketches(om.labelled(x[100:]))))  # 700 of 900 in common
    assert abs(np.mean(agree) - (7 / 9) ** 3) < 0.05


def test_whole_table_like_brute_force(spark):
    texts = [r.text for r in spark.read.parquet(SF).orderBy("doc_id").collect()]
    assert run(spark, texts) == brute(texts)


@pytest.mark.parametrize("outside", [2000, 1, 0])
def test_groups_like_brute_force(spark, monkeypatch, outside):
    monkeypatch.setattr(om, "OUTSIDE", outside)
    texts = corpus(5, 40)
    texts += [None, "", "", "$$", "$$", "one", "ONE!", "a b c", "a b d", texts[0]]
    assert run(spark, texts) == brute(texts)


def test_repeated_null_keys_and_keep_one(spark):
    t = " ".join(f"w{i}" for i in range(80))
    rows = [(5, t, "a"), (5, t, "a"), (None, t + " x", "b"), (7, "other words here", "c"), (None, None, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string")
    got = om.report(df).collect()
    assert sorted(str(r.class_id) for r in got) == ["5", "5", "5", "7", "None"]
    kept = om.keep_one(df)
    assert kept.columns == df.columns and sorted(r.id for r in kept.collect()).count("c") == 1 and kept.count() == 3
    assert om.report(df.limit(0)).collect() == [] and om.keep_one(df.limit(0)).collect() == []


def test_links_at_the_threshold_with_few_agreeing_sketches(spark):
    rng = np.random.default_rng(4)
    words = om.Words()
    texts = []
    for _ in range(6000):
        w = [f"w{i}" for i in rng.integers(0, 1 << 40, 94)]
        v = list(w)
        v[20 + rng.integers(0, 20)], v[50 + rng.integers(0, 20)] = "one", "two"  # 80 of 90 shingles stay: 80 / 100
        a, b = (om.sketches(om.labelled(om.shingled(words.numbers(" ".join(x))))) for x in (w, v))
        if 3 <= np.count_nonzero(a == b) < 8:
            texts += [" ".join(w), " ".join(v)]
    assert texts
    assert run(spark, texts) == [i // 2 * 2 for i in range(len(texts))]


def test_parity_bitmaps_pass_over_no_similar_pair(spark):
    rng = np.random.default_rng(5)
    rows = []
    for n, m in [(1, 1), (4, 5), (31, 33), (90, 90), (300, 300), (256, 290), (2000, 2000), (2400, 3000), (300, 260), (1000, 900), (30000, 36000)] * 4:
        for short in (0, 1):  # as few common k-mers as links have, then one or a twentieth less
            lcs = -(-4 * (n + m) // 9)
            lcs -= short and max(1, lcs // 20)
            x = rng.integers(0, 1 << 62, n + m - lcs, dtype=np.uint64) * np.uint64(4) + rng.integers(0, 4, n + m - lcs, dtype=np.uint64)
            own, other, common = x[: n - lcs], x[n - lcs : n + m - 2 * lcs], x[n + m - 2 * lcs :]
            bits = [om.parities(np.concatenate([y, common])).tolist() for y in (own, other)]
            if lcs >= 0:
                rows.append((short, [1] * om.TABLES, [1] * om.TABLES, n, m, *bits))
    kinds = "short int, sketch_a array<long>, sketch_b array<long>, n_a long, n_b long, bits_a array<long>, bits_b array<long>"
    passed = spark.createDataFrame(rows, kinds).where(om.agreeing())
    assert passed.where("short = 0").count() == sum(not r[0] for r in rows)
    assert passed.where("short = 1").count() < sum(r[0] for r in rows)


def recall_table(seed, n):
    """Pairs of a text and an edited copy, at 0.75 to 0.9, of 20 to 700 words."""
    rng = np.random.default_rng(seed)
    texts, similar = [], []
    words = om.Words()
    while len(texts) < 2 * n:
        size = int(rng.choice([20, 60, 150, 300, 700]))
        w = [f"w{i}" for i in rng.integers(0, 1 << 40, size)]
        v = list(w)
        for k in rng.choice(size, max(1, int(rng.uniform(0.012, 0.035) * size)), replace=False):
            v[k] = f"e{rng.integers(1 << 40)}"
        x, y = (om.shingled(words.numbers(" ".join(t))) for t in (w, v))
        c = om.aligned(x.tolist(), y.tolist(), len(x))
        s = c / (len(x) + len(y) - c)
        if 0.75 <= s <= 0.9:
            texts += [" ".join(w), " ".join(v)]
            similar.append(s >= 0.8 - 1e-9)
    return texts, similar


def test_recall_over_five_thousand_documents(spark):
    texts, similar = recall_table(6, 2500)
    got = run(spark, texts)
    found = [a == b for a, b in zip(got[::2], got[1::2])]
    assert not any(f and not s for f, s in zip(found, similar))
    assert sum(f for f, s in zip(found, similar) if s) == sum(similar) > 1000
