import math
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

pytest.importorskip("rollcall.llm")
from rollcall.llm import pitman_yor as py
from rollcall.sources.shared import shared_dir

SF = "/root/testdata/sf0.001/documents.parquet"


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), ""]


def base(rows):
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    count = Counter(w for i, t in rows if not out[i] for w in tokens(t))
    n, v = sum(count.values()), len(count)
    res = {}
    for i, t in rows:
        w = tokens(t)
        res[i] = (out[i], len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
    return res


def test_base_like_brute_force_and_a_better_model(spark):
    docs = spark.read.parquet(SF).select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = {r.doc_id: r for r in py.report(docs).collect()}
    want = base(rows)
    assert len(got) == len(rows)
    for i, (out, n, known, total, score) in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out, n, known, total)
        assert r.base_score == pytest.approx(score, rel=1e-9)
        assert r.score < 0
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_sum_to_one_and_scores_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(py, "BLOCK", 300)
    texts = ["the cat sat on the mat", "The dog sat", "a cat and a dog", "", None, "the the the the mat\x0bmat\tÉa", "zq xx the"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = py.numbered(df, "doc_id", "text").withColumn("train", ~py.held_out("id"))
    blocks = py.stash(py.blocked(rows, "train"))
    model = py.Model(blocks)
    answers = {bytes(r.key): r.v if r.key[0] else [r.c, *r.v] for r in model.answers.collect()}
    letters = {(k[0], int.from_bytes(k[1:])): v for k, v in answers.items() if k[0]}
    words = {k[1:]: (v[0], v[1:]) for k, v in answers.items() if not k[0]}

    def letter(k, code, s, i):
        """P(s) after the last k letters of the context code, in sample i."""
        if k == 1:
            return model.served[i][code % 258, s]
        context = code % 258**k
        seen = letters.get((k, context * 258 + s))
        if seen is not None and seen[i] is not None:
            return seen[i]
        part = letters.get((10 + k, context))
        return (1.0 if part is None or part[i] is None else part[i]) * letter(k - 1, code, s, i)

    for i in range(py.SAMPLES):
        assert np.allclose(model.served[i].sum(axis=1), 1)
        for (kind, context), _ in [x for x in letters.items() if x[0][0] == 13][:40]:
            assert sum(letter(3, context, s, i) for s in range(257)) == pytest.approx(1, abs=1e-5)

    def word(w, i):
        p, context = 1.0, (257 * 258 + 257) * 258 + 257
        for s in [*w, 256]:
            p *= letter(3, context, s, i)
            context = (context * 258 + s) % 258**3
        c, t = words.get(w, (0, [0] * py.SAMPLES))
        return (c - py.WORD_DISCOUNT * t[i] + (py.WORD_STRENGTH + py.WORD_DISCOUNT * model.tables[i]) * py.parent(p, model.types)) / (py.WORD_STRENGTH + model.total)

    got = {r.doc_id: r.score for r in py.report(df).collect()}
    for k, t in enumerate(texts):
        want = sum(math.log10(sum(word(w.encode(), i) for i in range(py.SAMPLES)) / py.SAMPLES) for w in tokens(t))
        assert got[k] == pytest.approx(want, rel=1e-6), t


def test_newcomers_like_a_sequential_restaurant():
    rng = np.random.default_rng(1)
    n, c = 3000, 200
    key, zero = np.arange(n, dtype=np.uint64), np.zeros(n, np.int64)
    t = py.seated(np.full(n, c), zero, zero, np.full(n, 0.02), np.full(n, 50), 0.5, 1.0, key, 7)
    one = []
    for _ in range(400):
        k = 1
        for i in range(1, c):
            a = (1 + 0.5 * (50 + k)) * 0.02
            k += rng.random() < a / (a + i - 0.5 * k)
        one.append(k)
    assert abs(t.mean() - np.mean(one)) < 0.3 and t.min() >= 1 and t.max() <= c


@pytest.mark.parametrize("c", [2, 5, 12, 30])
def test_sweeps_reach_the_posterior_of_the_tables(c):
    n, d, strength, p, others = 20_000, 0.5, 1.0, 0.05, 20
    s = np.zeros((c + 1, c + 1))
    s[0, 0] = 1
    for i in range(1, c + 1):
        for k in range(1, i + 1):
            s[i, k] = s[i - 1, k - 1] + (i - 1 - d * k) * s[i - 1, k]
    weight = np.array([s[c, k] * np.prod([(strength + d * (others + j)) * p for j in range(k)]) for k in range(1, c + 1)])
    want = weight / weight.sum()
    t, key = np.ones(n, np.int64), np.arange(n, dtype=np.uint64)
    for r in range(25):
        t = py.sweep(np.full(n, c), t, np.full(n, p), np.full(n, others), d, strength, key, r)
    got = np.bincount(t, minlength=c + 1)[1:] / n
    assert np.abs(got - want).max() < 0.02


def test_draws_are_binomial():
    m = np.repeat([1, 5, 40, 1000, 1000, 100_000], 20_000)
    q = np.repeat([0.3, 0.9, 0.1, 0.004, 0.5, 0.2], 20_000)
    x = py.binomial(m, q, np.arange(len(m), dtype=np.uint64), 3).reshape(6, -1)
    mean, spread = (m * q).reshape(6, -1)[:, 0], np.sqrt(m * q * (1 - q)).reshape(6, -1)[:, 0]
    assert (np.abs(x.mean(axis=1) - mean) < 5 * spread / np.sqrt(20_000)).all() and np.allclose(x.std(axis=1), spread, rtol=0.05)


def test_scores_do_not_depend_on_partitions_and_a_long_text(spark):
    docs = spark.read.parquet(SF).select("doc_id", "text").where("doc_id < 60")
    long_text = spark.createDataFrame([(1000, " ".join(f"w{i % 5000}" for i in range(200_000)) + " " + "x" * 500_000)], "doc_id long, text string")
    docs, found = docs.unionAll(long_text), []
    for n, shuffles in ((1, "3"), (9, "7")):
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        try:
            found.append({r.doc_id: [r.score, r.base_score] for r in py.report(docs.repartition(n)).collect()})
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(found[0]) > 50 and found[0].keys() == found[1].keys()
    assert all(found[0][i] == pytest.approx(found[1][i], rel=1e-12) for i in found[0])


def test_empty_repeated_and_untrained(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "y"), (None, None, "z")], "doc_id long, text string, block string")
    rows = py.report(df).collect()
    assert sorted(r.n_tokens for r in rows) == [1, 3, 3] and all(r.train_tokens == 7 for r in rows)
    assert py.report(df.limit(0)).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    only = py.report(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert only.held_out and only.n_known == 0 and only.train_tokens == 0 and only.base_score == pytest.approx(0.0, abs=1e-9)
    assert math.isfinite(only.score)


def pair_seats(model):
    """By context and word: customers and tables by round."""
    out = {}
    for r in model.pairs.where("blob is not null").collect():
        contexts, own, v, c, ts = py.unpacked(py.pa.scalar(bytes(r.blob)))
        out.update({(int(contexts[a]), int(b)): (int(n), t.tolist()) for a, b, n, t in zip(own, v, c, ts.T)})
    return out


def test_words_after_words_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(py, "BLOCK", 300)
    texts = ["the cat sat on the mat", "The dog sat on the mat", "a cat and a dog", "", None, "mat the on sat cat the"] * 6
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = py.numbered(df, "doc_id", "text").withColumn("train", ~py.held_out("id"))
    model = py.Model(py.stash(py.blocked(rows, "train")), 2)
    count = Counter()
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 10:
            words = tokens(t)
            count.update(zip(["", *words], words))
    seats, h = pair_seats(model), lambda w: int(py.digests([w.encode()])[0])
    assert {k: c for k, (c, _) in seats.items()} == {(h(u), h(v)): c for (u, v), c in count.items()}
    assert all(1 <= x <= c for c, t in seats.values() for x in t) and any(x > 1 for _, t in seats.values() for x in t)
    assert model.customers == [sum(t[py.BURN + i] for _, t in seats.values()) for i in range(py.SAMPLES)]
    answers = {bytes(r.key)[1:].decode(): r for r in model.answers.collect() if r.key[0] == 0}
    for w, r in answers.items():
        assert list(r.ns) == [sum(t[py.BURN + i] for (_, v), (_, t) in seats.items() if v == h(w)) for i in range(py.SAMPLES)]

    # words by themselves with the same seats, from the operator's own first step; the pairs by hand
    one, after = {}, py.after

    def kept(pairs, p, found):
        one.update({int(d): p[:, i] for i, d in enumerate(pairs.h)})
        out = after(pairs, p, found)
        for u, v, got in zip(pairs.h[pairs.u].tolist(), pairs.h[pairs.v].tolist(), out.T):
            own = [x for k, x in seats.items() if k[0] == u]
            c, t = seats.get((u, v), (0, [0] * 9))
            for i in range(py.SAMPLES):
                all_t = sum(x[1][py.BURN + i] for x in own)
                want = (c - py.PAIR_DISCOUNT * t[py.BURN + i] + (py.PAIR_STRENGTH + py.PAIR_DISCOUNT * all_t) * one[v][i]) / (py.PAIR_STRENGTH + sum(x[0] for x in own))
                assert got[i] == pytest.approx(want, rel=1e-9)
        return out

    for blob in py.stash(py.blocked(rows, "train")).collect():
        block = py.Block(py.pa.scalar(bytes(blob.blob)))
        pairs = py.Pairs(block, model.parts)
        found = {r.part: py.unpacked(py.pa.scalar(bytes(r.blob))) for r in py.pair_answers(model.asked, model.pairs).where(f"block = {blob.block}").collect()}
        kept(pairs, np.random.default_rng(1).random((py.SAMPLES, len(block.words))), found)


def test_the_order_of_words_counts_and_partitions_do_not(spark):
    rng = np.random.default_rng(3)
    following = {w: [f"w{(w * 7 + k) % 40}" for k in range(3)] for w in range(40)}

    def walk(n):
        w, out = int(rng.integers(40)), []
        for _ in range(n):
            out.append(following[w][int(rng.integers(3))])
            w = int(out[-1][1:])
        return " ".join(out)

    rows = [(i, walk(60)) for i in range(300)]
    docs, found = spark.createDataFrame(rows, "doc_id long, text string"), []
    for n, order in ((1, 2), (7, 2), (2, 1)):
        found.append({r.doc_id: r.score for r in py.report(docs.repartition(n), order=order).collect()})
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 10 == 0]
    assert all(found[0][i] == pytest.approx(found[1][i], rel=1e-12) for i in found[0])
    assert sum(found[0][i] for i in held) > 0.6 * sum(found[2][i] for i in held)  # log10(3) against log10(40) a word


def test_rounds_carry_dishes_that_move_and_leave_nothing_behind(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.5, 80) % 3000)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    stashes = lambda: set(Path(shared_dir(spark).removeprefix("file://").removeprefix("file:")).glob("stash-*"))
    before = stashes()
    out = py.report(docs, order=2)
    assert len(stashes() - before) == 2 and out.count() == 200  # the blocks and their answers
    train = py.numbered(docs, "doc_id", "text").withColumn("train", ~py.held_out("id"))
    model = py.Model(py.stash(py.blocked(train, "train")), 2)
    count, words = Counter(), Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 10:
            words.update(tokens(t))
            count.update(zip(["", *tokens(t)], tokens(t)))
    seats = [py.unpacked(py.pa.scalar(bytes(r.blob))) for r in model.seats.collect()]
    assert sorted(n for _, _, _, c, *_ in seats for n in c) == sorted(n for n in count.values() if n > 1)
    assert sum(int(still.sum()) for *_, still in seats) == sum(n == 1 for n in count.values())
    found = [(r.kind, py.words_of(r.kind, py.pa.scalar(bytes(r.blob)))) for r in model.words.collect()]
    assert {w.decode(): int(n) for _, (w_, c, _, _) in found for w, n in zip(w_, c)} == dict(words)
    assert all((c == 1).all() == (kind == py.ONCE) for kind, (_, c, _, _) in found)
