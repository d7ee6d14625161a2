import hashlib
import random
from collections import Counter

import pytest

pytest.importorskip("rollcall.llm")
from rollcall.llm import suffixes

SF = "/root/testdata/sf0.001/documents.parquet"


def brute(texts, window):
    data = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + window] for t in data for i in range(len(t) - window + 1))
    out = []
    for t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, texts, parts=4):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove(df).collect()}
    return [got[i] for i in range(len(texts))]


def passages(seed, n, length):
    rng = random.Random(seed)
    word = lambda: rng.choice(["é", "漢字", "the", "of", "and "]) + "".join(rng.choice("abcde") for _ in range(rng.randint(1, 6)))
    shared = [" ".join(word() for _ in range(rng.randint(20, 90))) for _ in range(12)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, length)):
            x = rng.choice(shared) if rng.random() < 0.4 else " ".join(word() for _ in range(rng.randint(1, 60)))
            if rng.random() < 0.3:
                k = rng.randrange(len(x))
                x = x[:k] + rng.choice(["", "#"]) + x[k + 1 :]
            parts.append(x)
        out.append(" ".join(parts))
    return out


def test_like_brute_force_on_whole_table(spark):
    texts = [r.text for r in spark.read.parquet(SF).orderBy("doc_id").collect()]
    assert run(spark, texts) == brute(texts, 200)


def test_like_brute_force_on_passages_and_periods(spark):
    texts = passages(4, 60, 6)
    texts += [None, "", "x" * 199, "x" * 200, "y" * 201, "ab" * 300, "abc" * 150 + "Q" + "abc" * 90, texts[0], texts[0], "z" * 1000, ("p" * 57 + "q") * 20]
    assert run(spark, texts, 7) == brute(texts, 200)


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 1000)
    for part in suffixes.pieces([b"a" * 5000, b"", b"b" * 10, b"c" * 1199, b"d" * 1200]):
        assert part[2]
    texts = ["".join(passages(9, 8, 9)), "".join(passages(9, 8, 9))[333:], *passages(11, 30, 12)]
    data = [t.encode() for t in texts]
    windows = Counter()
    for which, offsets, parts in suffixes.pieces(data):
        own, q, n, *_ = suffixes.runs(parts)
        for o, a, k in zip(own, q, n):
            windows.update((which[o], offsets[o] + a + j) for j in range(k))
    assert set(windows.values()) == {1}
    assert len(windows) == sum(max(0, len(t) - 199) for t in data)


def test_repeated_and_null_keys_and_clashing_columns(spark):
    t = "".join(passages(3, 1, 8)) * 2
    rows = [(1, t, "a"), (1, t, "a"), (None, t[5:], "b"), (2, None, "c"), (2, "short", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string")
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove(df).collect())
    assert got == sorted(brute([r[1] for r in rows], 200))
    assert suffixes.remove(df.limit(0)).collect() == []
