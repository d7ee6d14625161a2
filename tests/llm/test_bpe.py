import hashlib
import random
import sys

import numpy as np
import pytest

pytest.importorskip("rollcall.llm")
from tokenizers import Tokenizer

from rollcall.llm import bpe
from rollcall.llm.queries import vocabulary


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(vocabulary())


def ours(texts):
    return [np.frombuffer(x, "<u4").tolist() for x in bpe.codec(vocabulary()).encode(texts)]


def test_every_code_point_like_the_library(lib):
    texts = []
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 4000):
        texts.append("".join(f"a{chr(c)} {chr(c)}{chr(c)}  b" for c in points[k : k + 4000]))
    theirs = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    bad = [k for k, (a, b) in enumerate(zip(ours(texts), theirs)) if a != b]
    assert not bad


def test_random_texts_like_the_library_and_round_trip(lib):
    rng = random.Random(5)
    alphabet = ["a", "the", " ", "  ", "\n", "\t", "'s", "'LL", "é", "ß", "漢", "🙂", "0", "12", "-", "<|endoftext|>", "<|endo", "aaaa", " ", "\r\n", "."]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    texts += ["", " ", "x" * 30_000, "ab " * 20_000, "<|endoftext|>" * 3]
    codec = bpe.codec(vocabulary())
    for t, ids, raw in zip(texts, ours(texts), codec.encode(texts)):
        e = lib.encode(t, add_special_tokens=False).ids
        assert ids == e
        assert codec.decode(raw) == lib.decode(e, skip_special_tokens=False) == t


def test_frame_with_nulls_ties_and_extra_columns(spark):
    rows = [(1, None, "x"), (2, "", None), (3, "the cat", "y"), (3, "the cat", "y"), (None, "z", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digest(df, vocabulary()).collect())
    empty = hashlib.sha256(b"").hexdigest()
    assert got[0] == ("1", 0, empty, empty) and got[1] == ("2", 0, empty, empty)
    assert got[2] == got[3] and got[2][3] == hashlib.sha256(b"the cat").hexdigest()
    back = bpe.decode(bpe.encode(df, vocabulary()), vocabulary())
    assert sorted(r.text for r in back.collect()) == ["", "", "the cat", "the cat", "z"]
    assert bpe.digest(df.limit(0), vocabulary()).collect() == []
