import hashlib
import re

import pytest

pytest.importorskip("rollcall.llm")
from rollcall.llm import merkle


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def fingerprint(text):
    tree = [[[sha(m[0]) for m in re.finditer(merkle.PIECE, p)] for p in s.split("\n")] for s in text.split("\n\n")]
    root = sha(",".join(sha(",".join(sha(",".join(p)) for p in s)) for s in tree))
    return root + ":" + "/".join(".".join("".join(x[:6] for x in p) for p in s) for s in tree)


def near(a, b):
    if a[:64] == b[:64]:
        return 1.0
    x, y = ({*re.findall("[0-9a-f]{6}", re.sub("[./]", "", f[65:]))} for f in (a, b))
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 0.0


def brute(docs):
    order = sorted(docs, reverse=True)
    out = {}
    for i, (key, text) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        f, g = fingerprint(text), fingerprint(edited)
        out[key] = (len(text), sha(edited), f, g, near(f, g), near(f, fingerprint(nxt)))
    return out


def test_like_brute_force(spark):
    texts = ["", "one", "a b c d e f g h i", "x\n\ny z\n\n\nq", "🙂 é 漢 " * 9, "same text here\nand there", "same text here\nand there", "\n", "  lead", "w " * 30_000]
    docs = [(7 * i - 20, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(k, t or None, "x") for k, t in docs], "doc_id long, text string, rid string")
    got = {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in merkle.report(df).collect()}
    assert got == brute(docs)


def test_repeated_rows_null_keys_and_one_row(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c d e"), (None, None), (2, "c d e")], "doc_id long, text string")
    rows = merkle.report(df).collect()
    assert len(rows) == 5
    a, b = (r for r in rows if r.doc_id == 1)
    assert a == b
    assert len({r.fingerprint for r in rows if r.n_chars == 5}) == 1
    one = merkle.report(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).first()
    assert one.edited_sha256 == sha("abab") and one.near_next == 1.0
    assert merkle.report(df.limit(0)).collect() == []


def test_branches_locate_an_edit(spark):
    df = spark.createDataFrame([("a b\nc d\n\ne f\ng h", "a b\nc X\n\ne f\ng h")], "x string, y string")
    both = merkle.tree(merkle.tree(df, "x", "fx"), "y", "fy")
    assert both.select(merkle.edits("fx", "fy").alias("e")).first().e == ["0.1"]


def test_string_keys_follow_each_other_like_numbers(spark):
    texts = [f"word{i} some more words of text {i}\n\nanother section {i}" for i in range(40)] + [None, ""]
    plain = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    named = plain.withColumn("doc_id", plain.doc_id.cast("string"))
    columns = ["edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    got = {r.doc_id: r[1:] for r in merkle.report(named).select("doc_id", *columns).collect()}
    want = {str(r.doc_id): r[1:] for r in merkle.report(plain).select("doc_id", *columns).collect()}
    assert got == want
