"""Every operator over the same odd rows: nulls in any column, empty and very long texts, repeated rows, clashing names."""

import pytest

pytest.importorskip("rollcall.llm")
from pyspark.sql import functions as F

from rollcall.llm import bpe, decontam, langid, merkle, order_minhash, pii, pitman_yor, queries, secret_ledger, suffixes, urls

LONG = " ".join(f"word{i % 9973} mail{i}@host.org" for i in range(20_000))
ROWS = [
    (1, "the cat sat on the mat and looked at +34 600 123 456", "en"),
    (1, "the cat sat on the mat and looked at +34 600 123 456", "en"),
    (2, None, None), (3, "", "en"), (4, "\n\n \t", None), (5, LONG, "en"), (6, "x" * 300_000, None), (7, "1" * 60_000, "de"),
    (None, "password = hunter2hunter2 at http://a.com/en/x", "de"), (None, None, None), (8, "é🙂漢 " * 50, "de"),
]
#: Names that operators use inside.
CLASHING = ("id", "key", "rid", "row", "text_", "hit", "gram", "n", "at", "spans", "kind", "blob", "ids", "score", "lang_pred", "class_id", "host", "url", "part", "next", "copy", "_e", "a", "b")

OPERATORS = {
    "bpe": lambda d: bpe.digest(d, queries.vocabulary()),
    "pii": pii.report,
    "redact": lambda d: pii.redact(d).select("doc_id", F.sha2("text", 256)),
    "secrets": secret_ledger.report,
    "urls": lambda d: urls.judge(d, key="doc_id", url="text"),
    "decontam": lambda d: decontam.leaks(d, d.select(F.col("doc_id").alias("item_id"), "text")),
    "suffixes": lambda d: suffixes.remove(d),
    "near": order_minhash.report,
    "keep_one": lambda d: order_minhash.keep_one(d).select("doc_id", F.sha2("text", 256)),
    "langid": langid.report,
    "pitman_yor": pitman_yor.report,
    "merkle": merkle.report,
}
#: One row a document, repeated rows included.
PER_ROW = set(OPERATORS) - {"decontam", "keep_one"}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string")


def shown(df):
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_and_clashing_names(odd, name):
    run = OPERATORS[name]
    plain = run(odd)
    rows = shown(plain)
    if name in PER_ROW:
        assert len(rows) == len(ROWS)
    extra = odd.select("*", *(F.lit(None if i % 2 else f"v{i}").cast("string").alias(c) for i, c in enumerate(CLASHING)))
    again = run(extra)
    assert again.columns == plain.columns
    assert shown(again) == rows


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_no_rows_and_only_nulls(odd, name):
    assert OPERATORS[name](odd.limit(0)).collect() == []
    nulls = odd.select(*(F.lit(None).cast(t).alias(c) for c, t in odd.dtypes))
    got = OPERATORS[name](nulls).collect()
    if name in PER_ROW:
        assert len(got) == len(ROWS)
