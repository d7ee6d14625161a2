import zlib
from collections import Counter

import pytest
import regex

pytest.importorskip("rollcall.llm")
from rollcall.llm import langid

SF = "/root/testdata/sf0.001/documents.parquet"


def number(gram):
    return sum(ord(c) << 21 * (len(gram) - 1 - i) for i, c in enumerate(gram))


def ranked(counter, places):
    return sorted(counter, key=lambda g: (-counter[g], number(g)))[:places]


def counted(text):
    c = Counter()
    for w in regex.findall(r"\p{L}+", (text or "").lower()):
        w = f" {w} "
        c.update(w[i : i + n] for n in (1, 2, 3) for i in range(len(w) - n + 1))
    del c[" "]
    return c


def test_like_brute_force_on_whole_tables(spark):
    docs = spark.read.parquet(SF).select("doc_id", "text", "lang")
    rows = docs.collect()
    out = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in rows}
    totals = {}
    for i, text, lang in rows:
        if lang is not None and text is not None and not out[i]:
            totals.setdefault(lang, Counter()).update(counted(text))
    profiles = {lang: {g: k for k, g in enumerate(ranked(c, langid.PROFILE))} for lang, c in totals.items()}
    got = {r.doc_id: r for r in langid.report(docs).collect()}
    right = 0
    for i, text, lang in rows:
        mine = ranked(counted(text), langid.PROFILE)
        away = {p: sum(abs(profiles[p][g] - k) if g in profiles[p] else langid.PROFILE for k, g in enumerate(mine)) for p in profiles}
        best = min(sorted(away), key=away.get)
        assert got[i].lang_pred == best and got[i].held_out == out[i]
        assert got[i].score == pytest.approx(1 - away[best] / (langid.PROFILE * len(mine)))
        right += out[i] and best == lang
    assert right >= 0.97 * sum(out.values())


def test_nulls_wordless_texts_and_clashing_columns(spark):
    rows = [(1, "the cat sat", "en", "r"), (3, "der hund lief", "de", None), (4, None, "en", "x"), (5, "", None, "x"), (6, "12 $$ ²", "de", "x"),
            (None, "the dog", None, "x"), (7, "a" * 50_000 + " the", None, "x"), (1, "the cat sat", "en", "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, row string")
    got = [(r.doc_id, r.held_out, r.lang_pred, r.score) for r in langid.report(df).collect()]
    assert len(got) == len(rows)
    by = {i: (h, p, s) for i, h, p, s in got}
    assert by[4][1:] == by[5][1:] == by[6][1:] == ("und", 0.0)
    assert by[None][:2] == (False, "en") and by[1][1] == "en" and by[3][1] == "de"
    assert all(0 <= s <= 1 for *_, s in got)
    kept = langid.predict(df, langid.profiles(df))
    assert kept.columns == [*df.columns, "lang_pred", "score"]
    assert langid.report(df.limit(0)).collect() == []
    unlabelled = df.withColumn("lang", df.lang.substr(99, 1)).where("lang is null")
    assert {r.lang_pred for r in langid.report(unlabelled).collect()} <= {"und"}
