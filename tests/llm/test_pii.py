import hashlib
import random
import re

import pytest

pytest.importorskip("rollcall.llm")
from rollcall.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else None,
                "card": 16 <= len(d) <= 19 and luhn(d),
                "phone": 8 <= len(d) <= 15,
            }[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def texts():
    rng = random.Random(3)
    bits = ["a@b.co", "x.y+z@d-e.example.org", "a@b", "@", "é", "漢", "🙂", " ", ".", "-", "_", "1.2.3.4", "256.1.1.1", "001.2.3.4", "1.2.3.4.5",
            "4111 1111 1111 1111", "4111111111111111", "5500-0000-0000-0004", "4111111111111112", "+1 (555) 123-4567", "+49 30 1234567", "+1", "++12 345 6789",
            "12", "7", "030 1234 5678", "Maria Lopez", "Dr. Smith", "call ", "\n", "00000000000000000"]
    out = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(600)]
    return [*out, None, "", "1" * 40_000, "a" * 40_000, "a." * 20_000 + "@", "a@b.c " * 5_000, "1." * 20_000, "+" + "1 " * 20_000, "4111111111111111," * 3_000]


def test_base_spans_like_brute_force(spark):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want = brute(t)
        spans = got[i].spans.split(",") if got[i].spans else []
        assert [s for s in spans if s.split(":")[0] in PATTERNS] == want, t
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(w.startswith(k + ":") for w in want) for k in PATTERNS]


def test_learned_spans_and_redaction(spark):
    good = [(i, f"please call 0{i % 9}30 1234 567{i % 10} now, carte 7536784127813050 4111111111111111 and Dr. Smith", "x") for i in range(40)]
    doubt = [(100 + i, f"version 1{i % 9} 123 4567 of the tool", None) for i in range(40)]
    df = spark.createDataFrame([*good, *doubt, (999, None, "k"), (999, None, "k")], "doc_id long, text string, key string")
    got = {r.doc_id: r.spans for r in pii.report(df).collect()}
    assert all("tel:" in got[i] and "pan:" in got[i] for i, *_ in good)
    assert got[999] == ""
    out = pii.redact(df)
    assert out.columns == df.columns and out.count() == df.count()
    text = {r.doc_id: r.text for r in out.collect()}
    assert "[TEL]" in text[0] and "4111111111111111" not in text[0] and "please call " in text[0]
    assert text[999] is None
    masked = pii.redact(spark.createDataFrame([(1, "mail ab.cd@x.example.org or 9.8.7.6!")], "doc_id long, text string")).first().text
    assert masked == "mail [EMAIL] or [IP]!"


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.report(df).collect() == [] and pii.redact(df).collect() == []


def test_em_tells_reliable_labelers():
    cells = [("tel|1|1|1|m", 50), ("tel|1|0|1|m", 40), ("tel|-1|0|-1|m", 60), ("tel|0|0|-1|m", 30)]
    chance = pii.classifier(cells)
    assert chance["tel|1|1|1|m"] > 0.5 > chance["tel|-1|0|-1|m"]


def test_contexts_and_masks_of_texts_with_many_spans(spark):
    import random

    from pyspark.sql import functions as F

    from rollcall.llm import spans

    rnd = random.Random(5)
    rows = []
    for n in (0, 1, 2, 255, 256, 257, 2000):
        text = "".join(rnd.choice("ab é🙂\n") for _ in range(10 * n + 7))
        starts = sorted(rnd.sample(range(len(text) - 5), n))
        rows.append((text, [(s, s + rnd.choice((1, 2, 5)), f"[{i % 3}]") for i, s in enumerate(starts)]))
    rows.append(("x" * 9000, [(0, 9000, "[a]"), (3, 5, "[b]")] + [(4000 + i, 4002 + i, "[c]") for i in range(600)]))
    rows += [(None, None), ("", [])]
    df = spark.createDataFrame(rows, "text string, cut array<struct<start:int,end:int,mark:string>>")

    def brute(text, cut):
        out, at = [], 0
        for s, e, mark in sorted(cut):
            if s >= at:
                out += [text[at:s], mark]
            at = max(at, e)
        return "".join(out) + text[at:]

    got = [r.text for r in spans.masked(df, "text", "cut").collect()]
    assert got == [t if t is None else brute(t, c) for t, c in rows]
    seen = df.withColumn("p", spans.pieces("text")).select("text", "cut", F.transform("cut", lambda x: spans.ahead("p", x["start"], 24)).alias("a"))
    for r in seen.where("text is not null").collect():
        assert r.a == [r.text[max(0, c.start - 24) : c.start] for c in r.cut]
