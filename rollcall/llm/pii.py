"""Personal data: weak labelers vote on candidate spans, expectation-maximisation weighs them, a classifier decides.

1. Candidates. The base kinds (email, ip, card, phone) are found by their patterns and checks and always stay. Weaker
   patterns propose spans of further kinds: `tel` (a number without country code), `pan` (a card number inside a longer
   run of digits that the base drops) and `name` (a title or given name before a capitalised word).
2. Votes. Three labelers look at each candidate and say yes (1), no (-1) or nothing (0): the strict form (regular
   expression), a gazetteer (top-level domains, country codes, issuers, given names, reserved ranges), and the words
   just before the span (context).
3. Reliabilities. A vote pattern is (kind, form, gazetteer, context, length class): at most some hundred cells,
   whatever the corpus. Their counts over all candidates of all documents are all that EM (a Dawid-Skene model with a
   prior for each kind) needs; it runs on those cells.
4. Classifier. A logistic regression on the cells' features, trained on EM's posteriors weighted by counts, gives each
   cell its final decision; candidates of the further kinds whose cell is positive become spans.

Everything that touches documents is built-in functions. The candidates with their votes, a small part of the text,
are written to the shared folder once, so the texts are read by one pass.

Defined results: a null or empty text has no spans; repeated rows give repeated results; an empty table gives an empty
one; other columns don't take part, so their names can't clash. Ties: base spans of different kinds may overlap and all
stay; a span of a further kind that meets a base one goes; of overlapping spans redaction writes the first one's kind, of
equal ones that which ends first, then the kind whose mark sorts first. A very long text is searched whole, in time in proportion to its length;
contexts and masks are cut from pieces of it. Spans of further kinds are held against the text's base spans one by one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import stash

# The base patterns. Possessive quantifiers and the guards before them only spare steps that would fail.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# The weaker patterns.
TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Don|Doña"
GIVEN = "Anna|Ben|Carlos|Carmen|Clara|David|Elena|Emma|Fatima|Hans|Ivan|James|Jean|John|Jose|Juan|Julia|Karl|Laura|Lucas|Luis|Maria|Marie|Mary|Mohamed|Paul|Peter|Pierre|Robert|Sarah|Sofia|Thomas"
WEAK = {
    "tel": r"(?<![+0-9).-])(?<![+0-9).-]\x20)\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![\x20.-]?[0-9])",
    "pan": r"(?<![0-9])[0-9]{13,19}(?![0-9])",
    "name": rf"(?<!\p{{L}})(?:(?:{TITLES})\.?|{GIVEN})\x20\p{{Lu}}\p{{Ll}}+(?!\p{{L}})",
}
KINDS = (*BASE, *WEAK)
# The gazetteers and the cue words before a span.
DOMAINS = r"(?i)\.(?:com|org|net|edu|gov|int|info|io|de|fr|es|uk|eu|ch|at|be|mx|ca|us)$"
COUNTRY_CODES = r"^\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
RESERVED = r"^(?:0|10|127|192\.168|172\.(?:1[6-9]|2[0-9]|3[01])|22[4-9]|2[3-5][0-9])\."
CUES = {
    "email": r"(?i)(?:mail|contact|write|reach|schreib|écri|correo)",
    "ip": r"(?i)(?:\bip\b|host|server|address|login|adresse)",
    "card": r"(?i)(?:card|visa|master|credit|karte|carte|tarjeta)",
    "phone": r"(?i)(?:phone|call|tel|mobile|fax|ruf|appel|llam)",
    "tel": r"(?i)(?:phone|call|tel|mobile|fax|ruf|appel|llam)",
    "pan": r"(?i)(?:card|visa|master|credit|karte|carte|tarjeta)",
    "name": r"(?i)(?:name|dear|sincerely|regards|author|by|heiß|nom|llam|signed)",
}
DOUBTS = r"(?i)(?:version|isbn|issn|order|invoice|serial|ticket|build|\bv|\bno|nr|§|#)\.?[\x20:]*$"
#: Code points before a span that the context labeler reads.
CONTEXT = 24
#: Rounds of EM and of the classifier's gradient steps; the cell's probability from which a span counts.
EM_ROUNDS, STEPS, CUT = 30, 300, 0.5


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def passes(kind: str, hit: Column) -> Column:
    """The base kinds' checks."""
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return hit.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return F.when(F.length(digits(hit)).between(16, 19), spans.luhn(digits(hit))).otherwise(False)
    if kind == "phone":
        return F.length(digits(hit)).between(8, 15)
    return F.lit(True)


def base(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column for each base kind: its spans, those that pass the checks."""
    found = spans.add(docs, text, BASE)
    return found.select(*(F.col(c) for c in docs.columns), *(spans.kept(k, lambda h, k=k: passes(k, h)).alias(k) for k in BASE))


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes(kind: str, hit: Column, ahead: Column) -> list[Column]:
    """What form, gazetteer and context say of a candidate."""
    n = F.length(digits(hit))
    never = F.lit(False)
    form = {
        "email": vote(hit.rlike(r"^[A-Za-z0-9][^@]*[A-Za-z0-9]@"), hit.rlike(r"\.\.|^[._%+-]")),
        "ip": vote(~hit.rlike(r"(?:^|\.)0[0-9]"), hit.rlike(r"(?:^|\.)0[0-9]")),
        "card": vote(n == 16, n > 16),
        "phone": vote(n.between(10, 13), n < 9),
        "tel": vote(n.between(9, 11), n < 9),
        "pan": vote(F.when(n == 16, spans.luhn(digits(hit))).otherwise(False), ~spans.luhn(digits(hit))),
        "name": vote(hit.rlike(r"\p{Lu}\p{Ll}{2,}$"), never),
    }[kind]
    known = {
        "email": vote(hit.rlike(DOMAINS), ~hit.rlike(r"\.[A-Za-z]{2,}$")),
        "ip": vote(~hit.rlike(RESERVED), hit.rlike(RESERVED)),
        "card": vote(digits(hit).rlike(ISSUERS), digits(hit).rlike("^[017-9]")),
        "phone": vote(hit.rlike(COUNTRY_CODES), hit.rlike(r"^\+0")),
        "tel": vote(hit.rlike(r"^\(?0"), never),
        "pan": vote(digits(hit).rlike(ISSUERS), digits(hit).rlike("^[017-9]")),
        "name": vote(hit.rlike(rf"^(?:{GIVEN})"), never),
    }[kind]
    return [form, known, vote(ahead.rlike(CUES[kind]), ahead.rlike(DOUBTS))]


def candidates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_chars, spans array<struct<k, start, end, cell>>): all candidates of each document with their vote pattern."""
    src = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # most texts have neither an @ nor a digit: their patterns then see an empty text
    only = lambda known: F.when(known, F.col("text")).otherwise("")
    src = src.withColumns({"_mail": only(F.contains("text", F.lit("@"))), "_digits": only(F.col("text").rlike("[0-9]"))})
    by = {"_mail": ("email",), "_digits": ("ip", "card", "phone", "tel", "pan"), "text": ("name",)}
    found = src
    for column, kinds in by.items():
        found = spans.add(found, column, {k: {**BASE, **WEAK}[k] for k in kinds})
    checked = found.select("key", "text", *(
        (spans.kept(k, lambda h, k=k: passes(k, h)) if k in BASE else F.col(k)).alias(k) for k in KINDS
    ))
    checked = checked.select("*", F.concat(*BASE).alias("_taken"), spans.pieces("text").alias("_pieces"))
    free = lambda x: ~F.exists("_taken", lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"]))
    seen = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["hit"].alias("hit"), spans.ahead("_pieces", x["start"], CONTEXT).alias("ahead"))
    checked = checked.select("key", "text", *(F.transform(k if k in BASE else F.filter(k, free), seen).alias(k) for k in KINDS))

    def cell(i: int, kind: str):
        def of(x: Column) -> Column:
            long = F.when(F.length(x["hit"]) < 12, "s").when(F.length(x["hit"]) < 24, "m").otherwise("l")
            return F.struct(
                F.lit(i).alias("k"), x["start"].alias("start"), x["end"].alias("end"),
                F.concat_ws("|", F.lit(kind), *(v.cast("string") for v in votes(kind, x["hit"], x["ahead"])), long).alias("cell"),
            )

        return of

    return checked.select("key", F.length("text").alias("n_chars"), F.concat(*(F.transform(k, cell(i, k)) for i, k in enumerate(KINDS))).alias("spans"))


def em(cells: list[tuple[str, int]]) -> dict[str, float]:
    """The probability of each cell to be personal data, by EM over the vote counts.

    Labeler j says v of a true (false) span with probability yes[j][v] (no[j][v]); each kind has a prior. The base
    kinds start likely, the further kinds less so, and labelers start better than chance, which tells the classes apart.
    """
    rows = [(c.split("|"), n) for c, n in cells]
    says = (-1, 0, 1)
    prior = {k: (0.9 if k in BASE else 0.3) for k in KINDS}
    yes = [{-1: 0.1, 0: 0.3, 1: 0.6} for _ in range(3)]
    no = [{-1: 0.5, 0: 0.4, 1: 0.1} for _ in range(3)]
    post: list[float] = []
    for _ in range(EM_ROUNDS):
        post = []
        for (kind, *v, _), _n in rows:
            a = math.log(prior[kind]) + sum(math.log(yes[j][int(v[j])]) for j in range(3))
            b = math.log(1 - prior[kind]) + sum(math.log(no[j][int(v[j])]) for j in range(3))
            post.append(1 / (1 + math.exp(min(60.0, b - a))))
        for kind in prior:
            w = [(p * n, n) for p, ((k, *_), n) in zip(post, rows) if k == kind]
            true, total = sum(x for x, _ in w), sum(n for _, n in w)
            prior[kind] = (true + (9 if kind in BASE else 3)) / (total + 10)
        for j in range(3):
            for table, weight in ((yes, lambda p: p), (no, lambda p: 1 - p)):
                start = {-1: 1.0, 0: 3.0, 1: 6.0} if table is yes else {-1: 5.0, 0: 4.0, 1: 1.0}
                for p, ((_, *v, _), n) in zip(post, rows):
                    start[int(v[j])] += weight(p) * n
                total = sum(start.values())
                table[j] = {s: start[s] / total for s in says}
    return {c: p for (c, _), p in zip(cells, post)}


def features(cell: str) -> list[float]:
    kind, *v, long = cell.split("|")
    return [1.0, *(float(kind == k) for k in KINDS), *(float(x == s) for x in v for s in ("-1", "1")), float(long == "s"), float(long == "l")]


def classifier(cells: list[tuple[str, int]]) -> dict[str, float]:
    """Each cell's probability by a logistic regression trained on EM's posteriors."""
    soft = em(cells)
    x = [features(c) for c, _ in cells]
    weight = [math.log1p(n) for _, n in cells]
    total = sum(weight) or 1.0
    w = [0.0] * (len(x[0]) if x else 0)
    out = [0.5] * len(x)
    for _ in range(STEPS):
        out = [1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, f)))))) for f in x]
        for k in range(len(w)):
            slope = sum(m * (p - soft[c]) * f[k] for (c, _), m, p, f in zip(cells, weight, out, x)) / total
            w[k] -= 2.0 * (slope + 0.001 * w[k])
    return {c: p for (c, _), p in zip(cells, out)}


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, spans array<struct<k, start, end, cell, p>>): the base spans and those that the classifier adds."""
    found = stash(candidates(docs, key, text))
    counts = found.select(F.explode("spans.cell").alias("cell")).groupBy("cell").count().orderBy("cell")
    chance = classifier([(r["cell"], r["count"]) for r in counts.collect()])  # at most kinds x 27 x 3 cells
    p = F.create_map(*(F.lit(v) for kv in sorted(chance.items()) for v in kv)) if chance else F.expr("cast(map() as map<string,double>)")
    scored = F.transform("spans", lambda x: F.struct(x["k"], x["start"], x["end"], x["cell"], F.element_at(p, x["cell"]).alias("p")))
    return found.select("key", "n_chars", F.filter(scored, lambda x: (x["k"] < len(BASE)) | (x["p"] >= CUT)).alias("spans")).withColumnRenamed("key", key)


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts and digest of the base spans, and all spans.

    Spans are kind:start:end in code points, by kind (the base ones first), then start.
    """
    found = detect(docs, key, text)
    of = lambda i: F.filter("spans", lambda x: x["k"] == i)
    lists = found.select(key, *(of(i).alias(k) for i, k in enumerate(KINDS)))
    return lists.select(
        key,
        *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(F.array_join(spans.rendered(*((k, F.col(k)) for k in BASE)), ","), 256).alias("base_sha256"),
        F.array_join(spans.rendered(*((k, F.col(k)) for k in KINDS)), ",").alias("spans"),
    )


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with every span that detect() finds replaced by its kind in brackets.

    Rows go to the shared folder with their candidates, are counted there, and masked when read again: no text is shuffled,
    the texts are searched once, and repeated keys don't matter. Null texts stay null.
    """
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text).alias("text"))
    found = stash(candidates(row, "row", "text"))
    counts = found.select(F.explode("spans.cell").alias("cell")).groupBy("cell").count().orderBy("cell")
    chance = classifier([(r["cell"], r["count"]) for r in counts.collect()])
    good = [c for c, p in sorted(chance.items()) if p >= CUT]
    marks = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    ok = lambda x: (x["k"] < len(BASE)) | x["cell"].isin(good or [""])
    cut = F.transform(F.filter("spans", ok), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.element_at(marks, x["k"] + 1).alias("mark")))
    out = spans.masked(found.select("key", cut.alias("_cut"), F.col(f"key.`{text}`").cast("string").alias("_text")), "_text", "_cut")
    return out.select(*(F.col("_text").alias(c) if c == text else F.col(f"key.`{c}`").alias(c) for c in docs.columns))
