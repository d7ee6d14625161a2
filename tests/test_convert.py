from pyspark.sql import functions as F

from rollcall.plans import convert
from rollcall.sources.tables import WORDS
from test_layout import frame, header, row, word

PAGES = "source string, page int, issues array<string>"
ROSTER = "source string, id int, xref int, surnames string, given_names string"
HEAD = [("ORDE", 10), ("NIA", 60), ("COGNOMS", 200), ("I", 240), ("NOM", 260), ("MÒDUL", 400)]


def report():
    words = header(1, 20.0, HEAD) + header(1, 40.0, [("GRUP", 10), ("1A", 60), ("TUTOR", 300), ("Ona", 340)]) + header(1, 60.0, [("CURS", 10), ("1r", 60)])
    return words + row(1, 1, "0071", "Mas Pi", "Pau", 100.0) + row(2, 2, "0072", "Gil", "Zoe", 130.0)


def test_invalid_and_failed_rosters(spark):
    found, members = convert.references(frame(spark, report()))
    roster = spark.createDataFrame([(s, 1, 5, "Mas Pi", "Pau") for s in ("good", "bad")], ROSTER)
    groups = spark.createDataFrame([("good", "1a"), ("bad", "1a")], "source string, group_code string")
    pages = spark.createDataFrame([("good", 1, []), ("bad", 1, ["landscape"]), ("empty", 1, ["no_grid"])], PAGES)
    failures = spark.createDataFrame([("broken",)], "source string")
    rows, links, outcomes = convert.link_rosters(roster, groups, found, members, pages)
    assert {r.roster: (r.nia, r.method) for r in rows.collect()} == {"good": ("0071", "exact"), "bad": ("", "")}
    assert [r.roster for r in links.collect()] == ["good"]
    assert {(r.roster, r.outcome) for r in outcomes.collect()} == {("good", "matched"), ("bad", "unmatched")}
    assert {r.roster: r.issues for r in convert.match_issues(outcomes, pages).collect()} == {"good": [], "bad": ["roster_invalid"], "empty": ["roster_invalid"]}
    assert [r.issues for r in convert.match_issues(outcomes.where("roster = 'bad'")).collect()] == [["match_incomplete"]]
    status = {r.roster: (r.status, r.n_issues) for r in convert.items(roster, outcomes, 1, pages, failures).collect()}
    assert status == {"good": ("READY", 0), "bad": ("WARNING", 1), "empty": ("WARNING", 1), "broken": ("REVIEW", 0)}


def test_documents_without_header_or_students(spark):
    words = report() + [word(1, 1, 0, 0, "text", 10, 10, source="plain")]
    words += [(("head",) + w[1:]) for w in header(1, 20.0, HEAD)] + [(("rows",) + w[1:]) for w in row(1, 1, "0071", "Mas", "Pau", 100.0)]
    df = spark.createDataFrame(words, WORDS)
    found, members = convert.references(df)
    got = {r.source: r.issues for r in convert.reference_issues(df, found).collect()}
    assert got == {"d": [], "plain": ["no_signature", "no_students"], "head": ["no_students"], "rows": ["no_signature"]}
    assert {r.source: r.issues for r in convert.reference_issues(df, found.where(F.lit(False))).collect()}["d"] == ["no_classes"]
    groups = spark.createDataFrame([("p", "1a"), ("q", None)], "source string, group_code string")
    counts = {r.roster: tuple(r)[1:] for r in convert.pool_counts(groups, df, found, members).collect()}
    assert counts == {"p": (4, 1, 3, 1, 2, 2), "q": (4, 1, 3, 1, 2, 0)}
