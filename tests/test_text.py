import pytest
from pyspark.sql import functions as F

from rollcall.functions import text as tx


def values(spark, column, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    return [r.v for r in df.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def test_cleaning_and_predicates(spark):
    assert values(spark, tx.clean_spaces, ["  a \t b\n", "", None]) == ["a b", "", None]
    assert values(spark, tx.is_numeric, [" 12 ", "1a", ""]) == [True, False, False]
    assert values(spark, tx.is_name_component, ["O'Neil-Mas", "A1", ""]) == [True, False, False]


def test_person_names(spark):
    got = values(spark, tx.person_name, ["Ferrer  Vidal, Núria", "NoComma Here", "A, B, C", "A,B", ", B", "A B,", "A ,B", "D’Or, Anna-Lí"])
    assert [None if g is None else (g.surnames, g.given_names) for g in got] == [("Ferrer Vidal", "Núria"), None, None, None, None, None, None, ("D’Or", "Anna-Lí")]


def test_header_functions(spark):
    assert values(spark, tx.header_token, ["Matèria:", "MÒDUL", "R-1"]) == ["MATERIA", "MODUL", "R1"]
    assert values(spark, tx.label_key, ["Matèria:", "Grup"]) == ["MATÈRIA", "GRUP"]
    assert values(spark, tx.group_code, ["1A - First", " 2B ", "", None, "3-C"]) == ["1A", "2B", None, None, "3-C"]
    assert values(spark, tx.course_key, ["1r d'ESO (LOE)"]) == ["1R D ESO LOE"]
    got = spark.range(1).select(tx.header_value(F.array(*map(F.lit, [":", "a", "***", ":b "]))).alias("v"), tx.header_value(F.array(F.lit(":"))).alias("w")).first()
    assert (got.v, got.w) == ("a b", None)


@pytest.mark.parametrize("tier,want", [("exact", "garcía-peña  mc"), ("structural", "garcía peña mc"), ("folded", "garcia pena mc"), ("compact", "garciapenamc")])
def test_key_tiers(spark, tier, want):
    want = " ".join(want.split())
    assert values(spark, lambda c: tx.name_key(c, tier), [" García-Peña  MC", "Straße"])[0] == want
    assert values(spark, lambda c: tx.name_key(c, tier, exact=True), ["García-Peña  MC"])[0] == want


def test_unknown_tier():
    with pytest.raises(ValueError):
        tx.name_key(F.lit("a") if False else None, "nope")


def test_name_case(spark):
    given = ["GARCÍA DE LA FUENTE", "DE", "O'NEIL-MCKAY", "JUAN XIV", "McDonald I PUIG", "D’ARC", "MC", "", None]
    assert values(spark, tx.name_case, given) == ["García de la Fuente", "De", "O'Neil-McKay", "Juan XIV", "McDonald i Puig", "D’Arc", "MC", "", None]


def test_similarity_and_subsequences(spark):
    df = spark.createDataFrame([("abcd", "abed", ["a", "b"], ["a", "x", "b"]), ("", "", [], ["a"]), ("ab", "cd", ["b", "a"], ["a", "x", "b"])], "a string, b string, s array<string>, l array<string>")
    got = df.select(tx.similarity(F.col("a"), F.col("b")).alias("v"), tx.differently_long_subsequence(F.col("s"), F.col("l")).alias("w")).collect()
    assert [r.v for r in got] == [0.75, 1.0, 0.0] and [r.w for r in got] == [True, False, False]


def test_names_of_files(spark):
    assert values(spark, tx.safe_file_name, ['a/b:"c"', " ._x_. ", "???", None, "  "]) == ["a_b__c", "x", "grupo", "grupo", "grupo"]
    assert values(spark, tx.safe_sheet_name, ["'a[b]'", "x" * 40, None]) == ["a_b_", "x" * 31, "Alumnado"]
    assert values(spark, tx.recased_stem, ["MAS I PI, ANNA__2", "SOLA"]) == ["Mas i Pi, Anna__2", "Sola"]


def test_keys_are_short_expressions_and_fold_every_long_letter(spark):
    for tier in tx.TIERS:
        made = str(tx.name_key(F.col("x"), tier))
        assert made.count("replace(") < 10 and " map(" not in made and "(map(" not in made
    letters = [(k, v.lower()) for k, v in tx.LONG.items()]
    rows = spark.createDataFrame(letters, "x string, plain string")
    got = rows.select("x", "plain", tx.strip_marks(F.col("x")).alias("bare")).collect()
    assert len(got) > 10 and all(r.bare.lower() == r.plain for r in got if r.x not in "ßẞ")
