from pyspark.sql import functions as F

from rollcall.operators import assign, classes, enrich, match, redact


def test_an_anchor_without_value_resets(spark):
    df = spark.createDataFrame([("d", 1, "g", "A"), ("d", 2, "s", None), ("d", 3, "g", None), ("d", 4, "s", None), ("e", 1, "s", None)], "src string, seq int, kind string, code string")
    got = assign.carry_forward(df, ["src"], ["seq"], F.col("kind") == "g", ["code"], "own_").collect()
    assert {(r.src, r.seq): r.own_code for r in got} == {("d", 1): "A", ("d", 2): "A", ("d", 3): None, ("d", 4): None, ("e", 1): None}


def test_runs_need_sequence_and_a_new_section_to_restart(spark):
    rows = [("ok", i, o, s) for i, (o, s) in enumerate([(1, 1), (2, 1), (1, 2), (2, 2)])]
    rows += [("same", i, o, 1) for i, o in enumerate([1, 2, 1])] + [("gap", 0, 1, 1), ("gap", 1, 3, 1)]
    df = spark.createDataFrame(rows, "g string, seq int, o int, section int")
    got = {r.g: (r.n_rows, r.n_runs, r.in_sequence, r.restarts_ok) for r in assign.run_verdicts(df, ["g"], ["seq"], "o", "section").collect()}
    assert got == {"ok": (4, 2, True, True), "same": (3, 2, True, False), "gap": (2, 1, False, True)}


def test_modes_and_courses(spark):
    df = spark.createDataFrame([("g", 1, "b", "1r ESO"), ("g", 2, "a", "1R ESO A"), ("g", 3, "a", "1r eso"), ("g", 4, "b", None), ("h", 5, "", "2n"), ("h", 6, None, "3r")], "g string, seq int, v string, c string")
    assert {r.g: r["mode"] for r in classes.first_mode(df, ["g"], "v", "seq").collect()} == {"g": "b", "h": None}
    got = {r.g: (r.c, r.courses, r.compatible) for r in classes.resolve_course(df, ["g"], "c", "seq").collect()}
    assert got == {"g": ("1R ESO A", ["1r ESO", "1R ESO A"], True), "h": ("2n", ["2n", "3r"], False)}


def test_classes_carry_codes(spark):
    base = dict(source="d", page=1, full_name="", surnames="S", given_names="G", group_raw="1A - x", group_code="1A", tutor="T", course="1r", section=1)
    rows = [dict(base, seq=1, ordinal=1, nia="1"), dict(base, seq=2, ordinal=2, nia="1"), dict(base, seq=3, ordinal=1, nia="", group_code=None, group_raw=None, course=None, tutor=None)]
    schema = "source string, page int, full_name string, surnames string, given_names string, group_raw string, group_code string, tutor string, course string, section int, seq int, ordinal int, nia string"
    found, members = classes.build(spark.createDataFrame(rows, schema))
    assert {r.class_key: r.issues for r in found.collect()} == {"group:1a": ["repeated_number"], "unassigned:1": ["no_course", "no_group"]}
    assert members.count() == 2


def names(spark, rows):
    return spark.createDataFrame([("r", i, *x) for i, x in enumerate(rows)], "roster string, id int, surnames string, given_names string")


def test_link_stages(spark):
    photos = names(spark, [("Puig Mas", "Anna"), ("Puig-Soler", "Joan"), ("Peña", "Íñigo"), ("De La Roca", "Pau"), ("Ferrandiz", "Miquel"), ("Soto", "Ana Maria"), ("Nadal", "Zoe"), ("Gil", "Pol"), ("Vidal", "Marc")])
    refs = names(spark, [("PUIG MAS", "ANNA"), ("Puig Soler", "Joan"), ("Pena", "Inigo"), ("Delaroca", "Pau"), ("Ferrandis", "Miquel"), ("Soto", "Ana"), ("Gil", "Pol"), ("GIL", "POL"), ("Vidal", "Marta")])
    links, outcomes = match.link(photos, refs, ["roster"])
    assert {(r.id, r.ref_id, r.method) for r in links.collect()} == {(0, 0, "exact"), (1, 1, "structural"), (2, 2, "folded"), (3, 3, "compact"), (4, 4, "fuzzy"), (5, 5, "given_tokens")}
    assert {r.id: r.outcome for r in outcomes.collect()} == {**dict.fromkeys(range(6), "matched"), 6: "unmatched", 7: "ambiguous", 8: "ambiguous"}
    rows = enrich.enrich(photos, links, refs.withColumn("nia", F.concat(F.lit("n"), "id")), ["roster"], ["nia"])
    assert {r.id: r.nia for r in rows.collect()} == {**{i: f"n{i}" for i in range(6)}, 6: "", 7: "", 8: ""}
    assert {r.id for r in match.unresolved(photos, refs, links, ["roster"]).collect()} == {6, 7, 8}
    assert match.partial_names(photos, refs, links, ["roster"]).first().relation == "longer"


def test_rosters_are_linked_apart(spark):
    rows = spark.createDataFrame([("a", 1, "Mas", "Pau"), ("b", 1, "Mas", "Pau")], "roster string, id int, surnames string, given_names string")
    links = match.cascade(rows, rows, ["roster"])
    assert {(r.roster, r.id, r.ref_id, r.method) for r in links.collect()} == {("a", 1, 1, "exact"), ("b", 1, 1, "exact")}


def test_pool_prefers_own_group_then_complete_rows(spark):
    rows = [("r", "s1", 1, "7", "Mas", "Pau", "", "", "2B"), ("r", "s2", 1, "7", "Mas", "Pau", "R", "", "1A"), ("r", "s3", 1, "", "Mas", "Pau", "", "", "9"), ("r", "s4", 1, "", "MAS", "PAU", "", "x", "9")]
    df = spark.createDataFrame(rows, "roster string, source string, seq int, nia string, surnames string, given_names string, repetix string, materia string, g string")
    assert {r.source for r in match.pool(df, ["roster"], F.col("g") == "1A").collect()} == {"s2", "s4"}


def test_statuses_and_summary(spark):
    df = spark.createDataFrame([(False, 1, 0, 0, 0, 0), (True, 1, 0, 0, 0, 0), (False, 0, 0, 0, 0, 0), (False, 1, 2, 0, 1, 0), (False, 1, 0, 0, 1, 0), (False, 1, 0, 1, 0, 0)], "failed boolean, n_references int, n_unmatched int, n_ambiguous int, n_missing_photos int, n_issues int")
    items = enrich.statuses(df)
    assert [r.status for r in items.collect()] == ["READY", "REVIEW", "WARNING", "WARNING", "MISSING_PHOTOS", "REVIEW"]
    assert tuple(enrich.summary(items).first()) == (1, 3, 2, 2)


def test_sheet_columns(spark):
    df = spark.createDataFrame([("MAS", "PAU", "1", "R", "x")], "surnames string, given_names string, nia string, repetix string, materia string")
    assert enrich.sheet(df, repetix=True, materia=True, cased=True).collect()[0].asDict() == {"Apellidos": "Mas", "Nombre": "Pau", "NIA": "1", "REPETIX": "R", "MATÈRIA": "x"}


def test_reports_show_shapes_only(spark):
    df = spark.createDataFrame([("Puig-Mas,", False), ("12345", False), ("7", True), ("NIA", False)], "t string, o boolean")
    assert [r.v for r in df.select(redact.mask(F.col("t"), F.col("o")).alias("v")).collect()] == ["<L7:COMMA:HYPHEN>", "<NUM:5>", "ORDE=7", "NIA"]
    got = spark.range(1).select(redact.safe_issues(F.array(F.lit("no_group"), F.lit("Name: X"))).alias("v")).first().v
    assert got == ["no_group", "other"]
