from pyspark.sql import functions as F

from rollcall.operators import grid, layout
from rollcall.plans import convert
from rollcall.sources.tables import BLOCKS, IMAGES, WORDS

H, W = 842.0, 595.0


def word(page, block, line, n, text, x0, y0, width=30.0, height=10.0, source="d", rotation=0):
    x0, y0 = float(x0), float(y0)
    return (source, page, block, line, n, text, x0, y0, x0 + width, y0 + height, W, H, rotation)


def row(block, ordinal, nia, surnames, given, x, page=1, more=()):
    """A student's block on a page turned by 90 degrees: raw y is the column, raw x the row."""
    turned = dict(page=page, block=block)
    out = []

    def put(line, text, y):
        for n, w in enumerate(text.split(" ")):
            out.append(("d", page, block, line, n, w, x, y - 20.0 * n, x + 10.0, y - 20.0 * n + 15.0, W, H, 90))

    del turned
    put(0, str(ordinal), 800.0)
    put(1, nia, 740.0)
    put(2, f"{surnames}, {given}", 560.0)
    for line, (text, y) in enumerate(more, 3):
        put(line, text, y)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, WORDS)


def header(page, y, pairs):
    return [word(page, 90 + int(y), 0, n, t, x, y) for n, (t, x) in enumerate(pairs)]


def test_rotation(spark):
    df = layout.visual(frame(spark, [("d", 1, 0, 0, 0, "a", 10.0, 20.0, 30.0, 25.0, 100.0, 200.0, r) for r in (0, 90, 180, 270)]))
    got = [(r.vx0, r.vy0, r.vx1, r.vy1) for r in df.orderBy("rotation").collect()]
    assert got == [(10, 20, 30, 25), (175, 10, 180, 30), (70, 175, 90, 180), (20, 70, 25, 90)]


def test_students_with_optional_cells(spark):
    words = row(1, 1, "0071", "Mas Pi", "Pau", 100.0, more=[("R", 690.0), ("Física", 300.0)]) + row(2, 2, "0072", "Gil", "Zoe", 130.0) + row(3, 3, "12x", "Bad", "Row", 160.0)
    got = {r.ordinal: r for r in layout.students(frame(spark, words)).collect()}
    assert set(got) == {1, 2}
    assert (got[1].nia, got[1].surnames, got[1].given_names, got[1].repetix, got[1].materia) == ("0071", "Mas Pi", "Pau", "R", "Física")
    assert (got[2].repetix, got[2].materia) == ("", "")


def test_wrapped_cells_join_their_row_and_never_cross_an_anchor(spark):
    words = row(1, 1, "1", "Mas", "Pau", 100.0) + row(5, 2, "2", "Gil", "Zoe", 140.0)
    words += [("d", 1, 2, 0, 0, "Lluc", 106.0, 540.0, 116.0, 555.0, W, H, 90), ("d", 1, 3, 0, 0, "Química", 107.0, 200.0, 117.0, 215.0, W, H, 90)]
    df = frame(spark, words)
    got = {r.ordinal: r for r in layout.wrapped(df, layout.students(df)).collect()}
    assert (got[1].given_names, got[1].full_name, got[1].materia) == ("Pau Lluc", "Mas, Pau Lluc", "Química")
    assert got[2].given_names == "Zoe"
    barred = words + [("d", 1, 2, 1, 0, "9", 104.0, 800.0, 114.0, 810.0, W, H, 90), ("d", 1, 2, 2, 0, "9", 104.0, 740.0, 114.0, 750.0, W, H, 90)]
    df = frame(spark, barred)
    assert {r.given_names for r in layout.wrapped(df, layout.students(df)).collect()} == {"Pau", "Zoe"}


def test_signature(spark):
    general = [("ORDE", 10), ("NIA", 60), ("REPETIX", 120), ("COGNOMS", 200), ("I", 240), ("NOM", 260), ("MATÈRIA", 400)]
    fp = [("ORDE", 10), ("NIA", 60), ("COGNOMS", 200), ("I", 240), ("NOM", 260), ("MÒDUL", 400)]
    split = header(3, 100.0, general[:3]) + header(3, 140.0, general[3:])
    df = frame(spark, header(1, 100.0, general) + header(2, 100.0, fp) + split + header(4, 100.0, general[:-1]))
    assert [r.signature_pages for r in layout.signature_pages(df).collect()] == [[1, 2]]


def test_anchors(spark):
    words = header(1, 50.0, [("GRUP", 10), (":", 45), ("1A", 60), ("-", 95), ("ESO", 130), ("TUTOR", 300), (":Pau", 340), ("Mas", 380)])
    words += header(1, 80.0, [("*", 2), ("CURS", 35), ("1r", 80), ("ESO", 120), ("NIA", 200), ("x", 240)]) + header(2, 50.0, [("GRUP", 10), ("TUTOR", 300)])
    df = frame(spark, words)
    got = {r.page: (r.group_raw, r.group_code, r.tutor) for r in layout.group_anchors(df).collect()}
    assert got == {1: ("1A - ESO", "1A", "Pau Mas"), 2: (None, None, None)}
    assert [(r.course, r.decorated) for r in layout.course_anchors(df).collect()] == [("1r ESO", True)]


def photos(spark, boxes):
    rows = [("p", 1, i + 1, x, y, x + 77.0, y + 95.0, 300, 400, W, H) for i, (x, y) in enumerate(boxes)]
    return spark.createDataFrame(rows, IMAGES)


def blocks(spark, items):
    rows = [("p", 1, i, t, x, y, x + 70.0, y + 9.0, 1, 9.0) for i, (t, x, y) in enumerate(items)]
    return spark.createDataFrame(rows, BLOCKS)


def test_grid_pairs_merges_and_fills_slots(spark):
    images = photos(spark, [(50.0, 178.0), (144.0, 180.0), (50.0, 301.0)]).union(spark.createDataFrame([("p", 1, 99, 0.0, 5.0, 500.0, 60.0, 9, 9, W, H)], IMAGES))
    text = blocks(spark, [("Mas Pi,", 52.0, 276.0), ("Pau", 52.0, 286.0), ("Gil, Zoe", 146.0, 278.0), ("Soto, Ana", 52.0, 400.0), ("Nadal, Pol", 146.0, 400.0), ("Fotografia no disponible", 150.0, 340.0)])
    slots = grid.roster(grid.portraits(images), text, grid.missing_markers(text))
    got = {(r.row, r.column): (r.surnames, r.given_names, r.xref > 0) for r in slots.collect()}
    assert got == {(1, 1): ("Mas Pi", "Pau", True), (1, 2): ("Gil", "Zoe", True), (2, 1): ("Soto", "Ana", True), (2, 2): ("Nadal", "Pol", False)}
    assert [r.id for r in grid.numbered_roster(slots).orderBy("id").collect()] == [1, 2, 3, 4]
    pages = spark.createDataFrame([("p", 1, W, H), ("p", 2, H, W)], "source string, page int, page_w double, page_h double")
    assert {r.page: r.issues for r in grid.page_issues(slots, pages).collect()} == {1: [], 2: ["landscape", "no_grid"]}


def test_row_clusters_follow_the_running_mean(spark):
    boxes = spark.createDataFrame([("p", 1, i, 0.0 + i, y, 5.0 + i, y + 5) for i, y in enumerate([100.0, 110.0, 116.0, 140.0])], "source string, page int, id int, x0 double, y0 double, x1 double, y1 double")
    assert {r.id: (r.row, r.column) for r in grid.row_clusters(boxes).collect()} == {0: (1, 1), 1: (1, 2), 2: (1, 3), 3: (2, 1)}


def test_markers_from_single_words(spark):
    rows = [word(1, 1, 0, 0, "FOTOGRAFIA", 100, 200, source="q"), word(1, 1, 1, 0, "NO", 110, 212, source="q"), word(1, 1, 2, 0, "DISPONIBLE", 105, 224, source="q")]
    none = blocks(spark, [("x", 1.0, 1.0)])
    got = grid.missing_markers(none, frame(spark, rows)).collect()
    assert [(r.x0, r.y0, r.x1, r.y1) for r in got] == [(100, 200, 140, 234)]


def test_whole_flow(spark):
    head = [("ORDE", 10), ("NIA", 60), ("COGNOMS", 200), ("I", 240), ("NOM", 260), ("MÒDUL", 400)]
    words = header(1, 20.0, head) + header(1, 40.0, [("GRUP", 10), ("1A", 60), ("TUTOR", 300), ("Ona", 340)]) + header(1, 60.0, [("CURS", 10), ("1r", 60)])
    words += row(1, 1, "0071", "Mas Pi", "Pau", 100.0) + row(2, 2, "0072", "Gil", "Zoe", 130.0)
    found, members = convert.references(frame(spark, words))
    assert [(r.group_code, r.course, r.tutor, r.issues) for r in found.collect()] == [("1A", "1r", "Ona", [])]
    text = blocks(spark, [("MAS PI, PAU", 52.0, 278.0), ("Roca, Mar", 146.0, 278.0)])
    roster = convert.rosters(photos(spark, [(50.0, 178.0), (144.0, 180.0)]), text, grid.missing_markers(text))
    groups = spark.createDataFrame([("p", "1a")], "source string, group_code string")
    rows, links, outcomes = convert.link_rosters(roster, groups, found, members)
    assert {r.id: (r.nia, r.method) for r in rows.collect()} == {1: ("0071", "exact"), 2: ("", "")}
    assert [(r.status, r.n_matched, r.n_unmatched) for r in convert.items(roster, outcomes, 1).collect()] == [("WARNING", 1, 1)]
    assert F.col("x") is not None
