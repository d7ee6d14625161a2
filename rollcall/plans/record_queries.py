"""Registered queries of the record part: positioned words, photo grids, classes, linkage of whole rosters, file names and
reports, over pages laid out from the driver's tables. Every order is a page: its lines are students or photo slots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import assign, classes, enrich, grid, layout, match, redact
from ..sources import sinks
from ..sources.shared import stash
from . import convert
from .queries import SURNAMES, WORD, cascade_sql, fuzzy_sql, named, register, table

W, H = 595.0, 842.0
#: Lines of pages in a task, about: some dozen words come from each, and more than fit in memory would be sorted on disk.
PAGE_LINES = 50_000
# One line of an order with its number k from 1, and the names that stand for people.
LINES = """s AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)::INT AS k FROM lineitem),
    t AS (SELECT s.*, p_name, p_type, p_brand, o_custkey, o_orderstatus, o_orderpriority, o_orderdate, o_totalprice
        FROM s JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").withColumn("k", F.row_number().over(order))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type", "p_brand")
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    return rows.join(parts, "l_partkey").join(orders, "l_orderkey")


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lines() with their page, spread by it: lines go to their parts and to their pages, and what is made of them stays there.
    Numbers k count all lines of an order, also those of no part or of several, so those are sorted out after."""
    order = Window.partitionBy("page").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    parts = table(spark, sf_dir, "part").groupBy(F.col("p_partkey").alias("l_partkey")).agg(F.collect_list(F.struct("p_name", "p_type")).alias("parts"))
    orders = table(spark, sf_dir, "orders").withColumn("page", F.col("o_orderkey").cast("int")).drop("o_orderkey")
    rows = table(spark, sf_dir, "lineitem").withColumn("page", F.col("l_orderkey").cast("int")).join(parts, "l_partkey", "left")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table(spark, sf_dir, "lineitem").count() // PAGE_LINES))
    rows = rows.repartition(tasks, "page").withColumn("k", F.row_number().over(order)).join(orders, "page")
    return rows.select("*", F.inline("parts")).drop("parts")


def put(rows: DataFrame) -> DataFrame:
    """The words of the texts `put` (block, line, text, x, y, turned) of each row; on a turned page words follow each other
    upwards in raw coordinates."""
    src = rows.select("source", "page", F.explode("put").alias("t")).select("source", "page", "t.*").where("text is not null")
    src = src.select("source", "page", "block", "line", "x", "y", "turned", F.posexplode(F.split("text", " ")).alias("word_no", "text"))
    step, x, y = F.col("word_no") * 20.0, F.col("x"), F.col("y")
    box = {"x0": (x, x + 2 * step), "y0": (y - step, y), "x1": (x + 10.0, x + 2 * step + 30.0), "y1": (y - step + 15.0, y + 10.0)}
    return src.select(
        "source", "page", "block", "line", "word_no", "text", *(F.when(F.col("turned"), a).otherwise(b).alias(n) for n, (a, b) in box.items()),
        F.lit(W).alias("page_w"), F.lit(H).alias("page_h"), F.when(F.col("turned"), 90).otherwise(0).alias("rotation"),
    )


def text_at(block, line: int, text, x, y: float, turned: bool, when=None):
    """What put() writes: `text` where `when` is true, at x and y."""
    text = text if when is None else F.when(when, text)
    return F.struct(block.cast("int").alias("block"), F.lit(line).alias("line"), text.alias("text"), x.cast("double").alias("x"), F.lit(float(y)).alias("y"), F.lit(turned).alias("turned"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report pages: headers where the order has them, and a row for each line, read sideways; spread by page."""
    rows = page_lines(spark, sf_dir).withColumn("source", F.concat(F.lit("c"), F.col("o_custkey").cast("string")))
    k, first, ten = F.col("k"), F.col("k") == 1, F.lit(10)
    x = F.lit(100) + k * 30
    group = F.concat(F.lit("GRUP Q"), F.substring("o_orderpriority", 1, 1), F.lit(" - ESO TUTOR : "), F.col("p_type"), F.lit(" "), F.col("o_orderstatus"))
    course = F.concat(F.lit("CURS C"), F.year("o_orderdate").cast("string"), F.lit(" ESO"))
    return put(rows.withColumn("put", F.array(
        text_at(F.lit(9000), 0, F.lit("ORDE NIA COGNOMS I NOM MÒDUL"), ten, 20, False, first),
        text_at(F.lit(9001), 0, group, ten, 40, False, first & (F.col("o_orderstatus") != "P")),
        text_at(F.lit(9002), 0, course, ten, 60, False, first & (F.col("o_totalprice") > 100000)),
        text_at(k, 0, k.cast("string"), x, 800, True), text_at(k, 1, F.lpad(F.col("l_partkey").cast("string"), 7, "0"), x, 740, True),
        text_at(k, 2, F.concat("p_name", F.lit(", "), "p_type"), x, 560, True), text_at(k, 3, F.lit("R"), x, 690, True, F.col("l_returnflag") == "R"),
        text_at(k, 4, F.lit("Física"), x, 300, True, F.col("l_linestatus") == "F"),
    )))


# By document and page: the student rows as the words say, with the headers that govern them.
ASSIGNED = f"""{LINES},
    h AS (SELECT 'c' || o_custkey AS source, l_orderkey::INT AS page,
        CASE WHEN o_orderstatus <> 'P' THEN struct_pack(raw := 'Q' || o_orderpriority[1] || ' - ESO', code := 'Q' || o_orderpriority[1], tutor := p_type || ' ' || o_orderstatus) END AS g,
        CASE WHEN o_totalprice > 100000 THEN 'C' || year(o_orderdate) || ' ESO' END AS c FROM t WHERE k = 1),
    f AS (SELECT source, page, last_value(g IGNORE NULLS) OVER w AS g, last_value(c IGNORE NULLS) OVER w AS course, count(c) OVER w AS section
        FROM h WINDOW w AS (PARTITION BY source ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    a AS (SELECT f.source, f.page, k AS ordinal, lpad(l_partkey::VARCHAR, 7, '0') AS nia, p_name AS surnames, p_type AS given_names, CASE WHEN l_returnflag = 'R' THEN 'R' ELSE '' END AS repetix,
        CASE WHEN l_linestatus = 'F' THEN 'Física' ELSE '' END AS materia, g.raw AS group_raw, g.code AS group_code, g.tutor AS tutor, course, section,
        row_number() OVER (PARTITION BY f.source ORDER BY f.page, k) AS seq FROM t JOIN f ON f.page = l_orderkey)"""


@register(f"WITH {ASSIGNED} SELECT source, page, ordinal, nia, surnames, given_names, repetix, materia, group_raw, group_code, tutor, course, section FROM a")
def layout_assigned(spark, sf_dir):
    """Words to students with the group and course in force, from document to document and page to page."""
    found = layout.assigned(words(spark, sf_dir))
    return found.select("source", "page", "ordinal", "nia", "surnames", "given_names", "repetix", "materia", "group_raw", "group_code", "tutor", "course", "section")


@register(f"WITH {LINES} SELECT 'c' || o_custkey AS source, count(DISTINCT l_orderkey)::INT AS n_pages, list_sort(list(DISTINCT l_orderkey::INT)) AS signature_pages FROM t GROUP BY 1")
def layout_signatures(spark, sf_dir):
    return layout.signature_pages(words(spark, sf_dir)).select("source", F.size("signature_pages").alias("n_pages"), "signature_pages")


CLASSES = f"""{ASSIGNED}, r AS (SELECT *, coalesce('group:' || lower(group_code), 'unassigned:' || page) AS class_key FROM a),
    n1 AS (SELECT *, row_number() OVER w AS n, lag(section) OVER w AS before FROM r WINDOW w AS (PARTITION BY source, class_key ORDER BY seq)),
    n2 AS (SELECT *, sum(CASE WHEN ordinal = 1 AND n > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY source, class_key ORDER BY seq) AS run FROM n1),
    n3 AS (SELECT *, row_number() OVER (PARTITION BY source, class_key, run ORDER BY seq) AS place FROM n2),
    tutors AS (SELECT source, class_key, tutor FROM (SELECT source, class_key, tutor, row_number() OVER (PARTITION BY source, class_key ORDER BY count(*) DESC, min(seq)) AS n
        FROM r WHERE tutor <> '' GROUP BY source, class_key, tutor) WHERE n = 1),
    courses AS (SELECT source, class_key, arg_min(course, seq) AS course FROM r WHERE course IS NOT NULL GROUP BY ALL),
    built AS (SELECT source, class_key, min(group_code) AS group_code, count(*)::BIGINT AS n_students, [x FOR x IN [
        CASE WHEN count(DISTINCT tutor) > 1 THEN 'tutor_differs' END, CASE WHEN count(course) = 0 THEN 'no_course' END, CASE WHEN count(DISTINCT course) > 1 THEN 'courses_differ' END,
        CASE WHEN count(group_code) = 0 THEN 'no_group' END, CASE WHEN NOT bool_and(ordinal = place) THEN 'not_in_sequence' END,
        CASE WHEN bool_or(place = 1 AND run > 0 AND before IS NOT DISTINCT FROM section) THEN 'restart_without_section' END,
        CASE WHEN count(nia) <> count(DISTINCT nia) THEN 'repeated_number' END] IF x IS NOT NULL] AS issues FROM n3 GROUP BY ALL)"""


@register(f"WITH {CLASSES} SELECT source, class_key, group_code, n_students, tutor, course, issues, len(issues) = 0 AS is_valid FROM built LEFT JOIN tutors USING (source, class_key) LEFT JOIN courses USING (source, class_key)")
def class_issues(spark, sf_dir):
    """Words to classes with their issue codes."""
    found, _ = convert.references(words(spark, sf_dir))
    return found.select("source", "class_key", "group_code", "n_students", "tutor", "course", "issues", "is_valid")


@register(f"WITH {CLASSES} SELECT source, class_key, nia, min(seq_in) AS ordinal FROM (SELECT source, class_key, nia, first_value(ordinal) OVER (PARTITION BY source, class_key, nia ORDER BY seq) AS seq_in FROM r JOIN built USING (source, class_key) WHERE len(issues) = 0 OR issues = ['repeated_number']) GROUP BY ALL")
def class_members(spark, sf_dir):
    """The members, each number once, of the classes that are valid but for repeated numbers."""
    found, members = convert.references(words(spark, sf_dir))
    good = found.where((F.size("issues") == 0) | (F.col("issues") == F.array(F.lit("repeated_number"))))
    return members.join(good.select("source", "class_key"), ["source", "class_key"], "left_semi").select("source", "class_key", "nia", "ordinal")


@register(f"""WITH {CLASSES}, d AS (SELECT 'o' || o_orderkey AS source FROM orders WHERE o_totalprice > 400000 UNION SELECT DISTINCT source FROM a),
    b AS (SELECT DISTINCT source FROM built)
    SELECT d.source, CASE WHEN b.source IS NULL THEN ['no_signature', 'no_students'] ELSE [] END AS issues FROM d LEFT JOIN b USING (source)""")
def document_issues(spark, sf_dir):
    """Documents without a known header, students or classes; orders of over 400,000 stand for a page of other text."""
    every, sheets = documents(spark, sf_dir)
    sheets = layout.read(every, sheets)
    found = classes.keys(convert.reported(every, sheets))
    return convert.reference_issues(every, found, sheets)


def documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(words, layout.pages() of them). Pages of reports and of other texts are made apart: the union of their words isn't spread by
    page any more, and all of them would move."""
    seen = words(spark, sf_dir)
    other = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("source"), F.lit(1).alias("page"))
    other = put(other.repartition("source").withColumn("put", F.array(text_at(F.lit(0), 0, F.lit("other text"), F.lit(10), 10, False))))
    return seen.unionAll(other), layout.pages(seen).unionAll(layout.pages(other))


# Photo pages: slots of four columns 94 points apart, rows 123 apart, a few points off; names below, some in two blocks,
# some missing; markers where there is no photo.
GRID = f"""{LINES},
    g AS (SELECT 'c' || o_custkey AS source, l_orderkey::INT AS page, (k - 1) // 4 + 1 AS row, (k - 1) % 4 + 1 AS "column", k, l_returnflag = 'R' AND (k - 1) % 4 > 0 AS marked, l_discount > 0 AS named, l_linestatus = 'F' AS split,
        p_name, p_type, o_orderstatus FROM t)"""


def photo_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, blocks, markers) of the photo pages."""
    rows = lines(spark, sf_dir).select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source"), F.col("l_orderkey").cast("int").alias("page"), "k", (F.lit(50.0) + F.lit(94.0) * ((F.col("k") - 1) % 4)).alias("x"), (F.lit(178.0) + F.lit(123.0) * F.floor((F.col("k") - 1) / 4)).alias("y"),
        ((F.col("l_returnflag") == "R") & ((F.col("k") - 1) % 4 > 0)).alias("marked"), (F.col("l_discount") > 0).alias("named"), (F.col("l_linestatus") == "F").alias("split"),
        (F.col("l_partkey") % 7).cast("double").alias("dx"), (F.col("l_suppkey") % 9).cast("double").alias("dy"), "p_name", "p_type",
    )
    rows = stash(rows)
    place = ["source", "page"]
    x0, y0 = F.col("x") + F.col("dx"), F.col("y") + F.col("dy")
    size = [F.lit(300).alias("width_px"), F.lit(400).alias("height_px"), F.lit(W).alias("page_w"), F.lit(H).alias("page_h")]
    images = rows.where("not marked").select(*place, F.col("k").alias("xref"), x0.alias("x0"), y0.alias("y0"), (x0 + 77).alias("x1"), (y0 + 95).alias("y1"), *size)
    logo = rows.where("k = 1").select(*place, F.lit(99).alias("xref"), F.lit(0.0).alias("x0"), F.lit(5.0).alias("y0"), F.lit(500.0).alias("x1"), F.lit(60.0).alias("y1"), *size)

    def block(rows: DataFrame, number, text, y) -> DataFrame:
        return rows.select(*place, number.cast("int").alias("block"), text.alias("text"), (F.col("x") + 2).alias("x0"), y.alias("y0"), (F.col("x") + 72).alias("x1"), (y + 9).alias("y1"), F.lit(1).alias("line_count"), F.lit(9.0).alias("line_height"))

    name, top = F.concat("p_name", F.lit(", "), "p_type"), F.col("y") + 101
    blocks = block(rows.where("named and not split"), F.col("k"), name, top).unionAll(block(rows.where("named and split"), F.col("k"), F.concat("p_name", F.lit(",")), top))
    blocks = blocks.unionAll(block(rows.where("named and split"), F.col("k") + 1000, F.col("p_type"), top + 10.5))
    blocks = blocks.unionAll(block(rows.where("marked"), F.col("k") + 2000, F.lit("Fotografia no disponible"), F.col("y") + 45))
    blocks = stash(blocks)
    return images.unionAll(logo), blocks, grid.missing_markers(blocks)


@register(f"""WITH {GRID} SELECT source, page, row::INT AS row, "column"::INT AS "column", CASE WHEN marked THEN 0 ELSE k END AS xref, CASE WHEN named THEN p_name END AS surnames,
    CASE WHEN named THEN p_type END AS given_names, CASE WHEN NOT named THEN 0 WHEN split THEN 2 ELSE 1 END AS line_count, (count(*) OVER p)::INT AS n_slots,
    (count(*) FILTER (named) OVER p)::INT AS n_names, (count(*) FILTER (marked) OVER p)::INT AS n_markers, (count(*) FILTER (marked) OVER p)::INT AS n_placed, (max("column") OVER p)::INT AS n_columns
    FROM g WINDOW p AS (PARTITION BY source, page)""")
def photo_grid(spark, sf_dir):
    """Portraits, markers, names in parts, rows, and which name belongs to which slot."""
    images, blocks, markers = photo_pages(spark, sf_dir)
    return grid.roster(grid.portraits(images), blocks, markers)


@register(f"""WITH {GRID}, n AS (SELECT source, page, count(*) AS n_slots, count(*) FILTER (named) AS n_paired, max(row) AS n_rows FROM g GROUP BY ALL),
    p AS (SELECT 'c' || o_custkey AS source, o_orderkey::INT AS page, o_orderstatus = 'P' AS wide FROM orders)
    SELECT p.source, p.page, coalesce(n_slots, 0)::BIGINT AS n_slots, coalesce(n_paired, 0)::BIGINT AS n_paired, coalesce(n_rows, 0)::INT AS n_rows, [x FOR x IN [CASE WHEN wide THEN 'landscape' END,
        CASE WHEN n_slots IS NULL THEN 'no_grid' END, CASE WHEN n_paired = 0 THEN 'no_pairs' END, CASE WHEN n_paired < n_slots THEN 'slot_without_name' END] IF x IS NOT NULL] AS issues
    FROM p LEFT JOIN n USING (page)""")
def page_issues(spark, sf_dir):
    images, blocks, markers = photo_pages(spark, sf_dir)
    wide = F.col("o_orderstatus") == "P"
    pages = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source"), F.col("o_orderkey").cast("int").alias("page"), F.when(wide, 900.0).otherwise(W).alias("page_w"), F.lit(H).alias("page_h"))
    return grid.page_issues(grid.roster(grid.portraits(images), blocks, markers), pages)


@register(f"""WITH {GRID} SELECT source, page, row_number() OVER (PARTITION BY source ORDER BY page, k)::INT AS id, p_name AS surnames, p_type AS given_names FROM g WHERE named AND o_orderstatus = 'F'""")
def numbered_roster(spark, sf_dir):
    """The named slots of a roster's pages in one running number; here a document's pages are a customer's orders with status F."""
    finished = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("int").alias("page"))
    images, blocks, markers = (df.join(finished, "page", "left_semi") for df in photo_pages(spark, sf_dir))
    return convert.rosters(images, blocks, markers).select("source", "page", "id", "surnames", "given_names")


# Rosters of a brand's smaller parts, all larger ones as references, by documents and classes of one size; every fifth is invalid.
NAMES = f"{SURNAMES} AS s, p_type || ' ' || {WORD} AS g"
FLOW = f"""m AS (SELECT 'ref' || p_size AS source, p_partkey AS id, p_brand, {NAMES} FROM part WHERE p_size > 25 AND p_size % 5 <> 0),
    ra AS (SELECT p_brand AS roster, p_partkey AS id, {NAMES} FROM part WHERE p_size <= 25),
    rb AS (SELECT roster, m.id, s, g FROM (SELECT DISTINCT roster FROM ra), m)"""
FLOW_CASCADE, FLOW_LINKS = cascade_sql(["roster"], "SELECT * FROM ra", "SELECT * FROM rb", FLOW)


def flow(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """(roster, groups, classes, members) of the linkage queries."""
    part = named(spark, sf_dir)
    roster = part.where("p_size <= 25").select(F.col("p_brand").alias("source"), F.col("p_partkey").alias("id"), F.lit(1).alias("xref"), "surnames", "given_names")
    source = F.concat(F.lit("ref"), F.col("p_size").cast("string")).alias("source")
    members = part.where("p_size > 25").select(
        source, F.col("p_brand").alias("class_key"), F.col("p_brand").alias("group_code"), F.col("p_partkey").alias("seq"), F.col("p_partkey").cast("string").alias("nia"), "surnames", "given_names",
        F.lit("").alias("repetix"), F.lit("").alias("materia"),
    )
    rows = part.where("p_size > 25").select(source, F.col("p_brand").alias("class_key"), (F.col("p_size") % 5 != 0).alias("is_valid")).distinct()
    groups = roster.select("source", F.col("source").alias("group_code")).distinct()
    return roster, groups, rows, members


@register(f"""WITH {FLOW_CASCADE}, {fuzzy_sql(["roster"])}, l AS ({FLOW_LINKS} UNION ALL SELECT roster, id, ref_id, method FROM fuzzy)
    SELECT ra.roster, ra.id, ra.s AS surnames, ra.g AS given_names, coalesce(method, '') AS method, coalesce(l.ref_id::VARCHAR, '') AS nia FROM ra LEFT JOIN l USING (roster, id)""")
def roster_links(spark, sf_dir):
    """Rosters against the pool of all valid classes, and the rows to export. No name's words are a part of another's."""
    rows, _, _ = convert.link_rosters(*flow(spark, sf_dir))
    return rows.select("roster", "id", "surnames", "given_names", "method", "nia")


@register(f"""WITH {FLOW_CASCADE}, {fuzzy_sql(["roster"])}, l AS ({FLOW_LINKS} UNION ALL SELECT roster, id, ref_id, method FROM fuzzy),
    twin AS (SELECT DISTINCT a.roster, a.id FROM a4 a JOIN b4 b ON a.roster = b.roster AND a.compact = b.compact), near AS (SELECT DISTINCT roster, id FROM y WHERE score >= 0.84::DOUBLE),
    o AS (SELECT ra.roster, CASE WHEN l.id IS NOT NULL THEN 'matched' WHEN twin.id IS NOT NULL OR near.id IS NOT NULL THEN 'ambiguous' ELSE 'unmatched' END AS outcome
        FROM ra LEFT JOIN l USING (roster, id) LEFT JOIN twin USING (roster, id) LEFT JOIN near USING (roster, id)),
    i AS (SELECT roster, count(*) AS n_rows, count(*) FILTER (outcome = 'matched') AS m, count(*) FILTER (outcome = 'ambiguous') AS a, count(*) FILTER (outcome = 'unmatched') AS u FROM o GROUP BY ALL)
    SELECT roster, '[' || CASE WHEN a > 0 THEN 'REVIEW' WHEN u > 0 THEN 'WARNING' ELSE 'READY' END || '] rows=' || n_rows || ' matched=' || m || ' ambiguous=' || a || ' unmatched=' || u || ' missing_photos=0 issues=0' AS line,
        [x FOR x IN [CASE WHEN a > 0 THEN 'ambiguous_photo' END, CASE WHEN m = 0 THEN 'no_usable_reference' END] IF x IS NOT NULL] AS codes FROM i""")
def roster_report(spark, sf_dir):
    """Outcomes by roster, as report lines, with the codes that stop an export."""
    roster, groups, rows, members = flow(spark, sf_dir)
    exported, _, outcomes = convert.link_rosters(roster, groups, rows, members)
    lines_ = enrich.report(convert.items(roster, outcomes, 1))
    stops = enrich.blockers(exported.join(outcomes, ["roster", "id"]), 1)
    return lines_.join(stops, "roster", "left").select("roster", "line", F.coalesce("codes", F.array().cast("array<string>")).alias("codes"))


@register("""WITH m AS (SELECT 'ref' || p_size AS source, p_brand, p_partkey, p_size % 5 <> 0 AS ok FROM part WHERE p_size > 25), r AS (SELECT DISTINCT p_brand AS roster FROM part WHERE p_size <= 25 UNION SELECT DISTINCT source FROM m WHERE ok)
    SELECT roster, (SELECT count(DISTINCT source) FROM m WHERE source <> roster)::BIGINT AS n_files, (SELECT count(DISTINCT source) FROM m WHERE ok AND source <> roster)::BIGINT AS n_usable,
        (SELECT count(DISTINCT source) FROM m WHERE source <> roster)::BIGINT - (SELECT count(DISTINCT source) FROM m WHERE ok AND source <> roster)::BIGINT AS n_skipped,
        (SELECT count(DISTINCT (source, p_brand)) FROM m WHERE ok AND source <> roster)::BIGINT AS n_classes, (SELECT count(*) FROM m WHERE ok AND source <> roster)::BIGINT AS n_students,
        (SELECT count(*) FROM m WHERE ok AND source <> roster AND p_brand = roster)::BIGINT AS n_same_group FROM r""")
def pool_counts(spark, sf_dir):
    """What each roster's pool is made of; references asked as rosters leave themselves out."""
    _, groups, rows, members = flow(spark, sf_dir)
    own = rows.where("is_valid").select("source", F.lit(None).cast("string").alias("group_code")).distinct()
    return convert.pool_counts(groups.unionAll(own), rows, rows, members)


@register("""WITH x AS (SELECT *, p_brand || ' - ' || p_type AS grp, p_name || ', ' || p_type AS person, translate(p_size::VARCHAR, '0123456789', 'abcdefghij') AS letters FROM part)
    SELECT p_partkey, regexp_full_match(p_brand, '[\\p{L}\\-''’]+') AS part_ok, regexp_full_match(p_type, '[\\p{L}\\-''’]+') AS type_ok, true AS number_ok, person AS full_name, p_name AS surnames, p_type AS given_names, NULL::VARCHAR AS no_name,
        true AS goes_on, regexp_replace(upper('Mòdul ' || p_brand), '[^\\p{L}]', '', 'g') AS label, regexp_replace(upper('Modul ' || p_brand), '[^\\p{L}\\p{N}]', '', 'g') AS token, p_brand AS code,
        trim(regexp_replace(upper(p_type || '/' || p_size), '[^A-Z0-9]+', ' ', 'g')) AS course, p_size < 10 AS fits, p_name || ' ' || p_type AS header, p_brand || '|' AS held,
        CASE WHEN p_size > 25 THEN 'nia:' || p_size ELSE 'name:' || p_name || '|' || lower(p_type) END AS person_id, (p_name || '_' || replace(p_brand, '#', '_') || '_ a longer tail of words')[1:31] AS sheet,
        p_name || ', ' || p_type || '__2' AS stem, array_to_string([upper(w[1]) || w[2:] FOR w IN string_split(p_name, ' ')], ' ') || ', ' || p_type[1] || lower(p_type[2:]) || '__2' AS recased,
        printf('%.3f', p_size / 8.0) AS score, string_split(p_name, ' ') || [lower(p_type)] AS tokens, list_contains(string_split(p_name, ' '), letters) AS inside FROM x""")
def text_scalars(spark, sf_dir):
    """The scalar functions that other queries don't call."""
    part, c = table(spark, sf_dir, "part"), F.col
    person = F.concat("p_name", F.lit(", "), "p_type")
    name = tx.person_name(F.concat(F.lit("  "), F.regexp_replace(person, " ", "  ")))
    who = tx.identity(F.when(c("p_size") > 25, F.concat(F.lit(" "), c("p_size").cast("string"))), c("p_name"), c("p_type"))
    key = tx.course_key(F.concat("p_type", F.lit("/"), "p_size"))
    stem = F.concat(tx.file_stem(c("p_name"), c("p_type")), F.lit("__2"))
    letters = F.translate(c("p_size").cast("string"), "0123456789", "abcdefghij")
    return part.select(
        "p_partkey", tx.is_name_component(c("p_brand")).alias("part_ok"), tx.is_name_component(c("p_type")).alias("type_ok"), tx.is_numeric(F.concat(F.lit(" "), c("p_size").cast("string"))).alias("number_ok"),
        name["full_name"].alias("full_name"), name["surnames"].alias("surnames"), name["given_names"].alias("given_names"), tx.person_name(F.concat_ws(", ", "p_brand", "p_type"))["full_name"].alias("no_name"),
        tx.continues_name(c("p_name")).alias("goes_on"), tx.label_key(F.concat(F.lit("Mòdul "), "p_brand")).alias("label"), tx.header_token(F.concat(F.lit("Mòdul "), "p_brand")).alias("token"),
        tx.group_code(F.concat_ws(" - ", "p_brand", "p_type")).alias("code"), key.alias("course"), tx.courses_compatible(key, tx.course_key(F.concat("p_type", F.lit(" "), F.least("p_size", F.lit(9)), F.when(c("p_size") < 10, " B").otherwise("")))).alias("fits"),
        tx.header_value(F.array(F.lit(":"), F.concat(F.lit(":"), "p_name"), F.lit("***"), c("p_type"))).alias("header"), F.concat(tx.group_code(F.concat_ws(" - ", "p_brand", F.lit("x"))), F.lit("|")).alias("held"),
        F.concat_ws(":", who["kind"], who["value"]).alias("person_id"), tx.safe_sheet_name(F.concat(F.lit("'"), "p_name", F.lit("["), F.regexp_replace("p_brand", "#", ":"), F.lit("] a longer tail of words"))).alias("sheet"),
        stem.alias("stem"), tx.recased_stem(F.concat(F.upper("p_name"), F.lit(", "), F.upper("p_type"), F.lit("__2"))).alias("recased"), tx.score_text(c("p_size") / 8).alias("score"),
        tx.folded_tokens(F.concat_ws("-", "p_name", "p_type")).alias("tokens"), tx.is_subsequence(F.array(letters), tx.folded_tokens(c("p_name"))).alias("inside"),
    )


@register("""SELECT doc_id, trim(regexp_replace(replace(lower(nfc_normalize(d)), 'ß', 'ss'), '\\s+', ' ', 'g')) AS exact, trim(regexp_replace(replace(lower(nfc_normalize(d)), 'ß', 'ss'), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS structural,
    trim(regexp_replace(replace(strip_accents(lower(d)), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g')) AS folded, 'fin 12 muñoz' AS compatible FROM (SELECT doc_id, replace(replace(text, 'ñ', 'n' || chr(771)), 'é', 'e' || chr(769)) AS d FROM documents)""")
def fold_decomposed(spark, sf_dir):
    """Keys of texts whose letters and marks are apart, and of compatibility forms."""
    d = F.replace(F.replace("text", F.lit("\u00f1"), F.lit("n\u0303")), F.lit("\u00e9"), F.lit("e\u0301"))
    rows = table(spark, sf_dir, "documents").select("doc_id", d.alias("d"))
    return rows.select("doc_id", *(tx.name_key(F.col("d"), t).alias(t) for t in ("exact", "structural", "folded")), tx.name_key(F.lit("\ufb01n \uff11\uff12 \uff2d\uff55n\u0303oz"), "exact").alias("compatible"))


@register("""WITH a AS (SELECT l_orderkey, l_returnflag AS section, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem),
    b AS (SELECT *, (n - 1) % 3 + 1 AS o, (n - 1) // 3 AS run, lag(section) OVER (PARTITION BY l_orderkey ORDER BY n) AS before FROM a)
    SELECT l_orderkey, count(*)::BIGINT AS n_rows, max(run) + 1 AS n_runs, true AS in_sequence, NOT bool_or(o = 1 AND n > 1 AND before = section) AS restarts_ok FROM b GROUP BY ALL""")
def restarts_valid(spark, sf_dir):
    """Runs of three that may restart in a new section only."""
    rows = lines(spark, sf_dir).select("l_orderkey", "k", F.col("l_returnflag").alias("section"), ((F.col("k") - 1) % 3 + 1).alias("ordinal"))
    return assign.run_verdicts(rows, ["l_orderkey"], ["k"], "ordinal", "section")


@register("""SELECT p_partkey, p_brand, p_type || '_export' || CASE WHEN n > 1 THEN '__' || n ELSE '' END AS file_name, n > 1 AS repeated, by_name, p_size::VARCHAR AS by_number FROM (SELECT *,
    row_number() OVER (PARTITION BY p_type ORDER BY p_brand, p_partkey::VARCHAR) AS n, p_name || ', ' || p_type || CASE WHEN count(*) OVER (PARTITION BY p_brand, p_name, p_type) > 1
        THEN '__' || row_number() OVER (PARTITION BY p_brand, p_name, p_type ORDER BY p_partkey) ELSE '' END AS by_name FROM part)""")
def export_names(spark, sf_dir):
    """File names of classes and photos, and groups that occur again."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", "p_type", F.col("p_size").cast("string").alias("nia"))
    rows = part.withColumns({"source": F.col("p_brand"), "class_key": F.col("p_partkey").cast("string"), "group_code": F.col("p_type"), "id": F.col("p_partkey"), "surnames": F.col("p_name"), "given_names": F.col("p_type")})
    rows = classes.repeated_groups(sinks.photo_names(sinks.class_names(rows)), "group_code", ["source", "class_key"])
    return rows.select("p_partkey", "p_brand", "file_name", "repeated", "by_name", "by_number")


@register("""WITH t AS (SELECT DISTINCT p_brand || CASE WHEN p_size = 1 THEN '' ELSE '__' || p_size END AS name FROM part WHERE p_size < 4), w AS (SELECT DISTINCT p_brand AS name FROM part)
    SELECT w.name, CASE WHEN w.name NOT IN (FROM t) THEN w.name WHEN w.name || '__2' NOT IN (FROM t) THEN w.name || '__2' WHEN w.name || '__3' NOT IN (FROM t) THEN w.name || '__3' ELSE w.name || '__4' END AS free FROM w""")
def free_names(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    taken = part.where("p_size < 4").select(F.concat("p_brand", F.when(F.col("p_size") == 1, "").otherwise(F.concat(F.lit("__"), F.col("p_size").cast("string")))).alias("name")).distinct()
    return sinks.free_names(part.select(F.col("p_brand").alias("name")).distinct(), taken)


@register("""SELECT l_orderkey AS page, s.l_linenumber AS ordinal, CASE WHEN n = 1 THEN 'ORDE=' || s.l_linenumber WHEN n = 2 THEN '<NUM:' || length(l_partkey::VARCHAR) || '>' WHEN n = 3 THEN 'NIA' ELSE '<L' || length(l_returnflag) || ':COMMA>' END AS shown,
    (10.0 + 40.0 * (n - 1))::DOUBLE AS vx0 FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM lineitem WHERE l_linenumber <> l_partkey) s, range(1, 5) r(n)
    WHERE NOT (n = 4 AND upper(l_returnflag || ',') = 'R')""")
def layout_report(spark, sf_dir):
    """What may be shown of the words in an ordinal's row."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag").where("l_linenumber <> l_partkey").distinct()
    source = F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")))
    rows = rows.select(source.alias("source"), F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("ordinal"), F.array(F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.lit("Nia"), F.concat("l_returnflag", F.lit(","))).alias("t"))
    seen = rows.select("source", "page", F.posexplode("t").alias("n", "text"), F.lit(100.0).alias("vy0"), F.lit(105.0).alias("cy")).withColumn("vx0", F.lit(10.0) + F.col("n") * 40.0)
    return redact.layout_report(seen, rows.select("source", "page", "ordinal", F.lit(100.0).alias("visual_y"))).select("page", "ordinal", "shown", "vx0")


@register(f"""WITH p AS (SELECT p_brand, p_partkey AS id, p_size, {NAMES} FROM part), a AS (SELECT * FROM p WHERE p_size <= 3), b AS (SELECT * FROM p WHERE p_size > 3 AND p_size <= 12),
    x AS (SELECT a.p_brand, a.id, 0.55::DOUBLE * {{s}} + 0.35::DOUBLE * {{g}} + 0.10::DOUBLE * {{f}} AS score FROM a JOIN b USING (p_brand))
    SELECT a.p_brand, a.id, round(max(score), 9) AS score, 2 AS n_surname_tokens, 2 AS n_given_tokens FROM a LEFT JOIN x USING (p_brand, id) GROUP BY ALL""".format(
    **{k: f"CASE WHEN greatest(length({u}), length({v})) = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - levenshtein({u}, {v})::DOUBLE / greatest(length({u}), length({v})) END"
       for k, u, v in (("s", "lower(a.s)", "lower(b.s)"), ("g", "lower(a.g)", "lower(b.g)"), ("f", "lower(a.s || ' ' || a.g)", "lower(b.s || ' ' || b.g)"))}))
def unresolved_scores(spark, sf_dir):
    """For rows that nothing links, the best score among the references, without any name."""
    part = named(spark, sf_dir).select("p_brand", F.col("p_partkey").alias("id"), "p_size", "surnames", "given_names")
    none = spark.createDataFrame([], "p_brand string, id long, ref_id long")
    found = match.unresolved(part.where("p_size <= 3"), part.where("p_size > 3 and p_size <= 12"), none, ["p_brand"])
    return found.select("p_brand", "id", F.round("score", 9).alias("score"), "n_surname_tokens", "n_given_tokens")
