"""How often the layout goes over all words, and how many it writes."""

import duckdb
import pytest

from pyspark.sql import functions as F

from rollcall.functions import text as tx
from rollcall.operators import layout
from rollcall.plans import convert, record_queries
from rollcall.sources import shared
from test_convert import report
from test_layout import frame, row


@pytest.fixture
def passes(monkeypatch):
    """Calls of lines(), and the rows that label_rows() writes."""
    seen, lines, stash = {"lines": 0, "rows": []}, layout.lines, layout.stash

    def counted(words):
        seen["lines"] += 1
        return lines(words)

    def kept(df, *rest):
        out = stash(df, *rest)
        seen["rows"] += [out.count()] if "token" in out.columns else []
        return out

    monkeypatch.setattr(layout, "lines", counted)
    monkeypatch.setattr(layout, "stash", kept)
    return seen


def test_lines_are_made_once_and_headers_read_apart(spark, passes):
    words = report()
    for n in range(3, 40):
        words += row(n, n, f"{n:04d}", "Mas Pi", "Pau", 100.0 + 30 * n)
    got = layout.assigned(frame(spark, words)).collect()
    assert len(got) == 39 and {(r.group_raw, r.tutor, r.course) for r in got} == {("1A", "Ona", "1r")}
    assert passes == {"lines": 1, "rows": [6]}


def test_words_spread_by_page_are_not_moved_again(spark):
    words = frame(spark, report()).repartition("source", "page")
    plan = layout.pages(words)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_documents_and_classes_share_the_pages(spark, passes):
    words = frame(spark, report())
    sheets = layout.pages(words)
    found, members = convert.references(words, sheets)
    assert [r.issues for r in convert.reference_issues(words, found, sheets).collect()] == [[]] and members.count() == 2
    assert passes["lines"] == 1


def test_labels_by_pattern_are_those_by_key(spark):
    texts = ["GRUP", " grup:", "G-r 1 u.p", "GRUPS", "xGRUP", "", "CURS*", "matèria", "ORDÉ", "Orde.", "OR1DE", "ｏｒｄｅ"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    names = ["GRUP", "CURS", "MATÈRIA"]
    got = rows.select(tx.has_label(F.col("t"), names) == tx.label_key(F.col("t")).isin(*names), tx.has_token(F.col("t"), ["ORDE"]) == (tx.header_token(F.col("t")) == "ORDE")).collect()
    assert all(r[0] and r[1] for r in got)


def test_words_of_documents_do_not_move_and_are_not_written(spark, monkeypatch):
    for conf in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(conf, "-1")
    written = []
    try:
        _, sheets = record_queries.documents(spark, "/root/testdata/sf0.001")
        plan = sheets._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(shared, "stash", lambda df: written.append(df.schema.simpleString()) or df)
        layout.read(None, sheets)
    finally:
        for conf in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.unset(conf)
    pages = plan.split("Union")[1].split("ObjectHashAggregate(keys=[source")
    assert all("Exchange" not in step for step in pages[1:] if "posexplode" not in step)
    assert plan.count("hashpartitioning(page") == 2 and plan.count("hashpartitioning(source") == 1 and "hashpartitioning(l_orderkey" not in plan
    assert len(written) == 1 and "word_no" in written[0] and "n_words" not in written[0]


def test_lines_of_pages_are_those_of_the_sql(spark, tmp_path):
    """Lines without a part, of two parts, of no order, and orders without a customer."""
    duck = duckdb.connect()
    duck.sql("CREATE TABLE lineitem AS SELECT * FROM '/root/testdata/sf0.001/lineitem.parquet'")
    duck.sql("UPDATE lineitem SET l_partkey = CASE WHEN l_suppkey % 2 = 0 THEN 10000000 END WHERE l_linenumber = 2 AND l_orderkey % 3 = 0")
    duck.sql("UPDATE lineitem SET l_orderkey = NULL WHERE l_orderkey % 50 = 7")
    duck.sql("CREATE TABLE part AS SELECT * FROM '/root/testdata/sf0.001/part.parquet' UNION ALL SELECT * REPLACE (p_name || ' Bis' AS p_name) FROM '/root/testdata/sf0.001/part.parquet' WHERE p_partkey % 5 = 0")
    duck.sql("CREATE TABLE orders AS SELECT * REPLACE (CASE WHEN o_orderkey % 7 > 0 THEN o_custkey END AS o_custkey) FROM '/root/testdata/sf0.001/orders.parquet'")
    for t in ("lineitem", "part", "orders"):
        duck.sql(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    columns = "page, k, l_partkey, p_name, p_type, l_returnflag, l_linestatus, o_custkey, o_orderstatus"
    want = duck.sql(f"WITH {record_queries.LINES} SELECT {columns.replace('page', 'l_orderkey::INT')} FROM t").fetchall()
    got = [tuple(r) for r in record_queries.page_lines(spark, str(tmp_path)).select(*columns.split(", ")).collect()]
    assert len(want) > 4000 and sorted(map(repr, got)) == sorted(map(repr, want))


def test_pages_without_a_source_have_no_report(spark):
    words = frame(spark, report()).withColumn("source", F.when(F.col("text") == "none", "d"))
    sheets = layout.read(words)
    found, _ = convert.references(words, sheets)
    assert [tuple(r) for r in convert.reference_issues(words, found, sheets).collect()] == [(None, ["no_signature", "no_students"])]


def test_tasks_of_pages_grow_with_the_lines(spark, monkeypatch):
    monkeypatch.setattr(record_queries, "PAGE_LINES", 300)
    sheets = layout.pages(record_queries.words(spark, "/root/testdata/sf0.001"))
    n = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert sheets.rdd.getNumPartitions() == -(-n // 300) > 4
