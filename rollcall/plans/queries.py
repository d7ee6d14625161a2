"""The registered queries of the reference's own operators over the driver's tables, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import assign, classes, enrich, match, redact

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# What both engines agree on for Latin text: lower case, no marks, ß as ss.
FOLD = "replace(strip_accents(lower({0})), 'ß', 'ss')"
TEXT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@register(f"SELECT doc_id, {TEXT} AS text FROM documents")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.clean_spaces(F.col("text")).alias("text"))


@register(f"""WITH a AS (SELECT doc_id, {TEXT} AS x FROM documents)
    SELECT doc_id, trim(regexp_replace(replace(lower(x), 'ß', 'ss'), '\\s+', ' ', 'g')) AS exact,
        trim(regexp_replace(replace(lower(x), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS structural,
        trim(regexp_replace({FOLD.format('x')}, '[^a-z0-9]+', ' ', 'g')) AS folded,
        regexp_replace({FOLD.format('x')}, '[^a-z0-9]+', '', 'g') AS compact FROM a""")
def fold_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", tx.clean_spaces(F.col("text")).alias("x"))
    return rows.select("doc_id", *(tx.name_key(F.col("x"), t).alias(t) for t in tx.TIERS))


@register("""WITH w AS (SELECT p_partkey, upper(p_name) || ' DE LA O''NEIL-MCKAY XIV' AS name FROM part),
    t AS (SELECT p_partkey, [CASE WHEN lower(w) IN ('de', 'la') THEN lower(w)
        WHEN regexp_full_match(w, '[IVXLCDM]+') THEN w WHEN w = 'O''NEIL-MCKAY' THEN 'O''Neil-McKay'
        ELSE upper(w[1]) || lower(w[2:]) END FOR w IN string_split(name, ' ')] AS words FROM w)
    SELECT p_partkey, array_to_string(words, ' ') AS name FROM t""")
def title_case(spark, sf_dir):
    name = F.concat(F.upper("p_name"), F.lit(" DE LA O'NEIL-MCKAY XIV"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.name_case(name).alias("name"))


@register("""SELECT event_id, user_id,
    last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER w AS anchor_event_id,
    last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER w AS anchor_value,
    sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER w::BIGINT AS section
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def forward_fill(spark, sf_dir):
    signup = F.col("event_type") == "signup"
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    rows = assign.carry_forward(rows, ["user_id"], ["ts", "event_id"], signup, ["event_id", "value"], "anchor_")
    rows = assign.sections(rows, ["user_id"], ["ts", "event_id"], signup)
    return rows.select("event_id", "user_id", "anchor_event_id", "anchor_value", "section")


RUNS = """WITH a AS (SELECT {key} AS k, {ordinal} AS o, row_number() OVER w AS n FROM {table} WINDOW w AS (PARTITION BY {key} ORDER BY {order})),
    b AS (SELECT *, sum(CASE WHEN o = 1 AND n > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY n) AS run FROM a),
    c AS (SELECT *, row_number() OVER (PARTITION BY k, run ORDER BY n) AS place FROM b)
    SELECT k AS {key}, count(*)::BIGINT AS n_rows, (max(run) + 1)::BIGINT AS n_runs, bool_and(o = place) AS in_sequence FROM c GROUP BY k"""


@register(RUNS.format(key="l_orderkey", ordinal="l_linenumber", table="lineitem", order="l_linenumber, l_partkey, l_suppkey"))
def runs_valid(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return assign.run_verdicts(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "l_linenumber").drop("restarts_ok")


@register(RUNS.format(key="conv_id", ordinal="turn + 1", table="conversations", order="turn"))
def turns_valid(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") + 1).alias("ordinal"))
    return assign.run_verdicts(rows, ["conv_id"], ["turn"], "ordinal").drop("restarts_ok")


@register("""SELECT l_orderkey, count(l_linenumber)::BIGINT AS n_rows, count(DISTINCT l_linenumber)::BIGINT AS n_distinct,
    count(l_linenumber) <> count(DISTINCT l_linenumber) AS repeated FROM lineitem GROUP BY l_orderkey""")
def dup_ids(spark, sf_dir):
    return classes.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber")


COMPACT = f"regexp_replace({FOLD.format(TEXT)}, '[^a-z0-9]+', '', 'g')"


@register(f"""SELECT doc_id, k AS identity FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY k ORDER BY en DESC, n_chars DESC, doc_id) AS n
    FROM (SELECT doc_id, n_chars, lang = 'en' AS en, {COMPACT} AS k FROM documents)) WHERE n = 1""")
def priority_dedupe(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", tx.name_key(tx.clean_spaces(F.col("text")), "compact").alias("identity"))
    return classes.keep_first(rows, ["identity"], [F.desc(F.col("lang") == "en"), F.desc("n_chars"), "doc_id"]).select("doc_id", "identity")


@register("""WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL)
    SELECT user_id, event_type AS mode FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS r FROM c) WHERE r = 1""")
def mode_first(spark, sf_dir):
    return classes.first_mode(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


@register("""WITH a AS (SELECT p_brand, p_partkey, trim(regexp_replace(upper(p_type || CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN ' a' ELSE ' a b' END), '[^A-Z0-9]+', ' ', 'g')) AS k,
        p_type || CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN ' a' ELSE ' a b' END AS course FROM part),
    d AS (SELECT p_brand, k, min(p_partkey) AS f, arg_min(course, p_partkey) AS course FROM a GROUP BY ALL),
    t AS (SELECT p_brand, k AS top, course, row_number() OVER (PARTITION BY p_brand ORDER BY length(k) DESC, f) AS r FROM d)
    SELECT t.p_brand, t.course, count(*)::BIGINT AS n_courses, bool_and(d.k = top OR starts_with(top, d.k || ' ') OR starts_with(d.k, top || ' ')) AS compatible
    FROM t JOIN d USING (p_brand) WHERE r = 1 GROUP BY ALL""")
def course_specific(spark, sf_dir):
    tail = F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, " a").otherwise(" a b")
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.concat("p_type", tail).alias("course"))
    found = classes.resolve_course(rows, ["p_brand"], "course", "p_partkey")
    return found.select("p_brand", "course", F.size("courses").cast("long").alias("n_courses"), "compatible")


# A roster made of parts: smaller ones against larger ones of a brand, named by the part and by its type and price's last
# digit as a letter. Larger parts' names are written in four ways, one for each tier of keys.
WORD = "translate(right(floor(p_retailprice)::BIGINT::VARCHAR, 1), '0123456789', 'abcdefghij')"
SURNAMES = """CASE WHEN p_size <= 25 OR p_size % 4 = 3 THEN p_name WHEN p_size % 4 = 0 THEN replace(p_name, ' ', '-')
    WHEN p_size % 4 = 1 THEN replace(p_name, 'o', 'ó') ELSE replace(p_name, ' ', '') END"""
SCOPE = ["p_brand"]
PEOPLE = f"p AS (SELECT p_brand, p_size, p_partkey AS id, {SURNAMES} AS s, p_type || ' ' || {WORD} AS g FROM part)"
SMALL, LARGE = "SELECT * FROM p WHERE p_size <= 25", "SELECT * FROM p WHERE p_size > 25"


def word():
    return F.translate(F.right(F.floor("p_retailprice").cast("string"), F.lit(1)), "0123456789", "abcdefghij")


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts with surnames and given_names."""
    way = F.col("p_size") % 4
    surnames = F.when((F.col("p_size") <= 25) | (way == 3), F.col("p_name")).when(way == 0, F.translate("p_name", " ", "-")).when(way == 1, F.translate("p_name", "o", "ó"))
    return table(spark, sf_dir, "part").withColumns({"surnames": surnames.otherwise(F.translate("p_name", " ", "")), "given_names": F.concat_ws(" ", "p_type", word())})


def people(spark: SparkSession, sf_dir: str, small: bool) -> DataFrame:
    rows = named(spark, sf_dir).where((F.col("p_size") <= 25) == small)
    return rows.select("p_brand", F.col("p_partkey").alias("id"), "surnames", "given_names")


def _tier_sql(c: str) -> list[tuple[str, str]]:
    low = f"replace(lower({c}), 'ß', 'ss')"
    return [
        ("exact", f"trim(regexp_replace({low}, '\\s+', ' ', 'g'))"),
        ("structural", f"trim(regexp_replace({low}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"),
        ("folded", f"trim(regexp_replace({FOLD.format(c)}, '[^a-z0-9]+', ' ', 'g'))"),
        ("compact", f"regexp_replace({FOLD.format(c)}, '[^a-z0-9]+', '', 'g')"),
    ]


def cascade_sql(scope: list[str], small: str, large: str, *ctes_before: str) -> tuple[str, str]:
    """CTEs up to the links of each tier, from the sides' SQL (scope, id, s, g), and the union of all links."""
    by = ", ".join(scope)
    on = " AND ".join(f"a.{c} = b.{c}" for c in scope)
    keys = ", ".join(f"{x} || chr(31) || {y} AS {m}" for (m, x), (_, y) in zip(_tier_sql("s"), _tier_sql("g")))
    ctes = [*ctes_before, f"a0 AS (SELECT *, {keys} FROM ({small}))", f"b0 AS (SELECT *, {keys} FROM ({large}))"]
    for i, m in enumerate(tx.TIERS):
        one = lambda side, m=m, i=i: f"(SELECT {by}, {m}, min(id) AS id FROM {side}{i} GROUP BY {by}, {m} HAVING count(*) = 1)"
        ctes += [
            f"l{i} AS (SELECT {', '.join('a.' + c for c in scope)}, a.id AS id, b.id AS ref_id, '{m}' AS method FROM {one('a')} a JOIN {one('b')} b ON {on} AND a.{m} = b.{m})",
            f"a{i + 1} AS (SELECT a.* FROM a{i} a ANTI JOIN l{i} b ON {on} AND a.id = b.id)",
            f"b{i + 1} AS (SELECT a.* FROM b{i} a ANTI JOIN l{i} b ON {on} AND a.id = b.ref_id)",
        ]
    return ", ".join(ctes), " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(len(tx.TIERS)))


CASCADE, CASCADE_LINKS = cascade_sql(SCOPE, SMALL, LARGE, PEOPLE)


@register(f"WITH {CASCADE} {CASCADE_LINKS}")
def unique_cascade(spark, sf_dir):
    return match.cascade(people(spark, sf_dir, True), people(spark, sf_dir, False), SCOPE)


def _similar(a: str, b: str) -> str:
    return f"CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) END"


def fuzzy_sql(scope: list[str], small: str = "a4", large: str = "b4") -> str:
    """CTEs y (all pairs with their scores) and fuzzy (links) of two sides with the columns of cascade_sql; scores are those
    of distinct keys, so equal names are compared once."""
    by, folded = ", ".join(scope), "string_split(folded, chr(31))"
    on = " AND ".join(f"a.{c} = b.{c}" for c in scope)
    return f"""fa AS (SELECT *, {folded}[1] AS fs, {folded}[2] AS fg FROM {small}), fb AS (SELECT *, {folded}[1] AS fs, {folded}[2] AS fg FROM {large}),
    x AS (SELECT {', '.join('a.' + c for c in scope)}, a.id AS id, b.id AS ref_id, {_similar('a.fs', 'b.fs')} AS ss, {_similar('a.fg', 'b.fg')} AS gs,
        {_similar("(a.fs || ' ' || a.fg)", "(b.fs || ' ' || b.fg)")} AS fs,
        a.fs <> '' AND a.fg <> '' AND a.fs[1] = b.fs[1] AND a.fg[1] = b.fg[1] AS initials FROM fa a JOIN fb b ON {on}),
    y AS (SELECT *, 0.55::DOUBLE * ss + 0.35::DOUBLE * gs + 0.10::DOUBLE * fs AS score FROM x),
    z AS (SELECT *, row_number() OVER m AS r, lead(score) OVER m AS nxt, row_number() OVER t AS rr, lead(score) OVER t AS rnxt FROM y
        WINDOW m AS (PARTITION BY {by}, id ORDER BY score DESC, ref_id DESC), t AS (PARTITION BY {by}, ref_id ORDER BY score DESC, id DESC)),
    fuzzy AS (SELECT {by}, id, ref_id, 'fuzzy' AS method FROM z WHERE r = 1 AND rr = 1 AND coalesce(score - nxt, 1.0::DOUBLE) >= 0.08::DOUBLE
        AND coalesce(score - rnxt, 1.0::DOUBLE) >= 0.08::DOUBLE AND initials AND score >= 0.90::DOUBLE
        AND CASE WHEN ss = 1.0::DOUBLE OR gs = 1.0::DOUBLE THEN least(ss, gs) >= 0.82::DOUBLE ELSE ss >= 0.90::DOUBLE AND gs >= 0.90::DOUBLE END)"""


@register(f"WITH {CASCADE}, {fuzzy_sql(SCOPE, 'a0', 'b0')} SELECT * FROM fuzzy")
def fuzzy_mutual(spark, sf_dir):
    return match.mutual_best(match.scored(people(spark, sf_dir, True), people(spark, sf_dir, False), SCOPE), SCOPE)


@register(f"""WITH {CASCADE}, {fuzzy_sql(SCOPE)},
    links AS ({CASCADE_LINKS} UNION ALL SELECT * FROM fuzzy),
    twin AS (SELECT DISTINCT a.id FROM a4 a JOIN b4 b ON a.p_brand = b.p_brand AND a.compact = b.compact),
    near AS (SELECT DISTINCT id FROM y WHERE score >= 0.84::DOUBLE)
    SELECT a0.p_brand, a0.id, CASE WHEN l.id IS NOT NULL THEN 'matched'
        WHEN a0.id IN (SELECT id FROM twin) OR a0.id IN (SELECT id FROM near) THEN 'ambiguous' ELSE 'unmatched' END AS outcome
    FROM a0 LEFT JOIN links l ON a0.id = l.id""")
def link_outcomes(spark, sf_dir):
    """Given names have two words on either side, so nothing is rescued by word subsequences."""
    _, outcomes = match.link(people(spark, sf_dir, True), people(spark, sf_dir, False), SCOPE)
    return outcomes


@register(f"""WITH f AS (SELECT p_type, p_size, p_partkey, p_name, {WORD} AS w, lower(p_brand) AS b FROM part),
    c AS (SELECT a.p_type, a.p_partkey AS id, b.p_partkey AS ref_id FROM f a JOIN f b ON a.p_type = b.p_type AND a.p_name = b.p_name AND a.w = b.w AND a.p_size <= 25 AND b.p_size > 25)
    SELECT p_type, id, ref_id, 'given_tokens' AS method FROM (SELECT *, count(*) OVER (PARTITION BY p_type, id) AS n, count(*) OVER (PARTITION BY p_type, ref_id) AS m FROM c) WHERE n = 1 AND m = 1""")
def token_rescue(spark, sf_dir):
    return match.token_rescue(*rescue_sides(spark, sf_dir), ["p_type"])


def rescue_sides(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Smaller parts with the price in letters as given name, larger ones with the brand after it."""
    part = table(spark, sf_dir, "part")
    sides = ((part.where("p_size <= 25"), word()), (part.where("p_size > 25"), F.concat_ws(" ", word(), "p_brand")))
    return [rows.select("p_type", F.col("p_partkey").alias("id"), F.col("p_name").alias("surnames"), given.alias("given_names")) for rows, given in sides]


@register(f"""WITH f AS (SELECT p_type, p_size, p_partkey, p_name, {WORD} AS w FROM part),
    c AS (SELECT a.p_type, a.p_partkey AS id, b.p_partkey AS ref_id FROM f a JOIN f b ON a.p_type = b.p_type AND a.p_name = b.p_name AND a.w = b.w AND a.p_size <= 25 AND b.p_size > 25)
    SELECT p_type, id, ref_id, 'shorter' AS relation, true AS same_first, false AS same_last, 1 AS n_tokens, 3 AS n_ref_tokens
    FROM (SELECT *, count(*) OVER (PARTITION BY p_type, id) AS n, count(*) OVER (PARTITION BY p_type, ref_id) AS m FROM c) WHERE n = 1 AND m = 1""")
def partial_names(spark, sf_dir):
    sides = rescue_sides(spark, sf_dir)
    return match.partial_names(*sides, match.token_rescue(*sides, ["p_type"]), ["p_type"])


@register("""SELECT o_orderkey, o_custkey, coalesce(c_name, '') AS c_name, CASE WHEN c_custkey IS NULL THEN 'WARNING' WHEN o_totalprice > 400000 THEN 'REVIEW'
    WHEN o_orderstatus = 'P' THEN 'MISSING_PHOTOS' ELSE 'READY' END AS status FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0""")
def status_case(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_name")
    rows = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
    known = F.col("c_custkey").isNotNull()
    rows = rows.withColumns({
        "failed": known & (F.col("o_totalprice") > 400000), "n_ambiguous": F.lit(0), "n_references": F.lit(1), "n_issues": F.lit(0),
        "n_unmatched": (~known).cast("int"), "n_missing_photos": (F.col("o_orderstatus") == "P").cast("int"),
    })
    return enrich.statuses(rows).select("o_orderkey", "o_custkey", F.coalesce("c_name", F.lit("")).alias("c_name"), "status")


@register("""SELECT o.o_orderkey AS id, o.o_custkey, coalesce(c.method, '') AS method, coalesce(c.c_mktsegment, '') AS c_mktsegment FROM orders o
    LEFT JOIN (SELECT o_orderkey, 'segment' AS method, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000) c USING (o_orderkey)""")
def enrich_left(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    customers = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("id"), "c_mktsegment")
    links = orders.select("id", F.col("o_custkey").alias("ref_id"), F.lit("segment").alias("method")).join(customers.select(F.col("id").alias("ref_id")), "ref_id", "left_semi")
    return enrich.enrich(orders, links, customers, [], ["c_mktsegment"])


@register("SELECT o_orderkey AS id, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def unresolved_anti(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    return enrich.unresolved(orders, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id")), [])


@register("""SELECT s_suppkey AS id, c_custkey FROM (SELECT s_suppkey, c_custkey, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(c_acctbal - s_acctbal), c_custkey) AS n
    FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE c_acctbal >= s_acctbal) WHERE n = 1""")
def nearest(spark, sf_dir):
    """The customer of a supplier's nation with the least balance not below the supplier's, in one sorted pass."""
    left = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    right = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", F.col("c_acctbal").alias("balance"))
    return assign.as_of(left, right, ["nation"], "balance", ["c_custkey"]).select("id", "c_custkey")


@register("""SELECT a.event_id, count(b.event_id)::BIGINT AS n_between FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'signup') a
    LEFT JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 DAY GROUP BY a.event_id""")
def range_between(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    a = events.where("event_type = 'signup'").select("event_id", "user_id", "ts")
    b = events.select(F.col("user_id").alias("u"), F.col("ts").alias("t"), F.col("event_id").alias("other"))
    on = (F.col("user_id") == F.col("u")) & (F.col("t") > F.col("ts")) & (F.col("t") <= F.col("ts") + F.expr("INTERVAL 1 DAY"))
    return a.join(b, on, "left").groupBy("event_id").agg(F.count("other").alias("n_between"))


@register("""SELECT p_partkey, file_name FROM (SELECT p_partkey, safe || CASE WHEN count(*) OVER (PARTITION BY lower(safe)) > 1
    THEN '__' || row_number() OVER (PARTITION BY lower(safe) ORDER BY p_partkey) ELSE '' END AS file_name
    FROM (SELECT p_partkey, regexp_replace(regexp_replace(p_name || ': ' || p_brand, '[<>:"/\\\\|?*]', '_', 'g'), '^[ ._]+|[ ._]+$', '', 'g') AS safe FROM part))""")
def safe_names(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", tx.safe_file_name(F.concat_ws(": ", "p_name", "p_brand")).alias("safe"))
    return classes.numbered_names(rows, [], "safe", ["p_partkey"]).select("p_partkey", "file_name")


@register("""WITH t AS (SELECT unnest(string_split_regex(trim(text), '\\s+')) AS w FROM documents), c AS (SELECT w, count(*) AS n FROM t GROUP BY w),
    k AS (SELECT *, regexp_replace(upper(strip_accents(w)), '[^\\p{L}\\p{N}]', '', 'g') AS token, length(regexp_replace(w, '[^\\p{L}]', '', 'g')) AS l, length(regexp_replace(w, '[^\\p{Nd}]', '', 'g')) AS d,
        length(regexp_replace(w, '[\\p{L}\\p{Nd},''’-]', '', 'g')) AS p FROM c),
    m AS (SELECT n, CASE WHEN token IN ('ORDE', 'NIA', 'REPETIX', 'COGNOMS', 'I', 'NOM', 'MATERIA', 'MODUL') THEN token WHEN upper(w) = 'R' THEN 'R' WHEN regexp_full_match(w, '[0-9]+') THEN '<NUM:' || length(w) || '>'
        WHEN w = '' THEN '<EMPTY>' ELSE '<' || concat_ws(':', CASE WHEN l > 0 THEN 'L' || l END, CASE WHEN d > 0 THEN 'D' || d END, CASE WHEN contains(w, ',') THEN 'COMMA' END, CASE WHEN contains(w, '-') THEN 'HYPHEN' END,
            CASE WHEN contains(w, chr(39)) OR contains(w, '’') THEN 'APOST' END, CASE WHEN p > 0 THEN 'P' || p END) || '>' END AS shown FROM k)
    SELECT shown, sum(n)::BIGINT AS n FROM m GROUP BY shown""")
def shape_mask(spark, sf_dir):
    w = F.explode(F.split(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")), " "))
    return redact.shape_counts(table(spark, sf_dir, "documents").select(w.alias("w")))


@register(f"WITH {CASCADE}, l AS ({CASCADE_LINKS}) SELECT p_brand, method, count(*)::BIGINT AS n FROM l GROUP BY ALL")
def method_counts(spark, sf_dir):
    return match.method_counts(unique_cascade(spark, sf_dir), SCOPE)


@register("""WITH s AS (SELECT CASE WHEN c_custkey IS NULL THEN 'WARNING' WHEN o_totalprice > 400000 THEN 'REVIEW' WHEN o_orderstatus = 'P' THEN 'MISSING_PHOTOS' ELSE 'READY' END AS status
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0)
    SELECT count(*) FILTER (status = 'READY')::BIGINT AS ready, count(*) FILTER (status IN ('WARNING', 'MISSING_PHOTOS'))::BIGINT AS warning,
        count(*) FILTER (status = 'REVIEW')::BIGINT AS blocking, CASE WHEN count(*) FILTER (status = 'REVIEW') > 0 THEN 2 ELSE 0 END AS exit_code FROM s""")
def summary_counts(spark, sf_dir):
    return enrich.summary(status_case(spark, sf_dir))


@register("""SELECT user_id, event_id, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM
    (SELECT user_id, event_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 1 DAY AS gap FROM events)""")
def gap_sessions(spark, sf_dir):
    """Sections that a gap in time opens."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    gap = F.col("ts") - F.lag("ts").over(w) > F.expr("INTERVAL 1 DAY")
    rows = rows.withColumn("gap", F.coalesce(gap, F.lit(False)))
    return assign.sections(rows, ["user_id"], ["ts", "event_id"], F.col("gap"), "session").select("user_id", "event_id", "session")


@register(f"""WITH {CASCADE}, l AS ({CASCADE_LINKS})
    SELECT a0.p_brand, a0.id, a0.s AS "Apellidos", a0.g AS "Nombre", coalesce(l.method, '') AS method, coalesce(d.p_size::VARCHAR, '') AS nia
    FROM a0 LEFT JOIN l ON a0.id = l.id LEFT JOIN part d ON l.ref_id = d.p_partkey""")
def flagship_roster(spark, sf_dir):
    """Link the smaller parts' names to the larger ones' one to one, and export every roster row with what its link adds."""
    roster = people(spark, sf_dir, True)
    references = people(spark, sf_dir, False).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("string").alias("nia")), "id")
    links = match.cascade(roster, references.drop("nia"), SCOPE)
    rows = enrich.enrich(roster, links, references, SCOPE, ["nia"])
    return rows.select(*SCOPE, "id", F.col("surnames").alias("Apellidos"), F.col("given_names").alias("Nombre"), "method", "nia")


from . import record_queries  # noqa: E402, F401  registers its queries
