"""Queries over orders, line items and documents: feature tables, labels, suppressed aggregates, text and catalog rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions import scalar as S
from tidewatch.operators import catalog, features
from tidewatch.operators import windows as wn

#: Line numbers stand for measured items; number 7 is listed twice, and the later feature wins.
ITEMS = {"f1": (1,), "f2": (2, 3), "f3": (4, 7), "f4": (5,), "f5": (7,)}
FEATURES = list(ITEMS)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("o_orderdate").cast("timestamp")
    return _t(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("stay"), F.col("o_custkey").alias("subject"), start.alias("start"), (start + F.make_interval(days=F.lit(60))).alias("stop"),
        "o_orderstatus", "o_totalprice",
    )


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("stay"), F.col("l_shipdate").cast("timestamp").alias("time"), F.col("l_linenumber").alias("item"), F.col("l_quantity").alias("value")
    )
    return features.map_items(li, ITEMS)


def feature_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five statistics of every feature in a half-open window, for all cohort members."""
    cohort = _cohort(spark, sf_dir)
    wide = features.rollup(features.readings_in_window(_readings(spark, sf_dir), cohort, "stay", "time", "start", "stop"), "stay", "time", FEATURES)
    out = features.feature_table(cohort, [(wide, "stay")], ["stay"])
    return out.withColumns({f"{f}_mean": F.round(f"{f}_mean", 6) for f in FEATURES})


_map = "CASE WHEN l_linenumber = 1 THEN 'f1' WHEN l_linenumber IN (2, 3) THEN 'f2' WHEN l_linenumber = 4 THEN 'f3' WHEN l_linenumber = 5 THEN 'f4' WHEN l_linenumber = 7 THEN 'f5' END"
_stat = {"mean": "round(avg(v) FILTER (WHERE f = '{f}'), 6)", "min": "min(v) FILTER (WHERE f = '{f}')", "max": "max(v) FILTER (WHERE f = '{f}')",
         "last": "arg_max(v, (ts, v)) FILTER (WHERE f = '{f}')", "count": "nullif(count(v) FILTER (WHERE f = '{f}'), 0)::DOUBLE"}
_LONG = f"""o AS (SELECT o_orderkey AS stay, o_custkey AS subject, o_orderdate AS start, o_orderdate + INTERVAL 60 DAY AS stop FROM orders),
l AS (SELECT l_orderkey AS stay, {_map} AS f, l_quantity AS v, l_shipdate AS ts FROM lineitem JOIN o ON o.stay = l_orderkey WHERE l_quantity IS NOT NULL AND {{inside}} AND {_map} IS NOT NULL)"""
_inside = "l_shipdate >= start AND l_shipdate < stop"
FEATURE_ROLLUP = f"""WITH {_LONG.format(inside=_inside)}, w AS (SELECT stay, {", ".join(s.format(f=f) + f" AS {f}_{n}" for f in FEATURES for n, s in _stat.items())} FROM l GROUP BY 1)
SELECT o.stay, w.* EXCLUDE (stay) FROM o LEFT JOIN w USING (stay)"""


def closed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = features.readings_in_window(_readings(spark, sf_dir), _cohort(spark, sf_dir), "stay", "time", "start", "stop", closed=True)
    return r.groupBy("feature").agg(F.count("value").alias("n"), F.countDistinct("stay").alias("stays"))


CLOSED_WINDOW = f"WITH {_LONG.format(inside='l_shipdate BETWEEN start AND stop')} SELECT f AS feature, count(*) AS n, count(DISTINCT stay) AS stays FROM l GROUP BY 1"


def _stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cohort(spark, sf_dir)
    return features.label_return(c, "subject", "start", "start", "stay", 30)


def return_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivors only: a next stay within 30 days."""
    return _stays(spark, sf_dir).where(features.survived(F.col("o_orderstatus") == "F")).select("stay", "subject", "label")


_lead = "n AS (SELECT *, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nx FROM orders)"
RETURN_LABEL = f"WITH {_lead} SELECT o_orderkey AS stay, o_custkey AS subject, coalesce(nx <= o_orderdate + INTERVAL 30 DAY, false)::INT AS label FROM n WHERE o_orderstatus <> 'F'"


def death_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label 1 for a status of F, 0 for others; those without a status are dropped; and whether the stay counts as survived."""
    o = features.label_flag(_t(spark, sf_dir, "orders").withColumn("died", F.col("o_orderstatus") == "F"), "died")
    return o.select(F.col("o_orderkey").alias("stay"), "label", features.survived(F.col("died")).alias("survived"))


DEATH_LABEL = "SELECT o_orderkey AS stay, (o_orderstatus = 'F')::INT AS label, o_orderstatus <> 'F' AS survived FROM orders WHERE o_orderstatus IS NOT NULL"


def exists_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 where a stay has a returned line at a high discount."""
    pos = _t(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_discount >= 0.08").select(F.col("l_orderkey").alias("stay"))
    return features.label_exists(_cohort(spark, sf_dir).select("stay"), pos, "stay")


EXISTS_LABEL = "SELECT o_orderkey AS stay, (o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount >= 0.08))::INT AS label FROM orders"


def labelled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows with a return label, inner join; those who left are dropped."""
    f = feature_rollup(spark, sf_dir).select("stay", "f1_count", "f2_last")
    return f.join(return_label(spark, sf_dir).select("stay", "label"), "stay")


LABELLED = f"SELECT a.stay, f1_count, f2_last, label FROM ({FEATURE_ROLLUP}) a JOIN ({RETURN_LABEL}) b USING (stay)"

# --- suppressed aggregates -----------------------------------------------------------------------------------------------


def _priority_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stays of each priority, and those of them that cost at least 30,000, by quarter."""
    o = _t(spark, sf_dir, "orders").withColumn("quarter", F.concat(F.year("o_orderdate"), F.lit("Q"), F.quarter("o_orderdate")))
    return o.groupBy("quarter", F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("stays"), F.count_if(F.col("o_totalprice") >= 30000).alias("dear"))


def _open_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stays of each market segment, those still open, and those of customers in debt."""
    both = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return both.groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count("*").alias("stays"), F.count_if(F.col("o_orderstatus") == "O").alias("still_open"), F.count_if(F.col("c_acctbal") < 0).alias("in_debt")
    )


def _region_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines shipped by each region's suppliers, and how many of them came back."""
    li, s = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "supplier")
    n, r = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region")
    both = li.join(s, li.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return both.groupBy(F.col("r_name").alias("region"), F.year("l_shipdate").alias("shipped")).agg(F.count("*").alias("lines"), F.count_if(F.col("l_returnflag") == "R").alias("came_back"))


def _gap_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of days between a subject's neighbouring stays, and the stays after which the status was F."""
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    days = F.date_diff(F.lead("o_orderdate").over(w), F.col("o_orderdate"))
    gaps = _t(spark, sf_dir, "orders").select("o_orderstatus", days.alias("days")).where("days IS NOT NULL")
    band = features.size_bins(F.col("days"), [30, 90, 365], ["a month", "a quarter", "a year", "longer"])
    return gaps.groupBy(band.alias("band")).agg(F.count("*").alias("gaps"), F.count_if(F.col("o_orderstatus") == "F").alias("ended"))


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stays with and without a measured feature f5, by status."""
    have = _readings(spark, sf_dir).where("feature = 'f5'").select("stay").distinct().withColumn("has", F.lit(1))
    o = _t(spark, sf_dir, "orders").join(have, F.col("stay") == F.col("o_orderkey"), "left")
    return o.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("stays"), F.count("has").alias("measured"))


def _part_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each brand, and the large ones among them."""
    return _t(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("parts"), F.count_if(F.col("p_size") > 40).alias("large"))


def _label_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source, those with a label, and the good ones."""
    both = _t(spark, sf_dir, "documents").select("doc_id", "source").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    return both.groupBy("source").agg(F.count("*").alias("documents"), F.count("quality").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"))


def _busy_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by how many events they have; busy ones have 5 or more on one day."""
    e = _t(spark, sf_dir, "events")
    day = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    user = day.groupBy("user_id").agg(F.sum("n").alias("n"), F.max("n").alias("top"))
    band = features.size_bins(F.col("n"), [40, 60, 80], ["under 40", "40 to 59", "60 to 79", "80 up"])
    return user.groupBy(band.alias("band")).agg(F.count("*").alias("users"), F.count_if(F.col("top") >= 5).alias("busy"))


#: The suppressed aggregates: name to (frame, count columns, the first of which is the cell's size, SQL of the frame).
AGGREGATES = {
    "agg_priority_mix": (_priority_mix, ["stays", "dear"], "SELECT year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter, o_orderpriority AS priority, count(*) AS stays, count_if(o_totalprice >= 30000) AS dear FROM orders GROUP BY 1, 2"),
    "agg_open_by_segment": (_open_by_segment, ["stays", "still_open", "in_debt"], "SELECT c_mktsegment AS segment, count(*) AS stays, count_if(o_orderstatus = 'O') AS still_open, count_if(c_acctbal < 0) AS in_debt FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1"),
    "agg_region_returns": (_region_returns, ["lines", "came_back"], "SELECT r_name AS region, year(l_shipdate)::INT AS shipped, count(*) AS lines, count_if(l_returnflag = 'R') AS came_back FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2"),
    "agg_gap_bands": (_gap_bands, ["gaps", "ended"], "SELECT CASE WHEN d < 30 THEN 'a month' WHEN d < 90 THEN 'a quarter' WHEN d < 365 THEN 'a year' ELSE 'longer' END AS band, count(*) AS gaps, count_if(o_orderstatus = 'F') AS ended FROM (SELECT o_orderstatus, date_diff('day', o_orderdate, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) AS d FROM orders) WHERE d IS NOT NULL GROUP BY 1"),
    "agg_measured": (_measured, ["stays", "measured"], "SELECT o_orderstatus AS status, count(*) AS stays, count_if(o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 7)) AS measured FROM orders GROUP BY 1"),
    "agg_part_sizes": (_part_sizes, ["parts", "large"], "SELECT p_brand AS brand, count(*) AS parts, count_if(p_size > 40) AS large FROM part GROUP BY 1"),
    "agg_label_cover": (_label_cover, ["documents", "labelled", "good"], "SELECT source, count(*) AS documents, count(quality) AS labelled, count_if(quality = 1) AS good FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1"),
    "agg_busy_users": (_busy_users, ["users", "busy"], "SELECT CASE WHEN n < 40 THEN 'under 40' WHEN n < 60 THEN '40 to 59' WHEN n < 80 THEN '60 to 79' ELSE '80 up' END AS band, count(*) AS users, count_if(top >= 5) AS busy FROM (SELECT user_id, sum(n) AS n, max(n) AS top FROM (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1) GROUP BY 1"),
}


def _suppressed(frame, counts: list[str]):
    return lambda spark, sf_dir: features.suppressed(frame(spark, sf_dir), counts)


def _suppressed_sql(counts: list[str], sql: str) -> str:
    least = S.LEAST_CELL
    shown = ", ".join(f"CASE WHEN {counts[0]} >= {least} AND {c} >= {least} THEN {c} END::BIGINT AS {c}" for c in counts)
    return f"SELECT * EXCLUDE ({', '.join(counts)}), {shown} FROM ({sql})"


def statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stated read-only statement, run over views and suppressed."""
    from tidewatch.sources.readers import run_aggregate

    _t(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    return run_aggregate(spark, STATEMENT, ["lines"])


STATEMENT = "SELECT l_linestatus AS status, l_linenumber AS line, count(*) AS lines FROM lineitem GROUP BY l_linestatus, l_linenumber"


def composite_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2, "4-NOT SPECIFIED": 3, "5-LOW": 4}
    o = _t(spark, sf_dir, "orders")
    out = wn.composite_order(o, "o_orderpriority", "o_orderdate", "o_orderkey", ranks)
    return out.select("o_orderkey", F.round("combined_order", 6).alias("combined_order"))


COMPOSITE = """SELECT o_orderkey, round(CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 + (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1) * 1.0
  / count(*) OVER (PARTITION BY o_orderpriority), 6) AS combined_order FROM orders"""


def schema_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns and rows of three tables, as a catalog dump gives them."""
    from tidewatch.sources.readers import catalog_dump

    names = ("region", "nation", "supplier")
    cols = [("own", n, c, t, k) for n in names for k, (c, t) in enumerate(_t(spark, sf_dir, n).dtypes)] + [("pg_catalog", "x", "y", "int", 0)]
    columns = spark.createDataFrame(cols, "schema string, table string, column string, type string, ordinal int")
    sizes = None
    for n in names:
        s = _t(spark, sf_dir, n).agg(F.lit("own").alias("schema"), F.lit(n).alias("table"), F.count("*").cast("double").alias("reltuples"))
        sizes = s if sizes is None else sizes.union(s)
    out = catalog_dump(columns, sizes)
    return out.select("table", F.size("columns").alias("n_columns"), F.concat_ws(",", F.transform("columns", lambda c: c["column"])).alias("names"), "estimated_rows")


SCHEMA_DUMP = " UNION ALL ".join(
    f"SELECT '{t}' AS table, {n} AS n_columns, '{c}' AS names, (SELECT count(*) FROM {t}) AS estimated_rows"
    for t, n, c in (("region", 2, "r_regionkey,r_name"), ("nation", 3, "n_nationkey,n_name,n_regionkey"), ("supplier", 4, "s_suppkey,s_name,s_nationkey,s_acctbal"))
)

# --- texts ----------------------------------------------------------------------------------------------------------------

PATTERNS = {"the": r"\bthe\b", "rights": r"rights\s+reserved", "digits": r"[0-9]{4,}"}


def keyword_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.keyword_counts(_t(spark, sf_dir, "documents"), PATTERNS, ["lang", "source"])


KEYWORDS = "SELECT lang, source, " + ", ".join(f"sum(len(regexp_extract_all(text, '(?i){p}')))::BIGINT AS {n}" for n, p in PATTERNS.items()) + " FROM documents GROUP BY 1, 2"


def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select("doc_id", S.normalized(F.col("text")).alias("t"))
    return d.select("doc_id", F.length("t").alias("n"), F.md5("t").alias("digest"))


NORMALIZED = "WITH n AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'), ' ') AS t FROM documents) SELECT doc_id, length(t)::INT AS n, md5(t) AS digest FROM n"


def label_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language: labelled, good, toxic and without a label (left and anti joins)."""
    d, l = _t(spark, sf_dir, "documents").select("doc_id", "lang"), _t(spark, sf_dir, "labels")
    un = d.join(l, "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("unlabelled"))
    both = d.join(l, "doc_id").groupBy("lang").agg(F.count("*").alias("labelled"), F.sum("quality").alias("good"), F.sum("toxic").alias("toxic"))
    return both.join(un, "lang", "full").fillna(0)


LABEL_JOINS = """SELECT lang, count(l.doc_id) AS labelled, coalesce(sum(quality), 0)::BIGINT AS good, coalesce(sum(toxic), 0)::BIGINT AS toxic, count(*) - count(l.doc_id) AS unlabelled
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1"""


def duplicate_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are listed more than once, by order and line number."""
    lines = _t(spark, sf_dir, "lineitem").select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("line"))
    return catalog.duplicates(lines, "line")


DUPLICATES = "SELECT l_orderkey || '/' || l_linenumber AS \"where\", 'duplicate id' AS message FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"


def quote_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole benchmark items as quotes, each against the document of the same place in the order of ids: which are absent."""
    q = _t(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.regexp_extract(F.col("item_id").cast("string"), r"([0-9]+)$", 1).try_cast("long").alias("source"), F.col("text").alias("quote"))
    s = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("source"), "text")
    own = s.select(F.col("source").cast("string").alias("id"), "source", F.expr("substring(text, 1, CAST(bround(length(text) / 2) AS INT))").alias("quote"))
    shifted = own.select("id", (F.col("source") + 1).alias("source"), "quote")
    return catalog.contains_quote(q.union(own).union(shifted), s)


_nrm = lambda c: f"regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')"
QUOTES = f"""WITH h AS (SELECT doc_id, substr(text, 1, (length(text) / 2)::INT) AS quote FROM documents),
q AS (SELECT item_id::VARCHAR AS id, TRY_CAST(regexp_extract(item_id::VARCHAR, '([0-9]+)$', 1) AS BIGINT) AS src, text AS quote FROM benchmark
  UNION ALL SELECT doc_id::VARCHAR, doc_id, quote FROM h UNION ALL SELECT doc_id::VARCHAR, doc_id + 1, quote FROM h),
j AS (SELECT id, doc_id, contains({_nrm("b.text")}, {_nrm("quote")}) AS ok FROM q LEFT JOIN documents b ON b.doc_id = q.src)
SELECT id AS "where", CASE WHEN doc_id IS NULL THEN 'no such source' ELSE 'quote not found' END AS message FROM j WHERE doc_id IS NULL OR NOT ok"""


def page_locator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a document stand for pages: the first page that has the start of its last words."""
    d = _t(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "\n", "\f").alias("text"))
    q = d.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("source"), F.expr("right(text, 90)").alias("quote"))
    return catalog.locate_page(d.select(F.col("doc_id").alias("source"), "text"), q).select("id", F.col("page").cast("int").alias("page"))


PAGES = f"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents),
q AS (SELECT doc_id, substr({_nrm("right(text, 90)")}, 1, 50) AS start FROM documents), h AS (SELECT q.doc_id, min(page) AS page FROM q JOIN p USING (doc_id) WHERE contains({_nrm("body")}, start) GROUP BY 1)
SELECT q.doc_id AS id, page::INT AS page FROM q LEFT JOIN h USING (doc_id)"""


def reference_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail addresses that documents mention, unless some labelled document mentions them."""
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), "text")
    lab = d.join(_t(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("name")), "name", "left_semi")
    pattern = r"[a-z0-9._]+@[a-z0-9.]+"
    known = lab.select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("ref")).distinct()
    return catalog.references(d, pattern, known, "address")


_pat = "[a-z0-9._]+@[a-z0-9.]+"
REFERENCES = f"""WITH r AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{_pat}')) AS ref FROM documents), k AS (SELECT ref FROM r SEMI JOIN labels USING (doc_id))
SELECT CAST(doc_id AS VARCHAR) AS "where", 'unknown address ' || ref AS message FROM r WHERE ref NOT IN (SELECT ref FROM k)"""


def parsed_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_type"), F.lit(" "), (F.col("p_size") / 4).cast("decimal(8,2)").cast("string"), F.when(F.col("p_size") % 2 == 0, " pct").otherwise("x")).alias("level"))
    return p.select("p_partkey", F.round(S.parse_level(F.col("level")), 6).alias("value"))


LEVELS = "SELECT p_partkey, round(CASE WHEN p_size % 2 = 0 THEN p_size / 4.0 / 100 ELSE p_size / 4.0 END, 6)::DOUBLE AS value FROM part"


def margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margins, standard errors and chances per nation."""
    a = _t(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("b"), F.min("s_acctbal").alias("lo"), F.max("s_acctbal").alias("hi"))
    out = a.select(
        "s_nationkey", S.implied_margin(F.col("b"), F.lit(1000.0), 0.25).alias("margin"), S.se_from_interval(F.col("lo"), F.col("hi")).alias("se"),
        S.min_detectable(S.se_from_interval(F.col("lo"), F.col("hi")), 0.025, 0.8).alias("detectable"), S.chance_detection(30.0, F.abs("b") / 1000).alias("chance"),
    )
    return out.withColumns({c: F.round(F.when(~F.col(c).isin(float("inf")), F.col(c)), 4) for c in ("margin", "se", "detectable", "chance")})


MARGINS = """WITH a AS (SELECT s_nationkey, avg(s_acctbal) AS b, min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier GROUP BY 1)
SELECT s_nationkey, round(CASE WHEN b > 0 THEN 0.25 * 1000.0 / b END, 4) AS margin, round((hi - lo) / (2 * 1.959963984540054), 4) AS se,
  round((1.959963984540054 + 0.8416212335729143) * (hi - lo) / (2 * 1.959963984540054), 4) AS detectable, round(1 - exp(-30.0 * abs(b) / 1000 / 1000), 4) AS chance FROM a"""

def bibliography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BibTeX entries of parts, read as papers that none to two sources confirm."""
    p, k = _t(spark, sf_dir, "part"), F.col("p_partkey")
    found = p.select(k.cast("string").alias("id"), F.col("p_name").alias("title"), F.array("p_brand", "p_type").alias("authors"), (1990 + F.col("p_size") % 30).alias("year"), F.when(F.col("p_size") % 5 > 0, F.col("p_type")).alias("venue"), F.explode(F.array(F.lit("s1"), F.lit("s2"))).alias("source"), "p_size")
    hit = found.select("id", "source", ((F.col("source") == "s1") & (F.col("p_size") % 3 > 0) | (F.col("source") == "s2") & (F.col("p_size") % 2 == 0)).alias("matched"), F.lit(None).cast("string").alias("doi"))
    return catalog.bibliography(catalog.verdicts(hit).join(found.drop("source", "p_size").distinct(), "id"))


BIBLIOGRAPHY = """WITH a AS (SELECT *, (p_size % 3 > 0)::INT AS s1, (p_size % 2 = 0)::INT AS s2 FROM part)
SELECT p_partkey::VARCHAR AS id, CASE WHEN s1 + s2 = 2 THEN 'VALID' ELSE 'WARNING' END AS verdict, '@misc{' || p_partkey || ',' || chr(10) || '  title = {' || p_name || '},' || chr(10) || '  author = {' || p_brand || ' and ' || p_type || '},'
  || chr(10) || '  year = {' || (1990 + p_size % 30) || '},' || CASE WHEN p_size % 5 > 0 THEN chr(10) || '  howpublished = {' || p_type || '},' ELSE '' END || chr(10) || '  note = {Confirmed by ' || CASE WHEN s1 + s2 = 2 THEN 's1, s2' WHEN s1 = 1 THEN 's1' ELSE 's2' END || '}' || chr(10) || '}' AS entry
FROM a WHERE s1 + s2 > 0"""

QUERIES = {
    "feature_rollup": feature_rollup, "closed_window": closed_window, "return_label": return_label, "exists_label": exists_label,
    "labelled_features": labelled_features, "composite_order": composite_order, "schema_dump": schema_dump, "keyword_counts": keyword_counts,
    "normalized_text": normalized_text, "label_joins": label_joins, "duplicate_values": duplicate_values, "quote_check": quote_check,
    "page_locator": page_locator, "reference_check": reference_check, "parsed_levels": parsed_levels, "margins": margins,
    "statement": statement, "death_label": death_label, "bibliography": bibliography, **{k: _suppressed(f, c) for k, (f, c, _) in AGGREGATES.items()},
}
ORACLE = {
    "feature_rollup": FEATURE_ROLLUP, "closed_window": CLOSED_WINDOW, "return_label": RETURN_LABEL, "exists_label": EXISTS_LABEL,
    "labelled_features": LABELLED, "composite_order": COMPOSITE, "schema_dump": SCHEMA_DUMP, "keyword_counts": KEYWORDS, "normalized_text": NORMALIZED,
    "label_joins": LABEL_JOINS, "duplicate_values": DUPLICATES, "quote_check": QUOTES, "page_locator": PAGES, "reference_check": REFERENCES,
    "parsed_levels": LEVELS, "margins": MARGINS, "statement": _suppressed_sql(["lines"], STATEMENT), "death_label": DEATH_LABEL, "bibliography": BIBLIOGRAPHY,
    **{k: _suppressed_sql(c, sql) for k, (_, c, sql) in AGGREGATES.items()},
}
