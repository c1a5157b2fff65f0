"""Queries over text of labels, prices and dates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from labelkite.functions import geometry, text
from labelkite.operators import tools
from labelkite.session import table
from labelkite.sources import domain
from labelkite.sources.domain import with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return register


@query(r"""SELECT image_id, line_index, text, x1, y1, x1 + least(1200 - x1 - 10, greatest(80, 9 * length(text))) AS x2, y1 + 18 AS y2 FROM (
             SELECT *, 10 + 6 * least(length(regexp_extract(raw, '^[\x20\x09-\x0D]*')), 40) AS x1,
                    10 + 22 * (row_number() OVER (PARTITION BY image_id ORDER BY line_index) - 1) AS y1 FROM lines)""")
def text_lines(spark, d):
    """Text as lines with made-up boxes: one row after the other, shifted by their indentation."""
    l = domain.lines(spark, d)
    y = 10 + 22 * (F.row_number().over(Window.partitionBy("image_id").orderBy("line_index")) - 1)
    x = 10 + 6 * F.least(F.length(F.regexp_extract("raw", r"^[\x20\x09-\x0D]*", 0)), F.lit(40))
    out = l.withColumn("x1", x).withColumn("y1", y.cast("bigint"))
    width = F.least(1200 - F.col("x1") - 10, F.greatest(F.lit(80), 9 * F.length("text")))
    return out.select("image_id", "line_index", "text", "x1", "y1", (F.col("x1") + width).alias("x2"), (F.col("y1") + 18).alias("y2"))


@query(r"""SELECT image_id, line_index, regexp_extract(text, '([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})', 1) AS value FROM lines
           WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')""")
def extracted_emails(spark, d):
    l = domain.lines(spark, d)
    return l.filter(F.col("text").rlike(text.EMAIL)).select("image_id", "line_index", F.regexp_extract("text", f"({text.EMAIL})", 1).alias("value"))


@query(r"""SELECT image_id, line_index, regexp_replace(regexp_extract(text, '([0-9]{10})'), '[^0-9+]', '', 'g') AS value, squashed FROM (
             SELECT *, length(upper(regexp_replace(text, '[^A-Za-z0-9]', '', 'g'))) AS squashed FROM lines) WHERE regexp_matches(text, '(^|[^0-9])[6-9][0-9]{9}([^0-9]|$)')""")
def extracted_phones(spark, d):
    l = domain.lines(spark, d).filter(F.col("text").rlike("(^|[^0-9])[6-9][0-9]{9}([^0-9]|$)"))
    return l.select("image_id", "line_index", text.normalised_phone(F.regexp_extract("text", "([0-9]{10})", 1)).alias("value"), F.length(text.squashed(F.col("text"))).alias("squashed"))


@query(r"""SELECT image_id, line_index, CASE WHEN month IS NULL THEN NULL ELSE printf('%04d-%02d-%02d', year, month, day) END AS iso, a <= 12 AND b <= 12 AND a <> b AS ambiguous FROM (
             SELECT *, CASE WHEN b > 12 AND a <= 12 THEN b ELSE a END AS day, CASE WHEN b > 12 AND a <= 12 THEN a ELSE b END AS month, CASE WHEN y < 100 THEN y + 2000 ELSE y END AS year FROM (
               SELECT image_id, line_index, try_cast(p[1] AS INT) AS a, try_cast(p[2] AS INT) AS b, try_cast(p[3] AS INT) AS y FROM (
                 SELECT *, string_split_regex(regexp_extract(text, '(^|[^0-9])([0-9]{1,2}[./-][0-9]{1,2}[./-]([0-9]{4}|[0-9]{2}))([^0-9]|$)', 2), '[./-]') AS p FROM lines) WHERE len(p) = 3))
           WHERE try_cast(printf('%04d-%02d-%02d', year, month, day) AS DATE) IS NOT NULL""")
def extracted_dates(spark, d):
    found = domain.lines(spark, d).select("image_id", "line_index", text.printed_date(F.col("text")).alias("p"))
    return found.filter("p is not null").select("image_id", "line_index", "p.iso", "p.ambiguous")


@query(r"""SELECT image_id, line_index, replace(regexp_extract(lower(text), '(?:₹|rs\.?|inr|\$|€)[ ]*([0-9][0-9,]*(?:\.[0-9]{1,2})?)', 1), ',', '')::DOUBLE AS amount
           FROM lines WHERE regexp_matches(lower(text), '(?:₹|rs\.?|inr|\$|€)[ ]*[0-9]')""")
def extracted_amounts(spark, d):
    t = F.lower("text")
    l = domain.lines(spark, d).filter(t.rlike(r"(?:₹|rs\.?|inr|\$|€)[ ]*[0-9]"))
    return l.select("image_id", "line_index", text.number(F.regexp_extract(t, r"(?:₹|rs\.?|inr|\$|€)[ ]*([0-9][0-9,]*(?:\.[0-9]{1,2})?)", 1)).alias("amount"))


@query(r"""SELECT image_id, min(line_index) AS first, max(line_index) AS last, count(*) AS n_lines, round(avg(length(text)), 3) AS mean_length,
             sum(length(regexp_replace(text, '[^0-9A-Za-z]', '', 'g')))::BIGINT AS n_alnum FROM lines GROUP BY 1""")
def usable_text(spark, d):
    l = domain.lines(spark, d)
    return l.groupBy("image_id").agg(F.min("line_index").alias("first"), F.max("line_index").alias("last"), F.count("*").alias("n_lines"), F.round(F.avg(F.length("text")), 3).alias("mean_length"), F.sum(F.length(F.regexp_replace("text", "[^0-9A-Za-z]", ""))).alias("n_alnum"))


@query(r"""SELECT image_id, line_index, length(lag(text) OVER w) AS before, length(lead(text) OVER w) AS after FROM lines WINDOW w AS (PARTITION BY image_id ORDER BY line_index)""")
def neighbour_lines(spark, d):
    w = Window.partitionBy("image_id").orderBy("line_index")
    l = domain.lines(spark, d).withColumn("n", F.length("text"))
    return l.select("image_id", "line_index", F.lag("n").over(w).alias("before"), F.lead("n").over(w).alias("after"))


@query(r"""SELECT doc_id, CASE WHEN greatest(latin, other) = 0 THEN 'Unknown' WHEN other = greatest(latin, other) THEN 'Devanagari' ELSE 'Latin' END AS script FROM (
             SELECT doc_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS latin, length(regexp_replace(text, '[^\x{0900}-\x{097F}]', '', 'g')) AS other FROM documents)""")
def document_scripts(spark, d):
    return table(spark, d, "documents").select("doc_id", text.script(F.col("text")).alias("script"))


@query(r"""SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') || '|' || trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-') || '|' || trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-') AS dedupe_key FROM part""")
def product_keys(spark, d):
    from labelkite.operators.repository import dedupe_key

    return table(spark, d, "part").select("p_partkey", dedupe_key(F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.col("p_partkey")).alias("dedupe_key"))


@query("""SELECT bill_id, line, product_id, billed, mrp, round(billed - mrp, 2) AS difference, round(round(billed - mrp, 2) / mrp * 100, 1) AS percent,
            CASE WHEN round(billed - mrp, 2) <= mrp * 0.005 THEN 'PRICE_AT_OR_BELOW_MRP' ELSE 'POTENTIAL_PRICE_DIFFERENCE' END AS status FROM bills""")
def bill_checks(spark, d):
    b = domain.bills(spark, d).withColumn("c", tools.price_check(F.col("billed"), F.col("mrp")))
    return b.select("bill_id", "line", "product_id", "billed", "mrp", "c.difference", F.round(F.col("c.difference") / F.col("mrp") * 100, 1).alias("percent"), "c.status")


@query("""SELECT status, count(*) AS n FROM (SELECT CASE WHEN round(billed - mrp, 2) <= mrp * 0.005 THEN 'PRICE_AT_OR_BELOW_MRP' ELSE 'POTENTIAL_PRICE_DIFFERENCE' END AS status FROM bills) GROUP BY 1""")
def bill_check_counts(spark, d):
    return domain.bills(spark, d).select(tools.price_check(F.col("billed"), F.col("mrp"))["status"].alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey AS item_id, l_linenumber AS line, l_partkey AS product_id, strftime(expiry, '%Y-%m-%d') AS expiry,
            CASE WHEN expiry < DATE '1996-06-01' THEN 'EXPIRED' WHEN expiry - DATE '1996-06-01' <= 7 THEN 'EXPIRING_SOON' ELSE 'FRESH' END AS alert
          FROM (SELECT *, CAST(l_shipdate AS DATE) + 30 * p_size AS expiry FROM lineitem JOIN part ON l_partkey = p_partkey)""")
def grocery_alerts(spark, d):
    """Goods with a shelf life in months from their date of manufacture, on a given day."""
    l, p = table(spark, d, "lineitem"), table(spark, d, "part").select("p_partkey", "p_size")
    g = l.join(p, l.l_partkey == p.p_partkey)
    e = tools.expiry(F.lit(None).cast("string"), F.concat("p_size", F.lit(" months")), F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit(""))["expiry"]
    return g.select(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("product_id"), F.date_format(e, "yyyy-MM-dd").alias("expiry"), tools.alert(e, F.lit("1996-06-01").cast("date")).alias("alert"))


@query("""SELECT complaint_id, arg_max(status, event_id) AS status, count(*) AS n_events, coalesce(NOT bool_or(step < before), true) AS all_forward FROM (
            SELECT *, lag(step) OVER (PARTITION BY complaint_id ORDER BY event_id) AS before FROM (
              SELECT user_id AS complaint_id, event_id, (event_id % 4 + 1)::INT AS step, ['DRAFT', 'SUBMITTED', 'UNDER_REVIEW', 'RESOLVED'][event_id % 4 + 1] AS status FROM events)) GROUP BY 1""")
def complaint_states(spark, d):
    s = F.element_at(F.array(*[F.lit(x) for x in tools.STEPS]), (F.col("event_id") % 4 + 1).cast("int"))
    return tools.complaint_states(table(spark, d, "events").select(F.col("user_id").alias("complaint_id"), "event_id", s.alias("status")))


@query("SELECT status, count(*) AS n FROM (SELECT CASE event_type WHEN 'click' THEN 'SUBMITTED' ELSE upper(event_type) END AS status FROM events) GROUP BY 1")
def complaint_counts(spark, d):
    return table(spark, d, "events").select(F.when(F.col("event_type") == "click", "SUBMITTED").otherwise(F.upper("event_type")).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@query("""SELECT a.inspection_id, a.n AS label, b.n AS value, round(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) * 1.0
            / (greatest(1, (a.x2 - a.x1) * (a.y2 - a.y1)) + greatest(1, (b.x2 - b.x1) * (b.y2 - b.y1)) - greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))), 6) AS iou
          FROM boxes a JOIN boxes b ON a.inspection_id = b.inspection_id AND a.n < b.n""".replace("boxes", "(SELECT DISTINCT l_orderkey AS inspection_id, l_linenumber AS n, (l_partkey % 40)::INT AS x1, (l_suppkey % 30)::INT AS y1, (l_partkey % 40 + 25)::INT AS x2, (l_suppkey % 30 + 20)::INT AS y2 FROM lineitem)"))
def box_overlaps(spark, d):
    """Boxes of one page that overlap, compared within the page only."""
    box = F.struct((F.col("l_partkey") % 40).cast("int").alias("x1"), (F.col("l_suppkey") % 30).cast("int").alias("y1"), (F.col("l_partkey") % 40 + 25).cast("int").alias("x2"), (F.col("l_suppkey") % 30 + 20).cast("int").alias("y2"))
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("inspection_id"), F.col("l_linenumber").alias("n"), box.alias("box")).distinct()
    left, right = b.select("inspection_id", F.col("n").alias("label"), F.col("box").alias("a")), b.select(F.col("inspection_id").alias("i"), F.col("n").alias("value"), F.col("box").alias("b"))
    pairs = left.join(right, (F.col("inspection_id") == F.col("i")) & (F.col("label") < F.col("value")))
    return pairs.select("inspection_id", "label", "value", F.round(geometry.iou(F.col("a"), F.col("b")), 6).alias("iou"))
