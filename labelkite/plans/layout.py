"""Queries over the places of lines: values beside labels, blocks, merged passes, titles, dates in columns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from labelkite.operators import layout, quality
from labelkite.session import table
from labelkite.sources.domain import with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = with_views(sql.replace("LINED,", f"{_LINED},", 1) if "RECURSIVE LINED" in sql else sql)
        return f

    return register


#: Order lines, numbered from 1 on within their order (the table's own numbers can repeat).
_LINED = """lined AS (SELECT * REPLACE (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS l_linenumber) FROM lineitem)"""


def lined(spark, d):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return table(spark, d, "lineitem").withColumn("l_linenumber", F.row_number().over(order))


def _box(x1, y1, w, h):
    return F.struct(x1.alias("x1"), y1.alias("y1"), (x1 + w).alias("x2"), (y1 + h).alias("y2"))


def placed(spark, d):
    """Lines in columns and rows of an image, from order lines."""
    n, s, p = F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_partkey")
    return lined(spark, d).select(
        F.col("l_orderkey").alias("image_id"), n.cast("long").alias("line_index"), F.concat("l_returnflag", "l_linestatus", n.cast("string")).alias("text"),
        _box(s % 6 * 40, p % 17 * 9, 20 + F.col("l_quantity").cast("long"), 6 + p % 14).alias("bbox"), (1 - F.col("l_discount")).alias("confidence"),
        (F.col("l_returnflag") == "A").alias("anchor"), ((F.col("l_linestatus") == "O") & (n % 3 == 0)).alias("boundary"),
    )


_PLACED = """placed AS (SELECT l_orderkey AS image_id, l_linenumber::BIGINT AS line_index, l_returnflag || l_linestatus || l_linenumber AS text, l_suppkey % 6 * 40 AS x1, l_partkey % 17 * 9 AS y1,
    l_suppkey % 6 * 40 + 20 + l_quantity::BIGINT AS x2, l_partkey % 17 * 9 + 6 + l_partkey % 14 AS y2, 1 - l_discount AS confidence, l_returnflag = 'A' AS anchor, l_linestatus = 'O' AND l_linenumber % 3 = 0 AS boundary FROM lined)"""


@query(f"""WITH {_LINED}, {_PLACED},
     pairs AS (SELECT a.image_id, a.line_index AS anchor_index, v.*EXCLUDE (image_id), a.x1 AS ax1, a.x2 AS ax2, a.y1 AS ay1, a.y2 AS ay2 FROM placed a JOIN placed v ON a.image_id = v.image_id AND a.line_index <> v.line_index WHERE a.anchor),
     rightward AS (SELECT *, row_number() OVER (PARTITION BY image_id, anchor_index ORDER BY x1, line_index) AS n FROM pairs
                   WHERE least(ay2, y2) - greatest(ay1, y1) > 0 AND (least(ay2, y2) - greatest(ay1, y1)) / greatest(1, least(ay2 - ay1, y2 - y1)) >= 0.5 AND x1 >= ax2 - 2),
     under AS (SELECT *, sum(boundary::INT) OVER w AS stops, row_number() OVER w AS n FROM pairs
               WHERE y1 >= ay2 - 2 AND y1 - ay2 <= greatest(3 * (ay2 - ay1), 60) AND least(ax2, x2) - greatest(ax1, x1) > 0 AND (least(ax2, x2) - greatest(ax1, x1)) / greatest(1, least(ax2 - ax1, x2 - x1)) >= 0.5
               WINDOW w AS (PARTITION BY image_id, anchor_index ORDER BY y1, line_index))
     SELECT image_id, anchor_index, 'right' AS way, n, line_index, text FROM rightward UNION ALL SELECT image_id, anchor_index, 'below', n, line_index, text FROM under WHERE stops = 0""")
def value_walks(spark, d):
    return layout.walks(placed(spark, d)).drop("bbox")


@query(f"""WITH RECURSIVE {_LINED}, {_PLACED},
     numbered AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY y1, x1, line_index) AS k FROM placed),
     gaps AS (SELECT image_id, count(*) AS many, greatest(floor(list_sort(list(y2 - y1))[count(*) // 2 + 1] * 1.6)::BIGINT, 14) AS gap FROM placed GROUP BY 1),
     folded AS (SELECT image_id, 0::BIGINT AS k, []::STRUCT(x1 BIGINT, y1 BIGINT, x2 BIGINT, y2 BIGINT, members BIGINT[])[] AS groups FROM gaps
                UNION ALL
                SELECT image_id, k, CASE WHEN hit IS NULL OR hit = 0 THEN list_append(groups, struct_pack(x1 := x1, y1 := y1, x2 := x2, y2 := y2, members := [k]))
                       ELSE list_transform(groups, lambda g, i: CASE WHEN i = hit THEN struct_pack(x1 := least(g.x1, x1), y1 := least(g.y1, y1), x2 := greatest(g.x2, x2), y2 := greatest(g.y2, y2), members := list_append(g.members, k)) ELSE g END) END
                FROM (SELECT f.image_id, n.k, f.groups, n.x1, n.y1, n.x2, n.y2,
                             list_position(list_transform(f.groups, lambda g: abs(n.y1 - g.y2) <= s.gap AND (least(g.x2, n.x2) - greatest(g.x1, n.x1)) / greatest(1, least(g.x2 - g.x1, n.x2 - n.x1)) >= 0.15), true) AS hit
                      FROM folded f JOIN numbered n ON n.image_id = f.image_id AND n.k = f.k + 1 JOIN gaps s ON s.image_id = f.image_id)),
     done AS (SELECT f.image_id, unnest(range(len(groups))) AS block, unnest(groups) AS g FROM folded f JOIN gaps s ON s.image_id = f.image_id AND s.many = f.k),
     parts AS (SELECT d.image_id, d.block, d.g, n.k, n.y2 - n.y1 AS h, n.text, n.confidence FROM (SELECT image_id, block, g, unnest(g.members) AS k FROM done) d JOIN numbered n ON n.image_id = d.image_id AND n.k = d.k)
     SELECT image_id, block::INT AS block, g.x1::INT AS x1, g.y1::INT AS y1, g.x2::INT AS x2, g.y2::INT AS y2, count(*)::INT AS line_count, list_sort(list(h))[count(*) // 2 + 1]::INT AS line_height,
            round_even(sum(round(confidence * 100)) / count(*), 3) AS percent, array_to_string(list_slice(list(text ORDER BY k), 1, 6), chr(10)) AS text
     FROM parts GROUP BY image_id, block, g""")
def text_blocks(spark, d):
    lines = placed(spark, d).withColumn("confidence", F.round(100 * F.col("confidence")))
    return layout.blocks(lines).select("image_id", "block", "bbox.*", "line_count", "line_height", F.col("confidence").alias("percent"), "text")


def passes(spark, d):
    """The lines of two passes over an image: (first, second)."""
    n, s, p = F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_partkey")
    text = F.when(p % 3 == 0, F.concat(F.lit("B"), (s % 4).cast("string"))).otherwise(F.concat(F.lit("word "), n.cast("string")))
    rows = lined(spark, d).select(
        F.col("l_orderkey").alias("image_id"), n.cast("long").alias("line_index"), text.alias("text"), F.round(100 * F.col("l_discount")).alias("confidence"), F.when(n % 2 == 1, "full").otherwise("small").alias("variant"),
        _box(s % 4 * 6, p % 5 * 3, 30 + s % 3 * 2, 12 + p % 4).alias("bbox"),
    )
    return rows.filter("line_index % 2 = 1"), rows.filter("line_index % 2 = 0")


@query("""WITH RECURSIVE LINED, seen AS (SELECT l_orderkey AS image_id, l_linenumber AS line_index, CASE WHEN l_partkey % 3 = 0 THEN 'B' || l_suppkey % 4 ELSE 'word ' || l_linenumber END AS text, round(100 * l_discount) AS confidence,
            CASE WHEN l_linenumber % 2 = 1 THEN 'full' ELSE 'small' END AS variant, l_suppkey % 4 * 6 AS x1, l_partkey % 5 * 3 AS y1, l_suppkey % 4 * 6 + 30 + l_suppkey % 3 * 2 AS x2, l_partkey % 5 * 3 + 12 + l_partkey % 4 AS y2 FROM lined),
     rows AS (SELECT image_id, variant, line_index, struct_pack(text := text, confidence := confidence, variant := variant, x1 := x1, y1 := y1, x2 := x2, y2 := y2) AS l FROM seen),
     second AS (SELECT image_id, l, row_number() OVER (PARTITION BY image_id ORDER BY line_index) AS k FROM rows WHERE variant = 'small'),
     folded AS (SELECT image_id, 0::BIGINT AS k, coalesce(list(l ORDER BY line_index) FILTER (variant = 'full'), []) AS m FROM rows GROUP BY 1
                UNION ALL
                SELECT image_id, k, CASE WHEN hit = 0 THEN list_append(m, x) WHEN two AND NOT list_contains(list_transform(now, lambda a: [a.text, a.x1::VARCHAR, a.y1::VARCHAR, a.x2::VARCHAR, a.y2::VARCHAR]), [loser.text, loser.x1::VARCHAR, loser.y1::VARCHAR, loser.x2::VARCHAR, loser.y2::VARCHAR])
                       THEN list_append(now, struct_pack(text := loser.text, confidence := loser.confidence, variant := CASE WHEN loser.variant LIKE '%+alt' THEN loser.variant ELSE loser.variant || '+alt' END, x1 := loser.x1, y1 := loser.y1, x2 := loser.x2, y2 := loser.y2)) ELSE now END
                FROM (SELECT *, list_transform(m, lambda a, i: CASE WHEN i = hit THEN winner ELSE a END) AS now,
                             hit > 0 AND winner.text <> loser.text AND regexp_matches(winner.text, '^[^ ]{1,14}$') AND regexp_matches(loser.text, '^[^ ]{1,14}$') AND regexp_matches(winner.text, '[0-9]') AND regexp_matches(loser.text, '[0-9]')
                                 AND regexp_replace(winner.text, '[^0-9]', '', 'g') <> regexp_replace(loser.text, '[^0-9]', '', 'g') AS two
                      FROM (SELECT *, CASE WHEN hit > 0 AND x.confidence > m[hit].confidence THEN x WHEN hit > 0 THEN m[hit] END AS winner, CASE WHEN hit > 0 AND x.confidence > m[hit].confidence THEN m[hit] WHEN hit > 0 THEN x END AS loser
                            FROM (SELECT f.image_id, s.k, f.m, s.l AS x, coalesce(list_position(list_transform(f.m, lambda a: greatest(0, least(a.x2, s.l.x2) - greatest(a.x1, s.l.x1)) * greatest(0, least(a.y2, s.l.y2) - greatest(a.y1, s.l.y1))
                                      / (greatest(1, (a.x2 - a.x1) * (a.y2 - a.y1)) + greatest(1, (s.l.x2 - s.l.x1) * (s.l.y2 - s.l.y1)) - greatest(0, least(a.x2, s.l.x2) - greatest(a.x1, s.l.x1)) * greatest(0, least(a.y2, s.l.y2) - greatest(a.y1, s.l.y1))) >= 0.5), true), 0) AS hit
                                  FROM folded f JOIN second s ON s.image_id = f.image_id AND s.k = f.k + 1)))),
     ends AS (SELECT image_id, max(k) AS k FROM folded GROUP BY 1),
     done AS (SELECT f.image_id, unnest(range(len(m))) AS n, unnest(m) AS l FROM folded f JOIN ends e ON f.image_id = e.image_id AND f.k = e.k)
     SELECT image_id, n::INT AS n, l.text AS text, l.confidence AS confidence, l.variant AS variant, l.x1::INT AS x1, l.y1::INT AS y1, l.x2::INT AS x2, l.y2::INT AS y2 FROM done""")
def merged_readings(spark, d):
    return layout.merged_passes(*passes(spark, d)).select("image_id", "n", "text", "confidence", "variant", "bbox.*")


def title_lines(spark, d):
    """Lines stacked loosely in one or two columns."""
    n, s, p = F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_partkey")
    return lined(spark, d).select(
        F.col("l_orderkey").alias("image_id"), n.cast("int").alias("place"), F.concat(F.lit("W"), n.cast("string")).alias("text"), (1 - F.col("l_discount")).alias("confidence"), (s % 4 != 0).alias("fragment"),
        _box(F.when(p % 5 == 0, 300).otherwise(10) + s % 3 * 6, n * 24 + s % 2 * 12, 60 + p % 40, 16 + p % 8).alias("bbox"),
    )


@query("""WITH RECURSIVE LINED, t AS (SELECT l_orderkey AS image_id, l_linenumber AS place, 'W' || l_linenumber AS text, 1 - l_discount AS confidence, l_suppkey % 4 <> 0 AS fragment,
            CASE WHEN l_partkey % 5 = 0 THEN 300 ELSE 10 END + l_suppkey % 3 * 6 AS x1, l_linenumber * 24 + l_suppkey % 2 * 12 AS y1, 60 + l_partkey % 40 AS w, 16 + l_partkey % 8 AS h FROM lined),
     scan AS (SELECT image_id, place AS start, place AS seen, [text] AS members, confidence, 0 AS skips, true AS going, x1, y1, x1 + w AS x2, y1 + h AS y2, greatest(1, h) AS h FROM t WHERE fragment
              UNION ALL
              SELECT image_id, start, CASE WHEN part AND tight OR NOT part THEN seen + 1 ELSE seen END, CASE WHEN part AND tight THEN list_append(members, text) ELSE members END, CASE WHEN part AND tight THEN least(confidence, c) ELSE confidence END,
                     CASE WHEN part THEN 0 ELSE skips + 1 END, NOT part OR tight, CASE WHEN part AND tight THEN nx1 ELSE x1 END, CASE WHEN part AND tight THEN ny1 ELSE y1 END, CASE WHEN part AND tight THEN nx2 ELSE x2 END,
                     CASE WHEN part AND tight THEN ny2 ELSE y2 END, CASE WHEN part AND tight THEN greatest(1, ny2 - ny1) ELSE h END
              FROM (SELECT s.*, t.text, t.confidence AS c, t.x1 AS nx1, t.y1 AS ny1, t.x1 + t.w AS nx2, t.y1 + t.h AS ny2,
                           t.fragment AND (abs(t.x1 - s.x1) <= greatest(0.6 * s.h, 14) OR least(s.x2, t.x1 + t.w) - greatest(s.x1, t.x1) >= 0.75 * greatest(s.x2 - s.x1, t.w)) AS part,
                           t.y1 - s.y2 <= greatest(0.8 * s.h, 18) AND t.y1 - s.y2 >= -0.3 * s.h AS tight
                    FROM scan s JOIN t ON t.image_id = s.image_id AND t.place = s.seen + 1
                    WHERE s.going AND len(s.members) < 4 AND s.skips < 4 AND t.y1 - s.y2 <= greatest(1.2 * s.h, 30))),
     ended AS (SELECT image_id, start, max(seen) + 1 AS until, arg_max(members, len(members)) AS members, min(confidence) AS confidence FROM scan GROUP BY 1, 2 HAVING max(len(members)) > 1),
     chosen AS (SELECT image_id, min(start) AS start FROM ended GROUP BY 1
                UNION ALL
                SELECT c.image_id, n.start FROM chosen c JOIN ended e ON e.image_id = c.image_id AND e.start = c.start JOIN LATERAL (SELECT min(start) AS start FROM ended f WHERE f.image_id = c.image_id AND f.start >= e.until) n ON n.start IS NOT NULL)
     SELECT e.image_id, e.start AS place, e.until, array_to_string(members, ' ') AS text, e.confidence FROM ended e JOIN chosen c ON e.image_id = c.image_id AND e.start = c.start""")
def display_titles(spark, d):
    return layout.stacked_titles(title_lines(spark, d)).drop("bbox")


def _dates(spark, d):
    """(candidates, values): two labels of an order in one column or two, with what was read for them, and its lines' dates."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"), F.col("o_custkey").alias("c"))
    l = lined(spark, d)  # noqa: E741
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    n, s, p = F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_partkey")
    values = l.select(F.col("l_orderkey").alias("image_id"), n.cast("long").alias("line_index"), day.alias("iso"), (s % 4 == 0).alias("ambiguous"), _box(F.when(p % 9 == 0, 0).otherwise(90) + s % 5, 60 + n * 22 + s % 7, 70 + p % 10, 12 + p % 5).alias("bbox"))
    read = l.groupBy(F.col("l_orderkey").alias("image_id")).agg(*[F.max(F.when(n == k, day)).alias(f"v{k}") for k in (1, 2)])
    both = o.join(read, "image_id")
    row = lambda k, field, value, x, y: F.struct(F.lit(field).alias("field_name"), F.lit(k).cast("long").alias("n"), value.alias("value"), F.lit(1.0).alias("score"), _box(x, y, F.lit(70), F.lit(14)).alias("bbox"))
    first = row(0, "date_packing", F.when(F.col("c") % 5 != 0, F.col("v1")), F.lit(10), 80 + F.col("c") % 30)
    second = row(1, "date_expiry", F.when(F.col("c") % 3 != 0, F.col("v2")), F.when(F.col("c") % 11 == 0, 400).otherwise(12), 104 + F.col("c") % 40)
    return both.select("image_id", F.inline(F.array(first, second))), values


_DATES = """dated AS (SELECT l_orderkey AS image_id, l_linenumber AS line_index, strftime(l_shipdate, '%Y-%m-%d') AS iso, l_suppkey % 4 = 0 AS ambiguous, CASE WHEN l_partkey % 9 = 0 THEN 0 ELSE 90 END + l_suppkey % 5 AS x1,
        60 + l_linenumber * 22 + l_suppkey % 7 AS y1, CASE WHEN l_partkey % 9 = 0 THEN 0 ELSE 90 END + l_suppkey % 5 + 70 + l_partkey % 10 AS x2, 60 + l_linenumber * 22 + l_suppkey % 7 + 12 + l_partkey % 5 AS y2 FROM lined),
     labels AS (SELECT o_orderkey AS image_id, CASE WHEN o_custkey % 5 <> 0 THEN v1 END AS r_now, CASE WHEN o_custkey % 3 <> 0 THEN v2 END AS d_now, 80 + o_custkey % 30 AS ry, 104 + o_custkey % 40 AS dy, o_custkey % 11 = 0 AS away
                FROM orders JOIN (SELECT image_id, max(iso) FILTER (line_index = 1) AS v1, max(iso) FILTER (line_index = 2) AS v2 FROM dated GROUP BY 1) ON image_id = o_orderkey),
     pool AS (SELECT b.*, v.*EXCLUDE (image_id) FROM labels b JOIN dated v ON v.image_id = b.image_id
              WHERE NOT away AND (y1 + y2) / 2 BETWEEN least(ry, dy) - 35 AND greatest(ry, dy) + 14 + 35 AND (x1 >= 10 OR least(x2, 82) - greatest(x1, 10) > 0)),
     ends AS (SELECT image_id, any_value(r_now) AS r_now, any_value(d_now) AS d_now, any_value(ry) AS ry, any_value(dy) AS dy, arg_min({'iso': iso, 'a': ambiguous, 'x1': x1, 'x2': x2, 'y': (y1 + y2) / 2}, (iso, line_index)) AS e,
                     arg_max({'iso': iso, 'a': ambiguous, 'x1': x1, 'x2': x2, 'y': (y1 + y2) / 2}, (iso, line_index)) AS l FROM pool GROUP BY 1),
     blocks AS (SELECT image_id, 'date_packing' AS reference, 'date_expiry' AS deadline, r_now AS reference_now, d_now AS deadline_now, e.iso || CASE WHEN e.a THEN '|AMBIGUOUS' ELSE '' END AS earliest, l.iso || CASE WHEN l.a THEN '|AMBIGUOUS' ELSE '' END AS latest,
                       e.iso < l.iso AND abs(e.y - (ry + 7)) <= 90 AND (e.x1 >= 78 OR least(e.x2, 80) - greatest(e.x1, 10) > 0) AND abs(l.y - (dy + 7)) <= 90 AND (l.x1 >= 80 OR least(l.x2, 82) - greatest(l.x1, 12) > 0)
                       AND (r_now IS NOT NULL OR d_now IS NOT NULL) AND NOT coalesce(r_now <= d_now, false) AS moved FROM ends)"""


@query(f"WITH {_LINED}, {_DATES} SELECT * FROM blocks")
def date_block_pairs(spark, d):
    return layout.date_blocks(*_dates(spark, d))


@query(f"""WITH {_LINED}, {_DATES}, m AS (SELECT * FROM blocks WHERE moved),
     given AS (SELECT image_id, 'date_packing' AS field_name, r_now AS value FROM labels UNION ALL SELECT image_id, 'date_expiry', d_now FROM labels)
     SELECT g.image_id, g.field_name, CASE WHEN m.moved THEN CASE WHEN g.field_name = 'date_packing' THEN earliest ELSE latest END ELSE value END AS value, CASE WHEN m.moved THEN coalesce(value, '') END AS superseded
     FROM given g LEFT JOIN m ON m.image_id = g.image_id""")
def dates_in_order(spark, d):
    return layout.paired_dates(*_dates(spark, d)).select("image_id", "field_name", "value", "superseded")


_BANDS = {
    "resolution": ("least(width, height)", ">= 1400", ">= 700"), "blur": ("lap / greatest(greatest(width, height) / 1000.0::DOUBLE, 0.4::DOUBLE)", "> 120", "> 30"), "brightness": ("light", ">= 80", ">= 45"),
    "contrast": ("rms", ">= 40", ">= 22"), "glare": ("glare", "< 0.02::DOUBLE", "< 0.08::DOUBLE"), "overexposure": ("over", "<= 0.05::DOUBLE", "<= 0.15::DOUBLE"), "underexposure": ("under", "<= 0.15::DOUBLE", "<= 0.35::DOUBLE"),
    "orientation": ("abs(skew)", "<= 2", "<= 7"), "compression": ("blocky", "< 2.5", "< 6"),
}


@query(f"WITH {_LINED}, " + """i AS (SELECT l_orderkey AS inspection_id, l_linenumber AS image_id, l_partkey % 25 * 80 + 100 AS width, l_suppkey % 25 * 80 + 100 AS height, (l_partkey % 190)::DOUBLE AS lap, l_suppkey % 110 AS light, l_partkey % 60 AS rms,
              l_discount AS glare, l_tax * 3 AS over, l_discount * 5 AS under, (l_partkey % 19 - 9) AS skew, (l_suppkey % 9)::DOUBLE AS blocky FROM lined),
          b AS (SELECT inspection_id, image_id, """ + ", ".join(f"CASE WHEN {v} {g} THEN 10 WHEN {v} {f} THEN 6 ELSE 0 END AS {n}" for n, (v, g, f) in _BANDS.items()) + """ FROM i),
          s AS (SELECT *, resolution * 15 + blur * 20 + brightness * 12 + contrast * 12 + glare * 15 + overexposure * 8 + underexposure * 8 + orientation * 10 + compression * 10 AS points,
                       """ + " + ".join(f"({n} = 0)::INT" for n in _BANDS) + """ AS poor FROM b)
          SELECT inspection_id, image_id, round_even(points / 1100.0::DOUBLE, 3) AS score, poor::INT AS poor, CASE WHEN resolution = 0 AND blur = 0 THEN 'UNUSABLE' WHEN points >= 825 AND poor <= 1 THEN 'GOOD' WHEN points >= 495 THEN 'ACCEPTABLE' ELSE 'POOR' END AS status FROM s""")
def image_quality_bands(spark, d):
    l, p, s = lined(spark, d), F.col("l_partkey"), F.col("l_suppkey")
    images = l.select(
        F.col("l_orderkey").alias("inspection_id"), F.col("l_linenumber").alias("image_id"), (p % 25 * 80 + 100).alias("width"), (s % 25 * 80 + 100).alias("height"), (p % 190).cast("double").alias("laplacian_variance"),
        (s % 110).alias("mean_brightness"), (p % 60).alias("rms_contrast"), F.col("l_discount").alias("glare"), (F.col("l_tax") * 3).alias("overexposure"), (F.col("l_discount") * 5).alias("underexposure"), (p % 19 - 9).alias("skew"), (s % 9).cast("double").alias("blockiness"),
    )
    return quality.image_quality(images).select("inspection_id", "image_id", "score", F.size(F.filter("bands", lambda b: b["band"] == "POOR")).alias("poor"), "status")
