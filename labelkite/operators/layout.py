"""What the places of lines on an image tell: values beside and under a label, blocks, titles on several lines, dates in columns.

Lines are rows with key columns (an image), ``line_index``, ``text`` and ``bbox``. Pairs of lines are made by a join on the
strips of the image that they touch, never of all lines of an image. Steps that depend on an order (blocks, passes, titles)
fold over the lines of one image.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelkite.functions import geometry
from labelkite.functions.text import once

#: Pixels of a strip.
STRIP = 64
#: The fields that say when a pack was made, and those that say how long it lasts.
REFERENCE_DATES = ("date_manufacturing", "date_packing", "date_import")
DEADLINES = ("date_expiry", "date_best_before")


def _share(a: Column, b: Column, low: str, high: str) -> Column:
    """The part of the shorter one's extent that both share, in one direction."""
    common = F.least(a[high], b[high]) - F.greatest(a[low], b[low])
    return F.when(common <= 0, F.lit(0.0)).otherwise(common / F.greatest(F.lit(1), F.least(a[high] - a[low], b[high] - b[low])))


def row_share(a: Column, b: Column) -> Column:
    return _share(a, b, "y1", "y2")


def column_share(a: Column, b: Column) -> Column:
    return _share(a, b, "x1", "x2")


def walks(lines: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """``keys anchor_index way n line_index text bbox``: for each line marked ``anchor`` the lines that can hold its value, in order.

    ``way`` is ``right`` (half a row in common, beginning where the anchor ends) or ``below`` (half a column in common, within
    three row heights, 60 pixels at least). The walk down ends before the first line marked ``boundary``.
    """
    keys, a, b = list(keys), F.col("a"), F.col("b")
    strip = lambda y: F.floor(y / STRIP)
    touched = lambda box: F.explode(F.sequence(strip(box["y1"]), strip(F.greatest(box["y1"], box["y2"]))))
    anchors = lines.filter("anchor").select(*keys, F.col("line_index").alias("anchor_index"), F.col("bbox").alias("a"))
    values = lines.filter(F.trim("text") != "").select(*keys, "line_index", "text", F.coalesce("boundary", F.lit(False)).alias("boundary"), F.col("bbox").alias("b"))
    other = F.col("line_index") != F.col("anchor_index")
    # a pair that meets in several strips counts in the first one that both touch
    once = F.col("strip") == strip(F.greatest(a["y1"], b["y1"]))
    right = anchors.withColumn("strip", touched(a)).join(values.withColumn("strip", touched(b)), [*keys, "strip"])
    right = right.filter(once & other & (row_share(a, b) >= 0.5) & (b["x1"] >= a["x2"] - 2)).withColumn("n", F.row_number().over(Window.partitionBy(*keys, "anchor_index").orderBy(b["x1"], "line_index")))
    reach = F.greatest(3 * (a["y2"] - a["y1"]), F.lit(60))
    down = anchors.withColumn("strip", F.explode(F.sequence(strip(a["y2"] - 2), strip(a["y2"] + reach))))
    below = down.join(values.withColumn("strip", strip(b["y1"])), [*keys, "strip"])
    below = below.filter(other & (b["y1"] >= a["y2"] - 2) & (b["y1"] - a["y2"] <= reach) & (column_share(a, b) >= 0.5))
    order = Window.partitionBy(*keys, "anchor_index").orderBy(b["y1"], "line_index")
    below = below.withColumn("stops", F.sum(F.col("boundary").cast("int")).over(order)).filter("stops = 0").withColumn("n", F.row_number().over(order))
    out = lambda rows, way: rows.select(*keys, "anchor_index", F.lit(way).alias("way"), "n", "line_index", "text", b.alias("bbox"))
    return out(right, "right").unionByName(out(below, "below"))


def _fold(array: Column, start: Column, kind: str, step) -> Column:
    return F.aggregate(array, start.cast(kind), lambda s, x: step(s, x).cast(kind))


def blocks(lines: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """``keys block bbox line_count line_height confidence text``: lines grouped by their gaps and overlaps alone.

    From the top, a line joins the first block that it touches: above or below by at most 1.6 times the median height (14 pixels
    at least), with 0.15 of the narrower width in common. Lines without text or with an empty box are left out.
    """
    keys, box = list(keys), F.col("bbox")
    there = lines.filter((F.trim("text") != "") & (box["x2"] > box["x1"]) & (box["y2"] > box["y1"]))
    line = F.struct(*[box[c].cast("int").alias(c) for c in ("y1", "x1")], "line_index", *[box[c].cast("int").alias(c) for c in ("x2", "y2")], F.col("confidence").cast("double").alias("confidence"), F.trim("text").alias("text"))
    pages = there.groupBy(*keys).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    middle = lambda heights: F.get(F.array_sort(heights), F.floor(F.size(heights) / 2).cast("int"))
    height = lambda x: x["y2"] - x["y1"]
    pages = pages.withColumn("gap", F.greatest(F.floor(middle(F.transform("lines", height)) * 1.6).cast("int"), F.lit(14)))
    member = dict(there.dtypes)["line_index"]
    kind = f"array<struct<x1:int,y1:int,x2:int,y2:int,members:array<struct<y1:int,x1:int,line_index:{member},x2:int,y2:int,confidence:double,text:string>>>>"

    def step(groups, x):
        near = lambda g: (F.abs(x["y1"] - g["y2"]) <= F.col("gap")) & ((F.least(g["x2"], x["x2"]) - F.greatest(g["x1"], x["x1"])) / F.greatest(F.lit(1), F.least(g["x2"] - g["x1"], x["x2"] - x["x1"])) >= 0.15)
        hit = F.array_position(F.transform(groups, near), True)
        grown = lambda g: F.struct(*[(F.least if c[1] == "1" else F.greatest)(g[c], x[c]).alias(c) for c in ("x1", "y1", "x2", "y2")], F.concat(g["members"], F.array(x)).alias("members"))
        new = F.struct(*[x[c] for c in ("x1", "y1", "x2", "y2")], F.array(x).alias("members"))
        return F.when(hit == 0, F.concat(groups, F.array(new))).otherwise(F.transform(groups, lambda g, i: F.when(i + 1 == hit, grown(g)).otherwise(g)))

    found = pages.select(*keys, F.posexplode(_fold(F.col("lines"), F.array(), kind, step)).alias("block", "g"))
    members = F.col("g.members")
    mean = F.aggregate(members, F.lit(0.0), lambda s, m: s + m["confidence"]) / F.size(members)
    return found.select(
        *keys, "block", F.struct(*[F.col("g")[c].alias(c) for c in ("x1", "y1", "x2", "y2")]).alias("bbox"), F.size(members).alias("line_count"),
        middle(F.transform(members, height)).alias("line_height"), F.bround(mean, 3).alias("confidence"), F.array_join(F.transform(F.slice(members, 1, 6), lambda m: m["text"]), "\n").alias("text"),
    )


def _code_like(text: Column) -> Column:
    t = F.trim(text)
    return t.rlike("^[^ ]{1,14}$") & t.rlike("[0-9]")


def merged_passes(primary: DataFrame, secondary: DataFrame, keys: Sequence[str] = ("image_id",), least: float = 0.5) -> DataFrame:
    """``keys n text confidence variant bbox``: the lines of two passes over an image as one list.

    A line of the second pass meets the first line of the list that it overlaps by ``least``; the surer one of both stands
    there from then on. Two codes whose digits differ are both kept, the less sure one at the end as ``+alt``. Lines that meet none
    are added.
    """
    keys = list(keys)
    box = lambda b: F.struct(*[b[c].cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")])
    one = lambda df: df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("line_index", F.struct("text", F.col("confidence").cast("double").alias("confidence"), "variant", box(F.col("bbox")).alias("bbox")).alias("line")))).alias("of"))
    p, s = one(primary).withColumnRenamed("of", "p"), one(secondary).withColumnRenamed("of", "s")
    kind = "array<struct<text:string,confidence:double,variant:string,bbox:struct<x1:int,y1:int,x2:int,y2:int>>>"
    empty = F.array().cast(kind)
    lines = lambda c: F.coalesce(F.transform(c, lambda x: x["line"]).cast(kind), empty)
    digits = lambda x: F.regexp_replace(x["text"], "[^0-9]", "")

    def step(merged, x):
        share = lambda common, m: common / (geometry.area(x["bbox"]) + geometry.area(m["bbox"]) - common)
        near = lambda m: once(geometry.overlap(x["bbox"], m["bbox"]), lambda common: share(common, m) >= least)
        hit = F.array_position(F.transform(merged, near), True)
        return once(hit, lambda at: F.when(at == 0, F.concat(merged, F.array(x))).otherwise(once(F.get(merged, (at - 1).cast("int")), lambda keep: met(merged, x, at, keep))))

    def met(merged, x, hit, keep):
        better = x["confidence"] > keep["confidence"]
        two = F.when(better, F.struct(x.alias("winner"), keep.alias("loser"))).otherwise(F.struct(keep.alias("winner"), x.alias("loser")))
        return once(two, lambda t: settled(merged, hit, t["winner"], t["loser"]))

    def settled(merged, hit, winner, loser):
        now = F.transform(merged, lambda m, i: F.when(i + 1 == hit, winner).otherwise(m))
        two = (F.trim(winner["text"]) != F.trim(loser["text"])) & _code_like(winner["text"]) & _code_like(loser["text"]) & (digits(winner) != digits(loser))
        alt = F.struct(loser["text"].alias("text"), loser["confidence"].alias("confidence"), F.when(loser["variant"].endswith("+alt"), loser["variant"]).otherwise(F.concat(loser["variant"], F.lit("+alt"))).alias("variant"), loser["bbox"].alias("bbox"))
        known = lambda rows: F.exists(rows, lambda m: (m["bbox"] == loser["bbox"]) & (m["text"] == loser["text"]))
        return once(now, lambda rows: F.when(two & ~known(rows), F.concat(rows, F.array(alt))).otherwise(rows))

    both = p.join(s, keys, "full_outer").select(*keys, lines(F.col("p")).alias("p"), lines(F.col("s")).alias("s"))
    out = both.select(*keys, F.posexplode(F.aggregate("s", F.col("p"), lambda m, x: step(m, x).cast(kind))).alias("n", "l"))
    return out.select(*keys, "n", "l.*")


#: Lines of a title, lines beside it that may be skipped between two of its lines, and how far on its lines can stand.
TITLE_LINES, TITLE_SKIPS = 4, 4
_AHEAD = (TITLE_LINES - 1) * TITLE_SKIPS + TITLE_SKIPS


def stacked_titles(lines: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """``keys place until text confidence bbox``: titles printed on two to four lines, one under the other.

    ``lines`` in reading order (``place`` from 1 on) with ``fragment``, whether a line can be part of a title. The next line of a
    title stands in its column, right below; lines beside it are skipped. Lines of a title begin no other one.
    """
    keys = list(keys)
    line = F.struct("place", "fragment", "text", F.col("confidence").cast("double").alias("confidence"), F.col("bbox").alias("b"))
    ahead = Window.partitionBy(*keys).orderBy("place").rowsBetween(0, _AHEAD)
    seen = lines.withColumn("next", F.collect_list(line).over(ahead)).filter("fragment")
    member = "struct<text:string,confidence:double,x1:double,y1:double,x2:double,y2:double>"
    kind = f"struct<members:array<{member}>,skips:int,scanned:int,open:boolean>"
    of = lambda x: F.struct(x["text"].alias("text"), x["confidence"].alias("confidence"), *[x["b"][c].cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])

    def step(s, x):
        prev, cur = F.element_at(s["members"], -1), of(x)
        h = F.greatest(F.lit(1.0), prev["y2"] - prev["y1"])
        gap = cur["y1"] - prev["y2"]
        common = F.least(prev["x2"], cur["x2"]) - F.greatest(prev["x1"], cur["x1"])
        wider = F.greatest(prev["x2"] - prev["x1"], cur["x2"] - cur["x1"])
        in_column = (F.abs(cur["x1"] - prev["x1"]) <= F.greatest(0.6 * h, F.lit(14.0))) | (common >= 0.75 * wider)
        part = x["fragment"] & in_column
        going = s["open"] & (F.size(s["members"]) < TITLE_LINES) & (s["skips"] < TITLE_SKIPS) & (gap <= F.greatest(1.2 * h, F.lit(30.0)))
        tight = (gap <= F.greatest(0.8 * h, F.lit(18.0))) & (gap >= -0.3 * h)
        state = lambda members, skips, more, open_: F.struct(members.alias("members"), skips.alias("skips"), (s["scanned"] + more).alias("scanned"), open_.alias("open"))
        closed = state(s["members"], s["skips"], 0, F.lit(False))
        return F.when(~going, closed).when(~part, state(s["members"], s["skips"] + 1, 1, F.lit(True))).when(~tight, closed).otherwise(state(F.concat(s["members"], F.array(cur)), F.lit(0), 1, F.lit(True)))

    first = F.struct(F.array(of(F.get("next", 0))).alias("members"), F.lit(0).alias("skips"), F.lit(1).alias("scanned"), F.lit(True).alias("open"))
    folded = seen.select(*keys, "place", _fold(F.expr("slice(next, 2, size(next))"), first, kind, step).alias("s")).filter(F.size("s.members") > 1)
    starts = folded.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", (F.col("place") + F.col("s.scanned")).cast("int").alias("until"), F.col("s.members").alias("members")))).alias("starts"))
    chosen_kind = f"array<struct<place:int,until:int,members:array<{member}>>>"
    take = lambda c, x: F.when((F.size(c) == 0) | (x["place"] >= F.element_at(F.concat(F.transform(c, lambda y: y["until"]), F.array(F.lit(0))), F.greatest(F.size(c), F.lit(1)))), F.concat(c, F.array(x))).otherwise(c)
    titles = starts.select(*keys, F.inline(_fold(F.col("starts").cast(chosen_kind), F.array(), chosen_kind, take)))
    every = lambda c: F.transform("members", lambda m: m[c])
    return titles.select(
        *keys, "place", "until", F.array_join(F.transform("members", lambda m: F.trim(m["text"])), " ").alias("text"), F.array_min(every("confidence")).alias("confidence"),
        F.struct(*[(F.array_min if c[1] == "1" else F.array_max)(every(c)).alias(c) for c in ("x1", "y1", "x2", "y2")]).alias("bbox"),
    )


def date_blocks(candidates: DataFrame, values: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """``keys reference deadline reference_now deadline_now earliest latest moved``: the date blocks of images, and whether their
    labels must change values.

    ``candidates``: keys, field_name, n (order), value, score, bbox; ``values``: the dated lines beside them (keys, line_index, iso,
    ambiguous, bbox). A pack's date can't follow its last one. Where one label of each kind stands in a column and their values
    don't keep this order, or one has none, the earliest and the latest date beside the labels go to them, if near enough.
    """
    keys = list(keys)
    kind = F.when(F.col("field_name").isin(*REFERENCE_DATES), 0).when(F.col("field_name").isin(*DEADLINES), 1)
    rank = F.struct(F.col("score"), -F.col("n"))
    some = F.trim("value") != ""
    of_field = candidates.withColumn("kind", kind).filter("kind is not null").groupBy(*keys, "kind", "field_name").agg(
        F.min("n").alias("n"), F.max_by("bbox", F.when(F.col("bbox").isNotNull(), rank)).alias("box"),
        F.max_by(F.regexp_replace("value", r"\|AMBIGUOUS", ""), F.when(some, rank)).alias("now"), F.max(some).alias("read"),
    )
    label = F.struct("kind", "n", "field_name", *[F.col("box")[c].cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")], F.when(F.col("read"), F.col("now")).alias("now"))
    page = of_field.filter("box is not null").groupBy(*keys).agg(F.array_sort(F.collect_list(label)).alias("labels"))
    shape = "array<struct<kind:int,n:bigint,field_name:string,x1:double,y1:double,x2:double,y2:double,now:string>>"
    meets = lambda a, b: F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]) > 0
    joins = lambda held, x: F.when((F.size(held) == 0) | F.exists(held, lambda g: meets(x, g)), F.concat(held, F.array(x))).otherwise(held)
    page = page.withColumn("block", _fold(F.col("labels").cast(shape), F.array(), shape, joins))
    only = lambda k: F.filter("block", lambda x: x["kind"] == k)
    page = page.filter((F.size(only(0)) == 1) & (F.size(only(1)) == 1)).withColumn("r", F.get(only(0), 0)).withColumn("d", F.get(only(1), 0))
    every = lambda c: F.transform("block", lambda x: x[c])
    heights = F.transform("block", lambda x: F.greatest(F.lit(1.0), x["y2"] - x["y1"]))
    h = F.greatest(F.lit(12.0), F.floor(F.aggregate(heights, F.lit(0.0), lambda s, x: s + x) / F.size("block")).cast("double"))
    page = page.select(*keys, "r", "d", h.alias("h"), F.array_min(every("x1")).alias("left"), F.array_min(every("y1")).alias("top"), F.array_max(every("x2")).alias("right"), F.array_max(every("y2")).alias("bottom"))
    v, y = F.col("v"), geometry.y_center(F.col("v"))
    beside = (v["x1"] >= F.col("left")) | (F.least(v["x2"], F.col("right")) - F.greatest(v["x1"], F.col("left")) > 0)
    pool = page.join(values.select(*keys, "line_index", "iso", "ambiguous", F.col("bbox").alias("v")), keys).filter((y >= F.col("top") - 2.5 * F.col("h")) & (y <= F.col("bottom") + 2.5 * F.col("h")) & beside)
    entry, first, last = F.struct("iso", "ambiguous", "v"), F.struct("iso", "line_index"), F.struct("iso", "line_index")
    ends = pool.groupBy(*keys).agg(F.any_value("r").alias("r"), F.any_value("d").alias("d"), F.min_by(entry, first).alias("e"), F.max_by(entry, last).alias("l"))

    def near(value: Column, a: Column) -> Column:
        within = F.abs((value["y1"] + value["y2"]) / 2 - (a["y1"] + a["y2"]) / 2) <= F.greatest(3.0 * F.greatest(F.lit(1.0), a["y2"] - a["y1"]), F.lit(90.0))
        return within & ((value["x1"] >= a["x2"] - 2) | meets(value, a))

    r, d, e, last_one = F.col("r"), F.col("d"), F.col("e"), F.col("l")
    fits = (e["iso"] < last_one["iso"]) & near(e["v"], r) & near(last_one["v"], d)
    both = r["now"].isNotNull() & d["now"].isNotNull()
    moved = fits & (r["now"].isNotNull() | d["now"].isNotNull()) & ~(both & (r["now"] <= d["now"]))
    marked = lambda x: F.concat(x["iso"], F.when(x["ambiguous"], "|AMBIGUOUS").otherwise(""))
    return ends.select(*keys, r["field_name"].alias("reference"), d["field_name"].alias("deadline"), r["now"].alias("reference_now"), d["now"].alias("deadline_now"), marked(e).alias("earliest"), marked(last_one).alias("latest"), moved.alias("moved"))


def paired_dates(candidates: DataFrame, values: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """``candidates`` (keys, field_name, n, value, score, bbox) with the values that ``date_blocks`` gives; ``superseded`` keeps what
    was read before. All readings of a label that changes its value give way to one."""
    keys = list(keys)
    moved = date_blocks(candidates, values, keys).filter("moved")
    to = moved.select(*keys, F.explode(F.array(F.struct(F.col("reference").alias("field_name"), F.col("earliest").alias("to"), F.col("reference_now").alias("was")), F.struct(F.col("deadline").alias("field_name"), F.col("latest").alias("to"), F.col("deadline_now").alias("was")))).alias("m")).select(*keys, "m.*")
    joined = candidates.join(to, [*keys, "field_name"], "left")
    first = F.row_number().over(Window.partitionBy(*keys, "field_name").orderBy(F.col("score").desc(), "n"))
    stays = joined.withColumn("first", first).filter("to is null or first = 1")
    return stays.select(*[F.coalesce("to", "value").alias("value") if c == "value" else F.col(c) for c in candidates.columns], F.when(F.col("to").isNotNull(), F.coalesce("was", F.lit(""))).alias("superseded"))
