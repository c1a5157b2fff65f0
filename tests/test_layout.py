"""Places of lines: planted cases for blocks, passes, titles and dates in columns, and brute force for walks and passes."""

import random

from pyspark.sql import functions as F

from labelkite.operators import layout

BOX = "struct<x1:int,y1:int,x2:int,y2:int>"


def lines(spark, rows, more="confidence double"):
    return spark.createDataFrame(rows, f"image_id int, line_index int, text string, bbox {BOX}, {more}")


def test_walk_ends_at_a_boundary(spark):
    rows = [
        (1, 0, "Mfg", (10, 100, 60, 115), True, False), (1, 1, "12/03/2024", (70, 102, 150, 116), False, False), (1, 2, "far right", (300, 98, 350, 112), False, False),
        (1, 3, "below", (12, 118, 58, 130), False, False), (1, 4, "Batch", (12, 132, 58, 144), False, True), (1, 5, "after", (12, 146, 58, 158), False, False),
        (1, 6, "  ", (12, 117, 58, 120), False, False), (2, 0, "other image", (70, 102, 150, 116), False, False),
    ]
    got = layout.walks(lines(spark, rows, "anchor boolean, boundary boolean")).collect()
    assert sorted((r.way, r.n, r.text) for r in got) == [("below", 1, "below"), ("right", 1, "12/03/2024"), ("right", 2, "far right")]


def test_walks_against_all_pairs(spark):
    rnd = random.Random(6)
    rows = []
    for i in range(120):
        x, y = rnd.randrange(400), rnd.randrange(900)
        rows.append((i % 3, i, "t", (x, y, x + rnd.randrange(5, 150), y + rnd.randrange(1, 200)), rnd.random() < 0.3, rnd.random() < 0.2))
    got = {(r.image_id, r.anchor_index, r.way, r.line_index) for r in layout.walks(lines(spark, rows, "anchor boolean, boundary boolean")).collect()}
    want = set()
    for image, k, _, a, anchor, _ in rows:
        if not anchor:
            continue
        below = []
        for other, j, _, b, _, stop in rows:
            if other != image or j == k:
                continue
            common = min(a[3], b[3]) - max(a[1], b[1])
            if common > 0 and common / min(a[3] - a[1], b[3] - b[1]) >= 0.5 and b[0] >= a[2] - 2:
                want.add((image, k, "right", j))
            common = min(a[2], b[2]) - max(a[0], b[0])
            if common > 0 and common / min(a[2] - a[0], b[2] - b[0]) >= 0.5 and 0 <= b[1] - a[3] + 2 and b[1] - a[3] <= max(3 * (a[3] - a[1]), 60):
                below.append((b[1], j, stop))
        for _, j, stop in sorted(below):
            if stop:
                break
            want.add((image, k, "below", j))
    assert got == want and len(want) > 50


def test_blocks(spark):
    rows = [
        (1, 0, "HEAD", (10, 10, 200, 30), 0.9), (1, 1, "second", (10, 36, 180, 52), 0.8), (1, 2, "aside", (400, 36, 460, 52), 0.5), (1, 3, "far below", (10, 300, 90, 316), 0.7),
        (1, 4, "", (10, 53, 90, 60), 0.1), (1, 5, "no box", (10, 60, 10, 70), 0.1), (1, 6, "third", (150, 56, 300, 72), 0.6),
    ]
    got = layout.blocks(lines(spark, rows)).orderBy("block").collect()
    assert [(r.text, r.line_count, tuple(r.bbox), r.line_height) for r in got] == [
        ("HEAD\nsecond\nthird", 3, (10, 10, 300, 72), 16), ("aside", 1, (400, 36, 460, 52), 16), ("far below", 1, (10, 300, 90, 316), 16),
    ]
    assert got[0].confidence == 0.767
    assert layout.blocks(lines(spark, [])).count() == 0


def test_merged_passes_chains_and_codes(spark):
    kind = "confidence double, variant string"
    first = lines(spark, [(1, 0, "L-2034", (0, 0, 100, 20), 0.6, "full"), (1, 1, "alone", (0, 100, 50, 120), 0.9, "full"), (3, 0, "only here", (0, 0, 9, 9), 0.5, "full")], kind)
    second = lines(spark, [
        (1, 0, "L-2084", (2, 0, 102, 20), 0.8, "small"),  # surer, another code: both stay
        (1, 1, "L-2034 x", (3, 0, 103, 20), 0.7, "small"),  # meets the winner, no code
        (1, 2, "Alone", (0, 100, 52, 120), 0.2, "small"),  # less sure, no code: goes
        (1, 3, "new", (300, 0, 340, 20), 0.3, "small"), (2, 0, "first of its image", (0, 0, 9, 9), 0.4, "small"),
    ], kind)
    got = layout.merged_passes(first, second).collect()
    assert sorted((r.image_id, r.n, r.text, r.variant) for r in got) == [
        (1, 0, "L-2084", "small"), (1, 1, "alone", "full"), (1, 2, "L-2034", "full+alt"), (1, 3, "new", "small"), (2, 0, "first of its image", "small"), (3, 0, "only here", "full"),
    ]


def titles(spark, rows):
    df = spark.createDataFrame(rows, f"image_id int, place int, fragment boolean, text string, confidence double, bbox {BOX}")
    return [(r.place, r.until, r.text) for r in layout.stacked_titles(df).orderBy("place").collect()]


def test_title_over_a_tag_beside_it(spark):
    rows = [
        (1, 1, True, "COOKIE", (500, 40, 560, 60), 0.8), (1, 2, True, "GOLDEN", (100, 70, 300, 150), 0.9), (1, 3, False, "-30%", (320, 60, 400, 140), 0.9),
        (1, 4, True, "OATS", (102, 156, 240, 190), 0.7), (1, 5, True, "& HONEY", (101, 192, 260, 226), 0.8), (1, 6, True, "Net Wt", (101, 400, 160, 420), 0.9),
    ]
    rows = [(i, p, f, t, c, b) for i, p, f, t, b, c in rows]
    assert titles(spark, rows) == [(2, 6, "GOLDEN OATS & HONEY")]


def test_title_of_four_lines_at_most(spark):
    rows = [(1, k, True, f"T{k}", 0.9, (10, 30 * k, 100, 30 * k + 24)) for k in range(1, 8)]
    assert titles(spark, rows) == [(1, 5, "T1 T2 T3 T4"), (5, 8, "T5 T6 T7")]
    assert titles(spark, [(1, 1, True, "alone", 0.9, (0, 0, 9, 9))]) == []


CANDIDATES = f"image_id int, field_name string, n int, value string, score double, bbox {BOX}"
VALUES = f"image_id int, line_index int, iso string, ambiguous boolean, bbox {BOX}"


def test_columns_out_of_step(spark):
    labels = [("date_packing", (10, 100, 70, 115)), ("date_expiry", (10, 125, 70, 140))]
    values = [(0, "2024-03-01", False, (90, 88, 160, 100)), (1, "2025-02-28", True, (90, 112, 160, 125))]

    def run(now, values=values, labels=labels):
        c = spark.createDataFrame([(1, f, k, v, 1.0, b) for k, ((f, b), v) in enumerate(zip(labels, now))] + [(1, "mrp", 9, "12", 1.0, None)], CANDIDATES)
        return {r.field_name: (r.value, r.superseded) for r in layout.paired_dates(c, spark.createDataFrame([(1, *v) for v in values], VALUES)).collect()}

    # the packing label took the date beside the other one
    assert run(["2025-02-28", None]) == {"date_packing": ("2024-03-01", "2025-02-28"), "date_expiry": ("2025-02-28|AMBIGUOUS", ""), "mrp": ("12", None)}
    assert run(["2025-02-28", "2024-03-01"])["date_expiry"] == ("2025-02-28|AMBIGUOUS", "2024-03-01")
    # coherent blocks, blocks without any reading, one date only and columns apart stay
    for now in (["2024-03-01", "2025-02-28|AMBIGUOUS"], [None, None]):
        assert [v for v, _ in (run(now)["date_packing"], run(now)["date_expiry"])] == now
    assert run(["2025-02-28", None], values[1:])["date_packing"] == ("2025-02-28", None)
    assert run(["2025-02-28", None], labels=[labels[0], ("date_expiry", (400, 125, 460, 140))])["date_packing"] == ("2025-02-28", None)
    assert run(["2025-02-28", None], labels=[labels[0], ("date_import", (10, 125, 70, 140))])["date_packing"] == ("2025-02-28", None)


def test_best_reading_stands_for_a_label(spark):
    c = spark.createDataFrame([
        (1, "date_packing", 0, "2025-02-28", 0.4, (10, 100, 70, 115)), (1, "date_packing", 1, "2024-01-01", 0.9, None), (1, "date_expiry", 2, "2023-01-01", 0.9, (10, 125, 70, 140)),
    ], CANDIDATES)
    v = spark.createDataFrame([(1, 0, "2023-01-01", False, (90, 100, 160, 115)), (1, 1, "2024-01-01", False, (90, 125, 160, 140))], VALUES)
    got = layout.date_blocks(c, v).first()
    assert (got.reference_now, got.deadline_now, got.earliest, got.latest, got.moved) == ("2024-01-01", "2023-01-01", "2023-01-01", "2024-01-01", True)
    assert layout.paired_dates(c, v).filter(F.col("field_name") == "date_packing").count() == 1


def test_bands_of_an_image(spark):
    from labelkite.operators import quality

    kind = "width int, height int, laplacian_variance double, mean_brightness double, rms_contrast double, glare double, overexposure double, underexposure double, skew double, blockiness double"
    rows = [
        (2000, 1500, 400.0, 120.0, 50.0, 0.0, 0.0, 0.0, -1.0, 1.0),  # all good
        (1500, 2000, 400.0, 120.0, 50.0, 0.08, 0.0, 0.0, 0.0, 1.0),  # one poor metric
        (1500, 2000, 400.0, 120.0, 50.0, 0.08, 0.2, 0.0, 0.0, 1.0),  # two
        (600, 600, 10.0, 120.0, 50.0, 0.0, 0.0, 0.0, 0.0, 1.0),  # small and blurred
        (800, 800, 50.0, 20.0, 10.0, 0.5, 0.5, 0.5, -20.0, 9.0), (None, None, None, None, None, None, None, None, None, None),
    ]
    got = [(r.status, r.score) for r in quality.image_quality(spark.createDataFrame(rows, kind).coalesce(1)).collect()]
    assert got == [("GOOD", 1.0), ("GOOD", 0.864), ("ACCEPTABLE", 0.791), ("UNUSABLE", 0.682), ("POOR", 0.191), ("UNUSABLE", 0.0)]


def test_ground_truth_over_views(spark):
    from labelkite.operators import quality

    spec = "struct<value:string,unit:string>"
    annotations = spark.createDataFrame([(1, {"mrp": ("10.00", None), "net_quantity": ("500", "g"), "brand": (" ", None)}), (2, {"mrp": ("20", None)}), (3, {"mrp": ("30", None)})], f"product_id int, fields map<string,{spec}>")
    readings = spark.createDataFrame([(1, 0, "mrp", "99", 0.4), (1, 1, "mrp", "10", 0.6), (1, 0, "net_quantity_value", "", 0.9), (2, 0, "mrp", "21", 0.7)], "product_id int, view_index int, field string, value string, confidence double")
    got = {r.field: (r.exact, r["same"], r.wrong, r.missing) for r in quality.evaluated(annotations, readings).collect()}
    assert got == {"mrp": (0, 1, 1, 0), "net_quantity_value": (0, 0, 0, 1), "net_quantity_unit": (0, 0, 0, 1)}


def test_a_line_is_compared_with_a_merged_list_once(spark):
    kind = f"image_id int, line_index int, text string, confidence double, variant string, bbox {BOX}"
    first = spark.createDataFrame([(1, 0, "B12", 0.5, "full", (0, 0, 100, 20)), (1, 1, "word", 0.9, "full", (0, 40, 100, 60))], kind)
    second = spark.createDataFrame([(1, 0, "B13", 0.8, "small", (0, 0, 100, 20)), (1, 1, "other", 0.3, "small", (0, 40, 100, 60)), (1, 2, "new", 0.3, "small", (300, 40, 400, 60))], kind)
    got = layout.merged_passes(first, second)
    assert [(r.text, r.variant) for r in got.orderBy("n").collect()] == [("B13", "small"), ("word", "full"), ("B12", "full+alt"), ("new", "small")]
    assert got._jdf.queryExecution().analyzed().toString().count("array_position(") == 1
