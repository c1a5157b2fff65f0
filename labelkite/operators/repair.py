"""What recognition gets wrong and can be put right: lost spaces between words, and letters read for digits.

Neither changes a reading in place: names keep their raw text beside the repaired one, and readings of corrected lines stand
beside those of the lines as they were read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelkite.functions.composite import repaired
from labelkite.operators import extract

#: The words into which runs of capitals may be taken apart.
VOCABULARY = tuple(
    """with without and an for the of all free net wt weight volume quantity qty mrp price retail sale
    incl inclusive taxes maximum unit address refer please first character batch no number
    manufactured manufacturer mfd mfg mfgd packed packer pkd marketed marketer imported importer
    industries industry ltd limited pvt private company companies products product foods
    enterprises corporation traders agency distributors manufactures
    herbs herbal extracts extract oil oils soap medicine proprietary ayurvedic toilet toiletry
    care customer consumer service toll phone mobile email website www
    best before use expiry date drug drugs licensed license licence users tm made india
    store keep away mix pack composition contents packsize solid bis isi gr grade quality
    sulphate sodium silicate colour colours color water milk juice tea coffee salt sugar flour
    rice atta masala spices biscuit biscuits cookies chocolate cream powder hair skin body face
    hand wash chips noodles ghee butter cheese honey jam sauce paste detergent cleaner fresh pure
    natural premium bottle pouch sachet tub jar box carton contains added preservatives flavour
    flavours artificial vitamin vitamins protein energy calories serving approx gram grams
    millilitre millilitres litre litres kg g mg ml""".split()
)
#: Fields whose shown value is repaired; values that are parsed (quantities, prices, dates, codes) never are.
SPACED_FIELDS = (
    "product_name", "brand", "common_name", "manufacturer", "packer", "importer", "marketer",
    "manufacturer_address", "packer_address", "importer_address",
)
#: Fields that are read a second time from corrected lines.
CORRECTED_FIELDS = (
    "mrp", "net_quantity", "date_manufacturing", "date_packing", "date_import", "date_expiry", "date_best_before",
    "fssai_license", "consumer_care_phone", "batch_lot",
)
#: Letters of the shortest run that is taken apart, and of its shortest word.
LEAST_RUN, LEAST_WORD = 7, 2
#: Rows up to which a vocabulary is broadcast.
SMALL = 100_000
_MARKS = r"""[.,;:'"()\[\]]*"""
_RUN = rf"^({_MARKS})([A-Z]{{{LEAST_RUN},}})({_MARKS})$"
_IDENTIFIER = r"(?i)\b(?:batch|lot|serial|part\s*no|b\.?\s*no)\b"


def vocabulary(spark) -> DataFrame:
    return spark.createDataFrame([(w,) for w in VOCABULARY], "word string")


def decomposed(runs: DataFrame, words: DataFrame) -> DataFrame:
    """``run pieces`` for each distinct ``run`` of capitals that falls apart completely into at least two of ``words``.

    All pieces of a run that are words are found by one join; they are the steps between places of the run, over which a fold
    finds for each place the first one that leads there. A run that is a word itself stays whole. The work for a run grows
    with its length times that of the longest word.
    """
    known = words.select(F.lower("word").alias("word")).filter(F.length("word") >= LEAST_WORD).distinct()
    count, longest = known.agg(F.count("*"), F.max(F.length("word"))).first()
    n = F.length("run")
    asked = runs.select("run").distinct().join(known.select(F.col("word").alias("w")), F.lower("run") == F.col("w"), "left_anti")
    begins = asked.filter(n >= LEAST_RUN).withColumn("i", F.explode(F.sequence(F.lit(0), n - LEAST_WORD)))
    pieces = begins.withColumn("j", F.explode(F.sequence(F.col("i") + LEAST_WORD, F.least(F.col("i") + F.lit(longest or LEAST_WORD), n))))
    steps = pieces.withColumn("word", F.lower(F.substring("run", F.col("i") + 1, F.col("j") - F.col("i"))))
    steps = steps.join(F.broadcast(known) if count <= SMALL else known, "word", "left_semi")
    by_run = steps.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("i", "j"))).alias("steps"))
    # from[j]: the first place from which a word leads to j, -1 where none does
    start = F.transform(F.sequence(F.lit(0), n), lambda k: F.when(k == 0, 0).otherwise(-1))
    leads = lambda s, x: (F.get(s, x["i"]) >= 0) & (F.get(s, x["j"]) < 0)
    from_ = F.aggregate("steps", start, lambda s, x: F.when(leads(s, x), F.transform(s, lambda v, k: F.when(k == x["j"], x["i"]).otherwise(v))).otherwise(s))
    done = by_run.withColumn("from", from_).filter(F.get("from", n) >= 0)
    kind = "struct<at:int,pieces:array<string>>"

    def back(s: Column, _: Column) -> Column:
        at = F.get("from", s["at"])
        piece = F.substring("run", at + 1, s["at"] - at)
        return F.when(s["at"] > 0, F.struct(at.alias("at"), F.concat(F.array(piece), s["pieces"]).alias("pieces"))).otherwise(s).cast(kind)

    end = F.struct(n.alias("at"), F.array().cast("array<string>").alias("pieces")).cast(kind)
    return done.select("run", F.aggregate("steps", end, back)["pieces"].alias("pieces"))


def respaced(rows: DataFrame, column: str, words: DataFrame) -> DataFrame:
    """``rows`` with the lost spaces of ``column`` put back; letters are neither added nor taken away.

    A short abbreviation's full stop and a change between letters and digits get a space, a run of capitals that falls apart into
    ``words`` as a whole is split; white space becomes one space. Each distinct text is repaired once.
    """
    texts = rows.filter(F.col(column).isNotNull()).select(F.col(column).alias("text")).distinct()
    spaced = F.regexp_replace("text", r"(?<!\S)([A-Z][a-z]{1,4}\.)(?=[A-Z])", "$1 ")
    spaced = F.regexp_replace(F.regexp_replace(spaced, r"(?<=[A-Za-z])(?=[0-9])", " "), r"(?<=[0-9])(?=[A-Za-z])", " ")
    tokens = texts.select("text", F.posexplode(F.split(F.trim(F.regexp_replace(spaced, r"\s+", " ")), " ")).alias("n", "token"))
    tokens = tokens.withColumn("run", F.nullif(F.regexp_extract("token", _RUN, 2), F.lit("")))
    apart = decomposed(tokens.select("run").filter("run is not null"), words)
    whole = F.concat(F.regexp_extract("token", _RUN, 1), F.array_join("pieces", " "), F.regexp_extract("token", _RUN, 3))
    fixed = tokens.join(apart, "run", "left").select("text", "n", F.when(F.col("pieces").isNotNull(), whole).otherwise(F.col("token")).alias("token"))
    out = fixed.groupBy("text").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "token"))), lambda x: x["token"]), " ").alias("_spaced"))
    joined = rows.join(out.withColumnRenamed("text", "_text"), F.col(column) == F.col("_text"), "left")
    return joined.select(*[F.coalesce("_spaced", column).alias(c) if c == column else F.col(c) for c in rows.columns])


def shown(candidates: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates with ``raw_value`` as it was read and ``respaced``, whether the shown value differs; only ``SPACED_FIELDS`` do."""
    raw = candidates.withColumn("raw_value", F.col("value"))
    named = F.col("field_name").isin(*SPACED_FIELDS)
    fixed = respaced(raw.filter(named), "value", words)
    out = fixed.unionByName(raw.filter(~F.coalesce(named, F.lit(False))))
    return out.withColumn("respaced", ~F.col("value").eqNullSafe(F.col("raw_value")))


def second_run(lines: DataFrame) -> DataFrame:
    """Candidates of ``lines`` as they were read and as they are with misread digits corrected, told apart by ``corrected``.

    Corrected lines stand in their image with its other lines. Of what is read from them only ``CORRECTED_FIELDS`` count, and only
    what the line as it was read didn't give already; ``changes`` has what was corrected. Codes after a batch, lot or part number
    stay. ``ranking.deduplicated`` prefers corrected readings of a box. Both views of an image go through the extractors in one pass,
    without a join: lines are many times the size of what they are made from.
    """
    view = lines.withColumn("view", repaired(F.col("text"), F.col("text").rlike(_IDENTIFIER)))
    none = F.array().cast(view.schema["view"].dataType["changes"].dataType)
    one = lambda text, corrected, changes: F.struct(text.alias("text"), F.lit(corrected).alias("corrected"), changes.alias("changes"))
    views = F.array(one(F.col("text"), False, none), one(F.col("view.text"), True, F.col("view.changes")))
    both = view.select(*[c for c in lines.columns if c != "text"], F.inline(views))
    # the lines that stay as they are only surround the corrected ones
    marked = extract.flagged(both, "corrected").filter(~F.col("corrected") | (F.size("changes") > 0))
    read = extract.readings(marked, "corrected", "changes").filter(~F.col("corrected") | F.col("field_name").isin(*CORRECTED_FIELDS))
    given = F.min(F.col("corrected").cast("int")).over(Window.partitionBy(*extract.COLUMNS, "field_name", "value"))
    last = ("corrected", "changes")
    return read.withColumn("_given", given).filter(~F.col("corrected") | (F.col("_given") == 1)).select(*[c for c in read.columns if c not in last], *last)
