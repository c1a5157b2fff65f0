"""Typed readings from recognised lines.

Input lines: ``inspection_id image_id line_index text confidence``. Each extractor gives expressions over a line, each for one
candidate ``field_name value score confidence`` or null; ``candidates`` works all of them out in one pass over the lines.
Only the lines that a cheap test lets through reach the longer patterns.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelkite.functions import text as T

def any_of(*terms: str) -> str:
    """A pattern for each of the terms: a blank in a term is any white space or none, a dot may be missing."""
    return "(?:" + "|".join(t.replace(".", r"\.?").replace(" ", r"\s*") for t in terms) + ")"


#: Units of measure, by what they count, and how labels spell them.
UNITS = {"mass": ("kg", "mg", "grams", "gram", "gms", "gm", "g"), "volume": ("ml", "litres", "litre", "liters", "liter", "ltr", "l"), "length": ("mm", "cm", "m"), "number": ("units", "unit", "pieces", "piece", "pcs", "pc", "nos.", "no.", "n", "u")}
UNIT = any_of(*(u for group in UNITS.values() for u in group))
RUPEES = any_of("₹", "rs.", "inr")
AMOUNT = r"[0-9][0-9,]*(?:\.[0-9]{1,2})?"
NAMES_OF_PRICE = any_of("m. r. p.", "maximum retail price", "max. retail price", "retail sale price")
NUTRIENTS = ("energy", "protein", "proteins", "carbohydrate", "carbohydrates", "sugar", "sugars", "fat", "fats", "cholesterol", "sodium", "dietary fibre", "dietary fiber", "fibre", "fiber", "calcium", "iron", "vitamin", "vitamins", "kcal", "kj", "calorie", "calories")
#: What a line speaks of whose amounts are no retail prices.
OTHER_TOPICS = (*NUTRIENTS, "nutrition", "nutritional", "fssai", "licence no", "license no", "lic. no", "batch", "lot", "phone", "mobile", "tel", "toll free", "email", "e-mail", "pin code", "pincode", "invoice", "tax")

# What NUMERIC, CURRENCY, CARE and SITE recognise, and the terms of NUTRIENTS and OTHER_TOPICS, must be as they are for
# equal results. The other patterns are put together from the lists above. Java's syntax; the letters' case doesn't matter.
MRP_KEYWORD = rf"(?i)\b{NAMES_OF_PRICE}"
CURRENCY = rf"(?i){RUPEES}\s*({AMOUNT})"
UNIT_PRICE = rf"(?i){RUPEES}\s*[0-9][0-9.,]*\s*(?:/|per\s)\s*[0-9]*\s*{UNIT}(?![a-z])"
NEGATIVE = rf"(?i)(?:/|per\s)\s*{UNIT}(?![a-z])|\b{any_of(*OTHER_TOPICS)}\b|www\.|http"
PIN = r"\b[1-9][0-9]{5}\b"
LICENCE_NUMBER = r"\b([0-9]{14}|[0-9]{10})\b"
LICENCE_KEYWORD = rf"(?i)\b{any_of('fssai', 'licence no', 'license no', 'lic. no')}\b"
BATCH = rf"(?i)\b{any_of('batch', 'lot')}\s*{any_of('number', 'no.', 'code')}?\s*[:.-]?\s*([a-z0-9][a-z0-9/-]{{2,20}})\s*$"
CARE = rf"(?i)\b{any_of('consumer care', 'customer care', 'consumer complaint', 'consumer complaints', 'toll free', 'helpline', 'contact', 'contact us')}\b"
SITE = r"(?i)\b((?:https?://|www\.)[a-z0-9.-]+\.[a-z]{2,}(?:/[^\s,;]*)?)"
ORIGIN = rf"(?i)\b{any_of('country of origin', 'country of produce', 'origin', 'made in', 'manufactured in', 'produced in', 'packed in', 'product of', 'produce of')}\s*[:-]?\s*([a-z]{{3,}}[a-z ]{{0,38}})"
NET = r"(?i)\bnet\b|\bnet(?=wt|weight|qty|quantity|content|vol)"
QUANTITY = rf"(?i)([0-9]+(?:\.[0-9]+)?)\s*({UNIT})(?![a-z])"
NUTRITION = rf"(?i)\bnutrition|\bper\s*{any_of('100 g', '100 ml', 'serving', 'scoop')}|\b{any_of(*NUTRIENTS)}\b"
NUMERIC = rf"(?i)^[0-9.,\s%/]+$|^[0-9.,]+\s*{any_of('g', 'mg', 'kg', 'ml', 'kcal', 'kj', 'iu')}%?$"
#: Longer spellings of units to the shorter ones that quantities are given in.
SHORT_UNITS = {"grams": "g", "gram": "g", "gms": "gm", "litres": "litre", "liters": "litre", "liter": "litre", "ltr": "l", "pieces": "pcs", "piece": "pcs", "pc": "pcs", "units": "n", "unit": "n", "u": "n", "nos": "n", "no": "n"}
#: Anchors of dates, the longest first.
DATE_ANCHORS = (
    ("date_best_before", r"best\s*before|\bbb\b"), ("date_expiry", r"use\s*by|expiry|\bexp\b"), ("date_packing", r"pack(?:ed|ing|aging)?\s*(?:date|on)|\bpkd\b"),
    ("date_import", r"import(?:ed)?\s*(?:date|on)"), ("date_manufacturing", r"m[fi1]g|manufactur(?:ed|ing)\s*(?:date|on)?|\bmfd\b"),
)
#: Words of categories, in the order in which ties are settled.
CATEGORIES = {
    "FOOD": (
        "biscuit", "cookies", "snack", "namkeen", "chips", "chocolate", "tea", "coffee", "flour", "atta", "rice", "pulse", "dal", "spice", "masala", "salt",
        "sugar", "honey", "juice", "sauce", "ketchup", "noodles", "pasta", "oil", "ghee", "butter", "cheese", "milk", "dairy", "wafers", "candy", "toffee",
        "fssai", "nutrition", "energy protein", "best before", "confectionery", "food",
    ),
    "BEVERAGE": ("beverage", "drink", "water", "soda", "juice", "cola", "tea", "coffee", "liquid", "ml bottle"),
    "COSMETIC": (
        "cosmetic", "soap", "shampoo", "cream", "lotion", "deodorant", "perfume", "toothpaste", "toothbrush", "lipstick", "powder", "gel", "face wash",
        "hair oil", "conditioner", "toilet soap", "bathing soap", "ayurvedic soap",
    ),
    "HOUSEHOLD": (
        "detergent", "cleaner", "disinfectant", "phenyl", "room freshener", "repellent", "mosquito", "dishwash", "toilet cleaner", "floor cleaner",
        "agarbatti", "candle", "matchbox",
    ),
    "GARMENT": ("cotton", "polyester", "shirt", "t-shirt", "trouser", "saree", "fabric", "wash care", "size", "apparel"),
    "ELECTRICAL": ("bulb", "led", "watt", "voltage", "battery", "cable", "switch", "charger", "extension", "lamp", "lumens", "appliance"),
}
COLUMNS = ("inspection_id", "image_id", "line_index")


def _nutrition_row(text: Column) -> Column:
    """Whether a line speaks of nutrition. Looking for the words alone is much cheaper, so the pattern runs only where one is."""
    stems = sorted({t.split(" ")[0] for t in NUTRIENTS} | {"nutrition", "per"})
    least = [t for t in stems if not any(o != t and t.startswith(o) for o in stems)]
    low = F.transform(F.array(F.lower(text)), lambda t: functools.reduce(Column.__or__, [t.contains(x) for x in least]))
    return F.element_at(low, 1) & text.rlike(NUTRITION)


def flagged(lines: DataFrame, *more: str) -> DataFrame:
    """``lines`` with ``nutrition``: lines of a nutrition table, with the lines of numbers between its first and last one; and ``near_net``:
    whether the line before or after names a net quantity. One sort of each image's lines; ``more`` columns tell views of an image apart."""
    page = Window.partitionBy("inspection_id", "image_id", *more)
    marked = lines.withColumn("_row", _nutrition_row(F.col("text"))).withColumn("_net", F.lower("text").contains("net") & F.col("text").rlike(NET))
    row, ordered = F.when(F.col("_row"), F.col("line_index")), page.orderBy("line_index")
    first, last = F.min(row).over(page), F.max(row).over(page)
    between = F.coalesce(F.col("line_index").between(first, last), F.lit(False)) & F.trim("text").rlike(NUMERIC)
    near = F.coalesce(F.lag("_net").over(ordered), F.lit(False)) | F.coalesce(F.lead("_net").over(ordered), F.lit(False))
    return marked.withColumn("nutrition", F.col("_row") | between).withColumn("near_net", near).drop("_row", "_net")


def _reading(field: Column | str, value: Column, confidence: Column, bonus: Column | float = 0.0, when: Column | None = None, role_uncertain: bool = False) -> Column:
    """A candidate as a struct, null where ``when`` doesn't hold or the value is empty."""
    name = F.lit(field) if isinstance(field, str) else field
    found = lambda v, sure: F.struct(name.alias("field_name"), v.alias("value"), (sure + bonus).alias("score"), sure.alias("confidence"), F.lit(role_uncertain).alias("role_uncertain"))
    read = T.once(value, lambda v: F.when(F.coalesce(v, F.lit("")) != "", T.once(confidence, lambda sure: found(v, sure))))
    return read if when is None else F.when(when, read)


def _conf(pattern: float, context: float | Column) -> Column:
    return T.composed_confidence(F.col("confidence"), pattern, context)


def _digits() -> Column:
    """What most lines don't have, and all amounts, quantities, codes, phones and dates do."""
    return F.col("text").rlike("[0-9]")


def _plain() -> Column:
    return ~F.col("nutrition")


def prices() -> list[Column]:
    """Retail prices: with keyword and currency, with the keyword alone, or with a currency alone; never a price by unit."""
    t = F.col("text")
    priced = _digits() & _plain() & (t.rlike(MRP_KEYWORD) | t.rlike(CURRENCY)) & ~t.rlike(UNIT_PRICE)
    keyword, amount = t.rlike(MRP_KEYWORD), F.regexp_replace(F.regexp_extract(t, CURRENCY, 1), ",", "")
    after = F.regexp_replace(F.regexp_extract(F.regexp_replace(t, MRP_KEYWORD, "\x01"), f"\x01[^0-9]*({AMOUNT})", 1), ",", "")
    confidence = F.greatest(F.lit(0.05), _conf(0.95, 0.9) - F.when(t.rlike(NEGATIVE), 0.15).otherwise(0.0))
    bare = ~keyword & (amount != "") & ~t.rlike(NEGATIVE) & ~t.rlike(PIN) & ~t.rlike(r"\b1[0-9]{13}\b") & ~t.rlike(T.PHONE)
    return [
        _reading("mrp", amount, confidence, 0.3, when=priced & keyword & (amount != "")),
        _reading("mrp", after, _conf(0.65, 0.6), when=priced & keyword & (amount == "") & (after.try_cast("double") > 0)),
        _reading("mrp", amount, _conf(0.45, 0.3), when=priced & bare),
    ]


def unit_prices() -> list[Column]:
    return [_reading("unit_sale_price", F.regexp_extract("text", UNIT_PRICE, 0), _conf(0.9, 0.8), when=_digits())]


def quantities() -> list[Column]:
    """Net quantities; a keyword on the line, or on the one before or after, gives more confidence."""
    t, net = F.col("text"), F.col("text").rlike(NET)
    raw = F.regexp_replace(F.lower(F.regexp_extract(t, QUANTITY, 2)), r"\.", "")

    def short(unit: Column) -> Column:
        out = unit
        for long, less in SHORT_UNITS.items():
            out = F.when(unit == long, less).otherwise(out)
        return out

    value = F.concat_ws(" ", F.regexp_extract(t, QUANTITY, 1), T.once(raw, short))
    confidence = F.when(net, _conf(0.95, 0.85)).when(F.col("near_net"), _conf(0.55, 0.7)).otherwise(_conf(0.55, 0.4))
    return [_reading("net_quantity", value, confidence, F.when(net, 0.25).otherwise(0.0), when=_digits() & _plain() & t.rlike(QUANTITY) & ~t.rlike(UNIT_PRICE))]


def licences() -> list[Column]:
    digits = F.regexp_extract("text", LICENCE_NUMBER, 1)
    long = F.length(digits) == 14
    return [_reading("fssai_license", digits, F.when(long, _conf(0.95, 0.9)).otherwise(_conf(0.7, 0.9)), F.when(long, 0.1).otherwise(0.0), when=_digits() & _plain() & F.col("text").rlike(LICENCE_KEYWORD))]


def batches() -> list[Column]:
    """Batch codes: a digit at least, and neither date, licence, phone nor postal code; digits alone need five."""
    v = F.regexp_extract("text", BATCH, 1)
    code = v.rlike("[0-9]") & ~v.rlike(r"^[0-9]{1,4}[/.\-][0-9]{1,4}(?:[/.\-][0-9]{2,4})?$") & ~v.rlike(rf"^(?:{T.PHONE})$|^1[0-9]{{13}}$|^[1-9][0-9]{{5}}$") & ~v.rlike("^[0-9]{1,4}$")
    return [_reading("batch_lot", v, _conf(0.85, 0.8), when=_digits() & _plain() & code)]


def contacts() -> list[Column]:
    t = F.col("text")
    care = t.rlike(CARE)
    mail = F.lower(F.regexp_extract(t, rf"\b({T.EMAIL})\b", 1))
    phone = F.regexp_replace(F.regexp_extract(t, rf"(?<![0-9])({T.PHONE})(?![0-9])", 1), r"[\s\-]", "")
    calls = _digits() & _plain() & ~t.rlike(r"(?i)[₹$]|rs\.?\s") & ~t.rlike(r"\b1[0-9]{13}\b")
    return [
        _reading("consumer_care_email", mail, F.when(care, _conf(0.9, 0.85)).otherwise(_conf(0.9, 0.7)), when=t.contains("@") & _plain()),
        _reading("consumer_care_phone", phone, F.when(care, _conf(0.85, 0.85)).otherwise(_conf(0.85, 0.6)), F.when(care, 0.1).otherwise(0.0), when=calls),
    ]


def sites() -> list[Column]:
    low = F.lower("text")
    return [_reading("website", T.normalised_site(F.regexp_extract("text", SITE, 1)), _conf(0.9, 0.8), when=low.contains("www.") | low.contains("http"))]


def origins() -> list[Column]:
    low, raw = F.lower("text"), F.regexp_extract("text", ORIGIN, 1)
    spoken = low.contains("origin") | low.contains("in") | low.contains("of")
    return [_reading("country_of_origin", F.initcap(F.trim(F.regexp_replace(raw, r"(?i)\b(?:for|by|and|at|with|only)\b.*$", ""))), _conf(0.9, 0.85), when=spoken)]


def dates() -> list[Column]:
    """Dates by the anchor on their line; a date that can be read both ways is marked after a bar."""
    t = F.lower("text")
    field = F.lit(None).cast("string")
    for name, anchor in reversed(DATE_ANCHORS):
        field = F.when(t.rlike(anchor), name).otherwise(field)
    months = F.regexp_extract(t, r"([0-9]{1,3}\s*(?:day|week|month|year)s?)", 1)

    def valued(date: Column) -> Column:
        return F.coalesce(F.concat(date["iso"], F.when(date["ambiguous"], "|AMBIGUOUS").otherwise("")), F.nullif(months, F.lit("")))

    value = F.element_at(F.transform(F.array(T.printed_date(F.col("text"))), valued), 1)
    return [_reading(field, value, _conf(0.85, 0.8), 0.3, when=_digits() & _plain() & field.isNotNull())]


def companies() -> list[Column]:
    """Lines that name a company without saying in which role: makers, with an uncertain role."""
    return [_reading("manufacturer", F.trim("text"), _conf(0.6, 0.6), when=T.company_like(F.col("text")), role_uncertain=True)]


EXTRACTORS = (prices, unit_prices, quantities, licences, batches, contacts, sites, origins, dates, companies)


def candidates(lines: DataFrame) -> DataFrame:
    """All candidates of all lines, with ``seq`` (their order) and the flags that ranking reads. Each line is read once."""
    return readings(flagged(lines))


def readings(marked: DataFrame, *more: str) -> DataFrame:
    """Candidates of lines that are ``flagged``, with ``more`` of their columns."""
    found = [F.struct(F.lit(n).alias("n"), r.alias("r")) for n, extract in enumerate(EXTRACTORS) for r in extract()]
    found = marked.select(*COLUMNS, *more, F.explode(F.filter(F.array(*found), lambda x: x["r"].isNotNull())).alias("x"))
    seq = F.struct("image_id", F.col("x.n").alias("extractor"), "line_index")
    out = found.select(*COLUMNS, "x.r.field_name", "x.r.value", "x.r.score", "x.r.confidence", seq.alias("seq"), "x.r.role_uncertain", *more)
    return out.withColumn("ambiguous", F.col("value").endswith("|AMBIGUOUS"))


def classified(texts: DataFrame, key: str = "inspection_id", text: str = "text") -> DataFrame:
    """(key, category, state, confidence) by whole words of categories; the earlier category on a tie."""
    t = F.lower(F.coalesce(text, F.lit("")))
    plain = re.compile("[a-z0-9]+").fullmatch

    def score(words: tuple[str, ...]) -> Column:
        """Single words are looked up among the distinct words of the text; the pattern runs only for phrases that occur."""
        n = F.size(F.array_intersect("_words", F.array(*[F.lit(w) for w in words if plain(w)])))
        for w in words:
            if not plain(w):
                # the words of a phrase may be run together or stand further apart
                spaced = w.replace(" ", r"[\x20\x09-\x0D]*")
                n = n + F.when(F.contains(t, F.lit(w.split(" ")[0])), t.rlike(rf"(^|[^a-z0-9]){spaced}([^a-z0-9]|$)").cast("int")).otherwise(0)
        return n

    texts = texts.select(key, text, F.array_distinct(F.split(t, "[^a-z0-9]+")).alias("_words"))
    scores = [score(words) for words in CATEGORIES.values()]
    ranked = F.sort_array(F.array(*[F.struct(s.alias("n"), F.lit(-i).alias("order"), F.lit(c).alias("category")) for i, (c, s) in enumerate(zip(CATEGORIES, scores))]), asc=False)
    top, second = F.col("r")[0]["n"], F.col("r")[1]["n"]
    conflict = (second >= F.greatest(F.lit(1), top - 1)) & (top < 4)
    state = F.when(top == 0, "UNCERTAIN").when(conflict, "CONFLICTING").otherwise("DETECTED")
    confidence = F.when(top == 0, 0.0).when(conflict, F.least(F.lit(0.6), 0.3 + 0.08 * top)).otherwise(F.least(F.lit(0.95), 0.45 + 0.1 * top))
    return texts.select(key, ranked.alias("r")).select(key, F.when(top == 0, "OTHER").otherwise(F.col("r")[0]["category"]).alias("category"), state.alias("state"), F.bround(confidence, 3).alias("confidence"))
