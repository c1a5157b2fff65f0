"""Readings that take a line apart: misread digits, quantities in several parts, several dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelkite.functions.text import UNITS, printed_date, to_base, unit_family

#: Letters that recognition puts for digits, and these digits.
LETTERS, DIGITS = "OoIlSBGZ", "00115862"
_UNIT = "|".join(sorted(UNITS, key=len, reverse=True))
_AMOUNT = rf"([0-9]+(?:\.[0-9]+)?)\s*({_UNIT})\b"
_TOKEN = rf"^((?:₹|Rs\.?)?)([0-9OoIlSBGZ.,/:\-]*)((?:{_UNIT})?)$"
#: Anchors of dates on one line, and their fields.
ANCHORS = (
    ("best before", "date_best_before"), ("use by", "date_expiry"), ("expiry", "date_expiry"), ("exp", "date_expiry"), ("pkd", "date_packing"), ("packed", "date_packing"),
    ("mfg", "date_manufacturing"), ("mfd", "date_manufacturing"),
)


def repaired(text: Column, identifier: Column | None = None) -> Column:
    """struct(text, changes array<struct<was, now>>): letters for digits in tokens that are numbers otherwise.

    A token with any other letter (a code, a word) stays as it was read, and so does one without a digit. Where the line names an
    ``identifier``, a token that ends like a unit is a code as well.
    """
    code = F.lit(False) if identifier is None else F.coalesce(identifier, F.lit(False))

    def fixed(token: Column) -> Column:
        core = F.regexp_extract(token, _TOKEN, 2)
        now = F.concat(F.regexp_extract(token, _TOKEN, 1), F.translate(core, LETTERS, DIGITS), F.regexp_extract(token, _TOKEN, 3))
        return F.struct(token.alias("was"), F.when(token.rlike(_TOKEN) & core.rlike("[0-9]") & ~(code & (F.regexp_extract(token, _TOKEN, 3) != "")), now).otherwise(token).alias("now"))

    tokens = F.transform(F.split(text, " "), fixed)
    return F.struct(F.array_join(F.transform(tokens, lambda t: t["now"]), " ").alias("text"), F.filter(tokens, lambda t: t["was"] != t["now"]).alias("changes"))


def quantity(text: Column) -> Column:
    """struct(value, family, extra, declared_total, pack_count, uncombined, discrepancy) in base units.

    ``n x v`` is a pack; else parts are summed if they are of one family, and what is extra or free counts in. A total
    after ``=`` is compared with the sum: more than 0.05 and one per cent apart is a discrepancy.
    """
    t = F.lower(text)
    amounts = lambda c: F.transform(F.regexp_extract_all(c, F.lit(f"({_AMOUNT})"), F.lit(1)), lambda a: F.struct(to_base(F.regexp_extract(a, _AMOUNT, 1).cast("double"), F.regexp_extract(a, _AMOUNT, 2)).alias("v"), unit_family(F.regexp_extract(a, _AMOUNT, 2)).alias("f")))
    total_of = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x["v"])
    before, after = F.split(t, "=", 2)[0], F.get(F.split(t, "=", 2), 1)
    parts = amounts(before)
    pack = rf"([0-9]+)\s*[x×]\s*{_AMOUNT}"
    n = F.nullif(F.regexp_extract(before, pack, 1), F.lit("")).cast("int")
    packed = n * to_base(F.nullif(F.regexp_extract(before, pack, 2), F.lit("")).cast("double"), F.regexp_extract(before, pack, 3))
    one_family = F.size(F.array_distinct(F.transform(parts, lambda p: p["f"]))) == 1
    summed = F.when(one_family, F.round(total_of(parts), 6))
    free = F.coalesce(F.nullif(F.regexp_extract(before, rf"\+\s*({_AMOUNT})\s*(?:extra|free)", 1), F.lit("")), F.nullif(F.regexp_extract(before, rf"(?:free|extra)\s*({_AMOUNT})", 1), F.lit("")))
    extra = F.get(amounts(free), 0)["v"]
    declared = F.get(amounts(after), 0)["v"]
    value = F.coalesce(packed, summed)
    return F.struct(
        F.coalesce(declared, value).alias("value"), F.get(parts, 0)["f"].alias("family"), extra.alias("extra"), declared.alias("declared_total"), n.alias("pack_count"),
        ((F.size(parts) > 1) & ~one_family).alias("uncombined"), (F.abs(declared - value) > 0.05 + 0.01 * value).alias("discrepancy"),
    )


def several_dates(text: Column) -> Column:
    """array<struct<field, iso>> of a line with several dates: the first anchor goes with the first date, and so on; an anchor
    without a date of its own takes the last one. The first of a field counts; dates that can be read both ways are marked."""
    found = F.regexp_extract_all(F.lower(text), F.lit("(" + "|".join(a for a, _ in ANCHORS) + ")"), F.lit(1))
    dates = F.regexp_extract_all(text, F.lit(r"([0-9]{1,2}[./-][0-9]{1,2}[./-](?:[0-9]{4}|[0-9]{2}))"), F.lit(1))

    def field(anchor: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, f in ANCHORS:
            out = F.when(anchor == name, f).otherwise(out)
        return out

    def iso(d: Column) -> Column:
        p = printed_date(d)
        return F.concat(p["iso"], F.when(p["ambiguous"], "|AMBIGUOUS").otherwise(""))

    pairs = F.transform(found, lambda a, i: F.struct(field(a).alias("field"), iso(F.coalesce(F.get(dates, i), F.get(dates, F.size(dates) - 1))).alias("iso")))
    return F.filter(pairs, lambda p, i: p["iso"].isNotNull() & (F.array_position(F.transform(pairs, lambda q: q["field"]), p["field"]) == i + 1))
