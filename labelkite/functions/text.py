"""Column expressions over label text: cleaning, comparing, normalising, validating.

Patterns are written so that Java's, Python's and RE2's engines read them alike: explicit ASCII classes, no look-around.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days in a unit of a declared shelf life.
UNIT_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}
#: Units of measure with their family and size in the family's base unit.
UNITS = {
    "mg": ("MASS", 0.001), "g": ("MASS", 1.0), "gm": ("MASS", 1.0), "kg": ("MASS", 1000.0),
    "ml": ("VOLUME", 1.0), "l": ("VOLUME", 1000.0), "litre": ("VOLUME", 1000.0),
    "mm": ("LENGTH", 1.0), "cm": ("LENGTH", 10.0), "m": ("LENGTH", 1000.0), "n": ("NUMBER", 1.0), "pcs": ("NUMBER", 1.0),
}
#: What ends or is in the name of a company.
ENTITY_WORDS = (
    "pvt", "private", "ltd", "limited", "llp", "llc", "plc", "inc", "incorporated", "corp", "corporation", "company", "industries",
    "enterprises", "holdings", "gmbh", "manufacturers", "packers", "importers", "distributors",
)
ENTITY_TAILS = (
    "LTD", "LIMITED", "PVT", "PVTLTD", "PRIVATE", "PRIVATELIMITED", "LLP", "LLC", "PLC", "INCORPORATED", "CORPORATION", "CORP", "COMPANY",
    "ENTERPRISES", "INDUSTRIES", "HOLDINGS", "GMBH", "PTE", "SDNBHD",
)
ENTITY_STRONG = ("INDUSTRIES", "ENTERPRISES", "CORPORATION", "PRIVATELIMITED", "PVTLTD", "MANUFACTURERS", "PACKERS", "IMPORTERS", "DISTRIBUTORS")
#: Scripts and their blocks, in the order in which ties are settled.
SCRIPTS = {
    "Devanagari": "ऀ-ॿ", "Bengali": "ঀ-৿", "Gurmukhi": "਀-੿", "Gujarati": "઀-૿", "Odia": "଀-୿",
    "Tamil": "஀-௿", "Telugu": "ఀ-౿", "Kannada": "ಀ-೿", "Malayalam": "ഀ-ൿ", "Latin": "A-Za-z",
}

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?:\+?91[\s-]?)?[6-9][0-9]{9}|1800[\s-]?[0-9]{3}[\s-]?[0-9]{3,4}"


def once(value: Column, made) -> Column:
    """``made(value)`` with ``value`` worked out once, however often ``made`` names it: an array of one."""
    return F.element_at(F.transform(F.array(value), made), 1)


def squashed(text: Column) -> Column:
    """Letters and digits only, in capitals."""
    return F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9]+", ""))


def company_like(text: Column) -> Column:
    """Whether a line names a company, with or without spaces between its words."""
    word = F.lower(text).rlike(rf"\b({'|'.join(ENTITY_WORDS)})\b")
    either = lambda tests: functools.reduce(Column.__or__, tests)
    named = lambda s: (F.length(s) >= 5) & (either([s.endswith(x) for x in ENTITY_TAILS]) | either([s.contains(x) for x in ENTITY_STRONG]))
    return F.coalesce((F.length(F.trim(text)) >= 4) & (word | once(squashed(text), named)), F.lit(False))


def script(text: Column) -> Column:
    """The script with the most characters; the first one on a tie, 'Unknown' without any."""
    count = lambda block: F.length(F.regexp_replace(text, f"[^{block}]+", ""))
    one = lambda n, place, name: F.struct(n.alias("n"), F.lit(-place).alias("order"), F.lit(name).alias("name"))
    counted = F.array_max(F.array(one(F.lit(0), len(SCRIPTS), "Unknown"), *[one(F.when(text.rlike(f"[{block}]"), count(block)).otherwise(0), i, name) for i, (name, block) in enumerate(SCRIPTS.items())]))
    # Latin alone, or none: settled by looking for any letter of the other blocks, which reads the text once
    others = "".join(block for name, block in SCRIPTS.items() if name != "Latin")
    few = F.when(text.rlike(f"[{SCRIPTS['Latin']}]"), "Latin").otherwise("Unknown")
    return F.when(text.rlike(f"[{others}]"), counted["name"]).when(text.isNotNull(), few)


def number(text: Column) -> Column:
    """A number with thousands separators, or null."""
    return F.regexp_replace(text, ",", "").try_cast("double")


def agree(a: Column, b: Column) -> Column:
    """Two readings say the same: equal, or equal as numbers."""
    return (a == b) | F.coalesce(number(a) == number(b), F.lit(False))


def money(text: Column) -> Column:
    """The first amount in a text; commas separate thousands."""
    return number(F.nullif(F.regexp_extract(F.lower(text), r"(?:₹|rs\.?|inr)?[ ]*([0-9][0-9,]*(?:\.[0-9]{1,2})?)", 1), F.lit("")))


def duration_days(text: Column) -> Column:
    """Days of a declared duration; a month counts 30 days and a year 365."""
    def days(t: Column) -> Column:
        n = F.nullif(F.regexp_extract(t, r"([0-9]{1,3})[ ]*(day|week|month|year)", 1), F.lit("")).cast("int")
        return n * once(F.regexp_extract(t, r"([0-9]{1,3})[ ]*(day|week|month|year)", 2), size)

    def size(unit: Column) -> Column:
        out = F.lit(None).cast("int")
        for name, n in UNIT_DAYS.items():
            out = F.when(unit == name, n).otherwise(out)
        return out

    return once(F.lower(F.coalesce(text, F.lit(""))), days)


def parsed_date(text: Column) -> Column:
    """A date in one of the printed forms; month and year alone are the first of the month."""
    t = F.trim(text)
    forms = (
        (r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "y-M-d"), (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "d/M/y"), (r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$", "d-M-y"),
        (r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$", "d.M.y"), (r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$", "y/M/d"), (r"^[0-9]{1,2}/[0-9]{4}$", "M/y"),
    )
    found = [F.when(t.rlike(shape), F.to_date(F.try_to_timestamp(t, F.lit(form)))) for shape, form in forms]
    return F.coalesce(*found)


def printed_date(text: Column) -> Column:
    """struct(iso, ambiguous) of a day, month and year in a line; two-digit years are of this century.

    Day and month are swapped where only this gives a date, and ambiguous where both ways do.
    """
    shape = r"(?:^|[^0-9])([0-9]{1,2})[./-]([0-9]{1,2})[./-]([0-9]{4}|[0-9]{2})(?:[^0-9]|$)"
    a, b, y = (F.nullif(F.regexp_extract(text, shape, k), F.lit("")).cast("int") for k in (1, 2, 3))
    day, month = F.when((b > 12) & (a <= 12), b).otherwise(a), F.when((b > 12) & (a <= 12), a).otherwise(b)
    year = F.when(y < 100, y + 2000).otherwise(y)
    iso = F.format_string("%04d-%02d-%02d", year, month, day)
    date = F.when(y.isNotNull(), F.to_date(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd"))))
    return F.when(date.isNotNull(), F.struct(F.date_format(date, "yyyy-MM-dd").alias("iso"), ((a <= 12) & (b <= 12) & (a != b)).alias("ambiguous")))


def unit_family(unit: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, (family, _) in UNITS.items():
        out = F.when(F.lower(unit) == name, family).otherwise(out)
    return out


def to_base(quantity: Column, unit: Column) -> Column:
    """A quantity in the base unit of its family; null for an unknown unit."""
    out = F.lit(None).cast("double")
    for name, (_, size) in UNITS.items():
        out = F.when(F.lower(unit) == name, F.lit(size)).otherwise(out)
    return quantity * out


def normalised_price(text: Column) -> Column:
    """``₹ 1,234.00``"""
    return F.concat(F.lit("₹ "), F.format_number(money(text), 2))


def normalised_phone(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9+]", "")


def normalised_site(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"[.,;]+$", "")


def price_problems(text: Column) -> Column:
    v = money(text)
    return F.array_compact(F.array(F.when(v.isNull(), "not a price"), F.when(v <= 0, "not positive"), F.when(v > 1e7, "implausibly large")))


def licence_problems(text: Column) -> Column:
    digits = F.length(F.regexp_replace(text, "[^0-9]", ""))
    return F.array_compact(F.array(F.when(digits == 10, "10 digits, 14 expected"), F.when(~digits.isin(10, 14), "not a licence number")))


def contact_problems(email: Column, phone: Column) -> Column:
    return F.array_compact(F.array(F.when(~email.rlike(f"^{EMAIL}$"), "not an e-mail address"), F.when(~normalised_phone(phone).rlike(r"^\+?[0-9]{8,13}$"), "not a phone number")))


def substantive(text: Column) -> Column:
    """Not blank and more than a label: a digit, or a word of at least two letters."""
    return F.coalesce(text.rlike(r"[0-9]|[\p{L}]{2,}"), F.lit(False))


def composed_confidence(ocr: Column, pattern: float, context: Column | float) -> Column:
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c if isinstance(c, Column) else F.lit(c)))
    return F.bround(clamp(0.5 * clamp(ocr) + 0.3 * clamp(pattern) + 0.2 * clamp(context)), 3)
