"""Numbers with units: what a text states, and whether it states a claim's.

All in SQL functions, so that the numbers of a page are taken once, stored as
an array, and compared with those of any number of claims.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The units that count as part of a number.
UNITS = "kg/m3 m3/s m/s kW/m2 W/m2 MPa kPa Pa mm cm km m3 m2 m kW W MJ kJ J kg mg g ml L hours hour min h s °C K % ppm".split()
#: Characters that compatibility folding turns into what numbers and units are written with.
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "²³⁻−"
WIDE_AS = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + "23--"

GROUPED, DIGITS, POINT, POWER = r"\d{1,3}(?:,\d{3})+", r"\d+", r"\.\d+", r"[eE][+-]?\d+"
NUMBER = f"[+-]?(?:(?:{GROUPED}|{DIGITS})(?:{POINT})?|{POINT})(?:{POWER})?"
LONGEST_FIRST = "|".join(re.escape(u) for u in sorted(UNITS, key=lambda u: (-len(u), u)))
QUANTITY = rf"{NUMBER}(?:\s*(?i:{LONGEST_FIRST})(?![A-Za-z]))?"
#: A plain number: no sign, unit or exponent.
PLAIN = r"[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?"
#: Digits before and after the point up to which values are compared as decimals, beyond that by their spelling.
WHOLE, PART = 20, 18


def narrow(text: Column) -> Column:
    """Full-width letters, digits and signs as plain ones, ℃ as °C."""
    return F.translate(F.regexp_replace(text, "℃", "°C"), WIDE, WIDE_AS)


def value_of(number: Column) -> Column:
    """One spelling for all spellings of a value."""
    bare = F.regexp_replace(number, ",", "")
    short = bare.rlike(rf"^[+-]?\d{{0,{WHOLE}}}(?:\.\d{{0,{PART}}})?(?:[eE][+-]?\d{{1,2}})?$")
    return F.coalesce(F.when(short, bare.try_cast(f"decimal({WHOLE + PART},{PART})").cast("string")), bare)


def quantities(text: Column) -> Column:
    """The numbers of a text as structs of value and unit ('' for none), each once."""
    found = F.regexp_extract_all(narrow(F.coalesce(text, F.lit(""))), F.lit(QUANTITY), F.lit(0))

    def one(m: Column) -> Column:
        number = F.regexp_extract(m, NUMBER, 0)
        unit = F.lower(F.trim(F.substring(m, F.length(number) + 1, F.length(m))))
        return F.struct(value_of(number).alias("value"), F.when(unit.isin("hour", "hours"), "h").otherwise(unit).alias("unit"))

    return F.array_distinct(F.transform(found, one))


def stated_in(wanted: Column, there: Column) -> Column:
    """Whether every quantity of `wanted` is `there`, with its unit if it has
    one. Nothing wanted holds everywhere."""
    return F.forall(wanted, lambda w: F.exists(there, lambda t: (t["value"] == w["value"]) & ((w["unit"] == "") | (t["unit"] == w["unit"]))))


def number_appears(claim: Column, text: Column) -> Column:
    return stated_in(quantities(claim), quantities(text))


def canonical_numbers(text: Column) -> Column:
    """The distinct plain numbers of a text, in one spelling: no thousands
    separators, leading zeros or trailing zeros after the point."""
    plain = F.transform(F.regexp_extract_all(text, F.lit(PLAIN), F.lit(0)), lambda x: F.regexp_replace(x, ",", ""))

    def one(x: Column) -> Column:
        x = F.when(x.contains("."), F.regexp_replace(F.regexp_replace(x, "0+$", ""), r"\.$", "")).otherwise(x)
        return F.regexp_replace(x, "^0+(?=[0-9])", "")

    return F.array_distinct(F.transform(plain, one))
