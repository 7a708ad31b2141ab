"""Strings, encodings and digests, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that a file name may have besides letters and digits.
LEGAL = r"A-Za-z0-9 ._,=+()\[\]{}@#$%&~!^'`;-"


def tokens(s: Column, delimiters: str = " ,", good: str = r"\S") -> Column:
    """Pieces between any of the delimiters, without empty ones and those that have no good character."""
    return F.filter(F.split(s, f"[{re.escape(delimiters)}]+"), lambda x: (x != "") & x.rlike(good))


def joined(parts: Column, delimiter: str = " ") -> Column:
    return F.array_join(parts, delimiter)


def token(s: Column, separator: str, n: int) -> Column:
    """The n-th piece, from 1; null if there are fewer."""
    return F.try_element_at(F.split(s, re.escape(separator)), F.lit(n))


def fields(s: Column) -> Column:
    """"A1=1, B2=2;" as a map of numbers; every field ends in a comma or semicolon, names have two characters or more."""
    found = F.regexp_extract_all(s, F.lit(r"([A-Za-z]\w+\s*=\s*[-+0-9.eE]+)\s*[,;]"), F.lit(1))
    pair = lambda x: F.split(F.regexp_replace(x, r"\s", ""), "=")
    return F.map_from_entries(F.transform(found, lambda x: F.struct(pair(x)[0].alias("k"), pair(x)[1].try_cast("double").alias("v"))))


def sanitized(s: Column) -> Column:
    """Trimmed, control characters gone, illegal characters as "=", runs of blanks as "+"."""
    s = F.regexp_replace(F.trim(s), r"[\x00-\x1f\x7f]", "")
    return F.regexp_replace(F.regexp_replace(s, f"[^{LEGAL}]", "="), " +", "+")


def legal_filename(s: Column) -> Column:
    return ~s.rlike(f"[^{LEGAL}]")


def crc32_hex(s: Column) -> Column:
    return F.lpad(F.hex(F.crc32(s.cast("binary"))), 8, "0")


def hashed_filename(s: Column, longest: int = 64) -> Column:
    """The CRC of the lower-cased name and its sanitized form, cut to `longest` characters (8 at least)."""
    return F.substring(F.concat(crc32_hex(F.lower(s)), F.lit("-"), sanitized(s)), 1, max(8, longest))


def hex_to_text(h: Column) -> Column:
    return F.decode(F.unhex(h), "UTF-8")


def padded_left(s: Column, n: int) -> Column:
    """At least n characters, blanks in front."""
    return F.when(F.char_length(s) >= n, s).otherwise(F.lpad(s, n, " "))


def thousands(x: Column) -> Column:
    """Groups of three digits, and at most three decimals without zeros at their end."""
    return F.regexp_replace(F.regexp_replace(F.format_number(x, 3), r"0+$", ""), r"\.$", "")


def structural_hash(*columns: Column) -> Column:
    """SHA-256 of the columns' JSON form, so that values of different types or places differ."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def float_of_bits(bits: Column) -> Column:
    """The single-precision number of 32 characters 0 or 1, sign first; infinities and NaN excluded, zero as zero."""
    n = F.conv(bits, 2, 10).cast("long")
    sign = F.when(F.shiftright(n, 31) == 1, -1.0).otherwise(1.0)
    exponent = F.shiftright(n, 23).bitwiseAND(F.lit(255)).cast("double")
    fraction = n.bitwiseAND(F.lit(0x7FFFFF)) / float(1 << 23)
    value = F.when(exponent == 0, fraction * F.pow(F.lit(2.0), F.lit(-126.0))).otherwise((1 + fraction) * F.pow(F.lit(2.0), exponent - 127))
    return sign * value


def bits_of_float(x: Column) -> Column:
    """The 32 bits of a number in single precision (normal numbers and zero)."""
    a = F.abs(x.cast("float").cast("double"))
    e = F.floor(F.log2(a)).cast("int")
    e = F.when(a >= F.pow(F.lit(2.0), e + 1), e + 1).when(a < F.pow(F.lit(2.0), e), e - 1).otherwise(e)
    fraction = F.round((a / F.pow(F.lit(2.0), e) - 1) * (1 << 23)).cast("long")
    n = F.when(x < 0, F.lit(1 << 31)).otherwise(F.lit(0)).cast("long") + F.when(a == 0, 0).otherwise(F.shiftleft((e + 127).cast("long"), 23) + fraction)
    return F.lpad(F.conv(n.cast("string"), 10, 2), 32, "0")


# fixed values: electrode names as written by one amplifier, and the standard names used instead
RENAMES = (("^FCC", "FTT"), ("^FC7$", "FT7"), ("^FC8$", "FT8"), ("^CP7$", "TP7"), ("^CP8$", "TP8"), ("^M1$", "TP9"), ("^M2$", "TP10"))


def standard_electrode(name: Column) -> Column:
    for pattern, instead in RENAMES:
        name = F.regexp_replace(name, pattern, instead)
    return name


def masked_patient(s: Column) -> Column:
    """Personal fields of a text masked: letters as X, record numbers as 8, days and months of dates as 00."""
    s = F.regexp_replace(s, r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b", "00/00/$3")
    s = F.regexp_replace(s, r"\b\d{6,10}\b", "88888888")
    return F.regexp_replace(s, r"(?<=\bName: )[A-Za-z]+( [A-Za-z]+)*", "X")


def numeric_channel(name: Column) -> Column:
    """The number of a grid contact (Grid7, MG12, G3), else 0."""
    return F.coalesce(F.regexp_extract(name, r"^(?:Grid|MG|G)(\d+)", 1).try_cast("int"), F.lit(0))
