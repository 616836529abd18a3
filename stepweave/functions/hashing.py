"""Deterministic hashing of values: order, sampling and seeds come from SHA-256, never from row order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Escapes of a JSON string that keeps non-ASCII characters.
_ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f"))


def json_text(value: Column) -> Column:
    """A string column as a JSON string."""
    for raw, escaped in _ESCAPES:
        value = F.replace(value, F.lit(raw), F.lit(escaped))
    return F.concat(F.lit('"'), value, F.lit('"'))


def canonical_list(*parts: Column | str | int) -> Column:
    """The compact JSON of a list of constants, integer columns (cast to string) and, marked with ``json_text``, strings."""
    cells: list[Column] = []
    for p in parts:
        if isinstance(p, str):
            p = json_text(F.lit(p))
        elif isinstance(p, int):
            p = F.lit(str(p))
        cells.append(p.cast("string"))
    return F.concat(F.lit("["), F.concat_ws(",", *cells), F.lit("]"))


def stable_hash(*parts: Column | str | int) -> Column:
    """SHA-256 (hex) of the canonical JSON of a tuple."""
    return F.sha2(canonical_list(*parts), 256)


def stable_seed(*parts: Column | str | int) -> Column:
    """A seed below 2**31: the first 64 bits of the hash, modulo 2**31, of which only hex digits 9 to 16 matter."""
    return F.conv(F.substring(stable_hash(*parts), 9, 8), 16, 10).cast("long") % F.lit(2147483648)


def unit_interval(hexed: Column) -> Column:
    """The first 52 bits of a hex digest as a number in [0, 1)."""
    return F.conv(F.substring(hexed, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(16**13))


def digest_modulo(hexed: Column, n: int) -> Column:
    """The whole digest, as an integer, modulo ``n``: digit by digit, so no wide integer is needed."""
    digits = F.split(hexed, "")
    digit = lambda x: F.instr(F.lit("0123456789abcdef"), x) - 1
    step = lambda acc, x: F.when(x == "", acc).otherwise((acc * 16 + digit(x)) % n)
    return F.aggregate(digits, F.lit(0), step)
