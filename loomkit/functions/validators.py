"""Check digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def luhn(c: Column) -> Column:
    return F.call_function("luhn_check", c)


def digits(c: Column) -> Column:
    return F.transform(F.split(c, ""), lambda d: d.cast("int"))


def weighted(c: Column, weights: list[int]) -> Column:
    return F.aggregate(F.zip_with(digits(c), F.array(*map(F.lit, weights)), lambda d, w: d * w), F.lit(0), lambda a, x: a + x)


def matching(c: Column, pattern: str, check: Column) -> Column:
    """check where c matches, false where it doesn't, null where it is null."""
    return F.when(c.isNull(), None).when(c.rlike(pattern), check).otherwise(F.lit(False))


def aba_validate(c: Column) -> Column:
    """A 9-digit routing number whose digits, weighted 3, 7, 1 in turn, sum to a multiple of 10."""
    return matching(c, "^[0-9]{9}$", weighted(c, [3, 7, 1] * 3) % 10 == 0)


def luhn_validate(c: Column) -> Column:
    return matching(c, "^[0-9]+$", luhn(c))


def cc_validate(c: Column) -> Column:
    """A card number: 12 to 19 digits, spaces and hyphens aside, with a right Luhn digit."""
    plain = F.regexp_replace(c, "[ -]", "")
    return matching(plain, "^[0-9]{12,19}$", luhn(plain))


def lettered(c: Column) -> Column:
    """Letters as the numbers 10 to 35, digits as they are, joined."""
    return F.array_join(F.transform(F.split(c, ""), lambda x: F.when(x.rlike("[A-Z]"), (F.ascii(x) - 55).cast("string")).otherwise(x)), "")


def isin_validate(c: Column) -> Column:
    """A security identifier: two letters, nine letters or digits, and the Luhn digit of all of them as numbers."""
    return matching(c, "^[A-Z]{2}[A-Z0-9]{9}[0-9]$", luhn(lettered(c)))


def iban_validate(c: Column) -> Column:
    """An account number whose country and check digits, moved to the end, leave 1 modulo 97."""
    plain = F.upper(F.regexp_replace(c, " ", ""))
    moved = lettered(F.concat(F.substring(plain, 5, 100), F.substring(plain, 1, 4)))
    rest = F.aggregate(F.split(moved, ""), F.lit(0), lambda a, d: (a * 10 + d.cast("int")) % 97)
    return matching(plain, "^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$", rest == 1)


def isbn_validate(c: Column) -> Column:
    plain = F.regexp_replace(F.upper(c), "[- ]", "")
    ten = F.zip_with(F.split(plain, ""), F.sequence(F.lit(10), F.lit(1), F.lit(-1)), lambda d, w: F.when(d == "X", 10).otherwise(d.cast("int")) * w)
    old = F.aggregate(ten, F.lit(0), lambda a, x: a + x) % 11 == 0
    new = weighted(plain, [1, 3] * 6 + [1]) % 10 == 0
    return F.when(c.isNull(), None).when(plain.rlike("^[0-9]{9}[0-9X]$"), old).when(plain.rlike("^[0-9]{13}$"), new).otherwise(F.lit(False))
