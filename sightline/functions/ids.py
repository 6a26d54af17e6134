"""Row ids from 64-bit keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def id_of(key: Column) -> Column:
    """The key's 64 bits in base 32: twelve letters of five bits from the top, and one of the last four."""
    letter = lambda five: F.substring(F.lit(ALPHABET), (five + 1).cast("int"), F.lit(1))
    head = [letter(F.shiftrightunsigned(key, 59 - 5 * i).bitwiseAND(31)) for i in range(12)]
    return F.concat(*head, letter(F.shiftleft(key.bitwiseAND(15), 1)))


def assign_ids(df: DataFrame, key_col: str) -> DataFrame:
    """`df` with id. The same key always gives the same id, so a job that runs again names its rows alike."""
    return df.withColumn("id", id_of(F.col(key_col).cast("long")))


#: Bits of a member's number in a key that is made of an owner's key and that number.
MEMBER_BITS = 24


def pair_key(owner: Column, member: Column) -> Column:
    """The key of an owner's member (from 0): both side by side, so different pairs have different keys."""
    fits = (owner >= 0) & (owner < F.lit(1 << (63 - MEMBER_BITS))) & (member >= 0) & (member < F.lit(1 << MEMBER_BITS))
    told = F.concat(F.lit("no key for the pair "), owner.cast("string"), F.lit(", "), member.cast("string"))
    return F.when(fits, F.shiftleft(owner.cast("long"), MEMBER_BITS) + member.cast("long")).otherwise(F.raise_error(told).cast("long"))
