"""Expressions on the bit-mask column ``flag_status``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dqspark import values as V


def flag_value(position: int) -> int:
    """1, 2, 4, ... for position 0, 1, 2, ... (F16)."""
    if not 0 <= position < V.MAX_FLAGS:
        raise ValueError(f"a bigint status holds at most {V.MAX_FLAGS} flags")
    return 1 << position


def has_flag(status: Column, flag: int | Column) -> Column:
    flag = F.lit(flag).cast("bigint") if isinstance(flag, int) else flag
    return status.bitwiseAND(flag) != 0


def set_flags(status: Column) -> Column:
    """Array of the flags set in a status, ascending."""
    one = F.lit(1).cast("bigint")
    highest = F.char_length(F.bin(status)) - 1
    powers = F.transform(F.sequence(F.lit(0), highest), lambda i: F.call_function("shiftleft", one, i))
    return F.filter(powers, lambda f: status.bitwiseAND(f) != 0)


def flags_text(status: Column, label: str = "Flags: ", none: str = "No flags") -> Column:
    """``Flags: 1+4`` or ``No flags``."""
    listed = F.concat(F.lit(label), F.array_join(set_flags(status).cast("array<string>"), "+"))
    return F.when(status == 0, F.lit(none)).otherwise(listed)


def binary_text(status: Column, width: int = 0) -> Column:
    """Binary digits, left-padded with zeros to at least ``width``."""
    digits = F.bin(status)
    if not width:
        return digits
    return F.when(F.char_length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))
