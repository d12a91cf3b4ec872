"""Register words to counter values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from countermill.vocab import WORD_BITS


def word(registers: Column, index: int | Column) -> Column:
    """One register as BIGINT; NULL past the end instead of an ANSI error."""
    return F.get(registers, index).cast("bigint")


def decode_registers(registers: Column) -> Column:
    """Counter of a poll: two words low first, or a single word; words beyond the second are ignored."""
    low, high = word(registers, 0), word(registers, 1)
    return F.when(F.size(registers) >= 2, F.shiftleft(high, WORD_BITS).bitwiseOR(low)).otherwise(low)


def decode_failure(registers: Column) -> Column:
    """Why a poll cannot be decoded, or NULL."""
    return F.when(F.size(registers) == 0, F.lit("no register words")).when(
        F.exists(registers, lambda w: (w < 0) | (w > 65535)), F.lit("register word outside 0..65535")
    )


def block_counter(block: Column, channel: Column) -> Column:
    """Counter of one channel in a block that holds two words per channel; NULL when it is too short."""
    at = channel.cast("int") * 2
    return word(block, at + 1) * F.lit(65536).cast("bigint") + word(block, at)
