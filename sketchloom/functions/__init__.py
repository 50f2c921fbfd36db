"""Column expressions on bit words: the pieces that sketches are probed and combined with; and names that clash with none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 32


def word_of(position: Column) -> Column:
    return F.shiftright(position, 5)


def bit_of(position: Column) -> Column:
    """The position's bit as a one-bit word."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), position.bitwiseAND(F.lit(WORD - 1)).cast("int"))


def has_bit(words: Column, position: Column) -> Column:
    """Whether a dense array of words has the bit set."""
    return F.element_at(words, word_of(position).cast("int") + 1).bitwiseAND(bit_of(position)) != 0


def popcount(word: Column) -> Column:
    return F.bit_count(word).cast("bigint")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until no column of ``df`` has it (names are compared without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def unused(df: DataFrame, *names: str) -> None:
    """Raise if a result column would replace one of ``df``."""
    if clash := {c.lower() for c in df.columns} & {n.lower() for n in names}:
        raise ValueError(f"columns of these names exist already: {sorted(clash)}")
