"""Pitch names, spellings and ticks as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRECISION = 1024

LETTERS = "CDEFGAB"
LETTER_PC = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
SHARP_NAMES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
MIDDLE_C = 60


def quantise(x: Column, precision: int = PRECISION) -> Column:
    """Whole ticks of a (non-negative) time in quarter lengths."""
    return F.floor(x * precision).cast("long")


def letter_pc(letter: Column) -> Column:
    """Pitch class of a natural letter."""
    table = F.create_map(*[F.lit(v) for pair in LETTER_PC.items() for v in pair])
    return table[letter]


def accidental_shift(name: Column) -> Column:
    """Sharps minus flats; ``-`` and ``b`` both spell a flat."""
    marks = F.substring(name, 2, 100)
    sharps = F.length(marks) - F.length(F.replace(marks, F.lit("#"), F.lit("")))
    flats = F.length(marks) - F.length(F.translate(marks, "-b", ""))
    return sharps - flats


def spelling_to_pc(name: Column) -> Column:
    """Pitch class of a spelled name with up to two equal accidentals; -1 for
    anything else."""
    pc = F.pmod(letter_pc(F.substring(name, 1, 1)) + accidental_shift(name), F.lit(12))
    return F.when(name.rlike(r"^[A-G](#{0,2}|[-b]{0,2})$"), pc).otherwise(F.lit(-1)).cast("int")


def respell_sharp(name: Column) -> Column:
    """The sharp-only name of a spelled pitch."""
    pc = F.pmod(letter_pc(F.substring(name, 1, 1)) + accidental_shift(name), F.lit(12))
    names = F.array(*[F.lit(n) for n in SHARP_NAMES])
    return F.when(F.length(name) == 1, name).otherwise(F.element_at(names, pc.cast("int") + 1))


def letter_step(name: Column) -> Column:
    """0 for A up to 6 for G, as in letter order."""
    return F.ascii(F.substring(name, 1, 1)) - F.lit(65)
