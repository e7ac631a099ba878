"""The chord dictionary: spelled chords of all numerals in all keys, by rule.

Everything here has a fixed size (21 tonics, 75 numerals), so the tables made
from it are safe to broadcast.
"""

from __future__ import annotations

from functools import lru_cache

from scorelake.functions.pitch import LETTER_PC

# Fixed values. Tonics in use.
TONICS = ["C", "C#", "D-", "D", "D#", "E-", "E", "E#", "F-", "F", "F#", "G-", "G", "G#", "A-", "A", "A#",
          "B-", "B", "B#", "C-"]

# Fixed values. Interval -> (letter steps, semitones).
INTERVALS = {
    "P1": (0, 0), "m2": (1, 1), "M2": (1, 2), "m3": (2, 3), "M3": (2, 4), "P4": (3, 5), "A4": (3, 6),
    "d5": (4, 6), "P5": (4, 7), "m6": (5, 8), "M6": (5, 9), "A6": (5, 10), "d7": (6, 9), "m7": (6, 10), "M7": (6, 11),
}

# Fixed values. Chord type -> intervals above the root.
CHORD_TYPES = {
    "major": ("P1", "M3", "P5"), "minor": ("P1", "m3", "P5"), "diminished": ("P1", "m3", "d5"),
    "minor seventh": ("P1", "m3", "P5", "m7"), "dominant seventh": ("P1", "M3", "P5", "m7"),
    "half-diminished seventh": ("P1", "m3", "d5", "m7"), "diminished seventh": ("P1", "m3", "d5", "d7"),
    "German sixth": ("P1", "M3", "P5", "A6"), "French sixth": ("P1", "M3", "A4", "A6"), "Italian sixth": ("P1", "M3", "A6"),
}

# Figured bass -> number of rotations.
TRIAD_FIGURES = {"": 0, "6": 1, "64": 2}
SEVENTH_FIGURES = {"7": 0, "65": 1, "43": 2, "42": 3}

# Fixed values. Numerals: stem, interval of the root over the tonic, chord type, figures.
MAJOR_NUMERALS = [
    ("I", "P1", "major", ("", "6", "64")), ("bII", "m2", "major", ("", "6")), ("II", "M2", "minor", ("", "6")),
    ("II", "M2", "minor seventh", ("7", "65")), ("III", "M3", "minor", ("", "6")), ("IV", "P4", "major", ("", "6", "64")),
    ("V", "P5", "major", ("", "6", "64")), ("V", "P5", "dominant seventh", ("7", "65", "43", "42")),
    ("bVI", "m6", "major", ("", "6")), ("gerVI", "m6", "German sixth", ("",)), ("freVI", "m6", "French sixth", ("",)),
    ("itaVI", "m6", "Italian sixth", ("",)), ("VI", "M6", "minor", ("", "6")), ("VII", "M7", "diminished", ("", "6")),
    ("dimVII", "M7", "diminished seventh", ("7", "65", "43", "42")),
]
MINOR_NUMERALS = [
    ("I", "P1", "minor", ("", "6", "64")), ("I+", "P1", "major", ("", "6", "64")), ("bII", "m2", "major", ("", "6")),
    ("II", "M2", "diminished", ("", "6")), ("II", "M2", "half-diminished seventh", ("7", "65")),
    ("III", "m3", "major", ("", "6")), ("IV", "P4", "minor", ("", "6", "64")), ("IV+", "P4", "major", ("", "6", "64")),
    ("V", "P5", "minor", ("", "6", "64")), ("V+", "P5", "major", ("", "6", "64")),
    ("V+", "P5", "dominant seventh", ("7", "65", "43", "42")), ("VI", "m6", "major", ("", "6")),
    ("gerVI", "m6", "German sixth", ("",)), ("freVI", "m6", "French sixth", ("",)), ("itaVI", "m6", "Italian sixth", ("",)),
    ("VII", "m7", "major", ("", "6")), ("dimVII", "M7", "diminished seventh", ("7", "65", "43", "42")),
]
NUMERALS = {"Major": MAJOR_NUMERALS, "Minor": MINOR_NUMERALS}

# Fixed values. The chord types every key is expected to be able to use.
BASIC_TYPES = ("major", "minor", "minor seventh", "dominant seventh", "diminished", "half-diminished seventh",
               "diminished seventh")

# Fixed values. (letter steps, semitones) of a root over the tonic -> numeral.
ROOT_NUMERALS = {
    "Major": {"P1": "I", "m2": "bII", "M2": "II", "M3": "III", "P4": "IV", "P5": "V", "m6": "bVI", "M6": "VI", "M7": "VII"},
    "Minor": {"P1": "I", "m2": "bII", "M2": "II", "m3": "III", "P4": "IV", "P5": "V", "m6": "VI", "m7": "VII"},
}


def name_pc(name: str) -> int:
    return (LETTER_PC[name[0]] + name.count("#") - name.count("-")) % 12


def above(name: str, interval: str) -> str:
    """The spelled note an interval above."""
    steps, semitones = INTERVALS[interval]
    letter = "ABCDEFG"[(ord(name[0]) - 65 + steps) % 7]
    shift = (name_pc(name) + semitones - LETTER_PC[letter] + 6) % 12 - 6
    return letter + ("#" * shift if shift > 0 else "-" * -shift)


def spell(root: str, kind: str, turn: int = 0) -> list[str]:
    tones = [above(root, i) for i in CHORD_TYPES[kind]]
    return tones[turn:] + tones[:turn]


@lru_cache
def numeral_names(mode: str) -> list[str]:
    return [stem + f for stem, _, _, figures in NUMERALS[mode] for f in figures]


@lru_cache
def chord_dictionary() -> list[tuple[str, str, str, bool, tuple[str, ...]]]:
    """(tonic, mode, numeral, in root position, tones from the bass up)."""
    rows = []
    for tonic in TONICS:
        for mode, numerals in NUMERALS.items():
            for stem, root, kind, figures in numerals:
                for figure in figures:
                    turn = {**TRIAD_FIGURES, **SEVENTH_FIGURES}[figure]
                    rows.append((tonic, mode, stem + figure, turn == 0, tuple(spell(above(tonic, root), kind, turn))))
    return rows


def set_key(tones) -> str:
    return ",".join(sorted(tones))


@lru_cache
def chord_sets() -> list[tuple[str, int]]:
    """All chords of the dictionary as (sorted tones, number of tones)."""
    return sorted({(set_key(t), len(t)) for *_, t in chord_dictionary()})


@lru_cache
def tone_bits() -> dict[str, int]:
    """Tone of the dictionary -> its place in a bit mask (32 tones)."""
    return {t: k for k, t in enumerate(sorted({t for chord, _ in chord_sets() for t in chord.split(",")}))}


@lru_cache
def chord_mask(chord: str) -> int:
    return sum(1 << tone_bits()[t] for t in chord.split(","))


@lru_cache
def triads() -> list[str]:
    """Three-tone chords with at most one tone outside the spellings in use."""
    return [k for k, n in chord_sets() if n == 3 and sum(t not in TONICS for t in k.split(",")) <= 1]


@lru_cache
def seventh_bases() -> list[tuple[str, str]]:
    """(four-tone chord, the three lowest tones of one of its listed
    positions)."""
    return sorted({(set_key(t), set_key(t[:3])) for *_, t in chord_dictionary() if len(t) == 4})


@lru_cache
def root_positions() -> dict[str, str]:
    """Sorted tones -> tones from the root up, where some key lists the root
    position."""
    return {set_key(t): ",".join(t) for _, _, _, root, t in chord_dictionary() if root}


@lru_cache
def basic_chords() -> list[tuple[str, str, str]]:
    """(root, type, sorted tones) of the basic types over all tonics."""
    return [(t, kind, set_key(spell(t, kind))) for t in TONICS for kind in BASIC_TYPES]


@lru_cache
def rereadings(mode: str) -> list[tuple[str, str, str, str]]:
    """How numerals of C read elsewhere: (numeral in C, other tonic, other mode,
    numeral there), for equal chords in equal position; the last numeral of a
    key wins."""
    others = ["C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
    table: dict[tuple[str, str], list[tuple[str, tuple]]] = {}
    for tonic, m, numeral, _, tones in chord_dictionary():
        table.setdefault((tonic, m), []).append((numeral, tones))
    rows = []
    for tonic in others:
        for m in NUMERALS:
            there = {tones: numeral for numeral, tones in table[tonic, m]}
            rows += [(numeral, tonic, m, there[tones]) for numeral, tones in table["C", mode] if tones in there]
    return rows


def rule_weights() -> dict[tuple[str, str, str], float]:
    """Stand-in flow weights per (mode, from, to), for use without a trained
    model: fifths down weigh most, and staying on a function least."""
    out = {}
    for mode in NUMERALS:
        roots = {stem + f: name_pc(above("C", root)) for stem, root, _, fs in NUMERALS[mode] for f in fs}
        for a, ra in roots.items():
            for b, rb in roots.items():
                fifths = (rb - ra) * 7 % 12
                out[mode, a, b] = round((6 - abs(fifths - 11)) / 4 - (0.25 if b.endswith(("6", "64", "65", "43", "42")) else 0.0), 6)
    return out
