"""Degenerate nucleotide codes."""

from __future__ import annotations

# The IUPAC nucleotide codes.
IUPAC = {
    "A": "A",
    "C": "C",
    "G": "G",
    "T": "T",
    "R": "[AG]",
    "Y": "[CT]",
    "S": "[GC]",
    "W": "[AT]",
    "K": "[GT]",
    "M": "[AC]",
    "B": "[CGT]",
    "D": "[AGT]",
    "H": "[ACT]",
    "V": "[ACG]",
    "N": "[ACGT]",
}


def motif_pattern(motif: str) -> str:
    """The regular expression of a motif in IUPAC codes; a letter outside them raises KeyError."""
    return "".join(IUPAC[letter] for letter in motif.upper())


def offsets_of(motif: str, code: str) -> list[int]:
    """0-based offsets of a code in a motif."""
    return [k for k, letter in enumerate(motif.upper()) if letter == code]
