"""Greek text to ASCII beta code without a run-time Unicode normaliser."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Beta code of the Greek base letters.
LETTERS = {
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "h", "θ": "q",
    "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "c", "ο": "o", "π": "p",
    "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "u", "φ": "f", "χ": "x", "ψ": "y",
    "ω": "w", "ϝ": "v",
}
# Combining marks that leave nothing behind.
MARKS = "\u0313\u0314\u0301\u0300\u0342\u0302\u0308\u0345\u0304\u0306"


def _code(char: str) -> str:
    out = ""
    for c in unicodedata.normalize("NFD", char):
        if c not in MARKS:
            out += LETTERS.get(c.lower(), " ")
    return out


_SPACES = "\x00"              # control characters: the n-th after it stands for n spaces


@lru_cache(maxsize=1)
def _tables() -> tuple[str, str, int]:
    """Characters and their replacements for one ``translate``, and the longest run of
    spaces a single character yields. Marks come last and have no replacement.

    ASCII is mapped here too, so that afterwards only the codes of Greek letters are ASCII
    letters, and only the codes of runs are control characters.
    """
    found, codes, gone, most = [], [], [], 1
    for point in range(sys.maxunicode + 1):
        if 0xD800 <= point <= 0xDFFF:
            continue
        char = chr(point)
        code = _code(char)
        if code == "":
            gone.append(char)
        elif len(code) > 1:
            most = max(most, len(code))
            found.append(char)
            codes.append(chr(ord(_SPACES) + len(code)))
        elif code != " " or point < 128:
            found.append(char)
            codes.append(code)
    return "".join(found + gone), "".join(codes), most


def greek_to_betacode(x: Column) -> Column:
    """Base letters become ASCII, listed accents vanish, anything else becomes a space.

    A character that decomposes into several others becomes as many spaces.
    """
    found, codes, most = _tables()
    x = F.translate(x, found, codes)
    runs = "".join(f"\\x{ord(_SPACES) + n:02x}" for n in range(2, most + 1))
    x = F.regexp_replace(x, f"[^a-z {runs}]", " ")
    for n in range(2, most + 1):
        x = F.replace(x, F.lit(chr(ord(_SPACES) + n)), F.lit(" " * n))
    return x
