"""Word-level text normalisation for search."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


# Every character that counts as white space: the ASCII separators and Unicode blanks.
BLANKS = "".join(
    chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680)
) + "".join(chr(c) for c in (*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def strip(text: Column) -> Column:
    """Text without white space at either end."""
    return F.btrim(text, F.lit(BLANKS))


def _accent_table() -> tuple[str, str]:
    """Accented Latin letters and their base letters, from the Unicode decompositions.

    Combining marks come last without a counterpart: ``translate`` removes them.
    """
    accented, plain = [], []
    for code in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(unicodedata.combining(c) for c in parts[1:]):
            accented.append(chr(code))
            plain.append(parts[0])
    marks = [chr(code) for code in range(0x0300, 0x0370)]
    return "".join(accented + marks), "".join(plain)


_ACCENTED, _PLAIN = _accent_table()
_FOLD = {ord(c): (_PLAIN[i] if i < len(_PLAIN) else None) for i, c in enumerate(_ACCENTED)}


def fold_accents(text: Column) -> Column:
    """Accented Latin letters without their marks, precomposed or combining."""
    return F.translate(text, _ACCENTED, _PLAIN)


def fold_term(term: str) -> list[str]:
    """Words of a search term, folded as :func:`word_text` folds the searched text."""
    return [w for w in re.split(r"[\W_]+", term.lower().translate(_FOLD)) if w]


def word_text(text: Column) -> Column:
    """Lower-case, accent-free words, each with one blank on both sides.

    A word test is then ``contains(' word ')``, a phrase test
    ``contains(' two words ')`` and a prefix test ``contains(' pref')``.
    """
    lowered = F.lower(text)
    # Most log lines are ASCII, where folding has nothing to do.
    is_ascii = F.octet_length(text) == F.length(text)
    words = F.when(is_ascii, F.regexp_replace(lowered, "[^a-z0-9]+", " ")).otherwise(
        F.regexp_replace(fold_accents(lowered), r"[^\p{L}\p{N}]+", " ")
    )
    return F.concat(F.lit(" "), F.trim(words), F.lit(" "))


def words(text: Column) -> Column:
    """Array of folded words; empty array for text without any."""
    return F.filter(F.split(word_text(text), " "), lambda w: w != "")
