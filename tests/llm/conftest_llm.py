"""Rows that every operator of the subpackage must take."""

from __future__ import annotations

# Rows every operator must take: null and empty texts, blanks only, a text without letters, a very
# long one, repeated rows, a null id.
LONG = " ".join(f"word{i % 977} and {i % 31}" for i in range(30000))
ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n\x0b\x0c\r "),
    (4, "12 34 !!   ##"),
    (5, LONG),
    (6, "The same text is here twice, and again it is here."),
    (6, "The same text is here twice, and again it is here."),
    (7, "The same text is here twice, and again it is here."),
    (None, "A row without an id has words of its own."),
]
