"""Cutting texts into pieces that a byte-level tokenizer encodes on their own, and caching what it made of them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from typing import Any

from pyspark import Broadcast
from pyspark.sql import SparkSession

# Entries of a worker's cache in its young half. When that is full it becomes the old
# half, from which entries still in use come back; so memory stays bounded.
CACHE_ENTRIES = 600_000

# Longer parts are not kept.
CACHED_CHARS = 64

# A blank inside a run of spaces, where what stands before it decides how the run is
# cut. Python's \s holds all characters that a tokenizer's \s holds.
_BLANK_IN_RUN = re.compile(r"\s \s|\s \Z")


def cut_at_blanks(text: str) -> list[str] | None:
    """The text's parts between blanks, if each but the first can be encoded on its own with a blank before it.

    Byte-level patterns take one blank along with the word after it, so a token never
    spans the place before a blank, unless the blank stands inside a run of spaces:
    then the result is None and the text must be matched as a whole.
    """
    return None if _BLANK_IN_RUN.search(text) else text.split(" ")


class PartCache(dict):
    """part -> value, filled by `make`; the parts used last are kept, twice `entries` at most."""

    def __init__(self, make: Callable[[str], Any], entries: int = CACHE_ENTRIES):
        super().__init__()
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, part: str):
        value = self.old.get(part)
        if value is None:
            value = self.make(part)
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[part] = value
        return value


# Characters that are neither letters, numbers nor spaces: a run of them is one match of
# the pattern, and what follows letters leaves the letters' match alone.
MARKS = "#*$%&|<>.,;:!?()[]{}\"'-_=+/@~^`"


class CachedEncoder:
    """Encodes whole texts part by part. `encode(text)` is the tokenizer of a text on its own; it gives tuples or bytes.

    Letters and the marks after them are cached on their own.
    """

    def __init__(self, encode: Callable[[str], Any], entries: int = CACHE_ENTRIES):
        self.encode = encode
        self.marks = PartCache(encode, entries // 16)
        self.kept = PartCache(lambda part: encode(" " + part), entries)

    def part(self, part: str) -> Any:
        """Tokens of a blank and the part."""
        if len(part) > CACHED_CHARS:
            return self.encode(" " + part)
        letters = part.rstrip(MARKS)
        if letters != part and letters.isalpha():
            return self.kept[letters] + self.marks[part[len(letters) :]]
        return self.kept[part]

    def parts(self, text: str) -> list:
        """What `encode` made of the parts, in order."""
        cut = cut_at_blanks(text)
        if cut is None:
            return [self.encode(text)]
        known, part = self.kept.get, self.part
        found = [self.encode(cut[0])]
        found.extend([known(p) or part(p) for p in cut[1:]])
        return found


_LOADED: dict[str, Any] = {}


def shipped(spark: SparkSession, path: str) -> tuple[str, Broadcast]:
    """A vocabulary file (a few MB at most) read by the driver and sent to all executors; with its digest."""
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError(f"{path} is no vocabulary file: {len(data)} bytes")
    return hashlib.sha256(data).hexdigest(), spark.sparkContext.broadcast(data)


def loaded(kind: str, vocabulary: tuple[str, Broadcast], build: Callable[[bytes], Any]) -> Any:
    """The encoder of a shipped vocabulary, built once in a worker."""
    key = f"{kind}:{vocabulary[0]}"
    if key not in _LOADED:
        _LOADED[key] = build(vocabulary[1].value)
    return _LOADED[key]
