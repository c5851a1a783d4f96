"""Exact token counts of every prefix, by dynamic programming over last tokens.

For a merge-based vocabulary the encoding of a prefix of a word follows from the
encodings of shorter prefixes: it ends in exactly one token, namely the one whose
neighbour before it, the last token of the prefix that is left, does not merge with
it in any other way. So a table of last tokens and counts over the prefixes gives
all their exact counts in one pass; candidates for the last token come from an
Aho-Corasick automaton over the vocabulary. The vocabulary here marks the end of a
word, so the last token of a *whole* prefix is looked up among the end-of-word
tokens while the table itself runs over the unmarked ones.

A text's table is the running total over its pre-tokens plus the tables of the
pre-tokens: truncation and budget questions are looked up, nothing is encoded again.
"""

from __future__ import annotations

import json
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .packing import byte_alphabet
from .pretokens import CACHED_CHARS, MARKS, PartCache, loaded, shipped
from .tables import small_batches

LIMIT = 2048

# Entries of the young half of the caches of token pairs, pre-tokens and parts.
_PAIRS, _PIECES, _PARTS = 250_000, 120_000, 250_000

# Contractions are pre-tokens of their own; cut after their first letter they are not.
_CONTRACTIONS = ("'re", "'ve", "'ll")
# Python's split() takes these for spaces, the tokenizer's pattern does not.
_NOT_SPACES = "\x1c\x1d\x1e\x1f"


_ID = 1 << 20  # beyond any id: a pair of ids as one number


class WordCounter:
    """Counts the tokens of every prefix of a pre-token (in byte-level characters)."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        self.suffix = suffix
        self.vocab, self.text_of = vocab, {i: t for t, i in vocab.items()}
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        self.inner, self.closing = ahocorasick.Automaton(), ahocorasick.Automaton()
        for token, i in vocab.items():
            if token.endswith(suffix) and token != suffix:
                bare = token[: -len(suffix)]
                self.closing.add_word(bare, (i, len(bare)))
            else:
                self.inner.add_word(token, (i, len(token)))
        self.inner.make_automaton()
        self.closing.make_automaton()
        self.apart = PartCache(lambda pair: self._stay_apart(*divmod(pair, _ID)), _PAIRS)
        self.alone = PartCache(lambda i: self._merged(self._symbols(i)) == [i])

    def _symbols(self, token: int) -> list[int]:
        text = self.text_of[token]
        if text.endswith(self.suffix) and text != self.suffix:
            bare = text[: -len(self.suffix)]
            return [self.vocab[c] for c in bare[:-1]] + [self.vocab[bare[-1] + self.suffix]]
        return [self.vocab[c] for c in text]

    def _merged(self, ids: list[int]) -> list[int]:
        """The merges carried out: lowest rank first, then leftmost."""
        merges = self.merges
        while len(ids) > 1:
            best = min(((merges[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in merges), default=None)
            if best is None:
                break
            k = best[1]
            ids[k : k + 2] = [merges[ids[k], ids[k + 1]][1]]
        return ids

    def _stay_apart(self, a: int, b: int) -> bool:
        """The text of the two tokens is encoded as these two."""
        return (a, b) not in self.merges and self._merged(self._symbols(a) + self._symbols(b)) == [a, b]

    def prefixes(self, word: str) -> list[int]:
        """Tokens of word[:1], word[:2], ... each as a whole word."""
        n = len(word)
        last, count, whole = [-1] * (n + 1), [0] * (n + 1), [0] * n
        apart, alone = self.apart, self.alone
        for end, (token, length) in self.inner.iter(word):
            if count[end + 1]:
                continue
            start = end + 1 - length
            if alone[token] if not start else (count[start] and apart[last[start] * _ID + token]):
                last[end + 1], count[end + 1] = token, count[start] + 1
        for end, (token, length) in self.closing.iter(word):
            if whole[end]:
                continue
            start = end + 1 - length
            if alone[token] if not start else (count[start] and apart[last[start] * _ID + token]):
                whole[end] = count[start] + 1
        return whole


class TextCounter:
    """Token counts of the prefixes of whole texts, as the library's encoder would give them."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        self.library = Tokenizer.from_str(data.decode("utf-8"))
        self.normalize = self.library.normalizer.normalize_str
        self.split = self.library.pre_tokenizer.pre_tokenize_str
        self.special = [t["content"] for t in spec["added_tokens"]]
        model = spec["model"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.words = WordCounter(model["vocab"], merges, model["end_of_word_suffix"])
        self.continues = {c for b, c in enumerate(byte_alphabet()) if 0x80 <= b < 0xC0}
        self.pieces = PartCache(self._piece, _PIECES)
        self.kept = PartCache(self._total, _PARTS)
        self.marks = PartCache(self._total, _PARTS // 16)

    def _piece(self, piece: str) -> tuple[int, ...]:
        """Counts at the code points of a pre-token (byte-level characters)."""
        counts = self.words.prefixes(piece)
        if piece in _CONTRACTIONS:
            counts[1] = counts[0] + self.words.prefixes(piece[1])[0]
        after = [*piece[1:], ""]
        return tuple(c for c, follows in zip(counts, after) if follows not in self.continues)

    def _total(self, part: str) -> int:
        return self.pieces_of(part)[-1][1]

    def _part(self, part: str) -> int:
        """Tokens of a text without spaces; letters and the marks after them are pre-tokens of their own."""
        if len(part) > CACHED_CHARS:
            return self._total(part)
        letters = part.rstrip(MARKS)
        # Letters may become a letter and a mark when normalized; those join the marks.
        if letters != part and (letters if letters.isascii() else unicodedata.normalize("NFC", letters).lower()).isalpha():
            return self.kept[letters] + self.marks[part[len(letters) :]]
        return self.kept[part]

    def pieces_of(self, text: str) -> list[tuple[int, int, tuple[int, ...]]]:
        """(end in the normalized text, tokens up to there, counts within) of every pre-token; without special strings."""
        table, total = [(0, 0, ())], 0
        for piece, (_, end) in self.split(self.normalize(text)):
            counts = self.pieces[piece] if len(piece) <= CACHED_CHARS else self._piece(piece)
            total += counts[-1]
            table.append((end, total, counts))
        return table

    def count(self, text: str | None) -> int:
        """Tokens of the whole text."""
        if not text:
            return 0
        if "<|" in text and any(s in text for s in self.special):
            return self.table(text)[1][-1]
        if any(c in text for c in _NOT_SPACES):
            return self.pieces_of(text)[-1][1]
        # Spaces are dropped and nothing joins over them, so parts are counted on their own.
        known, part = self.kept.get, self._part
        return sum([known(p) or part(p) for p in text.split()])

    def table(self, text: str | None) -> tuple[list[int], list[int]]:
        """Ends and counts: from each end (code points of the normalized text) to the next the prefix has that count.

        Only places where the count changes are listed; the first is 0, 0. Within a
        special string the prefix is ordinary text, at its end it is one token.
        """
        ends, counts = [0], [0]

        def note(end: int, count: int) -> None:
            if ends[-1] == end:
                counts[-1] = count
            elif counts[-1] != count:
                ends.append(end)
                counts.append(count)

        base, before, rest = 0, 0, text or ""
        while True:
            found = min(((rest.find(s), s) for s in self.special if s in rest), default=None)
            ordinary = rest if found is None else rest[: found[0]]
            # What begins a special string counts as ordinary until the string is complete.
            table = self.pieces_of(ordinary if found is None else ordinary + found[1][:-1])
            done = 0
            for end, total, within in table[1:]:
                for k, c in enumerate(within):
                    note(base + end - len(within) + k + 1, before + done + c)
                done = total
            if found is None:
                return ends, counts
            ordinary_table = self.pieces_of(ordinary)
            before += ordinary_table[-1][1] + 1
            base += len(self.normalize(ordinary)) + len(found[1])
            note(base, before)
            rest = rest[found[0] + len(found[1]) :]

    def tokens_at(self, table: tuple[list[int], list[int]], code_points: int) -> int:
        """Tokens of the prefix of so many code points."""
        return table[1][bisect_right(table[0], code_points) - 1]

    def longest_within(self, table: tuple[list[int], list[int]], budget: int, length: int) -> int:
        """Code points of the longest prefix of at most `budget` tokens; the text has `length`."""
        ends, counts = table
        for k in range(len(ends) - 1, -1, -1):
            if counts[k] <= budget:
                return length if k == len(ends) - 1 else ends[k + 1] - 1
        return 0


def _counter(vocabulary) -> TextCounter:
    return loaded("counts", vocabulary, TextCounter)


def token_counts(
    docs: DataFrame, path: str, limit: int = LIMIT, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row's whole text; a null text is empty, with no tokens.

    Repeated rows and rows without id are all counted.
    """
    vocabulary = shipped(docs.sparkSession, path)
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary)
        for batch in batches:
            n = pa.array([counter.count(t) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), n], ["id", "n_bytes", "n_tokens"])

    text = F.col(f"`{text_col}`")
    narrow = docs.select(F.col(f"`{id_col}`").cast("long"), text, F.octet_length(F.coalesce(text, F.lit(""))).cast("long"))
    counted = narrow.mapInArrow(count, "id long, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def prefix_tables(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ends, counts): each text's table, from which any prefix's count and any budget's prefix is read.

    `ends` are code points of the normalized text (composed, lower case, each run of
    spaces one blank); the prefix of k code points has the count of the last end that
    is not beyond k. See `tokens_in_prefix` and `prefix_within`.
    """
    vocabulary = shipped(docs.sparkSession, path)
    small_batches(docs.sparkSession)

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary)
        for batch in batches:
            found = [counter.table(t) for t in batch.column(1).to_pylist()]
            columns = [pa.array([f[k] for f in found], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, "ends", "counts"])

    narrow = docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`"))
    return narrow.mapInArrow(tables, f"`{id_col}` long, ends array<int>, counts array<int>")


def tokens_in_prefix(code_points: int):
    """Column over `prefix_tables`: tokens of the prefix of so many code points."""
    return F.element_at("counts", F.size(F.filter("ends", lambda e: e <= code_points)))


def prefix_within(budget: int):
    """Column over `prefix_tables`: code points up to which prefixes stay within the budget; null if all do.

    Counts can fall when a word is completed; this is the last prefix within the budget.
    """
    over = F.filter(F.transform("counts", lambda c, i: F.when(c <= budget, i)), lambda i: i.isNotNull())
    return F.get(F.col("ends"), F.element_at(over, -1) + 1) - 1
