"""Packing documents into training sequences: best-two-fit.

A sequence is filled greedily with the largest piece that still fits. Then its
smallest piece is taken out if two unpacked pieces fit the larger gap more tightly.

Sequences depend on lengths only, and there are as many lengths as a sequence has
tokens. So the plan is made on the table of piece counts by length: one fill gives a
pattern of lengths, used as often as the counts allow. The plan has a bounded size
whatever the number of documents (see `plan_sequences`); the pieces find their
places by their rank among the pieces of their length.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .pretokens import CachedEncoder, loaded, shipped
from .ranking import with_ranks
from .tables import small_batches, stored

CAPACITY = 1024
END_ID = 2

PIECE_SCHEMA = "doc_id long, piece int, start long, length int, ids_crc32 long"


class DocumentEncoder:
    """Ids of whole texts as little-endian 32-bit numbers, equal to the tokenizers library's.

    The library's byte-level pattern cuts texts; its merges run on the same vocabulary
    in a rank encoder, part by part. A text that holds one of the file's special strings
    goes to the library itself.
    """

    def __init__(self, data: bytes, pattern: str):
        self.library = Tokenizer.from_str(data.decode("utf-8"))
        spec = json.loads(data)
        self.special = [t["content"] for t in spec["added_tokens"]]
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        ranker = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        whole = ranker.encode_ordinary
        self.cached = CachedEncoder(lambda text: np.array(whole(text), dtype="<u4").tobytes())

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(self.cached.parts(text))


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document of `n` tokens: full ones, and before them the rest."""
    if n <= capacity:
        return [n]
    rest = n % capacity
    return [rest] * (rest > 0) + [capacity] * (n // capacity)


def tokenized_pieces(
    docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID, *, id_col="doc_id", text_col="text"
) -> DataFrame:
    """The pieces of every row's whole text: doc_id, piece, start, length, ids_crc32.

    A document is its ids and `end_id`; a null text is empty, so the end alone. Rows
    without id and repeated rows are pieces like any other.
    """
    vocabulary = shipped(docs.sparkSession, path)
    small_batches(docs.sparkSession)
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded("pack:" + pattern, vocabulary, lambda data: DocumentEncoder(data, pattern))
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, start = encoder.ids(text) + end, 0
                for k, length in enumerate(cut_lengths(len(ids) // 4, capacity)):
                    stop = start + length
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * stop])))
                    start = stop
            columns = list(zip(*rows)) or [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
            names = [f.split()[0] for f in PIECE_SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    narrow = docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`"))
    return narrow.mapInArrow(cut, PIECE_SCHEMA)


def _fill(left: np.ndarray, capacity: int) -> Counter:
    """One sequence's lengths from the counts `left` (index: length): greedy, then one piece for two."""

    def largest(most: int) -> int:
        fits = np.flatnonzero(left[: most + 1])
        return int(fits[-1]) if fits.size else 0

    taken: list[int] = []
    gap = capacity
    while gap and (length := largest(gap)):
        taken.append(length)
        left[length] -= 1
        gap -= length
    if gap and len(taken) > 1:
        small = min(taken)
        room = gap + small
        # For every first piece the largest second one that fits beside it.
        lengths = np.flatnonzero(left[: room + 1])
        best = (small, 0, 0)
        if lengths.size:
            at = np.searchsorted(lengths, room - lengths, side="right") - 1
            for a, k in zip(lengths.tolist(), at.tolist()):
                if k >= 0 and lengths[k] == a and left[a] < 2:
                    k -= 1
                if k >= 0 and a + int(lengths[k]) > best[0]:
                    best = (a + int(lengths[k]), a, int(lengths[k]))
        if best[1]:
            taken.remove(small)
            left[small] += 1
            taken += best[1:]
            left[best[1]] -= 1
            left[best[2]] -= 1
    for length in taken:
        left[length] += 1
    return Counter(taken)


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank + 1, first sequence, uses in each, offset of the first) of every run of pieces.

    A pattern is used until one of its lengths has too few pieces left to use it again.
    A length can run short at most 1 + capacity / length times, which bounds the
    patterns by about capacity * ln(capacity), whatever the counts.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"no piece can have {length} tokens")
        left[length] = n
    ranks, plan, sequence = Counter(), [], 0
    while left.any():
        pattern = _fill(left, capacity)
        times = min(int(left[length]) // uses for length, uses in pattern.items())
        offset = 0
        for length in sorted(pattern, reverse=True):
            uses = pattern[length]
            plan.append((length, ranks[length], ranks[length] + times * uses, sequence, uses, offset))
            ranks[length] += times * uses
            left[length] -= times * uses
            offset += length * uses
        sequence += times
    return plan


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its sequence_id (from 0, gapless) and offset (gapless from 0 within a sequence).

    `pieces` has doc_id, piece, start, length and more; it is read twice, so it should
    be a stored table. Collected are the counts by length, `capacity` rows at most.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    schema = "length int, _from long, _to long, _first long, _uses int, _offset int"
    plan = pieces.sparkSession.createDataFrame(plan_sequences(counts, capacity), schema)
    ranked = with_ranks(pieces, "length", ["doc_id", "piece", "ids_crc32"], "_rank")
    # The plan's size is bounded by the capacity.
    placed = ranked.join(F.broadcast(plan), "length").where("_rank >= _from AND _rank < _to")
    return placed.select(
        *pieces.columns,
        F.expr("_first + (_rank - _from) div _uses").alias("sequence_id"),
        F.expr("_offset + pmod(_rank - _from, _uses) * length").cast("long").alias("offset"),
    )


def packed_documents(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """All documents (doc_id, text) cut into pieces and packed; an empty table gives no rows."""
    pieces = stored(tokenized_pieces(docs, path, pattern, capacity), "pieces")
    packed = pack_pieces(pieces, capacity)
    return packed.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset"
    )
