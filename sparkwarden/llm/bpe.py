"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The parts of a pre-token form a linked list. A queue holds, per merge rank, the
places where that merge is possible; which ranks are present is kept in bitmaps of
64-bit words over 64-bit words, so the lowest rank is found by a find-first-set per
level. Entries are not removed when a merge beside them changes the pair: they are
skipped as stale when they come up. A pre-token of n bytes so takes about n log n
steps, also if it is megabytes long.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import CachedEncoder, loaded, shipped
from .tables import small_batches

_WORD = 6  # bits of a rank that say its place within a 64-bit word


class RankQueue:
    """Places by rank; the lowest rank comes first, and of its places the leftmost.

    Two bitmaps: `words` has a bit per rank that holds places, `summary` a bit per
    word that is not zero (one wide number). `merges` below runs on these fields
    itself, since a call per step would cost more than the step.
    """

    def __init__(self, ranks: int):
        n = (ranks >> _WORD) + 1
        self.words = [0] * n
        self.bits = [1 << i for i in range(max(n, 64))]
        self.buckets: dict[int, int | list[int]] = {}  # a place, or a heap of places

    def also(self, rank: int, place: int) -> None:
        """One more place for a rank that has some."""
        bucket = self.buckets[rank]
        if type(bucket) is list:
            heappush(bucket, place)
        else:
            self.buckets[rank] = [bucket, place] if bucket < place else [place, bucket]

    def merges(self, piece: bytes, ranks: dict[bytes, int], of_bytes: list[int], longest: int) -> list[int]:
        """Starts of the parts that remain when all merges are made; the queue is empty before and after.

        `of_bytes` has the rank of every two bytes (at 256 * first + second), or -1.
        """
        words, bits, buckets, summary = self.words, self.bits, self.buckets, 0
        n = len(piece)
        after = list(range(1, n + 1))  # start of the next part
        before = list(range(-1, n - 1))
        pair = [-1] * n  # rank of the merge of a part with the next
        rank_of = ranks.get
        first = piece[0]
        for i in range(n - 1):
            second = piece[i + 1]
            rank = of_bytes[first << 8 | second]
            first = second
            if rank >= 0:
                pair[i] = rank
                if rank in buckets:
                    self.also(rank, i)
                else:
                    buckets[rank] = i
                    word = rank >> _WORD
                    words[word] |= bits[rank & 63]
                    summary |= bits[word]
        while summary:
            # Find first set: the word, then the rank within it.
            word = (summary & -summary).bit_length() - 1
            held = words[word]
            low = held & -held
            rank = (word << _WORD) + low.bit_length() - 1
            i = buckets[rank]
            if type(i) is list:
                i = heappop(bucket := i)
                emptied = not bucket
            else:
                emptied = True
            if emptied:
                del buckets[rank]
                words[word] = held = held ^ low
                if not held:
                    summary ^= bits[word]
            if pair[i] != rank:
                continue  # stale
            gone = after[i]
            end = after[i] = after[gone]
            pair[gone] = pair[i] = -1
            if end < n:
                before[end] = i
                stop = after[end]
                if stop - i <= longest and (r := rank_of(piece[i:stop])) is not None:
                    pair[i] = r
                    if r in buckets:
                        self.also(r, i)
                    else:
                        buckets[r] = i
                        word = r >> _WORD
                        words[word] |= bits[r & 63]
                        summary |= bits[word]
            left = before[i]
            if left >= 0:
                pair[left] = -1
                if end - left <= longest and (r := rank_of(piece[left:end])) is not None:
                    pair[left] = r
                    if r in buckets:
                        self.also(r, left)
                    else:
                        buckets[r] = left
                        word = r >> _WORD
                        words[word] |= bits[r & 63]
                        summary |= bits[word]
        starts, i = [], 0
        while i < n:
            starts.append(i)
            i = after[i]
        return starts


class BytePairEncoder:
    """Encodes and decodes by a table token bytes -> rank, the rank being the id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.longest = max(map(len, ranks))
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.queue = RankQueue(len(self.bytes_of))
        self.of_bytes = [ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]
        self.cached = CachedEncoder(self.encode_whole)
        self.decimal = [str(i) for i in range(len(self.bytes_of))]

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        starts = self.queue.merges(piece, ranks, self.of_bytes, self.longest)
        return tuple([ranks[piece[i:j]] for i, j in zip(starts, [*starts[1:], len(piece)])])

    def encode_whole(self, text: str) -> tuple[int, ...]:
        """Ids of a text, each match of the pattern on its own, nothing cached."""
        found = self.pattern.findall(text)
        if len(found) == 1:
            return self.merge(text.encode("utf-8"))
        return tuple(chain.from_iterable(self.merge(m.encode("utf-8")) for m in found))

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.cached.parts(text or "")))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def rank_table(data: bytes) -> dict[bytes, int]:
    """The ranks of a vocabulary file: lines of base64 and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if rank}


def _encoder(vocabulary, pattern: str) -> BytePairEncoder:
    return loaded("bpe:" + pattern, vocabulary, lambda data: BytePairEncoder(rank_table(data), pattern))


def encode_texts(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids: array<int>) of every row's whole text; a null text is empty and has no ids.

    Repeated rows and rows without id are all encoded. `path` is the file of ranks.
    """
    vocabulary = shipped(docs.sparkSession, path)
    small_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, pattern)
        for batch in batches:
            ids = pa.array([encoder.encode(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], [id_col, "ids"])

    narrow = docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`"))
    return narrow.mapInArrow(encode, f"`{id_col}` long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str, *, id_col: str = "doc_id") -> DataFrame:
    """(id, text: binary) of rows (id, ids); null ids decode to nothing. Unknown ids are an error."""
    vocabulary = shipped(encoded.sparkSession, path)
    small_batches(encoded.sparkSession)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, ".")
        for batch in batches:
            texts = pa.array([encoder.decode(ids or ()) for ids in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], [id_col, "text"])

    return encoded.select(F.col(f"`{id_col}`").cast("long"), "ids").mapInArrow(decode, f"`{id_col}` long, text binary")


# Parts of a text that are encoded, written out and decoded at a time.
_BLOCK = 1 << 16


def digests(encoder: BytePairEncoder, text: str | None) -> tuple[int, str, str]:
    """Count of ids, SHA-256 of the decimal ids with commas, SHA-256 of the decoded bytes; a block of the text at a time."""
    parts = encoder.cached.parts(text or "")
    written, decoded, n = hashlib.sha256(), hashlib.sha256(), 0
    for at in range(0, len(parts), _BLOCK):
        ids = list(chain.from_iterable(parts[at : at + _BLOCK]))
        if not ids:
            continue
        written.update(("," * (n > 0) + ",".join(map(encoder.decimal.__getitem__, ids))).encode("ascii"))
        decoded.update(encoder.decode(ids))
        n += len(ids)
    return n, written.hexdigest(), decoded.hexdigest()


def round_trip_digests(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text encoded and its ids decoded: (id, n_tokens, ids_sha256, decoded_sha256). A null text is empty."""
    vocabulary = shipped(docs.sparkSession, path)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, pattern)
        for batch in batches:
            found = [digests(encoder, t) for t in batch.column(1).to_pylist()]
            counts, ids, texts = ([f[k] for f in found] for k in range(3))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    narrow = docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`"))
    return narrow.mapInArrow(run, f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string")
