"""Runs of words (maximal repetitions) by uniting suffix classes in order of falling LCP.

Positions whose following words agree for `lcp` words form a class. Neighbours in
suffix order are united by falling longest common prefix, as in Kruskal's algorithm,
with a union-find over ordered sets of positions. Two positions i < j that become
adjacent in a set when their common prefix is `lcp` >= j - i start a stretch of
period j - i that ends at j + lcp; no smaller period fits, as a position between
them would have been in the set. The stretch is a run if the word before it does not
keep the period. A run's first position meets the one a period later in exactly one
union, so each run comes once.

A run of `least` words or more and at least two periods needs a common prefix of half
of `least`, so only positions whose first words (half of `least`) come again in the
text are sorted and united. Texts of an Arrow batch are sorted together, each with
words of its own; a text is never cut.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import small_batches

LEAST = 12

# Positions in one part of an ordered set: adding one moves at most so many.
PART = 512


class Positions:
    """An ordered set of positions in parts of bounded length."""

    __slots__ = ("parts", "size")

    def __init__(self, position: int):
        self.parts, self.size = [[position]], 1

    def _part(self, position: int) -> int:
        low, high = 0, len(self.parts) - 1
        while low < high:
            middle = (low + high) // 2
            if self.parts[middle][-1] < position:
                low = middle + 1
            else:
                high = middle
        return low

    def add(self, position: int) -> None:
        at = self._part(position)
        part = self.parts[at]
        insort(part, position)
        self.size += 1
        if len(part) > PART:
            self.parts[at : at + 1] = [part[: PART // 2], part[PART // 2 :]]

    def neighbours(self, position: int) -> tuple[int | None, int | None]:
        """The members before and after one that is in the set."""
        at = self._part(position)
        part = self.parts[at]
        k = bisect_left(part, position)
        before = part[k - 1] if k else self.parts[at - 1][-1] if at else None
        after = part[k + 1] if k + 1 < len(part) else self.parts[at + 1][0] if at + 1 < len(self.parts) else None
        return before, after

    def __iter__(self) -> Iterator[int]:
        for part in self.parts:
            yield from part


def _ranked(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks from 1 of rows of keys (non-negative), in their order."""
    value = keys[0]
    for key in keys[1:]:
        value = value * (int(key.max(initial=0)) + 1) + key
    return np.unique(value, return_inverse=True)[1].astype(np.int64) + 1


def _shifted(rank: np.ndarray, by: int, ends: np.ndarray) -> np.ndarray:
    """Each position's rank `by` places on, 0 beyond the end of its text."""
    out = np.zeros(len(rank), rank.dtype)
    out[: len(rank) - by] = rank[by:]
    out[np.arange(len(rank)) + by >= ends] = 0
    return out


def common_prefixes(words: np.ndarray, texts: np.ndarray, ends: np.ndarray, least: int):
    """(position, next position in suffix order, common prefix) of all neighbours that share `least` words or more.

    `words` are numbers from 0, `texts` the number of each position's text and `ends`
    the place after its last word; positions of different texts share nothing.
    """
    first = _ranked(texts, words)
    # Ranks by the first 1, 2, 4, ... words, put together to `least`.
    rank, length, power, width = None, 0, first, 1
    while True:
        if least & width:
            rank = power if rank is None else _ranked(rank, _shifted(power, length, ends))
            length += width
        width *= 2
        if width > least:
            break
        power = _ranked(power, _shifted(power, width // 2, ends))
    # From dense ranks to places: a class has the place of its first member.
    order = np.argsort(rank, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(rank[order]) > 0]) if len(order) else order
    sizes = np.diff(np.r_[starts, len(order)])
    place = np.empty(len(rank) + 1, np.int64)
    place[order] = np.repeat(starts, sizes)
    place[-1] = -1
    # Only classes of two or more are sorted on; `levels` keeps what each doubling knew.
    active = order[np.repeat(sizes > 1, sizes)]
    candidates = active.copy()
    levels = [(least, place.copy())]
    at = least
    while len(active):
        beyond = np.minimum(active + at, ends[active])
        second = np.where(active + at < ends[active], place[beyond], -1)
        old = place[active]
        sort = np.lexsort((second, old))
        active, second, old = active[sort], second[sort], old[sort]
        new_class = np.r_[True, np.diff(old) > 0]
        new_part = new_class | np.r_[True, np.diff(second) != 0]
        offset = np.arange(len(active)) - np.maximum.accumulate(np.where(new_class, np.arange(len(active)), 0))
        part_start = np.maximum.accumulate(np.where(new_part, np.arange(len(active)), 0))
        place[active] = old + offset[part_start]
        several = np.repeat(np.diff(np.r_[np.flatnonzero(new_part), len(active)]) > 1, np.diff(np.r_[np.flatnonzero(new_part), len(active)]))
        active = active[several]
        at *= 2
        if len(active):
            levels.append((at, place.astype(np.int32) if len(place) < 2**31 else place.copy()))
    suffixes = candidates[np.argsort(place[candidates], kind="stable")]
    shared = levels[0][1]
    together = np.flatnonzero(shared[suffixes[:-1]] == shared[suffixes[1:]])
    left, right = suffixes[together], suffixes[together + 1]
    lcp = np.zeros(len(left), np.int64)
    for step, known in reversed(levels):
        lcp += np.where(known[left + lcp] == known[right + lcp], step, 0)
    for _ in range(least - 1):
        inside = np.maximum(left, right) + lcp < ends[left]
        a, b = np.where(inside, left + lcp, 0), np.where(inside, right + lcp, 0)
        same = inside & (words[a] == words[b])
        if not same.any():
            break
        # A pair that differs once stays where it is: its next word is compared again and differs again.
        lcp += same
    return left, right, lcp


def repetitions(words: np.ndarray, texts: np.ndarray, ends: np.ndarray, least: int = LEAST):
    """(start, length, period) arrays of all runs of at least `least` words and two periods."""
    left, right, lcp = common_prefixes(words, texts, ends, (least + 1) // 2)
    order = np.argsort(-lcp, kind="stable")
    members = np.unique(np.concatenate([left, right]))
    parent = list(range(len(members)))
    sets: list[Positions | None] = [Positions(p) for p in members.tolist()]
    pairs = zip(
        np.searchsorted(members, left[order]).tolist(), np.searchsorted(members, right[order]).tolist(), lcp[order].tolist(), strict=True
    )

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    seeds: list[tuple[int, int, int]] = []
    for a, b, shared in pairs:
        a, b = root(a), root(b)
        if sets[a].size < sets[b].size:
            a, b = b, a
        large, small = sets[a], sets[b]
        parent[b], sets[b] = a, None
        added = list(small)
        for position in added:
            large.add(position)
        moved = set(added) if len(added) > 1 else None
        for position in added:
            before, after = large.neighbours(position)
            # Neighbours that were together before are not newly adjacent.
            if before is not None and position - before <= shared and not (moved and before in moved):
                seeds.append((before, position - before, shared))
            if after is not None and after - position <= shared and not (moved and after in moved):
                seeds.append((position, after - position, shared))
    start, period, shared = np.array(seeds, np.int64).reshape(-1, 3).T
    length = period + shared
    before = np.maximum(start - 1, 0)
    text_start = (start == 0) | (texts[before] != texts[start])
    maximal = (text_start | (words[before] != words[before + period])) & (length >= np.maximum(least, 2 * period))
    return start[maximal], length[maximal], period[maximal]


def looped(count: int, doc_id: int | None) -> tuple[int, int] | None:
    """(first word, period) of the loop written into every tenth text by its id's checksum, None for the others."""
    if doc_id is None or not count:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % count
    return a, 1 + (count - a) // (3 + g % 8)


def _numbered(texts: Iterable[list[bytes]]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(w, len(known)) for words in texts for w in words], np.int64)


def runs_of(texts: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of each text's runs, by start, then period."""
    counts = np.array([len(t) for t in texts], np.int64)
    stops = np.cumsum(counts)
    numbers = np.repeat(np.arange(len(texts)), counts)
    start, length, period = repetitions(_numbered(texts), numbers, np.repeat(stops, counts), least)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    order = np.lexsort((period, start))
    text = numbers[start[order]] if len(start) else start
    local = start[order] - (stops - counts)[text]
    for t, *run in zip(text.tolist(), local.tolist(), length[order].tolist(), period[order].tolist(), strict=True):
        found[t].append(tuple(run))
    return found


def kept_words(words: list[bytes], runs: Iterable[tuple[int, int, int]]) -> list[bytes]:
    """Without the words of a run after its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    dropped = np.cumsum(change[:-1]) > 0
    return [w for w, gone in zip(words, dropped.tolist(), strict=True) if not gone] if dropped.any() else words


# Words that are sorted together: short texts share a pass, a long one has its own.
TOGETHER = 1 << 17


def _grouped(words: list[list[bytes]]) -> Iterator[list[list[bytes]]]:
    group, size = [], 0
    for text in words:
        if group and size + len(text) > TOGETHER:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


RUNS = "id long, words long, runs array<struct<start:long,length:long,period:long>>, runs_sha256 string, collapsed string"


def word_runs(
    docs: DataFrame, least: int = LEAST, *, plant: bool = False, digest: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, words, runs, runs_sha256, collapsed): each text's runs of words and the text without their repeats.

    Words are stretches without ASCII white space. `runs` are by start, then period;
    `collapsed` is the words that no run repeats, joined by one space, or with `digest`
    that text's SHA-256. `plant` writes loops into every tenth text, by its id, as the
    contract of the query wants. Null, empty and blank texts have no words, no runs and
    an empty collapsed text. Rows without id get no loop. Repeated rows are all
    returned; other columns do not matter. Each text is handled whole in its task.
    """
    small_batches(docs.sparkSession)

    def sha(data: bytes) -> str:
        return hashlib.sha256(data).hexdigest()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [(t or "").encode().split() for t in batch.column(1).to_pylist()]
            for k, doc_id in enumerate(ids):
                loop = looped(len(texts[k]), doc_id) if plant else None
                if loop:
                    a, p = loop
                    head, cycle = texts[k][: a + p], texts[k][a : a + p]
                    rest = len(texts[k]) - len(head)
                    texts[k] = head + cycle * (rest // p) + cycle[: rest % p]
            runs = [r for group in _grouped(texts) for r in runs_of(group, least)]
            collapsed = [b" ".join(kept_words(t, r)) for t, r in zip(texts, runs, strict=True)]
            lines = [sha("".join(f"{s},{n},{p}\n" for s, n, p in r).encode()) for r in runs]
            names = ("start", "length", "period")
            columns = [
                pa.array(ids, pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([[dict(zip(names, x, strict=True)) for x in r] for r in runs], pa.list_(pa.struct([(n, pa.int64()) for n in names]))),
                pa.array(lines, pa.string()),
                pa.array([sha(c) if digest else c.decode() for c in collapsed], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "words", "runs", "runs_sha256", "collapsed"])

    narrow = docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`"))
    return narrow.mapInArrow(find, RUNS)


def run_digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) with the loops of the contract.

    The four numbers are those of the longest run (ties: smallest start, then period), null without runs.
    """
    found = word_runs(docs, plant=True, digest=True, id_col=id_col, text_col=text_col)
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"], r["period"]))
    longest = found.withColumn("_best", F.array_min(order))
    length = -F.col("_best.n")
    return longest.select(
        F.col("id").alias(id_col),
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"),
        length.alias("length"),
        F.col("_best.period").alias("period"),
        F.expr("(-_best.n * 1000) div _best.period").alias("exponent_milli"),
        "runs_sha256",
        F.col("collapsed").alias("collapsed_sha256"),
    )
