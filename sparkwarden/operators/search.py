"""Event search, lookups and pages."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.severity import severity_rank
from ..functions.text import fold_term, word_text, words
from ..functions.timestamps import instant
from ..schemas import SEVERITIES, SOURCES

# Fixed limits of the search interface.
SORT_FIELDS = ("timestamp", "severity", "source")
MAX_PAGE = 500
MAX_QUERY = 200
MAX_EVENT_TYPE = 100
MAX_IP = 45

# Folders of a word index.
WORD_BUCKETS = 64


@dataclass(frozen=True)
class TextQuery:
    """Words that must, may or must not occur; every part is optional."""

    all_of: Sequence[str] = ()
    any_of: Sequence[str] = ()
    none_of: Sequence[str] = ()
    phrase: str | None = None
    prefix: str | None = None

    def text(self) -> str:
        parts = [*self.all_of, *self.any_of, *self.none_of, self.phrase or "", self.prefix or ""]
        return " ".join(p for p in parts if p)


def check_page(limit: int, offset: int, most: int | None = MAX_PAGE) -> None:
    if limit < 1 or (most is not None and limit > most):
        raise ValueError("limit must be at least 1" if most is None else f"limit must be between 1 and {most}")
    if offset < 0:
        raise ValueError("offset must not be negative")


def check_id(value: int | str) -> int:
    """An event or alert id: 1 to 20 digits."""
    if not re.fullmatch(r"[0-9]{1,20}", str(value)):
        raise ValueError(f"invalid id: {value}")
    return int(value)


def has_id(column: str, value: int | str) -> Column:
    """The id column equals a checked id; ids beyond 64 bits equal nothing."""
    number = check_id(value)
    return F.col(column) == number if number < 2**63 else F.lit(False)


def _as_time(name: str, value: datetime | str | None) -> datetime | None:
    """A time bound; text must be ISO 8601, an offset is converted to UTC."""
    if value is None or value == "":
        return None
    if isinstance(value, str):
        try:
            value = datetime.fromisoformat(value)
        except ValueError:
            raise ValueError(f"invalid {name} timestamp: {value}") from None
    if value.tzinfo is not None:
        value = value.astimezone(timezone.utc).replace(tzinfo=None)
    return value


def event_filter(
    events: DataFrame,
    severity: str | None = None,
    source: str | None = None,
    event_type: str | None = None,
    source_ip: str | None = None,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
) -> DataFrame:
    """AND of the given conditions; empty ones do not filter. Bounds are inclusive.

    On a table laid out by ``event_date`` the time bounds also prune days.
    """
    if severity and severity not in SEVERITIES:
        raise ValueError(f"invalid severity: {severity}")
    if source and source not in SOURCES:
        raise ValueError(f"invalid source: {source}")
    if event_type and len(event_type) > MAX_EVENT_TYPE:
        raise ValueError("event_type is too long")
    if source_ip and len(source_ip) > MAX_IP:
        raise ValueError("source_ip is too long")
    start, end = _as_time("start", start), _as_time("end", end)

    wanted = {
        "severity": severity,
        "source": source,
        "event_type": event_type,
        "source_ip": source_ip,
    }
    for column, value in wanted.items():
        if value:
            events = events.filter(F.col(column) == value)
    by_day = "event_date" in events.columns
    if start:
        events = events.filter(F.col("timestamp") >= instant(start))
        if by_day:
            events = events.filter(F.col("event_date") >= F.lit(start.date()))
    if end:
        events = events.filter(F.col("timestamp") <= instant(end))
        if by_day:
            events = events.filter(F.col("event_date") <= F.lit(end.date()))
    return events


def _worded(terms: Sequence[str]) -> list[str]:
    """Terms with a letter or digit; others say nothing about words and are ignored."""
    return [t for t in terms if fold_term(t)]


def text_matches(text: Column, query: TextQuery) -> Column:
    """Case- and accent-insensitive whole-word match of the whole text.

    The text is normalised once per row: the tests are a lambda over it, which
    the optimizer cannot copy the normalisation into.
    """

    def matched(norm: Column) -> Column:
        def has(term: str) -> Column:
            # A term such as "10.0.0.1" is several words: it must occur as a phrase.
            folded = fold_term(term)
            return norm.contains(f" {' '.join(folded)} ") if folded else F.lit(True)

        result = F.lit(True)
        for term in _worded(query.all_of):
            result = result & has(term)
        if any_of := _worded(query.any_of):
            result = result & reduce(Column.__or__, [has(t) for t in any_of])
        for term in _worded(query.none_of):
            result = result & ~has(term)
        if query.phrase:
            result = result & has(query.phrase)
        if query.prefix:
            result = result & norm.contains(f" {' '.join(fold_term(query.prefix))}")
        return result

    return F.exists(F.transform(F.array(text), word_text), matched)


def text_search(df: DataFrame, query: TextQuery, column: str = "raw_message") -> DataFrame:
    """Rows whose text matches, by scanning the text column."""
    if len(query.text()) > MAX_QUERY:
        raise ValueError("query is too long")
    return df.filter(text_matches(F.col(column), query))


# Word index ---------------------------------------------------------------------------


def word_postings(
    df: DataFrame, id_column: str = "event_id", column: str = "raw_message"
) -> DataFrame:
    """(word, id) for every distinct word of every row; no shuffle."""
    return df.select(
        F.explode(F.array_distinct(words(F.col(column)))).alias("word"),
        F.col(id_column).alias("id"),
    )


def _word_bucket(word: Column, buckets: Column) -> Column:
    return F.pmod(F.xxhash64(word), buckets).cast("int")


def write_word_index(
    df: DataFrame,
    path: str,
    id_column: str = "event_id",
    column: str = "raw_message",
    mode: str = "append",
    buckets: int = WORD_BUCKETS,
) -> None:
    """Persist the postings in folders by word hash, sorted by word.

    The number of folders is part of the folders' names, so an index may be appended to
    with another number, and a lookup reads one folder of each.

    A lookup reads one folder, and in it the row groups of the word. Rebalancing
    lets Spark split the folder of a frequent word over several files.
    """
    (
        word_postings(df, id_column, column)
        .withColumn("buckets", F.lit(buckets))
        .withColumn("bucket", _word_bucket(F.col("word"), F.col("buckets")))
        .hint("rebalance", "bucket")
        .sortWithinPartitions("bucket", "word", "id")
        .write.mode(mode)
        .partitionBy("buckets", "bucket")
        .parquet(path)
    )


def index_search(
    spark: SparkSession,
    index_path: str,
    df: DataFrame,
    query: TextQuery,
    id_column: str = "event_id",
    column: str = "raw_message",
) -> DataFrame:
    """The same answer as :func:`text_search`, read through a word index.

    The ids of the wanted words are joined among themselves first, the longest word
    before the others, so that texts meet one narrow table of ids. Only the rows left
    over have their text read: the test stands behind a generator, which keeps it from
    being moved below the join.
    """
    index = spark.read.parquet(index_path)

    def rows_with(condition: Column) -> DataFrame:
        return index.filter(condition).select(F.col("id").alias(id_column))

    def one_of(found: list[str]) -> Column:
        tests = [
            (F.col("bucket") == _word_bucket(F.lit(w), F.col("buckets"))) & (F.col("word") == w) for w in found
        ]
        return reduce(Column.__or__, tests)

    if len(query.text()) > MAX_QUERY:
        raise ValueError("query is too long")
    terms = [w for t in (*query.all_of, query.phrase or "") for w in fold_term(t)]
    # Long words are rare more often than short ones.
    wanted = [rows_with(one_of([w])) for w in sorted(dict.fromkeys(terms), key=len, reverse=True)]
    if leads := [fold_term(t)[0] for t in _worded(query.any_of)]:
        wanted.append(rows_with(one_of(leads)).distinct())
    prefix = fold_term(query.prefix or "")
    if len(prefix) == 1:
        wanted.append(rows_with(F.col("word").startswith(prefix[0])).distinct())
    if not wanted:
        return text_search(df, query, column)
    ids = reduce(lambda some, more: some.join(more, id_column, "left_semi"), wanted)
    hits = df.join(ids, id_column, "left_semi")
    read = hits.select("*", F.inline(F.array(F.struct(text_matches(F.col(column), query).alias("_match")))))
    return read.filter("_match").drop("_match")


# Sort and page ------------------------------------------------------------------------


def _sort_column(sort: str, severity_order: str) -> Column:
    if sort not in SORT_FIELDS:
        raise ValueError(f"invalid sort field: {sort}")
    if severity_order not in ("lexical", "rank"):
        raise ValueError("severity_order must be 'lexical' or 'rank'")
    if sort == "severity" and severity_order == "rank":
        return severity_rank(F.col("severity"))
    return F.col(sort)


def sort_events(
    events: DataFrame,
    sort: str = "timestamp",
    order: str = "desc",
    severity_order: str = "lexical",
) -> DataFrame:
    """Order by one field; equal values by id, in the same direction."""
    if order not in ("asc", "desc"):
        raise ValueError("order must be 'asc' or 'desc'")
    keys = [_sort_column(sort, severity_order), F.col("event_id")]
    return events.orderBy(*[k.desc() if order == "desc" else k.asc() for k in keys])


def page_events(
    events: DataFrame,
    sort: str = "timestamp",
    order: str = "desc",
    limit: int = 50,
    offset: int = 0,
    after: tuple[object, int] | None = None,
    severity_order: str = "lexical",
) -> DataFrame:
    """One page of sorted events.

    ``after`` takes the (sort value, id) of the last row seen instead of an
    offset: the cost of a deep page is then that of the first one.
    """
    check_page(limit, offset)
    if after is not None:
        value, last_id = after
        key = _sort_column(sort, severity_order)
        last = instant(value) if isinstance(value, datetime) else F.lit(value)
        tie = F.col("event_id")
        if order == "desc":
            events = events.filter((key < last) | ((key == last) & (tie < last_id)))
        else:
            events = events.filter((key > last) | ((key == last) & (tie > last_id)))
    ordered = sort_events(events, sort, order, severity_order)
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def total(df: DataFrame) -> DataFrame:
    """One row, column ``total``."""
    return df.agg(F.count(F.lit(1)).alias("total"))


def search_events(
    events: DataFrame,
    query: TextQuery | None = None,
    sort: str = "timestamp",
    order: str = "desc",
    limit: int = 50,
    offset: int = 0,
    severity_order: str = "lexical",
    after: tuple[object, int] | None = None,
    **filters,
) -> tuple[DataFrame, DataFrame]:
    """(page, total) of the events that pass all filters of :func:`event_filter`; ``after`` as in :func:`page_events`."""
    found = event_filter(events, **filters)
    if query is not None:
        found = text_search(found, query)
    page = page_events(found, sort, order, limit, offset, after, severity_order)
    return page, total(found)


def existing(found: DataFrame, what: str) -> DataFrame:
    """`found`, or a LookupError when it has no row."""
    if found.isEmpty():
        raise LookupError(f"{what} not found")
    return found


def get_event(events: DataFrame, event_id: int | str) -> DataFrame:
    """The event with this id; an id that no event has is an error."""
    return existing(events.filter(has_id("event_id", event_id)), f"event {event_id}")


def list_anomalies(
    events: DataFrame,
    min_score: float = 0.5,
    limit: int = 50,
    offset: int = 0,
    after: tuple[float, int] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(page, total) of events scored at least ``min_score``, highest first.

    ``after`` takes the (score, id) of the last row seen instead of an offset.
    """
    check_page(limit, offset, None)
    found = events.filter(F.col("anomaly_score") >= min_score)
    rest = found
    if after is not None:
        score, last_id = F.col("anomaly_score"), F.lit(after[1])
        rest = found.filter((score < after[0]) | ((score == after[0]) & (F.col("event_id") > last_id)))
    ordered = rest.orderBy(F.col("anomaly_score").desc(), F.col("event_id"))
    return (ordered.offset(offset) if offset else ordered).limit(limit), total(found)
