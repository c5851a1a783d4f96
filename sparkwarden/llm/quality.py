"""Quality rules: plain counts, and how much a text resembles trusted texts.

Words and word pairs are hashed into a fixed number of buckets. Over the trusted
documents and over the whole corpus the buckets give two multinomials (add-one
smoothing); a document's score is the mean, over its n-grams, of the log ratio of
the two. The mean makes long and short texts comparable. A document is kept when
it passes the counts and scores at least the threshold; nothing is drawn at
random. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters between words: blank and \t \n \v \f \r.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

MIN_WORDS = 10
REPEAT_WINDOW = 5
MAX_REPEAT_PERCENT = 20

BUCKETS = 16384
THRESHOLD = -0.08


def _apart(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` with more columns, each computed once: a one-row generator is not merged into later projections."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _blanks_only(text: Column) -> Column:
    """The text with every space character as a blank: byte-wise replacement, and a split at one character, need no regex."""
    for c in SPACES[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def _words(parts: Column) -> Column:
    return F.when(F.array_contains(parts, ""), F.filter(parts, lambda w: w != "")).otherwise(parts)


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _pairs(hashes: Column) -> Column:
    """Hashes of the pairs of adjacent words."""
    firsts = F.slice(hashes, 1, F.greatest(F.size(hashes) - 1, F.lit(0)))
    return F.transform(firsts, lambda a, i: F.xxhash64(a, F.get(hashes, i + 1)))


def _bucket(hash_: Column, buckets: int) -> Column:
    return F.pmod(hash_, F.lit(buckets)).cast("int")


def gram_counts(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, *, id_col="doc_id", text_col="text") -> DataFrame:
    """Per bucket the n-grams of the whole corpus (`raw`) and of its trusted documents (`target`).

    `trusted` has the ids of the trusted documents in `id_col`; null ids are not
    trusted, repeated ids count once.
    """
    ids = trusted.select(F.col(id_col).alias("_id")).where(F.col("_id").isNotNull()).distinct().withColumn("_trusted", F.lit(1))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_text").isNotNull())
    # The ids are the narrow side: their hash table is built per partition and no text is sorted.
    marked = texts.join(ids.hint("shuffle_hash"), "_id", "left")
    parted = _apart(marked.select(F.coalesce("_trusted", F.lit(0)).alias("_trusted"), "_text"), _parts=F.split(_blanks_only(F.col("_text")), " ", -1))
    hashed = _apart(parted.drop("_text"), _h=_hashes(_words(F.col("_parts")))).drop("_parts")
    return (
        hashed.select("_trusted", F.explode(F.concat(F.col("_h"), _pairs(F.col("_h")))).alias("_g"))
        .groupBy(_bucket(F.col("_g"), buckets).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("raw"), F.sum("_trusted").alias("target"))
    )


def log_ratios(counts: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """ln(target share) - ln(raw share) of every bucket, smoothed by one; `buckets` numbers.

    Without any trusted n-gram all are zero, so the score decides nothing.
    """
    rows = {r["bucket"]: (r["raw"], r["target"]) for r in counts.collect()}
    all_raw, all_target = (sum(v[i] for v in rows.values()) for i in (0, 1))
    if not all_target:
        return [0.0] * buckets
    shift = math.log(all_raw + buckets) - math.log(all_target + buckets)
    return [math.log(t + 1) - math.log(r + 1) + shift for r, t in (rows.get(b, (0, 0)) for b in range(buckets))]


def _repeat_places(frame: DataFrame) -> DataFrame:
    """`frame` with `_at`, the places in order of those hashes in its array `_w` that stand there more than once, instead of `_w`."""
    # Hashes are sorted with their places: those beside an equal one are the repeated ones. Texts
    # whose hashes all differ, most of them, are not sorted.
    numbered = F.transform("_w", lambda x, i: F.struct(x.alias("hash"), i.cast("long").alias("place")))
    twice = F.size(F.array_distinct("_w")) < F.size("_w")
    nothing = F.array().cast("array<struct<hash:bigint,place:bigint>>")
    frame = _apart(frame, _sorted=F.when(twice, F.sort_array(numbered)).otherwise(nothing)).drop("_w")
    s = F.col("_sorted")

    def beside(x: Column, k: Column) -> Column:
        return F.coalesce(x["hash"] == F.get(s, k)["hash"], F.lit(False))

    places = F.transform(s, lambda x, k: F.when(beside(x, k + 1) | beside(x, k - 1), x["place"]))
    return _apart(frame, _at=F.sort_array(F.filter(places, lambda i: i.isNotNull()))).drop("_sorted")


def judge(
    docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD, *, text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """One row per row of `docs`: `row` (its columns, or those of `keep`, as a struct), the counts and the verdict.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed,
    score (double; 0 for a text without words), kept. Whole texts are used, of any
    length. A null text counts as empty: no words, so base_failed. Repeated rows are
    judged alike and all returned. Column names of `docs` cannot clash with the new ones.
    """
    if not ratios:
        raise ValueError("ratios must not be empty")
    # One literal: an array the optimizer folds from its text.
    weights = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    text = F.coalesce(F.col("_text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)])
    frame = docs.select(row.alias("row"), F.col(f"`{text_col}`").alias("_text"))
    frame = _apart(frame, _parts=F.split(_blanks_only(text), " ", -1), _lines=lines).select(
        "row",
        "_parts",
        (F.length(text) - F.size("_parts") + 1).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    )
    frame = _apart(frame, _h=_hashes(_words(F.col("_parts")))).drop("_parts")
    frame = _apart(frame, _p=_pairs(F.col("_h")))
    h, p, n = F.col("_h"), F.col("_p"), F.size("_h")

    def log_sum(hashes: Column) -> Column:
        return F.aggregate(hashes, F.lit(0.0), lambda acc, g: acc + F.get(weights, _bucket(g, len(ratios))))

    # A window of five words is its first two pairs and its last word.
    starts = F.slice(p, 1, F.greatest(n - (REPEAT_WINDOW - 1), F.lit(0)))
    windows = F.transform(starts, lambda x, i: F.xxhash64(x, F.get(p, i + 2), F.get(h, i + 4)))
    frame = _apart(
        frame,
        score=F.when(n == 0, 0.0).otherwise((log_sum(h) + log_sum(p)) / (n + F.size(p))),
        _w=windows,
        n_words=n.cast("long"),
    ).drop("_h", "_p")
    frame = _repeat_places(frame)
    # A repeated window covers its words up to where the next one starts.
    at = F.col("_at")
    five = F.lit(REPEAT_WINDOW)
    covered = F.transform(at, lambda i, k: F.least(five, F.coalesce(F.get(at, k + 1) - i, five)))
    frame = frame.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda acc, x: acc + x)).drop("_at")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    frame = frame.withColumn("base_failed", failed)
    return frame.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids labelled good and not toxic; a null label is no trust."""
    return labels.where((F.col("quality") == 1) & (F.col("toxic") == 0)).select("doc_id")


def judged_documents(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """`judge` with the ratios of these documents and their labels."""
    ratios = log_ratios(gram_counts(docs, trusted_ids(labels), buckets), buckets)
    return judge(docs, ratios, threshold, keep=keep)
