"""Near-duplicates by SimHash, found through deletion-variant signatures.

Two fingerprints of 64 bits that differ in at most two bits, cut into two halves,
have a half that differs in at most one. So each half is indexed under its 32
variants with one bit wiped out: fingerprints with an equal variant agree in that
half but for that bit. An equality join finds them and the other half is verified.
A pair is put out by one variant only (the bit that differs, or bit 0 where the
halves are equal; the first half if both serve), so nothing has to be made distinct.

A variant that many fingerprints share is not joined as such. Its fingerprints go
on with the other half by the same method: quarters, one of which differs in at
most one bit, and their one-wildcard variants are added to the signature. What is
still crowded goes on with the bytes of the last quarter; then 53 bits are fixed, and
a signature has at most 2,048 fingerprints, whatever the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import component_roots
from .tables import small_batches, stored

SHINGLE = 3
MAX_BITS = 2
HASH_SEED = 42

# Fingerprints under one signature beyond which it is cut further. Changes where
# the work is done, not which pairs are found.
CROWDED = 128

# Fingerprints with one value of a half beyond which the half's signatures are cut further without
# their members being counted, so that a window over a signature has at most twice as many.
HOT = 1 << 12

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLOCK = 1 << 16


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash: bits set in over half of the shingles' hashes; 0 without words."""
    # bytes.split() cuts at blank and \\t \\n \\v \\f \\r, which is what separates words.
    words = (text or "").encode("utf-8").translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _BLOCK):
        to = min(n, at + _BLOCK)
        stops = ends[min(shingle, len(words)) - 1 + at : min(shingle, len(words)) - 1 + to]
        hashes = np.array([digest(joined[s : e - 1], HASH_SEED) for s, e in zip(starts[at:to], stops)], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [fingerprint_of(t) for t in batch.column(1).to_pylist()]
        fp = pa.array(np.array(values, dtype=np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), fp], ["id", "fp"])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp: long, the fingerprint's bits) for every row of `docs`."""
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return narrow.mapInArrow(_fingerprints, "id long, fp long")


def _half(fp: Column, which: int) -> Column:
    return F.shiftrightunsigned(fp, 32 * which).bitwiseAND(0xFFFFFFFF)


def _one_wildcard(value: str, width: int) -> Column:
    """(bit, rest) for each bit of the `width`-bit number: the number with that bit wiped out."""
    return F.expr(
        f"transform(sequence(0, {width - 1}), b -> named_struct('bit', b, 'rest', {value} & ~shiftleft(1L, b)))"
    )


def _own_variant(value: str, bit: str) -> str:
    """SQL: the difference `value` is exactly this bit, or none and this is bit 0."""
    return f"({value} = shiftleft(1L, {bit}) OR ({value} = 0 AND {bit} = 0))"


def _signatures(halves: DataFrame, *names: str) -> DataFrame:
    """(*names, sig) for rows with the number `half` (0 or 1) and value `h` of a half: one row for each wiped-out bit."""
    variants = halves.select(*names, "half", F.explode(_one_wildcard("h", 32)).alias("_v"))
    # One number for half, bit and the 32 remaining bits.
    return variants.select(*names, F.expr("shiftleft(half * 32L + _v.bit, 32) | _v.rest").alias("sig"))


def _shared_signatures(distinct_fps: DataFrame) -> DataFrame:
    """(fp, sig, crowded) where two fingerprints or more have the signature.

    All signatures are shuffled once, and a window counts them where they meet. Of two values of
    a half that make up a signature, one has half its fingerprints, so those too many for
    a window are found beforehand, by counts of the halves.
    """
    parts = [distinct_fps.select("fp", F.lit(which).alias("half"), _half(F.col("fp"), which).alias("h")) for which in (0, 1)]
    halves = parts[0].unionByName(parts[1])
    many = halves.groupBy("half", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT)
    hot = stored(_signatures(many), "hot")
    signed = _signatures(halves, "fp")
    met = signed.join(hot, "sig", "left_anti").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("sig")))
    few = met.where("n > 1").select("fp", "sig", (F.col("n") > CROWDED).alias("crowded"))
    return few.unionByName(signed.join(hot, "sig", "left_semi").select("fp", "sig", F.lit(True).alias("crowded")))


def near_pairs(distinct_fps: DataFrame) -> DataFrame:
    """Pairs (a < b) of the distinct fingerprints `fp` that differ in one or two bits; each pair once."""
    shared = stored(_shared_signatures(distinct_fps), "shared")
    plain = shared.where("not crowded").select("sig", "fp")

    half, bit = "cast(shiftrightunsigned(sig, 37) as int)", "cast(shiftrightunsigned(sig, 32) & 31 as int)"
    differ = "(a ^ b)"
    first, second = f"({differ} & 4294967295L)", f"shiftrightunsigned({differ}, 32)"
    # Put out by the first half where it differs in at most one bit, else by the second.
    chosen = f"""CASE WHEN {half} = 0 THEN {_own_variant(first, bit)}
        ELSE bit_count({first}) > 1 AND {_own_variant(second, bit)} END"""

    def verified(members: DataFrame, keys: list[str], extra: str = "true") -> DataFrame:
        left = members.withColumnRenamed("fp", "a")
        right = members.withColumnRenamed("fp", "b")
        pairs = left.join(right, keys).where("a < b")
        return pairs.where(f"bit_count({differ}) <= {MAX_BITS} AND ({chosen}) AND ({extra})").select("a", "b")

    def finer(crowded: DataFrame, part: str, keys: list[str], width: int, level: int) -> DataFrame:
        """The crowd's rows under the variants of both `width`-bit pieces of `part`, what is not yet indexed of the fingerprint."""
        pieces = []
        for which in (0, 1):
            piece = crowded.withColumn("_q", F.shiftrightunsigned(F.expr(part), width * which).bitwiseAND((1 << width) - 1))
            piece = piece.select(*keys, "fp", F.lit(which).alias(f"piece{level}"), F.explode(_one_wildcard("_q", width)).alias("_v"))
            pieces.append(piece.select(*keys, "fp", f"piece{level}", F.expr(f"shiftleft(_v.bit, {width}) | _v.rest").alias(f"variant{level}")))
        return pieces[0].unionByName(pieces[1])

    def own(part: str, width: int, level: int) -> str:
        """SQL: of the variants that the pair shares in this part's pieces, this is the one that puts it out."""
        low, high = f"({part} & {(1 << width) - 1})", f"(shiftrightunsigned({part}, {width}) & {(1 << width) - 1})"
        bit = f"cast(shiftrightunsigned(variant{level}, {width}) as int)"
        return f"""CASE WHEN piece{level} = 0 THEN {_own_variant(low, bit)}
            ELSE bit_count({low}) > 1 AND {_own_variant(high, bit)} END"""

    # The rest of a crowded signature: the other half's quarters, then the other quarter's bytes.
    other = f"(CASE WHEN {half} = 0 THEN shiftrightunsigned({{0}}, 32) ELSE {{0}} & 4294967295L END)"
    last = f"(CASE WHEN piece1 = 0 THEN shiftrightunsigned({other}, 16) ELSE {other} & 65535L END)"
    first_keys = ["sig", "piece1", "variant1"]
    quarters = finer(shared.where("crowded").select("sig", "fp"), other.format("fp"), ["sig"], 16, 1)
    sizes = stored(quarters.groupBy(*first_keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "quarters")
    met = quarters.join(sizes, first_keys)
    octets = finer(met.where(F.col("n") > CROWDED).drop("n"), last.format("fp"), first_keys, 8, 2)
    by_quarter, by_octet = own(other.format(differ), 16, 1), own(last.format(differ), 8, 2)
    return (
        verified(plain, ["sig"])
        .unionByName(verified(met.where(F.col("n") <= CROWDED).drop("n"), first_keys, by_quarter))
        .unionByName(verified(octets, [*first_keys, "piece2", "variant2"], f"({by_quarter}) AND ({by_octet})"))
    )


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's fingerprint (16 hex digits) and component_id, the smallest id reachable by links.

    Rows link when their fingerprints differ in two bits or fewer, so equal texts
    always do. A text without words, null included, has fingerprint zero and links
    as any other. A row without id gets the component like any other but cannot name
    it; a component of such rows only has a null id. Repeated rows are all returned.
    Texts are hashed whole, in blocks of shingles. An empty table gives no rows.
    """
    prints = stored(fingerprints(docs, id_col=id_col, text_col=text_col), "fingerprints")
    return _with_components(prints).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def _classes(prints: DataFrame, *names: str) -> DataFrame:
    """(fp, component, *names) for the distinct fingerprints; `root` names the component even where no id does."""
    classes = stored(prints.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    roots = stored(component_roots(near_pairs(classes.select("fp"))), "roots")
    # Few classes link at all; each class's root and the smallest id under a root.
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return stored(rooted.join(named, "root").select("fp", "component", *names), "components")


def _with_components(prints: DataFrame) -> DataFrame:
    """(id, fp, component) for rows (id, fp)."""
    # A class of many copies is split by the skew join: one row on this side.
    return prints.join(_classes(prints), "fp").select("id", "fp", "component")


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, narrow in ((b, pa.RecordBatch.from_arrays(b.columns[:2], ["id", "text"])) for b in batches):
        done = next(_fingerprints(iter([narrow])))
        yield pa.RecordBatch.from_arrays([*done.columns, batch.column(2)], ["id", "fp", "mark"])


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component of near-duplicates, all columns kept: that with the smallest id, then text hash.

    A component keeps a row however its ids are shared: texts of one id that do not link are
    in components of their own. Rows without id come last in their component, so one stays
    only where no row has an id. Repeated rows leave one; null, empty and wordless
    texts have fingerprint zero and are one component. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    identity = (F.col(f"`{id_col}`").cast("long"), F.coalesce(F.md5(text.cast("binary")), F.lit("-")))
    narrow = docs.select(identity[0].alias("id"), text.alias("text"), identity[1].alias("mark"))
    prints = stored(narrow.mapInArrow(_marked, "id long, fp long, mark string"), "fingerprints")
    in_class = prints.join(_classes(prints, "root"), "fp")
    least = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "mark")).alias("least")
    kept = in_class.groupBy("root").agg(least).select(F.col("least.id").alias("_kept_id"), F.col("least.mark").alias("_kept_mark"))
    mine = (identity[0].eqNullSafe(F.col("_kept_id"))) & (identity[1] == F.col("_kept_mark"))
    named = docs.join(kept.hint("shuffle_hash"), mine, "left_semi")
    # What is left over are repeats of the kept rows: the first of each, merged before they meet.
    row = F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row")
    return named.groupBy(identity[0].alias("_id"), identity[1].alias("_mark")).agg(row).select("row.*")
