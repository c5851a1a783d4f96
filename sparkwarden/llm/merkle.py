"""Merkle manifest of a dataset, with a proof for every row, by incremental witnesses.

A row's leaf is the hash of its fields. Leaves of a source ascend by id; every
`ARITY` consecutive nodes become one, and so on up to the source's subroot; the
subroots make the root in the same way.

Leaves are appended one after another to a frontier of open subtrees. An open subtree
carries the partial witness of all leaves below it: each later sibling that completes
extends it, and when a run of siblings closes, its nodes become one open subtree of the
next level. Leaves come in aligned blocks of ``ARITY ** HEIGHT``, appended independently; the root
of a block is a further append, to the frontier of the next round of blocks, and the
subroots are appended likewise. Proofs go down the same way: the witness of a block's
root is what each of its leaves still lacks. A task holds a block at a time, whatever
the size of a source.

Global order takes a sort by range and running counts over its partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import placed
from .tables import small_batches, stored

ARITY = 3

# Levels of a block: 3^6 = 729 leaves, some 100 KB, go through a frontier at once.
HEIGHT = 6

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def joined_hash(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def field_text(value: Column) -> Column:
    """A field as it enters the leaf: ``-`` if null, else the UTF-8 length, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field_text(f) for f in fields]).cast("binary"), 256)


class Frontier:
    """Open subtrees of one tree, with the witnesses of the leaves appended so far.

    A witness is a list of steps from the leaf up; a step is the digests before and
    after the node among its siblings, each side as one text.
    """

    def __init__(self, arity: int = ARITY):
        self.arity = arity
        self.witnesses: list[list[tuple[str, str]]] = []
        # By level: [digest, first leaf, stop, digests before, digests after] of the run that is open there.
        self.open: list[list[list]] = []

    def append(self, digest: str) -> None:
        leaf = len(self.witnesses)
        self.witnesses.append([])
        self._complete(0, digest, leaf, leaf + 1)

    def _complete(self, level: int, digest: str, first: int, stop: int) -> None:
        """A subtree of this level is complete: it extends its siblings' witnesses and closes a full run."""
        if level == len(self.open):
            self.open.append([])
        run = self.open[level]
        before = "".join(node[0] for node in run)
        for node in run:
            node[4] += digest
        run.append([digest, first, stop, before, ""])
        if len(run) == self.arity:
            self._close(level)

    def _close(self, level: int) -> None:
        """The nodes of a run become one; their partial witnesses pass to the leaves below."""
        run, self.open[level] = self.open[level], []
        for _, first, stop, before, after in run:
            for leaf in range(first, stop):
                self.witnesses[leaf].append((before, after))
        self._complete(level + 1, joined_hash(*(node[0] for node in run)), run[0][1], run[-1][2])

    def finished(self, height: int | None = None) -> str:
        """The root, after the last append: short runs close too, level by level, to one node or to the given height."""
        level = 0
        while level < len(self.open):
            alone = len(self.open[level]) == 1 and not any(self.open[level + 1 :])
            if self.open[level] and not (alone and (height is None or level == height)):
                self._close(level)
            level += 1
        return next(run[0][0] for run in self.open if run)


def _blocks(nodes: DataFrame, height: int, purpose: str) -> DataFrame:
    """(tree, block, total, whole, nodes): consecutive nodes of a tree by place, with all their columns."""
    size = ARITY**height
    node = F.struct("place", *[c for c in nodes.columns if c not in ("tree", "place", "total")])
    blocks = nodes.groupBy("tree", F.expr(f"place div {size}").alias("block")).agg(
        F.max("total").alias("total"), F.array_sort(F.collect_list(node)).alias("nodes")
    )
    return stored(blocks.withColumn("whole", F.col("total") <= size), purpose)


def _filled(digests: Sequence[str], whole: bool, height: int) -> tuple[Frontier, str]:
    """A block's frontier and root. A part of a larger tree is raised to the block's height, however short it is."""
    frontier = Frontier()
    for digest in digests:
        frontier.append(digest)
    return frontier, frontier.finished(None if whole else height)


def _roots(blocks: DataFrame, height: int, purpose: str) -> DataFrame:
    """(tree, place, total, digest): the blocks' roots, the nodes of the next round."""

    def append(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = [_filled(d, w, height)[1] for w, d in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            columns = [*batch.columns[:3], pa.array(roots, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["tree", "place", "total", "digest"])

    above = F.expr(f"(total + {ARITY**height - 1}) div {ARITY**height}")
    narrow = blocks.select("tree", "block", above, "whole", F.col("nodes.digest"))
    return stored(narrow.mapInArrow(append, "tree string, place long, total long, digest string"), purpose)


def _witnessed(blocks: DataFrame, upper: DataFrame, height: int) -> DataFrame:
    """Every node's columns with its whole witness (before, after) and what else `upper` has.

    `upper` has the witness (tree, block, whole, before, after) of each block's root.
    """
    met = blocks.join(upper, ["tree", "block", "whole"]).withColumn("digests", F.col("nodes.digest"))
    carried = [c for c in met.columns if c not in ("block", "total", "whole", "digests", "before", "after")]
    used = met.select(*carried, "whole", "digests", "before", "after")
    steps = "array<array<string>>"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in used.select(*carried).schema)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.list_(pa.string()))
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                whole, digests, before, after = (one.column(name)[0].as_py() for name in ("whole", "digests", "before", "after"))
                witnesses = _filled(digests, whole, height)[0].witnesses
                columns = [
                    *one.columns[: len(carried)],
                    pa.array([[[b for b, _ in w] + before for w in witnesses]], kind),
                    pa.array([[[a for _, a in w] + after for w in witnesses]], kind),
                ]
                yield pa.RecordBatch.from_arrays(columns, [*carried, "befores", "afters"])

    extended = used.mapInArrow(extend, f"{schema}, befores {steps}, afters {steps}")
    one_each = extended.select(*[c for c in carried if c != "nodes"], F.explode(F.arrays_zip("nodes", "befores", "afters")).alias("_n"))
    return one_each.select(*[c for c in carried if c != "nodes"], "_n.nodes.*", F.col("_n.befores").alias("before"), F.col("_n.afters").alias("after"))


class _Forest:
    """Trees over placed nodes, in rounds of blocks; a round's roots are the nodes of the next one."""

    def __init__(self, nodes: DataFrame, height: int, purpose: str):
        self.height, self.rounds = height, []
        roots = None
        while True:
            blocks = _blocks(nodes, height, f"{purpose}-blocks")
            self.rounds.append(blocks)
            made = _roots(blocks, height, f"{purpose}-roots")
            ended = made.where("total = 1").select("tree", "digest")
            roots = ended if roots is None else roots.unionByName(ended)
            nodes = made.where("total > 1")
            if nodes.isEmpty():
                break
        self.roots = roots

    def witnessed(self, tops: DataFrame) -> DataFrame:
        """The first round's nodes with their witnesses; `tops` has (tree, before, after, ...) for each tree's root."""
        whole = tops.select("*", F.lit(0).cast("long").alias("block"), F.lit(True).alias("whole"))
        upper = whole
        for k, blocks in reversed(list(enumerate(self.rounds))):
            nodes = _witnessed(blocks, upper, self.height)
            if k:
                below = nodes.drop("digest", "total").withColumnRenamed("place", "block").withColumn("whole", F.lit(False))
                upper = stored(below.unionByName(whole), "witnesses")
        return nodes


def proofs(
    docs: DataFrame,
    *,
    fields: Sequence[str] = FIELDS,
    id_col: str = "doc_id",
    source_col: str = "source",
    carried: dict[str, Column] | None = None,
    height: int = HEIGHT,
) -> DataFrame:
    """(id, source, place, leaf, before, after, subroot, root) for every row, and the columns `carried` computes from it.

    `before` and `after` are the proof: for each level from the leaf up the digests of
    the node's siblings to its left and to its right, each as one text; see `folded`
    and `proof_hash`. Leaves of a source stand by id, rows without id first, rows of
    one id by their leaf; equal rows have places of their own. A null source is a
    source of its own and the first one. Null fields have a form of their own in the
    leaf, unlike empty texts; texts are hashed whole. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    column = {c: F.col(f"`{c}`") for c in (*fields, id_col, source_col)}
    carried = carried or {}
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), column[source_col].cast("string")), F.lit("")).alias("tree"),
        column[id_col].alias("_id"),
        leaf_hash([column[f] for f in fields]).alias("digest"),
        *[value.alias(f"_c{k}") for k, value in enumerate(carried.values())],
    )
    leaves = stored(leaves, "leaves")
    by_source = _Forest(placed(leaves, ["_id", "digest"], "ordered"), height, "source")
    subroots = by_source.roots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), "digest")
    over_sources = _Forest(placed(subroots, ["key"], "subroots"), height, "sources")
    nothing = F.array().cast("array<string>")
    top = over_sources.roots.select("tree", nothing.alias("before"), nothing.alias("after"), F.col("digest").alias("root"))
    tops = over_sources.witnessed(top).select(F.col("key").alias("tree"), "before", "after", F.col("digest").alias("subroot"), "root")
    rows = by_source.witnessed(stored(tops, "sources"))
    return rows.select(
        F.col("_id").alias(id_col),
        F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30)).alias(source_col),
        "place",
        F.col("digest").alias("leaf"),
        *[F.col(f"_c{k}").alias(name) for k, name in enumerate(carried)],
        "before",
        "after",
        "subroot",
        "root",
    )


def folded(leaf: Column, before: Column, after: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    steps = F.arrays_zip(before.alias("before"), after.alias("after"))
    return F.aggregate(steps, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]).cast("binary"), 256))


def proof_hash(before: Column, after: Column) -> Column:
    """One hash over all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.zip_with(before, after, lambda b, a: F.concat(b, a)), "").cast("binary"), 256)


def verified_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): each row against the manifest after tampering.

    Rows whose id has an even checksum come back without the line ends of their texts;
    a proof fails where that changed the leaf. Rows without id are never tampered with.
    """
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    claimed = leaf_hash([text if f == "text" else F.col(f) for f in FIELDS])
    proven = proofs(docs, carried={"claimed": claimed})
    rows = proven.withColumn("folded_root", folded(F.col("claimed"), F.col("before"), F.col("after")))
    return rows.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        proof_hash(F.col("before"), F.col("after")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
