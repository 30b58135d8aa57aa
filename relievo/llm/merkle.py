"""A Merkle manifest of a dataset, with a proof for every row, by fractal traversal.

Rows are leaves.  A source is a ternary tree over its leaves, by doc_id; the roots of the
sources are the leaves of one more tree.  A digest is the lower-case hex SHA-256 of digests
in hex, concatenated.

A tree is cut into aligned blocks of ``3 ** BLOCK`` nodes.  Each block is a small group of
its own, so a source that holds a third of all rows is only many blocks.  Inside a block the
paths of successive leaves are emitted by fractal traversal: the block's height is cut into
bands of ``BAND`` levels; each band keeps the subtree over the present leaf, and grows the
next one by a leaf a step, so that it is complete when the traversal gets there.  The roots of
blocks are the nodes of the next, ``3 ** BLOCK`` times smaller tier, and so on to the root;
the upper parts of the proofs are appended to the lower ones tier by tier, from the top.

Positions in a source come from one range shuffle: rows are sorted by source and doc_id over
all tasks, and each task's rows are numbered from counts per task and source.

Defined cases: a null field is hashed as ``-``; a null source is a source of its own, first in
order; null doc_ids come first in their source, ties of doc_id are ordered by leaf; rows that
repeat are each a leaf; a row with a null doc_id is never tampered with; an empty table gives
an empty result; texts of any length are hashed whole; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from relievo.llm.common import cut, small

ARITY = 3
#: Height of a block, and of the bands that it is cut into.
BLOCK, BAND = 6, 2
_NODE = "g string, idx long, n long, digest binary"


def digest_of(run: list[bytes]) -> bytes:
    """The parent of a run of nodes: the SHA-256 of their hex digests."""
    return hashlib.sha256(b"".join(run).hex().encode()).digest()


def height_of(n: int) -> int:
    """Levels over ``n`` nodes until one is left."""
    top = 0
    while n > 1:
        n, top = -(-n // ARITY), top + 1
    return top


class Subtree:
    """Grows leaf by leaf; keeps its nodes of heights ``low`` to ``high`` - 1, and below that only unfinished runs."""

    def __init__(self, low: int, high: int):
        self.low, self.high, self.root = low, high, None
        self.open: list[list[bytes]] = [[] for _ in range(high)]
        self.nodes: list[list[bytes]] = [[] for _ in range(high - low)]

    def _put(self, height: int, digest: bytes) -> None:
        if height == self.high:
            self.root = digest
            return
        if height >= self.low:
            self.nodes[height - self.low].append(digest)
        self.open[height].append(digest)

    def add(self, leaf: bytes) -> None:
        height, digest = 0, leaf
        self._put(height, digest)
        while height < self.high and len(self.open[height]) == ARITY:
            digest = digest_of(self.open[height])
            self.open[height].clear()
            height += 1
            self._put(height, digest)

    def close(self) -> None:
        """No more leaves: runs that are not full become nodes too."""
        for height, run in enumerate(self.open):
            if run:
                digest = digest_of(run)
                run.clear()
                self._put(height + 1, digest)


def traversal(leaves: list[bytes], top: int, band: int = BAND) -> Iterator[list[tuple[int, list[bytes]]]]:
    """For each leaf in turn its path of ``top`` levels: place in the run and the run's other nodes."""
    spans = [(low, min(low + band, top)) for low in range(0, top, band)]
    existing, desired = [Subtree(*s) for s in spans], [Subtree(*s) for s in spans]
    for tree in existing:
        for leaf in leaves[: ARITY**tree.high]:
            tree.add(leaf)
        tree.close()
    for i in range(len(leaves)):
        for k, (low, high) in enumerate(spans):
            size = ARITY**high
            if i and i % size == 0:  # what was desired exists from here on
                desired[k].close()
                existing[k], desired[k] = desired[k], Subtree(low, high)
            if i + size < len(leaves):
                desired[k].add(leaves[i + size])
        path = []
        for tree in existing:
            first = i // ARITY**tree.high
            for height in range(tree.low, tree.high):
                at = i // ARITY**height - first * ARITY ** (tree.high - height)
                start = at - at % ARITY
                run = tree.nodes[height - tree.low][start : start + ARITY]
                path.append((at - start, run[: at - start] + run[at - start + 1 :]))
        yield path


def root_of(leaves: list[bytes], top: int) -> bytes:
    if not top:
        return leaves[0]
    tree = Subtree(top, top)
    for leaf in leaves:
        tree.add(leaf)
    tree.close()
    return tree.root


def packed(path: list[tuple[int, list[bytes]]]) -> bytes:
    """A level is its place, how many siblings it has, and their digests."""
    return b"".join(bytes((place, len(others))) + b"".join(others) for place, others in path)


def folded(digest: bytes, path: bytes) -> tuple[bytes, bytes]:
    """The root that a leaf and its packed path lead to, and the hex of all siblings."""
    at, siblings = 0, []
    while at < len(path):
        place, many = path[at], path[at + 1]
        others = [path[k : k + 32] for k in range(at + 2, at + 2 + 32 * many, 32)]
        siblings += others
        digest = digest_of([*others[:place], digest, *others[place:]])
        at += 2 + 32 * many
    return digest, b"".join(siblings).hex().encode()


def _blocks(block: int):
    """The nodes of a block with their paths, and a row without a path for the block's own node."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        g, n, idx, leaves = table["g"][0].as_py(), table["n"][0].as_py(), table["idx"].to_pylist(), table["digest"].to_pylist()
        size = ARITY**block
        top = height_of(n) if n <= size else block
        paths = [packed(p) for p in traversal(leaves, top)] if top else [b""] * len(leaves)
        rows = [*zip(idx, [n] * len(idx), leaves, paths, strict=True), (idx[0] // size, -(-n // size), root_of(leaves, top), None)]
        kinds = {"idx": pa.int64(), "n": pa.int64(), "digest": pa.binary(), "path": pa.binary()}
        columns = zip(kinds.items(), zip(*rows, strict=True), strict=True)
        return pa.table({"g": pa.array([g] * len(rows), pa.string()), **{c: pa.array(v, kind) for (c, kind), v in columns}})

    return run


def authenticated(nodes: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(g, idx, path) of all nodes (g, idx, n, digest), and (g, root).  ``idx`` counts from 0 in a tree ``g`` of ``n`` nodes."""
    tiers, roots = [], []
    above = (F.col("idx") / ARITY**block).cast("long")
    while True:
        made = cut(nodes.groupBy("g", above.alias("block")).applyInArrow(_blocks(block), f"{_NODE}, path binary"))
        tiers.append(made.where("path IS NOT NULL").select("g", "idx", "path"))
        tops = made.where("path IS NULL").select("g", "idx", "n", "digest")
        roots.append(tops.where("n = 1").select("g", F.col("digest").alias("root")))
        nodes = tops.where("n > 1")
        if nodes.isEmpty():
            break
    paths = tiers[-1]
    for tier in reversed(tiers[:-1]):
        upper = cut(paths.select(F.col("g").alias("u_g"), F.col("idx").alias("u_idx"), F.col("path").alias("upper")))
        met = tier.join(small(upper, 1 << 12), (F.col("g") == F.col("u_g")) & (above == F.col("u_idx")), "left")
        paths = met.select("g", "idx", F.concat("path", F.coalesce("upper", F.lit(b""))).alias("path"))
    for more in roots[1:]:
        roots[0] = roots[0].union(more)
    return paths, roots[0]


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``idx``, the place in its ``g`` by ``order``, and ``n``, the rows of ``g``.

    The windows run over a row per task and ``g``, not over rows.
    """
    dealt = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    dealt = cut(dealt.withColumn("part", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id()))
    by = Window.partitionBy("g")
    counts = dealt.groupBy("g", "part").agg(F.count("*").alias("many"), F.min("pos").alias("first"))
    before = F.coalesce(F.sum("many").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = cut(counts.select(F.col("g").alias("c_g"), F.col("part").alias("c_part"), (before - F.col("first")).alias("shift"), F.sum("many").over(by).alias("n")))
    met = dealt.join(small(counts, 96), (F.col("g") == F.col("c_g")) & (F.col("part") == F.col("c_part")))
    return met.withColumn("idx", F.col("pos") + F.col("shift")).drop("part", "pos", "shift", "c_g", "c_part")


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(text: Column) -> Column:
    """The digest of a row with this text, as bytes."""
    return F.unhex(F.sha2(F.concat(*[_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], _field(text)), 256))


def _proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roots, proofs = [], []
        for leaf, path in zip(batch.column("tested").to_pylist(), batch.column("path").to_pylist(), strict=True):
            root, siblings = folded(leaf, path)
            roots.append(root)
            proofs.append(hashlib.sha256(siblings).hexdigest())
        kept = [batch.column(c) for c in ("doc_id", "leaf", "subroot", "root", "path")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(proofs, pa.string()), pa.array(roots, pa.binary())], ["doc_id", "leaf", "subroot", "root", "path", "proof_sha256", "folded_root"])


def manifest(docs: DataFrame, tampered: Column | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, leaf, subroot, root, path (packed), proof_sha256, folded_root, verified: one row per row of ``docs``.

    Digests are bytes, but for ``proof_sha256``.  ``tampered`` is the text that is held against
    the proof; without it that is the text itself, and every row is verified.
    """
    text = F.col("text")
    g = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    leaves = docs.select("doc_id", g.alias("g"), leaf_of(text).alias("digest"), (leaf_of(text) if tampered is None else leaf_of(tampered)).alias("tested"))
    leaves = cut(numbered(leaves, "doc_id", "digest"))
    paths, subroots = authenticated(leaves.select("g", "idx", "n", "digest"), block)
    subroots = cut(subroots)
    sources = cut(numbered(subroots.select(F.lit("").alias("g"), F.col("g").alias("s_g"), F.col("root").alias("digest")), "s_g"))
    tops, root = authenticated(sources.select("g", "idx", "n", "digest"), block)
    tops = sources.join(tops.select(F.col("idx").alias("t_idx"), "path"), F.col("idx") == F.col("t_idx"))
    tops = tops.join(F.broadcast(root.select(F.col("g").alias("r_g"), "root")), F.col("g") == F.col("r_g"))  # one row
    tops = cut(tops.select("s_g", F.col("digest").alias("subroot"), "root", F.col("path").alias("upper")))
    met = leaves.join(paths.select(F.col("g").alias("p_g"), F.col("idx").alias("p_idx"), "path"), (F.col("g") == F.col("p_g")) & (F.col("idx") == F.col("p_idx")))
    met = met.join(small(tops, 1 << 11), F.col("g") == F.col("s_g"))
    met = met.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.concat("path", "upper").alias("path"), "tested")
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = met.mapInArrow(_proved, f"doc_id {kind}, leaf binary, subroot binary, root binary, path binary, proof_sha256 string, folded_root binary")
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def without_newlines() -> Column:
    """The text without newlines where 2 divides the CRC-32 of the decimal doc_id, else the text."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
