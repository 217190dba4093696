"""Merkle manifest of a dataset as a persistent tree (operator 11).

Each row is a leaf; per group (lang) the leaves ascend by doc_id, and every FAN nodes in a row become one, until one is
left, the group's subroot. The subroots, by group, become the root in the same way.

The tree is built in aligned blocks of FAN ** LEVELS nodes: a block is one row of a table, and its own root is a node of the
next tier, which is cut into blocks again until a tier has one. So no task holds more than a block, whatever a group's size,
and texts don't move: only their digests do.

Within a block the tree is persistent. A changed leaf makes a version: its ancestors are copied, all other nodes are shared
with the tree as it was. Above the block the version goes on along the path that came down to the block, tier by tier, as the
siblings of its root on every level.

Defined cases: fields that are null hash as `-`; a null doc_id comes before the others of its group and isn't tampered
with, a null group before the other groups; rows that share a doc_id ascend by their digest, so equal rows give the same set
of results in any order; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import scan
from colloquy.operators.joins import sized_join

from .common import frugal, read_table, written

FAN = 8
LEVELS = 3  # of a block, so that it has 512 nodes
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(parts: list[bytes]) -> bytes:
    """SHA-256 of digests that are put one behind another as hexadecimal text."""
    return hashlib.sha256(b"".join(parts).hex().encode()).digest()


class Tree:
    """Nodes of a block: their digests, and the children of each. A node never changes; versions share what they have in common."""

    def __init__(self, leaves: list[bytes], levels: int, total: int):
        """A block that is all of its group's `total` nodes ends where one node is left, any other has `levels` levels."""
        whole = total <= FAN**levels
        self.digests, self.children = list(leaves), [()] * len(leaves)
        self.levels = [list(range(len(leaves)))]
        while len(self.levels) <= levels and not (whole and len(self.levels[-1]) == 1):
            below = self.levels[-1]
            self.levels.append([self.add(tuple(below[k : k + FAN])) for k in range(0, len(below), FAN)])
        self.root = self.levels[-1][0]

    def add(self, children: tuple[int, ...]) -> int:
        self.digests.append(digest([self.digests[c] for c in children]))
        self.children.append(children)
        return len(self.digests) - 1

    def siblings(self, at: int) -> list[list[bytes]]:
        """Of a leaf, level by level: what is before it in its run, and what is after it."""
        out = []
        for below in self.levels[:-1]:
            begin = at - at % FAN
            run = below[begin : begin + FAN]
            out.append([[self.digests[x] for x in run[: at - begin]], [self.digests[x] for x in run[at - begin + 1 :]]])
            at //= FAN
        return out

    def version(self, at: int, leaf: bytes) -> tuple[int, int]:
        """Root of the tree in which a leaf is changed, and the first of the nodes that were made for it. Only ancestors are copied."""
        first = len(self.digests)
        self.digests.append(leaf)
        self.children.append(())
        new = first
        for above in self.levels[1:]:
            old = self.children[above[at // FAN]]
            new = self.add((*old[: at % FAN], new, *old[at % FAN + 1 :]))
            at //= FAN
        return new, first

    def forget(self, first: int) -> None:
        """Drop a version whose results have been taken."""
        del self.digests[first:], self.children[first:]


#: A path as bytes: for each level the number of digests before and after, then the digests.
def as_path(levels: list[list[list[bytes]]]) -> bytes:
    return b"".join(bytes([len(before), len(after)]) + b"".join(before) + b"".join(after) for before, after in levels)


def as_levels(path: bytes) -> list[list[list[bytes]]]:
    out, k = [], 0
    while k < len(path):
        a, b = path[k], path[k + 1]
        found = [path[k + 2 + 32 * i : k + 34 + 32 * i] for i in range(a + b)]
        out.append([found[:a], found[a:]])
        k += 2 + 32 * (a + b)
    return out


def folded(node: bytes, levels: list[list[list[bytes]]]) -> bytes:
    """The root above a node, from its siblings."""
    return reduce(lambda x, level: digest([*level[0], x, *level[1]]), levels, node)


def field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    """Digest of a row with this text."""
    return F.unhex(F.sha2(F.concat(*[field(text if c == "text" else F.col(c)) for c in FIELDS]), 256))


def tampered() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))


def leaves(docs: DataFrame, group: str = "lang", order: str = "doc_id") -> DataFrame:
    """key, item, node, changed (null where nothing was done to the row) of each row."""
    key = F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit(""))  # the least of all is null's
    lower = F.translate("text", UPPER, UPPER.lower())
    return docs.select(key.alias("key"), F.col(order).cast("long").alias("item"), leaf(F.col("text")).alias("node"), F.when(tampered(), leaf(lower)).alias("changed"))


def unchanged() -> Column:
    return F.lit(None).cast("binary").alias("changed")


def packed(rows: DataFrame, levels: int) -> DataFrame:
    """key, block, total, nodes in order, of rows with key, total (nodes of the key), no (0, 1, ... in the key), item, node, changed."""
    block = F.floor(F.col("no") / FAN**levels).alias("block")
    return written(rows.groupBy("key", "total", block).agg(F.array_sort(F.collect_list(F.struct("no", "item", "node", "changed"))).alias("nodes")), "blocks")


def blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """Blocks of key, item, node, changed; ordered by key, item and node."""
    rows = scan.numbered(scan.in_order(nodes, ["key", "item", "node"], "nodes"), "no")
    begins = written(rows.groupBy("key").agg(F.min("no").alias("begin"), F.count("*").alias("total")), "groups")
    return packed(sized_join(rows, begins, ["key"], "inner").withColumn("no", F.col("no") - F.col("begin")), levels)


def roots(tier: DataFrame, levels: int) -> DataFrame:
    """key, item (the block's number), node (its root), total of each block."""

    @frugal
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            trees = [Tree(nodes.values.field("node").to_pylist(), levels, total) for total, nodes in zip(b.column(2).to_pylist(), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([t.digests[t.root] for t in trees], pa.binary()), b.column(2)], ["key", "item", "node", "total"])

    return written(tier.select("key", "block", "total", "nodes").mapInArrow(per_batch, "key string, item long, node binary, total long"), "roots")


def tiers(first: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """All tiers of blocks, from below, and key, node of the node that is left of each key. Keys that are done have no blocks in later tiers."""
    size, out, done, most = FAN**levels, [first], None, first.agg(F.max("total")).first()[0] or 0
    while True:
        top = roots(out[-1], levels)
        ended = top.filter(F.col("total") <= size).select("key", "node")
        done = ended if done is None else done.unionByName(ended)
        if most <= size:
            return out, done
        most = -(-most // size)
        more = top.filter(F.col("total") > size).select("key", F.ceil(F.col("total") / size).alias("total"), F.col("item").alias("no"), "item", "node", unchanged())
        out.append(packed(more, levels))


def paths_down(tier: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """key, block, path of the blocks of the tier below. above: key, block, path of this tier's blocks."""

    @frugal
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, total, nodes, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                tree = Tree(nodes.values.field("node").to_pylist(), levels, total)
                rows = [(key, item, as_path(tree.siblings(k)) + path) for k, item in enumerate(nodes.values.field("item").to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.binary()))], ["key", "block", "path"])

    got = sized_join(tier, above, ["key", "block"], "inner").select("key", "total", "nodes", "path")
    return written(got.mapInArrow(per_batch, "key string, block long, path binary"), "paths")


def proved(tier: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """doc_id, leaf, subroot, root, proof (siblings of all levels, one behind another), copied (ancestors in the leaf's version, up to its
    block's root), folded_root. above: key, block, subroot, root, path."""

    @frugal
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for total, nodes, path, subroot, root in zip(*(b.column(k) for k in range(5)), strict=True):
                found, upper = nodes.values, path.as_py()
                whole, tree = as_levels(upper), Tree(found.field("node").to_pylist(), levels, total.as_py())
                rows = []
                for k, (item, node, changed) in enumerate(zip(found.field("item").to_pylist(), found.field("node").to_pylist(), found.field("changed").to_pylist(), strict=True)):
                    inside = tree.siblings(k)
                    version, first = tree.version(k, node if changed is None else changed)
                    copied = b"".join(tree.digests[first + 1 :])
                    rows.append((item, node, b"".join(x for level in [*inside, *whole] for side in level for x in side), copied, folded(tree.digests[version], whole)))
                    tree.forget(first)
                cols = list(zip(*rows, strict=True))
                n = len(rows)
                arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array([subroot.as_py()] * n, pa.binary()), pa.array([root.as_py()] * n, pa.binary()), *(pa.array(c, pa.binary()) for c in cols[2:])]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "leaf", "subroot", "root", "proof", "copied", "folded_root"])

    got = sized_join(tier, above, ["key", "block"], "inner").select("total", "nodes", "path", "subroot", "root")
    return got.mapInArrow(per_batch, "doc_id long, leaf binary, subroot binary, root binary, proof binary, copied binary, folded_root binary")


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """One row per document: what `proved` gives, digests as bytes. levels: of a block."""
    size = FAN**levels
    low, subroots = tiers(blocks(written(leaves(docs), "leaves"), levels), levels)
    # The subroots, in the order of their keys, are the leaves of a tree of their own.
    names = scan.in_order(subroots, ["key"], "subroots")
    n = names.count()
    names = scan.numbered(names, "item").select("key", "item", "node")
    high, root = tiers(packed(names.select(F.lit("").alias("key"), F.lit(n).cast("long").alias("total"), F.col("item").alias("no"), "item", "node", unchanged()), levels), levels)
    above = written(high[-1].select("key", "block", F.unhex(F.lit("")).alias("path")), "paths")
    for tier in reversed(high):
        above = paths_down(tier, above, levels)
    # `above` has a path for each subroot now, by its number.
    tops = names.join(above.select(F.col("block").alias("item"), "path"), "item").select("key", F.col("node").alias("subroot"), "path")
    whole = root.first()
    tops = written(tops.withColumn("root", F.lit(whole.node if whole else None).cast("binary")), "tops")
    above = None
    for tier in reversed(low):
        new = tier.filter(F.col("total") <= size).select("key", "block").join(tops.select("key", "path"), "key")  # keys whose topmost tier this is
        above = new if above is None else above.unionByName(new)
        if tier is not low[0]:
            above = paths_down(tier, written(above, "paths"), levels)
    return proved(low[0], written(above.join(tops.select("key", "subroot", "root"), "key"), "above"), levels)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest(read_table(spark, sf_dir, "documents"))
    text = lambda c: F.lower(F.hex(c))
    return rows.select("doc_id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"), F.sha2(text("proof").cast("binary"), 256).alias("proof_sha256"), text("folded_root").alias("folded_root"), (F.col("folded_root") == F.col("root")).alias("verified"))


_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(text if c == "text" else c) for c in FIELDS) + ")"


#: Both trees by recursion over their levels. The CRC-32 of a number's decimal text goes bit by bit: a byte is added, then eight bits leave.
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
   lambda a, b: xor(xor(a, b) >> 1, CASE WHEN xor(a, b) % 2 = 1 THEN 3988292384::BIGINT ELSE 0 END))"""
ORACLE_SQL = f"""
WITH RECURSIVE
 d AS MATERIALIZED (SELECT doc_id, coalesce('=' || lang, '') AS key, {_leaf("text")} AS leaf, {_leaf(f"translate(text, '{UPPER}', '{UPPER.lower()}')")} AS low, coalesce(xor({_CRC}, 4294967295) % 3 = 0, false) AS hit FROM documents),
 n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY key) AS total FROM d),
 tree AS (SELECT key, 0 AS lev, i, leaf AS h, total FROM n
   UNION ALL SELECT key, lev + 1, i // {FAN}, sha256(string_agg(h, '' ORDER BY i)), any_value((total + {FAN - 1}) // {FAN}) FROM tree WHERE total > 1 GROUP BY key, lev, i // {FAN}),
 runs AS MATERIALIZED (SELECT key, lev, i // {FAN} AS j, list(h ORDER BY i) AS hs FROM tree WHERE total > 1 GROUP BY ALL),
 sub AS MATERIALIZED (SELECT key, h, row_number() OVER (ORDER BY key) - 1 AS i, count(*) OVER () AS total FROM tree WHERE total = 1),
 top AS (SELECT 0 AS lev, i, h, total FROM sub
   UNION ALL SELECT lev + 1, i // {FAN}, sha256(string_agg(h, '' ORDER BY i)), any_value((total + {FAN - 1}) // {FAN}) FROM top WHERE total > 1 GROUP BY lev, i // {FAN}),
 high AS MATERIALIZED (SELECT lev, i // {FAN} AS j, list(h ORDER BY i) AS hs FROM top WHERE total > 1 GROUP BY ALL),
 walk AS (SELECT doc_id, key, leaf, 0 AS lev, i, CASE WHEN hit THEN low ELSE leaf END AS x, '' AS proof FROM n
   UNION ALL SELECT doc_id, key, leaf, lev + 1, i // {FAN}, sha256(array_to_string(hs[1:i % {FAN}], '') || x || array_to_string(hs[i % {FAN} + 2:], '')), proof || array_to_string(hs[1:i % {FAN}], '') || array_to_string(hs[i % {FAN} + 2:], '')
   FROM walk JOIN runs USING (key, lev) WHERE runs.j = walk.i // {FAN}),
 upper AS (SELECT doc_id, key, leaf, sub.h AS subroot, 0 AS lev, sub.i, x, proof FROM walk JOIN (SELECT key, max(lev) AS lev FROM tree GROUP BY key) USING (key, lev) JOIN sub USING (key)
   UNION ALL SELECT doc_id, key, leaf, subroot, lev + 1, i // {FAN}, sha256(array_to_string(hs[1:i % {FAN}], '') || x || array_to_string(hs[i % {FAN} + 2:], '')), proof || array_to_string(hs[1:i % {FAN}], '') || array_to_string(hs[i % {FAN} + 2:], '')
   FROM upper JOIN high USING (lev) WHERE high.j = upper.i // {FAN}),
 r AS (SELECT max(lev) AS lev, max_by(h, lev) AS root FROM top)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, x AS folded_root, x = root AS verified FROM upper JOIN r USING (lev)
"""
