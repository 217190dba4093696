"""Near-duplicates by a chosen-path similarity join (operator 9).

A document is the set of its word shingles; documents link when 100 * common >= SIMILAR * all shingles of both, and
one of each group of linked documents stays. Equal sets are one class. In each of TREES independent trees a class
walks from the root: at every node one or two places of its MinHash signature are chosen by the node's own random
bits (1.25 on average, the inverse of the similarity), and the tokens there name the children. After FIRST_STEPS steps
nodes of one member end, and of nodes with equal members one stays. Nodes of more than MEMBERS members walk on (1.5
places a node) while that makes their pairs fewer.

A node is compared exhaustively in units of about MEMBERS members. First by signature: two members of different
groups may link if their sizes allow it and AGREE of their PLACES agree. Members that such pairs join are a cluster;
equal clusters of several nodes are one. Then on the full sets: each cluster's pairs are counted exactly, and what
comes out is each member's least linked member, so rows grow with members, not with pairs. A node of several units is
dealt anew once the groups within units are known: blocks of one large group, and blocks of the rest; all pairs of
blocks are compared but those of one and the same group. So no size is a cap.

What can be lost: pairs that meet in no node, and those whose signatures agree too little; `recall` computes the
probability of both. Nothing else does: links are confirmed on sets of 64-bit shingle hashes.

Groups come from links by rounds of taking the least neighbour and jumping to its least; only classes
with links take part, nothing is gathered on the driver.

Defined cases: null and empty texts have an empty set, are linked with nothing and stay; fewer words than a shingle
make one of all; rows that share a doc_id are each compared by their own text; a row without doc_id has no group and
stays; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators.joins import few, sized_join

from .common import frugal, read_table, salted_left_join, text_of, written
from .words import U, factors, in_slices, mixed, word_hashes

SIMILAR = 80  # percent
RECALL = 0.9995  # of pairs at the least similarity, after FIRST_STEPS steps
PLACES = 64  # of a signature
FIRST_STEPS, FIRST_TWICE = 4, 4  # one node in FIRST_TWICE branches twice
MORE_STEPS, MORE_TWICE = 16, 2
MEMBERS = 1024  # of a unit
AGREE = 32  # places, at least, of a pair that is compared on its sets
PAIRS = 50_000  # looked at in one go
SHARED = 1024  # shingles counted in one go
STEP_KEYS = 100_000  # that walk on in one go
SEND_BYTES = 2 << 20  # of sets in one batch


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order within each text, and the text each is in."""
    words, text = word_hashes(texts)
    count = np.bincount(text, minlength=len(texts))
    h = words.copy()
    for k in range(1, n):
        ahead = np.append(words[k:], np.zeros(min(k, len(words)), U))[: len(words)]
        inside = np.append(text[k:], np.full(min(k, len(text)), -1))[: len(text)] == text
        h = np.where(inside, mixed(h * U(0x9E3779B97F4A7C15) + ahead), h)
    first = np.cumsum(count) - count
    rank = np.arange(len(words)) - first[text]
    keep = rank <= np.maximum(count[text] - n, 0)  # starts of whole shingles, or the first word of a short text
    h, text = mixed(h[keep] + np.minimum(count, n)[text[keep]].astype(U)), text[keep]
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.append(True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])) if len(h) else np.zeros(0, bool)
    return h[new], text[new]


def signatures(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """16 bits of each MinHash value, a row per place; offsets: where each (non-empty) set begins."""
    return np.stack([np.minimum.reduceat((h * f) >> U(32), offsets).astype(np.uint16) for f in factors(PLACES, 1000)])


def children(keys: np.ndarray, sig: np.ndarray, twice: int) -> tuple[np.ndarray, np.ndarray]:
    """From each node (of column k of sig) its children's keys and their columns. One node in `twice` branches at two places."""
    col = np.arange(len(keys))
    second = np.flatnonzero((keys >> U(40)) % U(twice) == 0)
    place, up = keys % U(PLACES), keys[second]
    other = (place[second] + U(1) + (up >> U(16)) % U(PLACES - 1)) % U(PLACES)
    place, col, up = np.concatenate([place, other]), np.concatenate([col, second]), np.concatenate([keys, up])
    token = sig[place.astype(np.int64), col].astype(U)
    return mixed(up * U(0x9E3779B97F4A7C15) + mixed(token + (place << U(32)))), col


def walk(sig: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys after `steps` steps in all trees, and the column of sig each belongs to; a column is in a node once."""
    roots = factors(TREES, 77)
    keys, col = np.repeat(roots, sig.shape[1]), np.tile(np.arange(sig.shape[1]), TREES)
    for _ in range(steps):
        keys, at = children(keys, sig[:, col], FIRST_TWICE)
        col = col[at]
    both = np.unique(np.stack([keys, col.astype(U)]), axis=1)
    return both[0], both[1].astype(np.int64)


def recall(similarity: float, steps: int = FIRST_STEPS, trees: int | None = None) -> float:
    """Probability that a pair meets in a node after `steps` steps and has AGREE places in common. All trees draw from the same places."""
    total, trees = 0.0, TREES if trees is None else trees
    for k in range(AGREE, PLACES + 1):
        q, meet = k / PLACES, 1.0
        for step in range(steps):
            second = 1 / (FIRST_TWICE if step >= steps - FIRST_STEPS else MORE_TWICE)  # from the leaves up
            meet = (1 - second) * q * meet + second * (1 - (1 - q * meet) ** 2)
        total += comb(PLACES, k) * similarity**k * (1 - similarity) ** (PLACES - k) * (1 - (1 - meet) ** trees)
    return total


def trees_for(target: float) -> int:
    """The fewest trees with at least this recall of pairs that are just similar enough."""
    return next(t for t in range(1, 1000) if recall(SIMILAR / 100, FIRST_STEPS, t) >= target)


TREES = trees_for(RECALL)


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """row (a number of its own), doc_id, n_shingles, print (of the set), sig."""

    @frugal
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in in_slices(b.column(1)):
                h, text = shingle_sets(texts, n)
                count = np.bincount(text, minlength=len(texts))
                full = np.flatnonzero(count)
                prints, sigs = [None] * len(texts), [None] * len(texts)
                if len(full):
                    offsets = np.cumsum(count[full]) - count[full]
                    sums, sig = prints_of(h, offsets), signatures(h, offsets)
                    for k, at in enumerate(full.tolist()):
                        prints[at], sigs[at] = sums[k].tobytes(), sig[:, k].tobytes()
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), pa.array(count, pa.int64()), pa.array(prints, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "print", "sig"])

    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(per_batch, "doc_id long, n_shingles long, print binary, sig binary")
    return rows.withColumn("row", F.monotonically_increasing_id())


def prints_of(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """128 bits of each set."""
    return np.stack([np.add.reduceat(h, offsets), np.add.reduceat(mixed(h ^ U(0x5851F42D4C957F2D)), offsets)], axis=1)


def first_nodes(classes: DataFrame) -> DataFrame:
    """node, cls: where every class is after FIRST_STEPS steps."""

    @frugal
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls, raw = b.column(0).to_numpy(), b.column(1).to_pylist()
            for at in range(0, len(raw), 1_000):
                keys, col = walk(signature_rows(raw[at : at + 1_000]).T, FIRST_STEPS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(cls[at + col])], ["node", "cls"])

    return classes.select("cls", "sig").mapInArrow(per_batch, "node long, cls long")


def next_nodes(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """One step on from node, cls."""

    @frugal
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                of = np.repeat(np.arange(b.num_rows), b.column(0).value_lengths().to_numpy())
                sig = signature_rows(b.column(2).to_pylist())
                for at in range(0, len(of), STEP_KEYS):
                    part = of[at : at + STEP_KEYS]
                    keys, col = children(b.column(0).flatten().to_numpy()[at : at + STEP_KEYS].view(U), sig[part].T, MORE_TWICE)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), b.column(1).take(pa.array(part[col]))], ["node", "cls"])

    nodes = rows.groupBy("cls").agg(F.collect_list("node").alias("nodes"))  # a row a class: what is joined grows with classes, not with their nodes
    with_sig = classes.select("cls", "sig").join(nodes, "cls").select("nodes", "cls", "sig")
    return with_sig.mapInArrow(per_batch, "node long, cls long").distinct()


def signature_rows(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.uint16).reshape(-1, PLACES)


def crowded(rows: DataFrame) -> DataFrame:
    """node, cls, size (members) of nodes of two members and more; of nodes with equal members (by 128 bits) one."""
    members = [F.bit_xor(F.xxhash64("cls", F.lit(k))).alias(f"members_{k}") for k in (1, 2)]
    nodes = rows.groupBy("node").agg(F.count("*").alias("size"), *members).filter("size > 1")
    nodes = nodes.groupBy("size", "members_1", "members_2").agg(F.min("node").alias("node"))
    return written(sized_join(rows, written(nodes.select("node", "size"), "sizes"), ["node"], "inner").select("node", "cls", "size"), "nodes")


def all_nodes(classes: DataFrame) -> DataFrame:
    """node, cls, size of the nodes to compare: large ones walk on while their pairs get fewer."""
    rows = crowded(written(first_nodes(classes), "first-nodes"))
    for _ in range(MORE_STEPS):
        large = rows.filter(F.col("size") > MEMBERS)
        pairs = large.agg(F.sum(F.col("size").cast("double") - 1)).first()[0]
        if not pairs:
            break
        deeper = crowded(written(next_nodes(large, classes), "next-nodes"))
        if (deeper.agg(F.sum(F.col("size").cast("double") - 1)).first()[0] or 0) >= pairs:
            break
        rows = written(rows.filter(F.col("size") <= MEMBERS).union(deeper), "nodes")
    return rows


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches in order of their first column."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            key = b.column(0).to_numpy()
            if held and held[-1].column(0)[-1].as_py() != key[0]:
                yield pa.Table.from_batches(held)
                held = []
            cut = int(np.count_nonzero(key != key[-1]))
            if cut:
                yield pa.Table.from_batches([*held, b.slice(0, cut)])
                held = []
            held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def joined(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """labels (each the least place of its group) with the groups of i and j made one."""
    while True:
        low = np.minimum(labels[i], labels[j])
        new = labels.copy()
        np.minimum.at(new, labels[i], low)
        np.minimum.at(new, labels[j], low)
        new = new[new]
        if (new == labels).all():
            return new
        labels = new


def likely_clusters(unit: np.ndarray, comp: np.ndarray, n: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in order of unit) that may link with another group's in their unit, and the least place of what such pairs join."""
    size = len(unit)
    ends = np.searchsorted(unit, unit, side="right")
    pairs = np.append(0, np.cumsum(ends - np.arange(size) - 1))
    labels, at = np.arange(size), 0
    while at < size:
        to = max(at + 1, int(np.searchsorted(pairs, pairs[at] + PAIRS, side="right")) - 1)
        i = np.repeat(np.arange(at, to), pairs[at + 1 : to + 1] - pairs[at:to])
        j = i + 1 + np.arange(pairs[to] - pairs[at]) - (pairs[i] - pairs[at])
        low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        may = (comp[i] != comp[j]) & (100 * low >= SIMILAR * high)
        i, j = i[may], j[may]
        may = np.count_nonzero(sig[i] == sig[j], axis=1) >= AGREE
        labels, at = joined(labels, i[may], j[may]), to
    used = np.flatnonzero(np.bincount(labels, minlength=size)[labels] > 1)
    return used, labels[used]


def clusters(units: DataFrame, classes: DataFrame) -> DataFrame:
    """cluster, cls of members of units (unit, cls, comp) that may link with another group. A cluster's number comes from its members."""

    @frugal
    def per_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            unit, cls, comp, n = (t.column(k).to_numpy() for k in range(4))
            used, label = likely_clusters(unit, comp, n, signature_rows(t.column(4).to_pylist()))
            if len(used):
                number = np.zeros(len(unit), U)
                np.add.at(number, label, mixed(cls[used].astype(U) + U(1)))
                yield pa.RecordBatch.from_arrays([pa.array(mixed(number[label]).astype(np.int64)), pa.array(cls[used])], ["cluster", "cls"])

    own = written(units.groupBy("cls").agg(F.collect_list(F.struct("unit", "comp")).alias("units")), "units")  # a row a class, as in next_nodes
    rows = sized_join(classes.select("cls", "n", "sig"), own, ["cls"], "inner").select("cls", "n", "sig", F.inline("units")).select("unit", "cls", "comp", "n", "sig")
    return rows.repartition("unit").sortWithinPartitions("unit").mapInArrow(per_group, "cluster long, cls long")


def with_sets(docs: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """cluster, cls, shingles (8 bytes each, in order). rows: rep, print, cls, clusters; a document stands for its class if its print is the class's."""

    @frugal
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["cluster", "cls", "shingles"]
        for b in batches:
            for first, texts in in_slices(b.column(0)):
                h, text = shingle_sets(texts, n)
                ends = np.cumsum(np.bincount(text, minlength=len(texts)))
                raw, begin, size, out = h.tobytes(), 0, 0, ([], [], [])
                for k, end in enumerate(ends.tolist()):
                    if end > begin and prints_of(h[begin:end], np.zeros(1, np.int64)).tobytes() == b.column(1)[first + k].as_py():
                        for c in b.column(3)[first + k].as_py():
                            for column, value in zip(out, (c, b.column(2)[first + k].as_py(), raw[8 * begin : 8 * end]), strict=True):
                                column.append(value)
                            size += 8 * (end - begin)
                            if size > SEND_BYTES:
                                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names)
                                size, out = 0, ([], [], [])
                    begin = end
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names)

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), text_of().alias("text"))
    return sized_join(texts, rows, ["rep"], "inner").select("text", "print", "cls", "clusters").mapInArrow(per_batch, "cluster long, cls long, shingles binary")


def linked(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the least place among those that links join it to. Common shingles are counted by products of blocks of the sets' incidence."""
    m, n = len(sets), np.array([len(x) for x in sets], np.float64)
    member = np.repeat(np.arange(m), n.astype(np.int64))
    _, at, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    member, at = member[df[at] > 1], at[df[at] > 1]
    order = np.argsort(at, kind="stable")
    member, at = member[order], np.cumsum(np.append(0, np.diff(at[order]) != 0))[: len(order)]
    common = np.zeros((m, m), np.float32)
    for first in range(0, int(at[-1]) + 1 if len(at) else 0, SHARED):
        low, high = np.searchsorted(at, [first, first + SHARED])
        block = np.zeros((m, min(SHARED, int(at[-1]) + 1 - first)), np.float32)
        block[member[low:high], at[low:high] - first] = 1
        common += block @ block.T
    labels = np.arange(m)
    for first in range(0, m, 128):
        got = common[first : first + 128].astype(np.float64)
        i, j = np.nonzero(100 * got >= SIMILAR * (n[first : first + 128, None] + n[None, :] - got))
        labels = joined(labels, i + first, j)
    return labels


def confirmed(rows: DataFrame) -> DataFrame:
    """cls, low: the least class that links within a cluster join each class to, if it is another."""

    @frugal
    def per_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            cluster, cls, raw = t.column(0).to_numpy(), t.column(1).to_numpy(), t.column(2)
            edges = [*np.flatnonzero(np.append(True, cluster[1:] != cluster[:-1])).tolist(), len(cluster)]
            for first, end in zip(edges, edges[1:]):
                order = first + np.argsort(cls[first:end], kind="stable")
                lows = linked([np.frombuffer(raw[int(k)].as_buffer(), U) for k in order])
                a, b = cls[order], cls[order[lows]]
                if (a != b).any():
                    yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["cls", "low"])

    return rows.repartition("cluster").sortWithinPartitions("cluster").mapInArrow(per_group, "cls long, low long").distinct()


def links_of(docs: DataFrame, classes: DataFrame, units: DataFrame, n: int) -> DataFrame:
    """cls, low: links that the units (unit, cls, comp) hold between different groups, by the least class they join each to."""
    found = clusters(units, classes).groupBy("cls").agg(F.collect_set("cluster").alias("clusters"))
    rows = sized_join(classes.select("cls", "rep", "print"), written(found, "clusters"), ["cls"], "inner")
    return written(confirmed(with_sets(docs, written(rows.select("rep", "print", "cls", "clusters"), "compared"), n)), "links")


def components(links: DataFrame) -> DataFrame:
    """cls, comp (the least class that can be reached) of every end of a link."""
    both = written(links.select(F.col("cls").alias("a"), F.col("low").alias("b")).union(links.select("low", "cls")).distinct(), "edges")
    state = written(both.groupBy(F.col("a").alias("cls")).agg(F.min("b").alias("m")).select("cls", F.least("cls", "m").alias("comp")), "components")
    small = few(both)
    side = F.broadcast if small else (lambda df: df.hint("merge"))
    while True:
        near = both.join(side(state.withColumnRenamed("cls", "b")), "b").groupBy(F.col("a").alias("cls")).agg(F.min("comp").alias("near"))
        low = near.join(side(state), "cls").select("cls", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = state.select(F.col("cls").alias("comp"), F.col("comp").alias("far"))
        new = low.join(side(jump), "comp", "left").select("cls", "old", F.least("comp", F.coalesce("far", "comp")).alias("comp"))
        new = written(new.coalesce(4) if small else new, "components")
        state = new.select("cls", "comp")
        if new.filter("old <> comp").isEmpty():
            return state


def units_of(nodes: DataFrame) -> DataFrame:
    """unit, cls, comp: nodes in parts of about MEMBERS members."""
    part = F.pmod(F.xxhash64("cls", "node"), F.ceil(F.col("size") / MEMBERS))
    return nodes.select(F.xxhash64("node", part).alias("unit"), "cls", F.col("cls").alias("comp"))


def units_across(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """unit, cls, comp: two blocks of a node each. A group of more than half a unit has blocks of its own, which are not compared with one another."""
    half = MEMBERS // 2
    rows = written(sized_join(nodes.select("node", "cls"), groups, ["cls"], "left").select("node", "cls", F.coalesce("comp", "cls").alias("comp")), "grouped")
    sizes = rows.groupBy("node", "comp").agg(F.count("*").alias("m")).withColumn("own", F.col("m") > half)
    rest = sizes.groupBy("node").agg(F.count("*").alias("groups"), F.sum(F.when(~F.col("own"), F.col("m"))).alias("rest")).filter("groups > 1")
    dealt = sizes.join(rest, "node").select("node", "comp", F.when(F.col("own"), F.col("comp")).alias("owner"), F.ceil(F.when(F.col("own"), F.col("m")).otherwise(F.col("rest")) / half).alias("parts"))
    block = F.xxhash64("node", "owner", F.pmod(F.xxhash64("cls", "node"), F.col("parts")))
    rows = written(sized_join(rows, written(dealt, "dealt"), ["node", "comp"], "inner").select("node", "cls", "comp", "owner", block.alias("block")), "blocks")
    x, y = (rows.select("node", F.col("owner").alias(f"owner_{s}"), F.col("block").alias(s)).distinct() for s in "xy")
    pairs = x.join(y, "node").filter((F.col("x") <= F.col("y")) & (F.col("owner_x").isNull() | ~F.col("owner_x").eqNullSafe(F.col("owner_y"))))
    pairs = pairs.select(F.xxhash64("x", "y").alias("unit"), F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    return sized_join(rows, written(pairs, "units"), ["block"], "inner").select("unit", "cls", "comp")


def near_groups(docs: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """cls, comp of classes (cls, rep, print, n, sig) that are linked."""
    nodes = all_nodes(classes)
    links = links_of(docs, classes, units_of(nodes), n)
    groups = components(links)
    large = nodes.filter(F.col("size") > MEMBERS)
    if large.isEmpty():
        return groups
    return components(links.union(links_of(docs, classes, units_across(large, groups), n)))


def near_dedup(docs: DataFrame, n: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document. n: words of a shingle."""
    sk = written(sketches(docs, n), "sketches")
    classes = sk.filter("print is not null and doc_id is not null").groupBy("print").agg(F.min("row").alias("cls"), F.min("doc_id").alias("rep"), F.count("*").alias("rows"), F.any_value("n_shingles").alias("n"), F.any_value("sig").alias("sig"))
    classes = written(classes, "classes")
    groups = near_groups(docs, classes, n)
    named = sized_join(classes.select("cls", "rep", "print"), groups, ["cls"], "inner")
    named = written(named.select("comp", "rep", "print"), "named")
    least = written(named.groupBy("comp").agg(F.min("rep").alias("component_id")), "least")
    alone = sized_join(classes.filter("rows > 1"), groups, ["cls"], "left_anti").select("print", F.col("rep").alias("component_id"))
    many = sized_join(named, least, ["comp"], "inner").select("print", "component_id").union(alone)
    out = salted_left_join(sk.select("doc_id", "n_shingles", "print"), many, "print", F.col("doc_id"))
    comp_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", comp_id.alias("component_id"), F.col("doc_id").eqNullSafe(comp_id).alias("kept"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read_table(spark, sf_dir, "documents"), n=2)
