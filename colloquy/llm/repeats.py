"""Repeated substrings by two-stage suffix sorting (operator 8).

A byte goes if a string of SPAN bytes that covers it also starts earlier. Each string of SPAN bytes holds a least
32-gram (by hash, leftmost of equals), its anchor; strings that are equal have equal anchors in equal places. Starts
with one anchor form a run of at most 69, and the bytes its strings cover, 168 at most, are its context. So:

1. Runs are listed; anchors that occur once in all documents are dropped (a count by hash, combined before the shuffle).
2. Runs with equal anchor and context (128 bits of hash) are counted and their first document found; in every
   later document, and where a context comes again within a document, the whole run repeats.
3. What is left are first contexts that share an anchor with other contexts. Their bytes are dealt by anchor into
   blocks, and each block's suffixes are sorted in two stages: suffixes smaller than their successors directly, the
   others induced by scanning the buckets in order. Neighbours with a common prefix of SPAN bytes or more are equal
   strings, of which all but the earliest repeat. An anchor with more than HOT contexts would fill a task: of its
   strings only 128 bits of hash are dealt, the first of each is found by an aggregation that is combined before the
   shuffle, and the others are marked by a salted join, so that no task holds all copies of one string.
4. Ranges meet their documents and are cut out.

A row is known by its doc_id and a 64-bit hash of its text all the way, so that rows which share a doc_id, or have none,
are told apart; rows equal in both are worked on once and lose the same bytes.

A document's contexts and its ranges go to the tasks only if their counted rows and bytes are few; beyond that the
same joins shuffle. Whole contexts are equal by 128 bits of hash: among 10^13 runs any two different ones are mixed up
with a probability below 10^-12.

Defined cases: null and empty texts have no bytes; texts below SPAN bytes lose nothing; a null doc_id comes before
all others; rows that share a doc_id, or have none, stand at the same place: none removes another's bytes, each its own
repeats and those of smaller doc_ids; an empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.operators.joins import sized_join

from .common import frugal, read_table, salted_left_join, text_of, written
from .words import U, factors, in_slices, mixed

SPAN = 100
GRAM = 32
PIECE = 1 << 22  # bytes of a text looked at together
PLACE_BITS = 24  # of a place among the bytes looked at together, 2 * PIECE at most; the rest of 64 is hash
BLOCK = 1_200_000  # bytes of contexts sorted together
HOT = 10_000
SENT_ROWS = 10_000  # contexts of one batch
NO_DOC = -(2**63)

ROUNDS = GRAM.bit_length() - 1
STEP_FACTORS = factors(ROUNDS, 31)
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(int(BASE), -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U)
    out[0] = 1
    return np.multiply.accumulate(out)


_powers: dict[str, np.ndarray] = {}


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 17)
        _powers["up"], _powers["down"] = powers(BASE, size), powers(INVERSE, size)
    return _powers["up"], _powers["down"]


def window_min(x: np.ndarray, width: int) -> np.ndarray:
    n, size = len(x) - width + 1, 1
    while size * 2 <= width:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[width - size : width - size + n])


class Sums:
    """Hash of any range of bytes, from prefix sums."""

    def __init__(self, data: np.ndarray):
        self.up, down = power_tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=U)
        np.cumsum((data.astype(U) + U(1)) * down[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.up[start] + (end - start).astype(U))


def runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of texts put one behind another: text, start in it, number of starts, anchor and context hash of each run."""
    lengths = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if len(data) < SPAN:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U, U))
    h = data.astype(U) + U(1)
    for k in range(ROUNDS):
        h = h[: len(h) - (1 << k)] * STEP_FACTORS[k] + h[1 << k :]
    h = mixed(h)
    if len(data) >> PLACE_BITS:
        raise ValueError("places beyond PLACE_BITS")
    low = U((1 << PLACE_BITS) - 1)
    at = (window_min((h & ~low) | np.arange(len(h), dtype=U), SPAN - GRAM + 1) & low).astype(np.int64)
    begins = np.cumsum(lengths) - lengths
    text = np.repeat(np.arange(len(texts)), lengths)
    whole = text[: len(at)] == text[SPAN - 1 :]
    first = np.flatnonzero(whole & np.append(True, (at[1:] != at[:-1]) | ~whole[:-1] | (text[1 : len(at)] != text[: len(at) - 1])))
    last = np.flatnonzero(whole & np.append((at[1:] != at[:-1]) | ~whole[1:] | (text[1 : len(at)] != text[: len(at) - 1]), True))
    of = text[first]
    return of, first - begins[of], last - first + 1, h[at[first]], Sums(data).of(first, last + SPAN)


def runs_in_turn(parts: list[bytes]) -> tuple[np.ndarray, ...]:
    """As runs, over lists of texts of no more than two pieces together."""
    out, first, size = [], 0, 0
    for k, part in enumerate(parts):
        size += len(part)
        if size >= PIECE or k == len(parts) - 1:
            of, *rest = runs(parts[first : k + 1])
            out.append((of + first, *rest))
            first, size = k + 1, 0
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else runs([])


def pieces(text: bytes) -> list[tuple[int, bytes]]:
    """A text in parts that share SPAN - 1 bytes with the next, so that each string of SPAN bytes is in one."""
    return [(k, text[k : k + PIECE + SPAN - 1]) for k in range(0, max(1, len(text) - SPAN + 1), PIECE)]


#: What is kept of a first context, and of a removed range, in a document's packed list.
FIRST = np.dtype([("start", "<i4"), ("n", "u1"), ("hot", "u1"), ("anchor", "<i8")])
RANGE = np.dtype([("start", "<i4"), ("end", "<i4")])


def run_rows(docs: DataFrame) -> DataFrame:
    """doc_id, row, start, n (starts), anchor, context, again (the context came before in the row). docs: doc_id, row, text."""

    @frugal
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = b.column(0).to_numpy(), b.column(1).to_numpy()
            for first, texts in in_slices(b.column(2), 120_000):
                cut = [(first + k, base, part) for k, t in enumerate(texts) for base, part in pieces(t)]
                doc, base = np.array([c[0] for c in cut]), np.array([c[1] for c in cut])
                of, start, n, anchor, context = runs_in_turn([c[2] for c in cut])
                at = doc[of]
                key = mixed(anchor) ^ context
                order = np.lexsort((key, at))
                again = np.zeros(len(at), bool)
                again[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (at[order[1:]] == at[order[:-1]])
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(rows[at]), pa.array((start + base[of]).astype(np.int64)), pa.array(n.astype(np.int32)), pa.array(anchor.astype(np.int64)), pa.array(context.astype(np.int64)), pa.array(again)], ["doc_id", "row", "start", "n", "anchor", "context", "again"])

    return docs.select("doc_id", "row", "text").mapInArrow(per_batch, "doc_id long, row long, start long, n int, anchor long, context long, again boolean")


def packed(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a number that sorts as they do; zeros follow the end."""
    p = np.append(data, np.zeros(SPAN + 16, np.uint8)).astype(U)
    for k in (1, 2, 4):
        p = (p[:-k] << U(8 * k)) | p[k:]
    return p


def words_of(p: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The k-th 8 bytes of each place's first SPAN bytes."""
    left = SPAN - 8 * k
    got = p[at + 8 * k]
    return got if left >= 8 else got >> U(8 * (8 - left))


def sort_directly(p: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places in the order of their first SPAN bytes."""
    at = at[np.argsort(p[at], kind="stable")]
    w = p[at]
    new = np.append(True, w[1:] != w[:-1])
    for k in range(1, -(-SPAN // 8)):
        group = np.cumsum(new)
        tied = ~new
        tied[:-1] |= ~new[1:]
        live = np.flatnonzero(tied)
        if not len(live):
            break
        w = words_of(p, at[live], k)
        order = np.lexsort((w, group[live]))
        at[live], w, g = at[live][order], w[order], group[live][order]
        new[live] = np.append(True, (w[1:] != w[:-1]) | (g[1:] != g[:-1]))
    return at


def suffix_order(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of texts put one behind another (each ends at one of `ends`), in the order of their suffixes' first
    SPAN bytes, in two stages. Where a text ends counts as less than any byte; places nearer than SPAN to it only
    serve to induce others."""
    n = len(data)
    t = np.zeros(n + len(ends), dtype=np.int16)
    shift = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    place = np.arange(n) + shift
    t[place] = data.astype(np.int16) + 1
    stop = ends + np.arange(len(ends))
    # A suffix is smaller than its successor if its first byte that differs from the next one is smaller than it.
    step = np.sign(np.diff(t, append=np.int16(0)))
    mark = np.where(step != 0, np.arange(len(t)), len(t) - 1)
    smaller = step[np.minimum.accumulate(mark[::-1])[::-1]] > 0
    smaller[stop] = False
    direct = place[smaller[place]]
    back = np.empty(len(t), dtype=np.int64)
    back[place] = np.arange(n)
    order = place[sort_directly(packed(data), back[direct])]
    by_byte = np.searchsorted(t[order], np.arange(1, 259))
    larger: list[list[np.ndarray]] = [[] for _ in range(258)]

    def induce(seq: np.ndarray, byte: int) -> np.ndarray:
        """Deals the larger suffixes before those of seq to their buckets; returns those of the bucket itself."""
        before = seq[seq > 0] - 1
        before = before[~smaller[before] & (t[before] > 0)]
        c = t[before]
        own, rest = before[c == byte], before[c > byte]
        if len(rest):
            rest = rest[np.argsort(t[rest], kind="stable")]
            c = t[rest]
            at = np.append(np.flatnonzero(np.diff(c, prepend=-1)), len(c))
            for i, j in zip(at[:-1], at[1:], strict=True):
                larger[c[i]].append(rest[i:j])
        return own

    out = []
    induce(stop, 0)
    for byte in range(1, 257):
        grown = larger[byte]
        while grown:
            seq = np.concatenate(grown)
            out.append(seq)
            own = induce(seq, byte)
            grown = [own] if len(own) else []
        seq = order[by_byte[byte - 1] : by_byte[byte]]
        if len(seq):
            out.append(seq)
            induce(seq, byte)
    return back[np.concatenate(out)] if out else np.zeros(0, np.int64)


def common_prefixes(p: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bytes, at most SPAN, that each place but the first shares with the one before."""
    out = np.zeros(max(0, len(at) - 1), dtype=np.int64)
    live = np.arange(len(out))
    for k in range(-(-SPAN // 8)):
        width = min(8, SPAN - 8 * k)
        x, y = words_of(p, at[live], k), words_of(p, at[live + 1], k)
        diff = x ^ y
        bits = np.zeros(len(live), dtype=np.int64)
        odd = diff != 0
        top = np.floor(np.log2((diff[odd] >> U(32)).astype(float) + 0.5)).astype(np.int64)
        low = np.floor(np.log2((diff[odd] & U(0xFFFFFFFF)).astype(float) + 0.5)).astype(np.int64)
        bits[odd] = np.where(diff[odd] >> U(32) > 0, 32 + top, low) + 1
        out[live] += np.where(odd, width - (bits + 7) // 8, width)
        live = live[~odd]
    return out


def later_copies(contexts: list[bytes], docs: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc, row, start and end of ranges of strings that among these contexts are equal to one of a smaller doc, or an earlier one of their row."""
    lengths = np.array([len(c) for c in contexts])
    ends = np.cumsum(lengths)
    data = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    ctx = np.repeat(np.arange(len(contexts)), lengths)
    inside = np.arange(len(data)) - (ends - lengths)[ctx]
    at = suffix_order(data, ends)
    at = at[inside[at] + SPAN <= lengths[ctx[at]]]
    none = (np.zeros(0, np.int64),) * 4
    if len(at) < 2:
        return none
    group = np.cumsum(np.append(True, common_prefixes(packed(data), at) < SPAN)) - 1
    c = ctx[at]
    order = np.lexsort((starts[c] + inside[at], rows[c], docs[c], group))
    at, group, c = at[order], group[order], c[order]
    new = np.append(True, group[1:] != group[:-1])
    least = docs[c[np.flatnonzero(new)]][group]
    later = ~new & ((docs[c] > least) | np.append(False, rows[c[1:]] == rows[c[:-1]]))
    gone = np.sort(at[later])
    if not len(gone):
        return none
    cut = np.append(True, (np.diff(gone) != 1) | (np.diff(ctx[gone]) != 0))
    a, b = gone[np.flatnonzero(cut)], gone[np.append(np.flatnonzero(cut)[1:] - 1, len(gone) - 1)]
    c = ctx[a]
    return docs[c], rows[c], starts[c] + inside[a], starts[c] + inside[b] + SPAN


def context_rows(texts: DataFrame) -> DataFrame:
    """route, doc_id, row, start, bytes of the contexts in `packed` (of FIRST) of each text, but for those of hot anchors."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary())], ["route", "doc_id", "row", "start", "bytes"])

    @frugal
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for doc, row, text, first in zip(*b.columns, strict=True):
                doc, row, raw, found = doc.as_py(), row.as_py(), text.as_py().encode(), np.frombuffer(first.as_py(), FIRST)
                found = found[found["hot"] == 0]
                for k in range(0, len(found), SENT_ROWS):
                    rows += [(anchor, doc, row, start, raw[start : start + n + SPAN - 1]) for start, n, _, anchor in found[k : k + SENT_ROWS].tolist()]
                    if len(rows) >= SENT_ROWS:
                        yield batch_of(rows)
                        rows = []
            yield batch_of(rows)

    return texts.mapInArrow(per_batch, "route long, doc_id long, row long, start long, bytes binary")


def hot_strings(texts: DataFrame) -> DataFrame:
    """string (128 bits of hash), doc_id, row, start of each string of the hot contexts in `packed` (of FIRST) of each text."""

    @frugal
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, row, text, first in zip(*b.columns, strict=True):
                doc, row, raw, found = doc.as_py(), row.as_py(), text.as_py().encode(), np.frombuffer(first.as_py(), FIRST)
                found = found[found["hot"] > 0]
                for k in range(0, len(found), 1000):
                    starts = np.concatenate([np.arange(s, s + n) for s, n in found[["start", "n"]][k : k + 1000].tolist()]).astype(np.int64)
                    strings = [xxhash.xxh3_128_digest(raw[s : s + SPAN]) for s in starts.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(strings, pa.binary()), pa.array(np.full(len(starts), doc, np.int64)), pa.array(np.full(len(starts), row, np.int64)), pa.array(starts)], ["string", "doc_id", "row", "start"])

    return texts.mapInArrow(per_batch, "string binary, doc_id long, row long, start long")


def later_strings(strings: DataFrame) -> DataFrame:
    """doc_id, row, start, end of the strings that are equal to one of a smaller doc_id, or to an earlier one of their row."""
    strings = written(strings, "strings")
    first = strings.groupBy("string").agg(F.min("doc_id").alias("least"), F.count("*").alias("m")).filter("m > 1").drop("m")
    both = written(salted_left_join(strings, written(first, "least"), "string", F.struct("doc_id", "row", "start")).filter("least is not null"), "shared-strings")
    # What is left in the first documents repeats where its own row has it before.
    earlier = F.row_number().over(Window.partitionBy("string", "doc_id", "row").orderBy("start")) > 1
    own = both.filter("doc_id = least").withColumn("earlier", earlier).filter("earlier")
    return both.filter("doc_id > least").select("doc_id", "row", "start").unionByName(own.select("doc_id", "row", "start")).withColumn("end", F.col("start") + SPAN)


def sorted_blocks(contexts: DataFrame) -> DataFrame:
    """doc_id, row, start, end of what repeats within the contexts of one route."""

    @frugal
    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]] = []

        def flush() -> pa.RecordBatch:
            got = later_copies([c for h in held for c in h[3]], *(np.concatenate([h[k] for h in held]) for k in range(3)))
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in got], ["doc_id", "row", "start", "end"])

        size, last = 0, None
        for b in batches:
            route = b.column(0).to_numpy()
            docs, rows, starts, texts = b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy(), b.column(4).to_pylist()
            edges = np.append(np.flatnonzero(np.diff(route)) + 1, len(route)).tolist()
            begin = 0
            for end in edges:
                if end == begin:
                    continue
                if size >= BLOCK and route[begin] != last:
                    yield flush()
                    held, size = [], 0
                held.append((docs[begin:end], rows[begin:end], starts[begin:end], texts[begin:end]))
                size += sum(map(len, texts[begin:end]))
                begin, last = end, route[end - 1]
        if held:
            yield flush()

    return contexts.repartition("route").sortWithinPartitions("route").mapInArrow(per_task, "doc_id long, row long, start long, end long")


def packed_lists(rows: DataFrame, kind: np.dtype, join: bool = False) -> DataFrame:
    """doc_id, row, packed: the list in column `items` of each row, in order, as bytes; ranges that touch joined if asked."""

    @frugal
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                items, doc = b.column(2).flatten(), np.repeat(np.arange(b.num_rows), b.column(2).value_lengths().to_numpy())
                got = np.empty(len(items), kind)
                for c in kind.names:
                    got[c] = items.field(c).to_numpy(zero_copy_only=False)
                got = got[np.lexsort([*(got[c] for c in reversed(kind.names)), doc])]
                parts = np.split(got, np.cumsum(np.bincount(doc, minlength=b.num_rows))[:-1])
                out = [(np.array(merged(x.tolist()), dtype=kind) if join else x).tobytes() for x in parts]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["doc_id", "row", "packed"])

    return rows.groupBy("doc_id", "row").agg(F.collect_list("items").alias("items")).mapInArrow(per_batch, "doc_id long, row long, packed binary")


def shared_runs(docs: DataFrame) -> DataFrame:
    """Runs whose anchor occurs in other runs too."""
    anchors = written(run_rows(docs).groupBy("anchor").agg(F.count("*").alias("m")).filter("m > 1").select("anchor"), "anchors")
    return run_rows(docs).join(anchors.hint("merge"), "anchor", "left_semi")


def repeated_ranges(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, row, packed (of RANGE): all that repeats. docs: doc_id without nulls, row, text; no two of one doc_id and row."""
    found = written(shared_runs(docs), "runs")
    firsts = written(found.groupBy("anchor", "context").agg(F.min("doc_id").alias("first")), "contexts")
    several = firsts.groupBy("anchor").agg(F.count("*").alias("contexts")).filter("contexts > 1")
    firsts = written(firsts.join(several, "anchor", "left"), "firsts")
    known = written(found.join(firsts, ["anchor", "context"]), "known")
    later = F.col("again") | (F.col("doc_id") > F.col("first"))
    whole = known.filter(later).select("doc_id", "row", "start", (F.col("start") + F.col("n") + (SPAN - 1)).alias("end"))
    left = known.filter(~later & F.col("contexts").isNotNull()).select("doc_id", "row", F.struct("start", "n", "anchor", (F.col("contexts") > hot).alias("hot")).alias("items"))
    left = written(packed_lists(left, FIRST), "left")
    texts = sized_join(docs, left, ["doc_id", "row"], "inner").select("doc_id", "row", "text", "packed")
    ranges = whole.union(sorted_blocks(context_rows(texts)))
    if not several.filter(F.col("contexts") > hot).isEmpty():
        ranges = ranges.union(later_strings(hot_strings(texts)))
    return written(packed_lists(ranges.select("doc_id", "row", F.struct("start", "end").alias("items")), RANGE, join=True), "ranges")


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges with those that overlap or touch joined."""
    out: list[tuple[int, int]] = []
    for s, e in ranges:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def once(docs: DataFrame) -> DataFrame:
    """docs (doc_id, row, text) with one of each doc_id and row. Texts move only of those that come again, one a task."""
    again = written(docs.groupBy("doc_id", "row").agg(F.count("*").alias("m")).filter("m > 1").select("doc_id", "row"), "again")
    if again.isEmpty():
        return docs
    one = sized_join(docs, again, ["doc_id", "row"], "left_semi").groupBy("doc_id", "row").agg(F.first("text").alias("text"))
    return sized_join(docs, again, ["doc_id", "row"], "left_anti").unionByName(written(one, "one-of-each"))


def without_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, removed (ranges of bytes), kept (what is left, as bytes) of every document."""

    @frugal
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            sizes, gone, kept = [], [], []
            for text, ranges in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw, at, parts = text.encode(), 0, []
                cut = [(s, min(e, len(raw))) for s, e in np.frombuffer(ranges or b"", RANGE).tolist() if s < len(raw)]
                for s, e in cut:
                    parts.append(raw[at:s])
                    at = e
                sizes.append(len(raw))
                gone.append([{"start": s, "end": e} for s, e in cut])
                kept.append(b"".join([*parts, raw[at:]]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(gone, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC)).alias("doc_id"), F.xxhash64(text_of()).alias("row"), text_of().alias("text"))
    got = sized_join(rows, repeated_ranges(once(rows), hot), ["doc_id", "row"], "left").select("doc_id", "text", "packed")
    out = got.mapInArrow(per_batch, "doc_id long, n_bytes long, removed array<struct<start long, end long>>, kept binary")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_DOC, F.col("doc_id")))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = without_repeats(read_table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r.end - r.start)
    return rows.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
