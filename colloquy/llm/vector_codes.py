"""Vectors compressed to short codes: integer codebooks for equal parts of each vector (operator 12).

Components become integers, so all sums and distances are exact and no order of work changes a result. The parts of all
vectors are sorted along a Hilbert curve, by position of the part, and cut into flat blocks of at most BLOCK parts, each stored
with its box (least and greatest value of each dimension) and its sum. A round then sends the codebooks (parts times entries
small vectors) to the blocks: the distance of each entry from a block's box leaves the block a shortlist. An entry alone on it
takes the whole block by its stored sum; else an integer kernel compares the block's parts with the shortlist. Each task sends
one row for each part and entry on.

Defined cases: rows whose vector is null, or holds a null or a component that isn't finite, are dropped; a null vec_id comes
after all others and shares of one vec_id come in order of their components; with fewer vectors than entries there are as many
entries as vectors; an empty table gives no rows; extra columns are not read. Vectors of different lengths, or of a length
that can't be cut into the parts, and components whose squared distances don't fit a long, raise a ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators.joins import sized_join

from .common import frugal, read_table, written

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
BLOCK = 256
BITS = 62  # of a place on the curve


def curve(x: np.ndarray, low: int, high: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of integers between low and high, by their first dimensions and bits."""
    x = x[:, :BITS]
    n = x.shape[1]
    if n == 0:
        return np.zeros(len(x), np.int64)
    bits = min(8, BITS // n)
    cells = ((x - low) * ((1 << bits) - 1) // max(1, high - low)).astype(np.int64)
    # From the highest bit down, each dimension that has it turns the rest of the first, any other trades its rest with the first.
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        for i in range(n):
            has = (cells[:, i] & q) != 0
            swap = np.where(has, 0, (cells[:, 0] ^ cells[:, i]) & (q - 1))
            cells[:, 0] ^= np.where(has, q - 1, swap)
            cells[:, i] ^= swap
        q >>= 1
    cells = np.bitwise_xor.accumulate(cells, axis=1)
    turn, q = np.zeros(len(x), np.int64), top
    while q > 1:
        turn ^= np.where((cells[:, -1] & q) != 0, q - 1, 0)
        q >>= 1
    cells ^= turn[:, None]
    place = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << 1) | ((cells[:, i] >> b) & 1)
    return place


def binaries(x: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    x = np.ascontiguousarray(x)
    width = x.shape[1] * x.itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(x.tobytes())])


def integers(vectors: DataFrame, vector: str, scale: int = SCALE) -> DataFrame:
    """vec_id, label, ints, row (a number for each row) of the rows that are kept; stored."""
    x = F.col(vector)
    good = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    ints = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    return written(vectors.filter(good).select("vec_id", "label", ints.alias("ints"), F.monotonically_increasing_id().alias("row")), "vectors")


def checked(rows: DataFrame, parts: int) -> tuple[int, int, int]:
    """Length, least and greatest component of all vectors; says if they can't be coded."""
    a, b, low, high = rows.agg(F.min(F.size("ints")), F.max(F.size("ints")), F.min(F.array_min("ints")), F.max(F.array_max("ints"))).first()
    if a is None:
        return 0, 0, 0
    if a != b or a % parts:
        raise ValueError(f"vectors of {a} to {b} components can't be cut into {parts} equal parts")
    low, high = low or 0, high or 0
    if a * (high - low + 1) ** 2 >= 1 << 62:
        raise ValueError("components are too far apart for exact distances")
    return a, low, high


def sorted_blocks(rows: DataFrame, parts: int, length: int, low: int, high: int, size: int = BLOCK) -> DataFrame:
    """part, n, rows, data, low, high, sums of each block, the last five as packed integers; stored."""
    kind = np.dtype("<i4") if max(abs(low), abs(high)) < 1 << 31 else np.dtype("<i8")
    m = length // parts

    @frugal
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(b.num_rows, length)
            for p in range(parts):
                part = x[:, p * m : (p + 1) * m]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), p, np.int32)), pa.array(curve(part, low, high)), b.column(0), binaries(part.astype(kind))], ["part", "place", "row", "data"])

    @frugal
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def block(part: int, ids: np.ndarray, x: np.ndarray) -> tuple:
            return part, len(x), ids.tobytes(), x.tobytes(), x.min(0).tobytes(), x.max(0).tobytes(), x.sum(0, dtype=np.int64).tobytes()

        def batch() -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(7)], ["part", "n", "rows", "data", "low", "high", "sums"])

        held, ids, data = -1, np.zeros(0, np.int64), np.zeros((0, m), kind)
        for b in batches:
            part = b.column(0).to_numpy()
            row = b.column(2).to_numpy()
            x = np.frombuffer(b"".join(b.column(3).to_pylist()), kind).reshape(len(part), m)
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for i, j in zip(edges, edges[1:], strict=False):
                if i == j:
                    continue
                if part[i] != held and len(ids):
                    out.append(block(held, ids, data))
                    ids, data = ids[:0], data[:0]
                held = int(part[i])
                ids, data = np.append(ids, row[i:j]), np.concatenate([data, x[i:j]])
                whole = len(ids) // size * size
                out += [block(held, ids[k : k + size], data[k : k + size]) for k in range(0, whole, size)]
                ids, data = ids[whole:], data[whole:]
            if out:
                yield batch()
                out = []
        if len(ids):
            out.append(block(held, ids, data))
            yield batch()

    pieces = rows.select("row", "ints").mapInArrow(cut, "part int, place long, row long, data binary")
    dealt = pieces.repartitionByRange("part", "place", "row").sortWithinPartitions("part", "place", "row")
    return written(dealt.mapInArrow(gather, "part int, n int, rows binary, data binary, low binary, high binary, sums binary"), "blocks")


def shortlists(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """For each box and entry whether the entry can be the nearest of a part in the box, equal distances included."""
    under, over = low[:, None, :] - entries, entries - high[:, None, :]
    nearest = (np.maximum(np.maximum(under, over), 0) ** 2).sum(2)
    farthest = (np.maximum(np.abs(under), np.abs(over)) ** 2).sum(2)
    return nearest <= farthest.min(1, keepdims=True)


def nearest(x: np.ndarray, entries: np.ndarray, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest of the listed entries (their numbers, ascending) to each row, the first of equals, and its squared distance."""
    gap = x[:, None, :] - entries[listed]
    d = np.einsum("ijk,ijk->ij", gap, gap)
    at = d.argmin(1)
    return listed[at], d[np.arange(len(x)), at]


def _blocks(b: pa.RecordBatch, books: np.ndarray, kind: np.dtype) -> Iterator[tuple]:
    """part, number of parts, the block's column of rows and its data, sums, and shortlist of each block of a batch."""
    m = books.shape[2]
    part = b.column(0).to_numpy()
    box = [np.frombuffer(b"".join(b.column(k).to_pylist()), kind).reshape(len(part), m).astype(np.int64) for k in (4, 5)]
    for p in np.unique(part):
        at = np.flatnonzero(part == p)
        lists = shortlists(box[0][at], box[1][at], books[p])
        for k, listed in zip(at.tolist(), lists, strict=True):
            yield int(p), b.column(1)[k].as_py(), b.column(2)[k], b.column(3)[k], b.column(6)[k], np.flatnonzero(listed)


def round_sums(blocks: DataFrame, books: np.ndarray, kind: np.dtype) -> list:
    """part, entry, n, sums of what each entry is nearest to: a row for each entry at most."""
    parts, k, m = books.shape

    @frugal
    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros((parts, k), np.int64), np.zeros((parts, k, m), np.int64)
        for b in batches:
            for p, n, _, data, whole, listed in _blocks(b, books, kind):
                if len(listed) == 1:
                    count[p, listed[0]] += n
                    sums[p, listed[0]] += np.frombuffer(whole.as_py(), np.int64)
                    continue
                x = np.frombuffer(data.as_py(), kind).reshape(n, m).astype(np.int64)
                code, _ = nearest(x, books[p], listed)
                for e in np.unique(code):
                    mine = x[code == e]
                    count[p, e] += len(mine)
                    sums[p, e] += mine.sum(0)
        p, e = np.nonzero(count)
        cols = [p.astype(np.int32), e.astype(np.int32), count[p, e], *sums[p, e].T]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], ["part", "entry", "n", *[f"s{i}" for i in range(m)]])

    each = [f"s{i}" for i in range(m)]
    got = blocks.mapInArrow(per_task, ", ".join(["part int, entry int, n long", *[f"{c} long" for c in each]]))
    return got.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in each]).collect()  # parts times entries rows


def assigned(blocks: DataFrame, books: np.ndarray, kind: np.dtype) -> DataFrame:
    """row, part, code, error of every part."""
    m = books.shape[2]

    @frugal
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, n, rows, data, _, listed in _blocks(b, books, kind):
                code, error = nearest(np.frombuffer(data.as_py(), kind).reshape(n, m).astype(np.int64), books[p], listed)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(rows.as_py(), np.int64)), pa.array(np.full(n, p, np.int32)), pa.array(code.astype(np.int32)), pa.array(error)], ["row", "part", "code", "error"])

    return blocks.mapInArrow(per_batch, "row long, part int, code int, error long")


def book_text(books: np.ndarray) -> str:
    return ",".join(map(str, books.ravel().tolist()))


def coded(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, vector: str = "embedding", each: Callable[[np.ndarray], None] | None = None) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, codes (array, one for each part), error; and the codebooks (part, entry, position). vectors: vec_id, label and the
    vector. entries: 256 at most. each: is told the codebooks after every round."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is a byte: 1 to 256 entries")
    rows = integers(vectors, vector, scale)
    length, low, high = checked(rows, parts)
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), "ints").select("ints").limit(entries).collect()  # as many as entries
    books = np.array([r.ints for r in seeds], np.int64).reshape(len(seeds), parts, length // parts).transpose(1, 0, 2).copy()
    if not seeds:
        return rows.select("vec_id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error")), books
    kind = np.dtype("<i4") if max(abs(low), abs(high)) < 1 << 31 else np.dtype("<i8")
    blocks = sorted_blocks(rows, parts, length, low, high)
    for _ in range(rounds):
        for r in round_sums(blocks, books, kind):
            books[r.part, r.entry] = np.array(r[3:], np.int64) // r.n
        if each is not None:
            each(books)
    code = [F.max(F.when(F.col("part") == p, F.col("code"))) for p in range(parts)]
    per_row = assigned(blocks, books, kind).groupBy("row").agg(F.array(*code).alias("codes"), F.sum("error").alias("error"))
    return rows.select("row", "vec_id", "label").join(per_row, "row").drop("row"), books


def decoded(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """codes with `vector`: the middle of what the coded integers stand for."""
    table = F.array(*[F.array(*[F.array(*[F.lit((v + 0.5) / scale) for v in entry]) for entry in part]) for part in books.tolist()])
    return codes.withColumn("vector", F.flatten(F.transform("codes", lambda c, i: F.get(F.get(table, i), c))))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = coded(read_table(spark, sf_dir, "embeddings"))
    label = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("key")
    rows = written(rows.select("*", label), "codes")
    per = written(rows.groupBy("key").agg(F.sum("error").alias("label_error")), "labels")
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return sized_join(rows, per, ["key"], "inner").select("vec_id", code.alias("code"), "error", "label_error", F.lit(hashlib.sha256(book_text(books).encode()).hexdigest()).alias("codebooks_sha256"))


def _sql() -> str:
    """Parts as lists; each round's nearest entries and the means that replace them."""
    gap = "list_sum(list_transform(range(1, len(xs) + 1), lambda i: (xs[i] - es[i]) * (xs[i] - es[i])))::BIGINT"
    out = [
        "v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "parts AS MATERIALIZED (SELECT id, p, e[p * len(e) // 8 + 1:(p + 1) * len(e) // 8] AS xs FROM v, range(8) AS r(p))",
        "book0 AS MATERIALIZED (SELECT p, j, xs AS es FROM parts JOIN (SELECT id, row_number() OVER (ORDER BY vec_id, e) - 1 AS j FROM v QUALIFY j < 16) USING (id))",
    ]
    for k in range(7):
        out.append(f"near{k} AS MATERIALIZED (SELECT id, p, j, xs, d FROM (SELECT id, p, j, xs, {gap} AS d FROM parts JOIN book{k} USING (p)) QUALIFY row_number() OVER (PARTITION BY id, p ORDER BY d, j) = 1)")
        if k < 6:
            out.append(
                f"book{k + 1} AS MATERIALIZED (SELECT p, j, coalesce(m.es, b.es) AS es FROM book{k} b LEFT JOIN (SELECT p, j, list(floor(s::DOUBLE / n)::BIGINT ORDER BY i) AS es FROM"
                f" (SELECT p, j, i, sum(xs[i])::BIGINT AS s, count(*) AS n FROM (SELECT p, j, xs, unnest(range(1, len(xs) + 1)) AS i FROM near{k}) GROUP BY p, j, i) GROUP BY p, j) m USING (p, j))"
            )
    return (
        "WITH " + ", ".join(out) + ", c AS (SELECT id, string_agg(printf('%02x', j), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near6 GROUP BY id)"
        " SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(es, ','), ',' ORDER BY p, j)) FROM book6) AS codebooks_sha256 FROM v JOIN c USING (id)"
    )


ORACLE_SQL = _sql()
