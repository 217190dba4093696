"""Token ids in binary shards with Elias-Fano document boundaries (operator 2).

Documents are dealt by ranges of doc_id and sorted within a task; each task encodes its texts and writes shards.
A shard is one file: header, the ids of its documents one after another (2 bytes each if they fit, else 4), its
doc_ids, and the documents' end offsets in Elias-Fano form: low bits packed, high bits in unary, and a select
sample for every 64th boundary. An offset is found from a sample and a few popcounts; there is no table of
64-bit offsets. A task names its files by attempt, and only files named in the manifest (a table written through
Spark's commit) count, so a lost executor leaves nothing that is read. Offsets across shards come from prefix sums
over the manifest.

Defined cases: a null text is empty and yields the end id alone; a null doc_id sorts first and comes back null;
repeated rows are encoded each, side by side; an empty table gives an empty manifest and no rows; extra columns
are not read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain, islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, frugal, read_table, text_of, written

# Fixed values of the file format.
MAGIC = b"EFTOKEN1"
HEADER = "<8sQQQQB7x"  # magic, documents, ids, low bits a boundary, words of the high part, bytes an id
SAMPLE = 64  # boundaries a select sample
NO_DOC = -(2**63)

SHARD_IDS = 4_000_000
CACHED_WORDS = 1_200_000  # a worker forgets its words beyond this many
LONG_WORD = 64  # longer ones are not remembered
WORDWISE = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}  # a pre-tokenizer that allows to encode word by word
LINE = "\0"  # stands for a line feed before a word
MARKS = ".,!?;:"
SINGLE_BLANK = re.compile(r"(?<=\S) (?=\S)")


class EliasFano:
    """A non-decreasing sequence of numbers below 2**40: low bits packed, high bits in unary."""

    def __init__(self, n: int, low_bits: int, lows: np.ndarray, highs: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.lows, self.highs, self.samples = n, low_bits, lows, highs, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        v = values.astype(np.uint64)
        bits = ((v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        lows = np.packbits(bits.ravel(), bitorder="little")
        at = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        marks = np.zeros(-(-(int(at[-1]) + 1 if n else 0) // 64) * 64, dtype=np.uint8)
        marks[at] = 1
        highs = np.packbits(marks, bitorder="little").view("<u8")
        return cls(n, low_bits, lows, highs, at[::SAMPLE].astype("<u4"))

    def _low(self, i: int) -> int:
        first = i * self.low_bits
        got = int.from_bytes(self.lows[first // 8 : (first + self.low_bits + 7) // 8].tobytes(), "little")
        return (got >> (first % 8)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th number, from the sample before it and popcounts."""
        left, at = i % SAMPLE, int(self.samples[i // SAMPLE])
        word = at // 64
        rest = int(self.highs[word]) >> (at % 64) << (at % 64)  # the sampled mark is the lowest one left
        while (ones := rest.bit_count()) <= left:
            left, word = left - ones, word + 1
            rest = int(self.highs[word])
        for _ in range(left):
            rest &= rest - 1
        at = word * 64 + (rest & -rest).bit_length() - 1
        return ((at - i) << self.low_bits) | self._low(i)

    def all(self) -> np.ndarray:
        at = np.flatnonzero(np.unpackbits(self.highs.view(np.uint8), bitorder="little"))[: self.n]
        high = (at - np.arange(self.n)).astype(np.int64) << self.low_bits
        if not self.low_bits:
            return high
        bits = np.unpackbits(self.lows, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        return high + bits.astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))


def shard_bytes(doc_ids: list[int | None], ids: np.ndarray, ends: np.ndarray) -> bytes:
    wide = 2 if not len(ids) or int(ids.max()) < 65536 else 4
    ef = EliasFano.build(ends)
    head = struct.pack(HEADER, MAGIC, len(doc_ids), len(ids), ef.low_bits, len(ef.highs), wide)
    docs = np.array([NO_DOC if d is None else d for d in doc_ids], dtype="<i8")
    return b"".join([head, ids.astype(f"<u{wide}").tobytes(), docs.tobytes(), ef.lows.tobytes(), ef.highs.tobytes(), ef.samples.tobytes()])


def parse_shard(data: bytes) -> tuple[np.ndarray, np.ndarray, EliasFano]:
    """ids, doc_ids, end offsets."""
    magic, n, n_ids, low_bits, n_high, wide = struct.unpack_from(HEADER, data)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    at, parts = struct.calcsize(HEADER), []
    for kind, count in ((f"<u{wide}", n_ids), ("<i8", n), ("u1", -(-n * low_bits // 8)), ("<u8", n_high), ("<u4", -(-n // SAMPLE))):
        parts.append(np.frombuffer(data, kind, count, at))
        at += parts[-1].nbytes
    return parts[0], parts[1], EliasFano(n, low_bits, *parts[2:])


class WordEncoder:
    """Ids of whole texts. A byte-level tokenizer with the usual split (WORDWISE) never joins across a single blank or line
    feed between other characters, so a text's ids are its words' ids one after another; a worker remembers those of
    words it has met. Any other tokenizer encodes whole texts."""

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        self.cached = cached
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.wide = "<u2" if self.tok.get_vocab_size() <= 65536 else "<u4"
        how = json.loads(self.tok.to_str())
        self.wordwise = how["normalizer"] is None and how["post_processor"] is None and (how["pre_tokenizer"] or {}).items() >= WORDWISE.items()
        self.known: dict[str, bytes | None] = {}  # by word: ids of the blank and the word; after LINE, of line feed and word
        self.learning = True
        self.feed, *marks = self._encode(["\n", *MARKS])
        self.marks = dict(zip(MARKS, marks, strict=True))

    def _encode(self, parts: list[str]) -> list[bytes]:
        got = [e.ids for e in self.tok.encode_batch_fast(parts, add_special_tokens=False)]
        ids, width = memoryview(np.fromiter(chain.from_iterable(got), self.wide).tobytes()), np.dtype(self.wide).itemsize
        ends = list(accumulate((width * len(x) for x in got), initial=0))
        return [bytes(ids[i:j]) for i, j in pairwise(ends)]

    def _learn(self, new: set[str]) -> None:
        """None marks what can't stand alone: an empty word or one that white space begins or ends."""
        known, stems = self.known, {}
        for w in new:
            stem = w[:-1] if w[-1:] in self.marks and w[:-1].isalpha() else w  # a mark after letters stands by itself
            body = stem[1:] if stem[:1] == LINE else stem
            if not body or body[0].isspace() or body[-1].isspace() or LINE in body:
                known[w] = None
            else:
                stems.setdefault(stem, []).append(w)
        todo = [x for x in stems if x not in known]
        got = dict(zip(todo, self._encode([x[1:] if x[0] == LINE else " " + x for x in todo]), strict=True))
        for x in todo:
            known[x] = self.feed + got[x] if x[0] == LINE else got[x]
        for x, words in stems.items():
            known.update((w, known[x] + self.marks[w[-1]]) for w in words if w != x)

    def batch(self, texts: list[str]) -> list[bytes]:
        if not self.wordwise:
            return self._encode(texts)
        if len(self.known) > self.cached:
            self.known = {}
        docs = [t.replace("\n", " " + LINE).split(" ") for t in texts]
        firsts = self._encode([d[0] for d in docs])
        out = [None if self.learning else self._joined(*x) for x in zip(texts, firsts, docs, strict=True)]
        late = [k for k, got in enumerate(out) if got is None]  # with words that are not known yet, or can't stand alone
        new = set(chain.from_iterable(islice(docs[k], 1, None) for k in late)).difference(self.known)
        self.learning = 2 * len(new) > len(docs)  # then most texts of the next batch have new words too
        self._learn(new)
        for k in late:
            got = self._joined(texts[k], firsts[k], docs[k])
            out[k] = self._careful(texts[k]) if got is None else got
        for w in new:
            if len(w) > LONG_WORD:
                self.known.pop(w, None)
        return out

    def _joined(self, text: str, first: bytes, words: list[str]) -> bytes | None:
        """The ids of a text if all its words are known and can stand alone: one look at each word. White space beside a blank or line feed can't."""
        if not text or text[0].isspace() or words[0][-1:].isspace() or LINE in text:
            return None
        try:
            return first + b"".join(map(self.known.get, islice(words, 1, None)))
        except TypeError:
            return None

    def _careful(self, text: str) -> bytes:
        return b"".join(self._encode([(" " if k else "") + p for k, p in enumerate(SINGLE_BLANK.split(text))])) if text else b""


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def slices(texts: pa.Array, most: int = 2_000_000) -> Iterator[tuple[int, list[str]]]:
    """Number of the first text and texts, of about `most` bytes together."""
    begin, held = 0, 0
    for k, n in enumerate(pc.binary_length(texts).to_pylist()):
        held += n
        if held >= most or k == len(texts) - 1:
            yield begin, texts.slice(begin, k + 1 - begin).to_pylist()
            begin, held = k + 1, 0


def encoded(docs: DataFrame, tokenizer: str, end_id: int | None = None, keep_ids: bool = False, cached: int = CACHED_WORDS) -> DataFrame:
    """row (a number of its own once written), doc_id, size (ids, the end id included) and, if asked, ids (little-endian,
    2 bytes each if the vocabulary fits, else 4). A null or empty text has none, not even the end id. cached: words that a worker remembers, 250 bytes each;
    if given, only for the length of a task."""

    @frugal
    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer) if cached == CACHED_WORDS else WordEncoder(tokenizer, cached)
        end = b"" if end_id is None else np.array([end_id], dtype=enc.wide).tobytes()
        for b in batches:
            for first, texts in slices(b.column(1)):
                got = [x + end if x else x for x in enc.batch(texts)]
                columns = [b.column(0).slice(first, len(texts)), pa.array([len(x) // np.dtype(enc.wide).itemsize for x in got], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(got, pa.binary())] if keep_ids else columns, ["doc_id", "size", "ids"][: 2 + keep_ids])

    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(per_task, "doc_id long, size long" + ", ids binary" * keep_ids)
    return rows.withColumn("row", F.monotonically_increasing_id())


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, shard_ids: int = SHARD_IDS) -> DataFrame:
    """The manifest: part, seq, file, n_docs, n_ids, base (ids of all shards before it)."""

    @frugal
    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root)
        end = np.array([end_id], dtype=enc.wide).tobytes()
        held: tuple[list, list, int] = ([], [], 0)

        def flush(doc_ids: list, parts: list) -> pa.RecordBatch:
            nonlocal seq
            ids = np.frombuffer(b"".join(parts), dtype=enc.wide)
            ends = np.cumsum([len(p) // ids.itemsize for p in parts])
            name = f"{part:07d}-{seq:05d}-{uuid.uuid4().hex}.eft"
            with fs.open_output_stream(f"{root}/{name}") as f:
                f.write(shard_bytes(doc_ids, ids, ends))
            row = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "file": name, "n_docs": len(doc_ids), "n_ids": len(ids)}], schema=manifest)
            seq += 1
            return row

        manifest = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
        for b in batches:
            for first, texts in slices(b.column(1)):
                for d, got in zip(b.column(0).slice(first, len(texts)).to_pylist(), enc.batch(texts), strict=True):
                    held[0].append(d)
                    held[1].append(got + end)
                    held = (held[0], held[1], held[2] + len(got) + len(end))
                    if held[2] >= shard_ids * len(end):
                        yield flush(held[0], held[1])
                        held = ([], [], 0)
        if held[0]:
            yield flush(held[0], held[1])

    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    done = written(rows.mapInArrow(per_task, "part int, seq int, file string, n_docs long, n_ids long"), "manifest")
    parts = done.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_ids")
    return done.withColumn("inside", inside).join(before, "part").withColumn("base", F.col("before") + F.col("inside")).drop("before", "inside")


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of every document in the shards named in the manifest."""

    @frugal
    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{name}") as f:
                    ids, doc_ids, ends = parse_shard(f.read())
                stops = ends.all()
                starts = np.append(0, stops[:-1]).astype(np.int64)
                offsets = pa.array(np.append(0, stops).astype(np.int32), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=doc_ids == NO_DOC), pa.array(starts + base), pa.array(stops - starts), lists], ["doc_id", "start", "n_tokens", "ids"])

    return manifest.select("file", "base").repartition("file").mapInArrow(per_task, "doc_id long, start long, n_tokens long, ids array<int>")


def shard_digests(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; ids are digested where they are read."""

    @frugal
    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{name}") as f:
                    ids, doc_ids, ends = parse_shard(f.read())
                stops, view = ends.all(), memoryview(ids.astype("<u4").tobytes())
                starts = np.append(0, stops[:-1]).astype(np.int64)
                crcs = [zlib.crc32(view[4 * i : 4 * j]) for i, j in zip(starts.tolist(), stops.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=doc_ids == NO_DOC), pa.array(starts + base), pa.array(stops - starts), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.select("file", "base").repartition("file").mapInArrow(per_task, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = fresh_path(spark, "token-shards")
    manifest = write_shards(read_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return shard_digests(manifest, folder)
