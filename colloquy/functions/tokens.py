"""Token counts, ids and cuts by a tokenizer's file. The file is loaded once in each Python worker; texts go there in Arrow batches,
of which a slice is encoded at a time: an encoding takes many times the bytes of its text."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

ELLIPSIS = "…"
SLICE_BYTES = 1 << 20  # of texts, encoded at once
SLICE_IDS = 1 << 18  # decoded at once


@lru_cache(maxsize=4)
def loaded(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are text
    return tokenizer


def _cuts(sizes: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Half-open runs of entries that reach `most` together, or are the last."""
    begin, held = 0, 0
    for k, n in enumerate(sizes.fill_null(0).to_pylist()):
        held += n
        if held >= most or k == len(sizes) - 1:
            yield begin, k + 1
            begin, held = k + 1, 0


def _encodings(path: str, texts: pa.Array) -> Iterator[list]:
    for i, j in _cuts(pc.binary_length(texts), SLICE_BYTES):
        yield loaded(path).encode_batch_fast([t or "" for t in texts.slice(i, j - i).to_pylist()], add_special_tokens=False)


def ids(path: str) -> Callable[[Column], Column]:
    """A text's ids; null has none."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        found = [np.array(e.ids, np.int32) for part in _encodings(path, texts) for e in part]
        ends = pa.array(list(accumulate(map(len, found), initial=0)), pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.int32), *found])))

    return encode


def count(path: str) -> Callable[[Column], Column]:
    """The number of a text's ids."""

    @F.arrow_udf("int")
    def counted(texts: pa.Array) -> pa.Array:
        return pa.array([len(e) for part in _encodings(path, texts) for e in part], pa.int32())

    return counted


def text_of(path: str) -> Callable[[Column], Column]:
    """The text of ids. Where ids end within a character, it shows as the sign of a broken one."""

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        out = []
        for i, j in _cuts(lists.value_lengths(), SLICE_IDS):
            out += loaded(path).decode_batch([x or [] for x in lists.slice(i, j - i).to_pylist()], skip_special_tokens=False)
        return pa.array(out, pa.string())

    return decode


def cut(path: str) -> Callable[[Column, Column, Column], Column]:
    """A body in k pieces of equal numbers of ids, each behind the prefix; a piece without text shows an ellipsis. Only bodies that are cut leave the JVM."""

    @F.arrow_udf("array<string>")
    def pieces(bodies: pa.Array, parts: pa.Array) -> pa.Array:
        out = []
        ids = (e.ids for part in _encodings(path, bodies) for e in part)
        for body, k in zip(ids, parts.to_pylist(), strict=True):
            step = -(-len(body) // (k or 1))
            out.append([x.strip() or ELLIPSIS for x in loaded(path).decode_batch([body[i * step : (i + 1) * step] for i in range(k or 0)], skip_special_tokens=False)] if body else None)
        return pa.array(out, pa.list_(pa.string()))

    def cut_up(prefix: Column, body: Column, k: Column) -> Column:
        got = pieces(F.when(k > 1, body), F.when(k > 1, k))
        return F.when((k > 1) & got.isNotNull(), F.transform(got, lambda x: F.concat(prefix, x))).otherwise(F.array(F.concat(prefix, body)))

    return cut_up
