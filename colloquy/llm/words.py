"""Words and their hashes over whole batches of texts, as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64


def mixed(z: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
    return z ^ (z >> U(31))


def factors(n: int, seed: int) -> np.ndarray:
    return mixed((np.arange(n, dtype=U) + U(seed)) * U(0x9E3779B97F4A7C15)) | U(1)


def runs_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """bytes of all texts, start and length of each word (a run without blanks), and the text it is in."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.flatnonzero(np.diff(solid, prepend=False))
    starts, ends = edge[::2], edge[1::2]
    begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    return data, starts, ends - starts, np.searchsorted(begins, starts, side="right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of bytes: random factors by place, then mixed with the length."""
    if not len(starts):
        return np.zeros(0, dtype=U)
    offsets = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(offsets, lengths)
    at = place + np.repeat(starts, lengths)
    values = (data[at].astype(U) + U(1)) * factors(int(lengths.max()), 1)[place]
    return mixed(np.add.reduceat(values, offsets) + lengths.astype(U) * U(0xD6E8FEB86659FD93))


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, A-Z lower-cased if asked, and the text it is in."""
    data, starts, lengths, text = runs_of(texts)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    return hashes(data, starts, lengths), text


def in_slices(texts: pa.Array, most: int = 300_000) -> Iterator[tuple[int, list[bytes]]]:
    """Number of the first text and texts in UTF-8, of about `most` bytes together; null is empty. Never all of a batch at once."""
    first, held, size = 0, [], 0
    for k, t in enumerate(texts.cast(pa.binary())):
        held.append(t.as_py() or b"")
        size += len(held[-1])
        if size >= most:
            yield first, held
            first, held, size = k + 1, [], 0
    if held:
        yield first, held
