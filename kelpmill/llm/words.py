"""Words of a batch of texts and their 64-bit hashes, in numpy inside a task."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text whose arrays are in memory at once; a longer text takes more only for its words.
SEGMENT_BYTES = 500_000
#: Words of more bytes are hashed one by one: the sums below give certain long words one hash, whatever their base.
SUMMED_BYTES = 64

_draw = np.random.default_rng(20240229)
_BYTE = _draw.integers(0, 2**64, 256, dtype=np.uint64)
_ODD = [int(x) | 1 for x in _draw.integers(2**60, 2**63, 16, dtype=np.uint64)]
_BASE = _ODD[0]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SEGMENT_BYTES + 4096)
        with np.errstate(over="ignore"):
            _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]).cumprod(dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 2**64))]
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values, as Murmur's last step does."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the words of data, which ends with a space."""
    space = _SPACE[data]
    edges = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edges[::2], edges[1::2]
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    for k in np.flatnonzero(ends - starts > SUMMED_BYTES):
        hashes[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8).digest(), "little")
    return starts, hashes


class Words(NamedTuple):
    hashes: np.ndarray
    #: Of each text, the place of its first word; one more at the end.
    first: np.ndarray


def words_of(texts: list[bytes], lower: bool = False) -> Words:
    """The word hashes of texts, which are UTF-8; texts are cut at spaces if they are longer than a segment."""
    joined = np.frombuffer(b"".join(t + b" " for t in texts), np.uint8)
    if lower:
        joined = _LOWER[joined]
    ends = np.cumsum([0] + [len(t) + 1 for t in texts])
    at, found, places = 0, [], []
    while at < len(joined):
        to = min(len(joined), at + SEGMENT_BYTES)
        while to < len(joined) and not _SPACE[joined[to - 1]]:
            step = np.flatnonzero(_SPACE[joined[to : to + 4096]])
            to += int(step[0]) + 1 if len(step) else 4096
        to = min(to, len(joined))
        starts, hashes = _hashes(joined[at:to])
        found.append(hashes)
        places.append(starts + at)
        at = to
    if not found:
        return Words(np.zeros(0, np.uint64), np.zeros(1, np.int64))
    return Words(np.concatenate(found), np.searchsorted(np.concatenate(places), ends))


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text) of all windows of size words inside one text; texts are places in the batch."""
    n = len(words.hashes) - size + 1
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    mix = np.zeros(n, np.uint64)
    for k in range(size):
        mix += words.hashes[k : k + n] * np.uint64(_ODD[k + 1])
    return mix, text[:n]


def batches_of(texts: list[bytes], most: int = SEGMENT_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first, texts) in runs of about most bytes."""
    at, run, size = 0, [], 0
    for k, t in enumerate(texts):
        run.append(t)
        size += len(t)
        if size >= most:
            yield at, run
            at, run, size = k + 1, [], 0
    if run:
        yield at, run


def runs(texts: pa.Array, most: int = SEGMENT_BYTES) -> Iterator[tuple[int, int]]:
    """(first, number) of runs of about most bytes of an Arrow array of texts; a longer text is a run by itself."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if held and held + size > most:
            yield at, k - at
            at, held = k, 0
        held += size
    if at < len(sizes):
        yield at, len(sizes) - at


def slices(batches: Iterator[pa.RecordBatch], text: int, most: int = SEGMENT_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about most bytes in column text, so that a worker makes Python values of a few rows at a time."""
    for batch in batches:
        for at, n in runs(batch.column(text), most):
            yield batch.slice(at, n)
