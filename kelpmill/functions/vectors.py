"""Vectors of a batch, in numpy inside a task: hashed tokens, and the nearest rows of a block."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text whose tokens are in memory at once; a longer text is a run by itself.
RUN_BYTES = 4_000_000


def runs(texts: pa.Array, most: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """(first, number) of runs of about most bytes of an array of texts."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, side="right")))
        yield at, to - at
        at = to


def hashed_places(texts: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, weight), by row and bucket, of the unit vectors of texts, whose tokens stand between single spaces. Each different token is hashed once."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
    coded = lists.flatten().dictionary_encode()
    buckets = np.array([int.from_bytes(hashlib.md5(t.encode()).digest()[:4], "big") % dimension if t else -1 for t in coded.dictionary.to_pylist()], np.int64)
    found = buckets[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    keys, n = np.unique((row * dimension + found)[found >= 0], return_counts=True)
    row, bucket = keys // dimension, keys % dimension
    norms = np.sqrt(np.bincount(row, weights=n.astype(float) ** 2, minlength=len(texts)))
    return row, bucket, n / norms[row]


def places_column(row: np.ndarray, bucket: np.ndarray, weight: np.ndarray, n: int) -> pa.Array:
    """list<struct<bucket, weight>> of n rows."""
    values = pa.StructArray.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(weight)], ["bucket", "weight"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), values)


def dense_column(row: np.ndarray, bucket: np.ndarray, weight: np.ndarray, n: int, dimension: int) -> pa.Array:
    """list<double> of n rows."""
    table = np.zeros((n, dimension))
    table[row, bucket] = weight
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dimension), pa.array(table.ravel()))


def lengths(vectors: pa.ChunkedArray) -> np.ndarray:
    """Of each vector; -1 for null."""
    return pc.fill_null(pc.list_value_length(vectors), -1).to_numpy()


def matrix(vectors: pa.ChunkedArray, dimension: int) -> np.ndarray:
    """The rows of a column of vectors of one length, or of lists of (bucket, weight)."""
    lists = vectors.combine_chunks()
    values = lists.flatten()
    if not pa.types.is_struct(values.type):
        return values.to_numpy(zero_copy_only=False).astype(float).reshape(-1, dimension)
    out = np.zeros((len(lists), dimension))
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    bucket, weight = (values.field(k).to_numpy(zero_copy_only=False) for k in range(2))
    out[row, bucket] = weight
    return out


def cosines(asked: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine of each asked vector with each row, to six places; 0 where either has no length."""
    norms = np.sqrt((asked * asked).sum(axis=1))[:, None] * np.sqrt((rows * rows).sum(axis=1))[None, :]
    dots = asked @ rows.T
    return np.round(np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0), 6) + 0.0


def nearest(scores: np.ndarray, order: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (asked, row) of each asked one's top rows by score, then by order."""
    most = int(min(top.max(), scores.shape[1]))
    if most < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    floor = np.partition(scores, scores.shape[1] - most, axis=1)[:, scores.shape[1] - most]
    asked, row = np.nonzero(scores >= floor[:, None])
    by = np.lexsort((order[row], -scores[asked, row], asked))
    asked, row = asked[by], row[by]
    nth = np.arange(len(asked)) - np.searchsorted(asked, asked)
    kept = nth < top[asked]
    return asked[kept], row[kept]
