"""Texts of Arrow batches in pieces of bounded size, as UTF-8 bytes and numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20  # texts handled together; a longer text is a piece of its own


def pieces(batch: pa.RecordBatch, size: int = PIECE_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts have about ``size`` bytes in sum."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    if not len(sizes):
        return
    ends = np.cumsum(sizes.astype(np.int64) + 1)
    cuts = np.flatnonzero(np.diff((ends - 1) // size)) + 1
    for low, high in zip(np.r_[0, cuts], np.r_[cuts, len(sizes)], strict=True):
        yield batch.slice(int(low), int(high - low))


def joined(texts: pa.Array, separator: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, ``separator`` after each, and each text's start with the end of all.

    A null text is empty.
    """
    raw = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
    sizes = np.fromiter((len(t) for t in raw), np.int64, len(raw))
    starts = np.r_[0, np.cumsum(sizes + len(separator))]
    data = separator.join(raw) + separator if raw else b""
    return np.frombuffer(data, np.uint8), starts


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Lists ``values[offsets[i]:offsets[i + 1]]``."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
