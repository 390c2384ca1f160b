"""Lists of strings of an Arrow batch as numbers, without a Python object for each string."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def spans(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The lists' values, and where each list begins and how many it has (none for null)."""
    return column.values, column.offsets.to_numpy()[:-1].astype(np.int64), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def numbered(column: pa.Array, numbers: dict[str, int], other: int) -> list[bytes]:
    """Each list as the bytes of its values' numbers (int32); values without a number have `other`."""
    values, starts, sizes = spans(column)
    coded = values.dictionary_encode(null_encoding="encode")
    own = np.array([numbers.get(t, other) for t in coded.dictionary.to_pylist()], np.int32)
    data = (own[coded.indices.to_numpy()] if len(values) else own).tobytes()
    return [data[a:b] for a, b in zip((4 * starts).tolist(), (4 * (starts + sizes)).tolist(), strict=True)]


def matrix(rows: list[bytes], width: int) -> np.ndarray:
    """The numbers of such lists (row, width); behind shorter ones there are zeros."""
    return np.frombuffer(b"".join([r.ljust(4 * width, b"\0") for r in rows]), np.int32).reshape(-1, width)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i] .. starts[i] + sizes[i] - 1, one range after the other."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
