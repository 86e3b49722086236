"""Terms of whole batches of texts as spans of one byte array: a table says what each byte becomes, and 0 parts terms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def byte_table(digits: bool) -> np.ndarray:
    """Letters become their lower case, bytes of characters outside ASCII and, if wanted, digits themselves; others part terms."""
    table = np.zeros(256, "u1")
    table[ord("A"):ord("Z") + 1] = table[ord("a"):ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
    table[128:] = np.arange(128, 256)
    if digits:
        table[ord("0"):ord("9") + 1] = np.arange(ord("0"), ord("9") + 1)
    return table


def spans(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mapped bytes of all texts, where each term starts, its length, and the number of its text. No text may be NULL."""
    data = texts.cast(pa.large_binary())
    ends = np.frombuffer(data.buffers()[1], "int64")[data.offset:data.offset + len(data) + 1]
    raw = np.frombuffer(data.buffers()[2] or b"", "u1")[ends[0]:ends[-1]]
    mapped, ends = table[raw], ends - ends[0]
    inside = np.concatenate([[False], mapped != 0, [False]])
    edges = inside[1:] != inside[:-1]
    starts, stops = np.flatnonzero(edges & inside[1:]), np.flatnonzero(edges & inside[:-1])
    # Terms that touch at a border between texts are parted there.
    borders = np.unique(ends[1:-1])
    borders = borders[inside[borders] & inside[borders + 1]]
    starts, stops = (np.sort(np.concatenate([side, borders])) for side in (starts, stops))
    return mapped, starts, stops - starts, np.searchsorted(ends, starts, side="right") - 1


def term_array(mapped: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The terms of ``spans`` as an Arrow array: what is not 0, one term after another."""
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype("int64")
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(mapped[mapped != 0])])
