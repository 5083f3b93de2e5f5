"""Texts of an Arrow batch as one buffer of bytes, and what numpy does with it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text worked on at a time: memory follows this and the longest text, not the batch.
STEP = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a string column, one after the other, and where each begins (one more at the end). Null: empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(batch: pa.RecordBatch, text: str):
    """Slices of a batch of STEP bytes of text (a string or binary column) or a single row."""
    sizes = pc.binary_length(batch.column(batch.schema.get_field_index(text))).fill_null(0).to_numpy()
    begin = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and total + n > STEP:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield batch.slice(begin)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finalizer of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_POWERS = mix(np.arange(1, (1 << 16) + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] of disjoint ascending spans, none of them empty."""
    out = np.empty(len(starts), U64)
    sizes = ends - starts
    total = np.cumsum(sizes)
    begin = 0
    while begin < len(starts):
        done = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, done + STEP)))
        n, at = sizes[begin:end], np.zeros(end - begin, np.int64)
        np.cumsum(n[:-1], out=at[1:])
        place = np.arange(int(n.sum())) - np.repeat(at, n)
        chars = data[place + np.repeat(starts[begin:end], n)]
        spread = (chars.astype(U64) + U64(1)) * _POWERS[place & 0xFFFF]
        part = np.add.reduceat(spread, at) + mix(n.astype(U64))
        out[begin:end] = part + _blocks(chars, at, n) if n.max() > 1 << 16 else part
        begin = end
    return mix(out)


def _blocks(chars: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Part of the hash that tells the 64 KB blocks of very long spans apart."""
    out = np.zeros(len(at), U64)
    for i in np.flatnonzero(n > 1 << 16):
        text = chars[at[i] : at[i] + n[i]]
        for k in range(0, len(text), 1 << 16):
            part = text[k : k + (1 << 16)]
            out[i] = mix(out[i : i + 1] + U64(k) + ((part.astype(U64) + U64(1)) * _POWERS[: len(part)]).sum())[0]
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and how many words stand before each text (one more at the end)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~blank[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    cuts = cuts[inside[cuts] & inside[cuts + 1]]  # a text ends within a run of word characters
    if len(cuts):
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends, np.searchsorted(starts, offsets)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All integers of the ranges [start, start + size), one range after the other."""
    before = np.zeros(len(sizes), np.int64)
    np.cumsum(sizes[:-1], out=before[1:])
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)
