"""The eight images of grid texts by fixed permutations.

A grid of h rows of w tiles has eight tables of places, one for each image, and an image is one gather
from the text's bytes. Texts come by Arrow batch and are handled by shape. Texts with characters
beyond ASCII are permuted one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

NEWLINE = 10
IMAGES = 8


@lru_cache(256)
def places(h: int, w: int) -> list[np.ndarray]:
    """Of each image the places in the text that its characters come from; the place after the last stands for a new line."""
    grid = np.arange(h)[:, None] * (w + 1) + np.arange(w)
    end = h * (w + 1) - 1
    out = []
    for k in range(IMAGES):
        image = np.rot90(grid, -(k % 4))
        image = image[:, ::-1] if k >= 4 else image
        out.append(np.pad(image, ((0, 0), (0, 1)), constant_values=end).ravel()[:-1])
    return out


def shape(text: str) -> tuple[int, int] | None:
    """Rows and width of a text; None for a ragged one."""
    rows = text.split("\n")
    return (len(rows), len(rows[0])) if rows[0] and all(len(r) == len(rows[0]) for r in rows) else None


def shaped(texts: pa.Array) -> Iterator[tuple[np.ndarray, int, int, np.ndarray]]:
    """Row numbers, height, width and bytes (a new line added) of the ASCII grids of a batch, by shape."""
    texts = texts.cast(pa.large_binary())
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts)]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)
        m = data[offsets[rows, None] + np.arange(size)]
        ends = m == NEWLINE
        width = np.where(ends.any(axis=1), ends.argmax(axis=1), size)
        for w in np.unique(width[width > 0]):
            if (size + 1) % (w + 1):
                continue
            due = np.arange(1, size + 1) % (w + 1) == 0
            fit = (width == w) & (ends == due).all(axis=1) & (m < 128).all(axis=1)
            if fit.any():
                yield rows[fit], int((size + 1) // (w + 1)), int(w), np.pad(m[fit], ((0, 0), (0, 1)), constant_values=NEWLINE)


def others(texts: pa.Array, done: np.ndarray) -> Iterator[tuple[int, list[str]]]:
    """The images of grids beyond ASCII."""
    wide = pc.greater(pc.binary_length(texts.cast(pa.binary())), pc.utf8_length(texts)).fill_null(False).to_numpy(zero_copy_only=False)
    for i in np.flatnonzero(wide & ~done):
        text = texts[i].as_py()
        if grid := shape(text):
            at = [*text, "\n"]
            yield int(i), ["".join(at[p] for p in image) for image in places(*grid)]


def strings(m: np.ndarray) -> pa.Array:
    """Rows of bytes, all of one length, as texts."""
    offsets = (np.arange(len(m) + 1) * m.shape[1]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(m), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(m))).cast(pa.string())


def placed(n: int, parts: list[tuple[np.ndarray, pa.Array]], kind: pa.DataType) -> pa.Array:
    """An array of n values from parts of it with their row numbers; null elsewhere."""
    at = np.full(n, -1)
    start = 0
    for rows, values in parts:
        at[rows] = start + np.arange(len(rows))
        start += len(values)
    every = pa.concat_arrays([v for _, v in parts]) if parts else pa.array([], kind)
    return every.take(pa.array(at, mask=at < 0))


def all_images(texts: pa.Array) -> pa.Array:
    """The eight images of each text; null for ragged texts."""
    parts, done = [], np.zeros(len(texts), bool)
    for rows, h, w, m in shaped(texts):
        if h == w:
            flat = strings(np.stack([m[:, p] for p in places(h, w)], axis=1).reshape(-1, m.shape[1] - 1))
        else:
            order = np.arange(IMAGES * len(rows)).reshape(IMAGES, -1).T.ravel()
            flat = pa.concat_arrays([strings(m[:, p]) for p in places(h, w)]).take(pa.array(order))
        parts.append((rows, pa.ListArray.from_arrays(pa.array(np.arange(0, IMAGES * len(rows) + 1, IMAGES, dtype=np.int32)), flat)))
        done[rows] = True
    parts += [(np.array([i]), pa.array([x], pa.list_(pa.string()))) for i, x in others(texts, done)]
    return placed(len(texts), parts, pa.list_(pa.string()))


def one_image(texts: pa.Array, which: pa.Array) -> pa.Array:
    """Image `which` of each text; null for ragged texts and numbers beyond 0 to 7."""
    k = pc.fill_null(which, -1).to_numpy(zero_copy_only=False)
    parts, done = [], np.zeros(len(texts), bool)
    for rows, h, w, m in shaped(texts):
        for image in range(IMAGES):
            if (mine := k[rows] == image).any():
                parts.append((rows[mine], strings(m[mine][:, places(h, w)[image]])))
        done[rows] = True
    parts += [(np.array([i]), pa.array([x[k[i]]])) for i, x in others(texts, done) if 0 <= k[i] < IMAGES]
    return placed(len(texts), parts, pa.string())


def least_image(texts: pa.Array) -> pa.Array:
    """The least image of each text in binary order; null for ragged texts."""
    parts, done = [], np.zeros(len(texts), bool)
    for rows, h, w, m in shaped(texts):
        best, pick = None, np.zeros(len(rows), int)
        for k, p in enumerate(places(h, w)):
            image = np.ascontiguousarray(m[:, p])
            key = image.view(f"S{image.shape[1]}").ravel()
            if best is None:
                best = key
            else:
                less = key < best
                pick[less], best = k, np.where(less, key, best)
        parts += [(rows[pick == k], strings(m[pick == k][:, p])) for k, p in enumerate(places(h, w)) if (pick == k).any()]
        done[rows] = True
    parts += [(np.array([i]), pa.array([min(x)])) for i, x in others(texts, done)]
    return placed(len(texts), parts, pa.string())
