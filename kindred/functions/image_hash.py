"""DCT perceptual hash of grey images, on NumPy arrays inside Spark tasks."""

from __future__ import annotations

import io
from collections.abc import Iterable
from functools import reduce

import numpy as np

# Side of the resized image and of the kept low frequencies,
# the grey weights (in 1/65536), and the Lanczos radius.
SIDE = 32
KEPT = 8
GREY_WEIGHTS = (19595, 38470, 7471)
LANCZOS_RADIUS = 3.0


def cosine_rows() -> np.ndarray:
    """The first 8 rows of the orthonormal 32-point DCT-II."""
    u, x = np.meshgrid(np.arange(KEPT), np.arange(SIDE), indexing="ij")
    scale = np.where(u == 0, np.sqrt(1 / SIDE), np.sqrt(2 / SIDE))
    return scale * np.cos(np.pi * (2 * x + 1) * u / (2 * SIDE))


def _added(terms: Iterable[np.ndarray]) -> np.ndarray:
    """Sum in the order of the terms; ``np.sum`` and BLAS choose an order of their own."""
    return reduce(np.add, terms)


def _corner(blocks: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The 8x8 low frequencies of an (n, side, side) stack, columns first, each added in order."""
    places = range(blocks.shape[1])
    half = _added(rows[:, x][:, None] * blocks[:, None, :, x] for x in places)
    return _added(rows[:, y][:, None] * half[:, None, :, y] for y in places)


def hash_blocks(blocks: np.ndarray) -> np.ndarray:
    """Signed 64-bit hashes of an (n, 32, 32) stack of grey blocks.

    Only the 8x8 corner is computed, for the whole stack at once, in doubles:
    with single precision values that differ in the sixth digit change places
    around the median.  Values that are equal as real numbers are told apart by
    rounding alone, so the order of the additions is fixed.  Blocks made of
    equal 4x4 pixels take each of these once, with the sum of its weights.
    """
    rows, cell = cosine_rows(), SIDE // KEPT
    grid = blocks.reshape(-1, KEPT, cell, KEPT, cell).astype(np.float64)
    coarse = (grid == grid[:, :, :1, :, :1]).all(axis=(1, 2, 3, 4))
    corner = np.empty((len(blocks), KEPT, KEPT))
    corner[coarse] = _corner(grid[coarse, :, 0, :, 0], _added(rows[:, i::cell] for i in range(cell)))
    corner[~coarse] = _corner(blocks[~coarse].astype(np.float64), rows)
    values = corner.reshape(len(blocks), KEPT * KEPT)
    cut = np.median(values[:, 1:], axis=1, keepdims=True)
    weights = np.left_shift(np.uint64(1), np.arange(63, -1, -1, dtype=np.uint64))
    return np.where(values >= cut, weights, np.uint64(0)).sum(axis=1, dtype=np.uint64).view(np.int64)


# Weights by length, kept per worker for the lengths seen last.
RESIZE_ROWS: dict[int, np.ndarray] = {}
RESIZE_KEPT = 64


def resize_rows(length: int) -> np.ndarray:
    """32 x ``length`` matrix of antialiased Lanczos weights."""
    if length not in RESIZE_ROWS:
        scale = length / SIDE
        centre = (np.arange(SIDE)[:, None] + 0.5) * scale
        t = (np.arange(length)[None, :] + 0.5 - centre) / max(scale, 1.0)
        weights = np.where(np.abs(t) < LANCZOS_RADIUS, np.sinc(t) * np.sinc(t / LANCZOS_RADIUS), 0.0)
        if len(RESIZE_ROWS) >= RESIZE_KEPT:
            RESIZE_ROWS.clear()
        RESIZE_ROWS[length] = weights / weights.sum(axis=1, keepdims=True)
    return RESIZE_ROWS[length]


def _to_bytes(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(values + 0.5), 0, 255)


def shrink(grey: np.ndarray) -> np.ndarray:
    """Resize a grey image to 32x32, rounding to 8 bits after each direction."""
    height, width = grey.shape
    wide = grey.astype(np.float64)
    if width != SIDE:
        wide = _to_bytes(wide @ resize_rows(width).T)
    if height != SIDE:
        wide = _to_bytes(resize_rows(height) @ wide)
    return wide.astype(np.float32)


def grey_of(bgr: np.ndarray) -> np.ndarray:
    """Grey image of an (h, w, channels) array in Spark's channel order."""
    if bgr.shape[2] == 1:
        return bgr[:, :, 0]
    red, green, blue = (bgr[:, :, c].astype(np.uint32) for c in (2, 1, 0))
    r, g, b = GREY_WEIGHTS
    return ((r * red + g * green + b * blue + 0x8000) >> 16).astype(np.uint8)


def upright(grey: np.ndarray, orientation: int) -> np.ndarray:
    """Undo one of the eight EXIF orientations."""
    if orientation in (5, 6, 7, 8):
        grey = grey.T
    if orientation in (2, 3, 6, 7):
        grey = grey[:, ::-1]
    if orientation in (3, 4, 7, 8):
        grey = grey[::-1, :]
    return grey


def exif_orientation(stream) -> int:
    """EXIF orientation of a JPEG, PNG or TIFF file, 1 when there is none.

    ``stream`` can seek; pixels are passed over.
    """
    mark = stream.read(8)
    if mark[:2] == b"\xff\xd8":
        return _jpeg_orientation(stream)
    if mark == b"\x89PNG\r\n\x1a\n":
        return _png_orientation(stream)
    return _tiff_orientation(stream, 0)


def _jpeg_orientation(stream) -> int:
    stream.seek(2)
    while True:
        head = stream.read(4)
        if len(head) < 4 or head[0] != 0xFF or head[1] == 0xDA:
            return 1
        end = stream.tell() + int.from_bytes(head[2:], "big") - 2
        if head[1] == 0xE1 and stream.read(6) == b"Exif\0\0":
            return _tiff_orientation(stream, stream.tell())
        stream.seek(end)


def _png_orientation(stream) -> int:
    while True:
        head = stream.read(8)
        if len(head) < 8 or head[4:] == b"IEND":
            return 1
        if head[4:] == b"eXIf":
            return _tiff_orientation(stream, stream.tell())
        stream.seek(stream.tell() + int.from_bytes(head[:4], "big") + 4)


def _tiff_orientation(stream, start: int) -> int:
    """Orientation in the first directory of TIFF data that begins at ``start``."""
    stream.seek(start)
    head = stream.read(8)
    if head[:4] not in (b"II*\0", b"MM\0*"):
        return 1
    order = "little" if head[:2] == b"II" else "big"
    stream.seek(start + int.from_bytes(head[4:], order))
    entries = stream.read(12 * int.from_bytes(stream.read(2), order))
    for at in range(0, len(entries) - 11, 12):
        if int.from_bytes(entries[at : at + 2], order) == 0x0112:
            found = int.from_bytes(entries[at + 8 : at + 10], order)
            return found if 1 <= found <= 8 else 1
    return 1


def pillow_block(content: bytes) -> np.ndarray:
    """32x32 grey block of an encoded image, decoded by Pillow."""
    from PIL import Image, ImageOps

    try:
        import pillow_heif

        pillow_heif.register_heif_opener()
    except ImportError:
        pass
    with Image.open(io.BytesIO(content)) as opened:
        grey = ImageOps.exif_transpose(opened).convert("L")
        small = grey.resize((SIDE, SIDE), resample=Image.Resampling.LANCZOS)
    return np.asarray(small, dtype=np.float32)
