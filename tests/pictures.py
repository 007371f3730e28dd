"""Small pictures as files, and a PNG reader for tests."""

import struct
import zlib

import numpy as np

from kindred.functions import image_hash


def png(pixels: np.ndarray) -> bytes:
    pixels = np.asarray(pixels, dtype=np.uint8)
    height, width = pixels.shape[:2]
    colour = 0 if pixels.ndim == 2 else 2

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    lines = b"".join(b"\0" + row.tobytes() for row in pixels)
    head = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    return (
        b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    )


def read_png(content: bytes) -> np.ndarray:
    """32x32 grey block of a picture written by :func:`png`."""
    if content[:4] != b"\x89PNG":
        raise ValueError("not a picture")
    width, height, _, colour = struct.unpack(">IIBB", content[16:26])
    channels = 1 if colour == 0 else 3
    at = content.index(b"IDAT")
    size = struct.unpack(">I", content[at - 4 : at])[0]
    lines = np.frombuffer(zlib.decompress(content[at + 4 : at + 4 + size]), np.uint8)
    pixels = lines.reshape(height, 1 + width * channels)[:, 1:].reshape(height, width, channels)
    return image_hash.shrink(image_hash.grey_of(pixels[:, :, ::-1]))


def smooth(seed: int, side: int = 64) -> np.ndarray:
    """A smooth random picture of the given size."""
    rng = np.random.default_rng(seed)
    y, x = (np.mgrid[0:side, 0:side] + 0.5) / side
    total = np.zeros((side, side))
    for u in range(8):
        for v in range(8):
            total += rng.normal() * np.cos(np.pi * u * x) * np.cos(np.pi * v * y)
    total -= total.min()
    return (40 + 160 * total / total.max()).astype(np.uint8)
