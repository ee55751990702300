"""Pictures as arrays of (height, width, 3) bytes: PNG text, resizing, and the drawing of tiles."""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np

BACKGROUND, STRIP, INK = 0x1A, 0, 255
#: Left margin of a label in its strip.
INSET = 6
#: The 5 by 7 dots of the letters of a label, a row as a number of five bits.
GLYPHS = {
    "0": (14, 17, 19, 21, 25, 17, 14), "1": (4, 12, 4, 4, 4, 4, 14), "2": (14, 17, 1, 2, 4, 8, 31), "3": (31, 2, 4, 2, 1, 17, 14), "4": (2, 6, 10, 18, 31, 2, 2),
    "5": (31, 16, 30, 1, 1, 17, 14), "6": (6, 8, 16, 30, 17, 17, 14), "7": (31, 1, 2, 4, 8, 8, 8), "8": (14, 17, 17, 14, 17, 17, 14), "9": (14, 17, 17, 15, 1, 2, 12),
    "F": (31, 16, 16, 30, 16, 16, 16), "t": (8, 8, 28, 8, 8, 9, 6), "s": (0, 0, 15, 16, 14, 1, 30), "=": (0, 0, 31, 0, 31, 0, 0), ".": (0, 0, 0, 0, 0, 12, 12), "-": (0, 0, 0, 31, 0, 0, 0),
}
_MAGIC = b"\x89PNG\r\n\x1a\n"


def png(picture: np.ndarray) -> bytes:
    """Lossless, without filters."""
    high, wide, _ = picture.shape
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.concatenate([np.zeros((high, 1), np.uint8), picture.reshape(high, -1)], axis=1).tobytes()
    return _MAGIC + part(b"IHDR", struct.pack(">IIBBBBB", wide, high, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows, 6)) + part(b"IEND", b"")


def opened(data: bytes) -> np.ndarray:
    """A picture from ``png``; other forms need Pillow."""
    if data[:8] == _MAGIC and data[24:26] == b"\x08\x02":
        wide, high = struct.unpack(">II", data[16:24])
        at, body = 8, b""
        while at < len(data):
            size = struct.unpack(">I", data[at : at + 4])[0]
            if data[at + 4 : at + 8] == b"IDAT":
                body += data[at + 8 : at + 8 + size]
            at += size + 12
        rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(high, 1 + 3 * wide)
        if not rows[:, 0].any():
            return rows[:, 1:].reshape(high, wide, 3).copy()
    try:
        from PIL import Image
    except ImportError as error:
        raise ValueError("pictures other than plain PNG need Pillow") from error
    return np.asarray(Image.open(io.BytesIO(data)).convert("RGB"))


def split(data: bytes) -> list[bytes]:
    """The PNG pictures that follow one another in ``data``."""
    out, at = [], 0
    while data[at : at + 8] == _MAGIC:
        first, kind = at, b""
        at += 8
        while kind != b"IEND":
            size, kind = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8]
            at += size + 12
        out.append(data[first:at])
    return out


def _weights(of: int, to: int) -> np.ndarray:
    """Rows of Lanczos weights of three lobes, one for each of ``to`` places over ``of`` pixels."""
    scale = max(of / to, 1.0)
    place = (np.arange(to) + 0.5) * of / to - 0.5
    far = (np.arange(of)[None, :] - place[:, None]) / scale
    weight = np.where(np.abs(far) < 3, np.sinc(far) * np.sinc(far / 3), 0.0)
    return weight / weight.sum(1, keepdims=True)


def resized(picture: np.ndarray, wide: int, high: int) -> np.ndarray:
    out = np.einsum("ij,jkc->ikc", _weights(picture.shape[0], high), picture.astype(np.float64))
    out = np.einsum("ij,kjc->kic", _weights(picture.shape[1], wide), out)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def write_label(picture: np.ndarray, left: int, top: int, text: str, size: int) -> None:
    """Draw ``text`` in letters about ``size`` pixels high; what leaves the picture is cut."""
    dot = max(1, size // 9)
    for letter in text:
        for y, bits in enumerate(GLYPHS.get(letter, ())):
            for x in range(5):
                if bits >> (4 - x) & 1:
                    picture[top + y * dot : top + (y + 1) * dot, left + x * dot : left + (x + 1) * dot] = INK
        left += (6 if letter != " " else 4) * dot


def drawn(pictures: list[np.ndarray], labels: list[str], cols: int, cell: tuple[int, int], whole: tuple[int, int], label_height: int, gap: int, font: int, inset: int) -> np.ndarray:
    """A tile of ``whole`` (width, height): pictures in cells row by row, each over its label."""
    wide, high = cell
    tile = np.full((whole[1], whole[0], 3), BACKGROUND, np.uint8)
    for k, (picture, label) in enumerate(zip(pictures, labels, strict=True)):
        left, top = k % cols * (wide + gap), k // cols * (high + label_height + gap)
        tile[top : top + high, left : left + wide] = resized(picture, wide, high)
        strip = tile[top + high : top + high + label_height, left : left + wide]
        strip[:] = STRIP
        write_label(strip, INSET, inset, label, font)
    return tile
