"""Images as arrays: heat, rectangles, labels and lines on frames, and PNG files of them."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from ..operators.overlay import TURBO

#: Colours of tubes in turn (the ten of a public qualitative palette).
PALETTE = np.array([(31, 119, 180), (255, 127, 14), (44, 160, 44), (214, 39, 40), (148, 103, 189), (140, 86, 75), (227, 119, 194), (127, 127, 127), (188, 189, 34), (23, 190, 207)], np.uint8)
#: Rows of 3 x 5 signs, as numbers of three bits.
SIGNS = {"T": (7, 2, 2, 2, 2), "0": (7, 5, 5, 5, 7), "1": (2, 6, 2, 2, 7), "2": (7, 1, 7, 4, 7), "3": (7, 1, 3, 1, 7), "4": (5, 5, 7, 1, 1), "5": (7, 4, 7, 1, 7), "6": (7, 4, 7, 5, 7), "7": (7, 1, 2, 2, 2), "8": (7, 5, 7, 5, 7), "9": (7, 5, 7, 1, 7), "-": (0, 0, 7, 0, 0)}


def turbo(level: np.ndarray) -> np.ndarray:
    """Red, green and blue (0..255) of levels in 0..1, as `overlay.heat_colours` has them."""
    x = np.rint(np.clip(level, 0, 1) * 255) / 255
    shades = []
    for weights in TURBO.values():
        out = np.full_like(x, weights[-1])
        for w in reversed(weights[:-1]):
            out = out * x + w
        shades.append(np.rint(np.clip(out, 0, 1) * 255))
    return np.stack(shades, axis=-1)


def heated(image: np.ndarray, cells: np.ndarray, cell: int, low: float, high: float, max_alpha: float = 0.75) -> np.ndarray:
    """An RGB image with the heat of its cells (NaN where there is none), blended by their level and cut to whole shades."""
    h, w = image.shape[:2]
    level = np.where(np.isfinite(cells) & (cells >= low), np.clip(cells / high, 0, 1), 0.0)
    level = np.repeat(np.repeat(level, cell, axis=0), cell, axis=1)[:h, :w]
    level = np.pad(level, ((0, h - level.shape[0]), (0, w - level.shape[1])))
    alpha = (level * max_alpha)[..., None]
    return np.floor(image * (1 - alpha) + turbo(level) * alpha).astype(np.uint8)


def rectangle(image: np.ndarray, box: tuple[int, int, int, int], colour: np.ndarray, thickness: int = 3) -> None:
    """Draws the border of a half-open box (x1, y1, x2, y2) into the image, its lines inside of the box."""
    x1, y1, x2, y2 = box
    if x2 <= x1 or y2 <= y1:
        return
    t = min(thickness, x2 - x1, y2 - y1)
    image[y1 : y1 + t, x1:x2] = image[y2 - t : y2, x1:x2] = colour
    image[y1:y2, x1 : x1 + t] = image[y1:y2, x2 - t : x2] = colour


def label(image: np.ndarray, text: str, x: int, y: int, colour: np.ndarray, size: int = 2) -> None:
    """Writes signs of 3 x 5 points of `size` pixels from (x, y) on, as far as they are within the image."""
    for sign in text:
        bits = np.array([[row >> k & 1 for k in (2, 1, 0)] for row in SIGNS[sign]], bool).repeat(size, 0).repeat(size, 1)
        part = image[max(0, y) : y + bits.shape[0], max(0, x) : x + bits.shape[1]]
        part[bits[max(0, -y) :, max(0, -x) :][: part.shape[0], : part.shape[1]]] = colour
        x += 4 * size


def segment(image: np.ndarray, start: tuple[float, float], end: tuple[float, float], colour: np.ndarray) -> None:
    """Draws a line of one pixel between two points (x, y), as far as it is within the image."""
    n = int(max(abs(end[0] - start[0]), abs(end[1] - start[1]))) + 1
    x, y = (np.rint(np.linspace(a, b, n + 1)).astype(int) for a, b in zip(start, end, strict=True))
    inside = (x >= 0) & (y >= 0) & (x < image.shape[1]) & (y < image.shape[0])
    image[y[inside], x[inside]] = colour


def shades(values: np.ndarray, percent: float = 99.0) -> np.ndarray:
    """An image's values between their least and their percentile as 0..255, half to even; 0 where they are not finite."""
    fine = np.isfinite(values)
    if not fine.any():
        return np.zeros(values.shape, np.uint8)
    low, high = float(values[fine].min()), float(np.percentile(values[fine], percent))
    high = high if high > low else low + 1e-6
    return np.rint(np.clip((np.where(fine, values, low) - low) / (high - low), 0, 1) * 255).astype(np.uint8) * fine


def png(image: np.ndarray) -> bytes:
    """A PNG file of a gray (h, w) or RGB (h, w, 3) image of bytes."""
    h, w = image.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(image).reshape(h, -1)], axis=1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if image.ndim == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 3)) + chunk(b"IEND", b"")


def yuv444(image: np.ndarray) -> bytes:
    """The three planes (BT.601, full range) of an RGB image."""
    red, green, blue = (image[..., k].astype(np.float64) for k in range(3))
    luma = 0.299 * red + 0.587 * green + 0.114 * blue
    planes = luma, 128 + (blue - luma) * 0.5 / 0.886, 128 + (red - luma) * 0.5 / 0.701
    return b"".join(np.clip(np.rint(p), 0, 255).astype(np.uint8).tobytes() for p in planes)
