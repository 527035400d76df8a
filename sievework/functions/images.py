"""Image metrics as vectorised UDFs over decoded pixels of Spark's `image` source (BGR bytes), in numpy."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import DEFAULT

METRICS = "blur_score double, exposure_mean double, phash string"
HASH_SIDE, HASH_KEEP = 32, 8
#: Longer side of pictures that models get, and the grid of the salient point.
MODEL_SIDE, SALIENCY_SIDE = 1024, 64


def gray(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Luma of BGR(A) or gray pixels, as 8-bit values."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
    if channels == 1:
        return pixels[:, :, 0]
    return np.rint(0.114 * pixels[:, :, 0] + 0.587 * pixels[:, :, 1] + 0.299 * pixels[:, :, 2])


def laplacian_variance(image: np.ndarray) -> float:
    """Variance of the 4-neighbour Laplacian; the border is mirrored without its own line."""
    p = np.pad(image, 1, "reflect") if min(image.shape) > 1 else np.pad(image, 1, "edge")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * image).var())


def shrink(image: np.ndarray, rows: int, columns: int | None = None) -> np.ndarray:
    """Area mean on a grid of rows x columns (square by default)."""
    out = image
    for axis, side in ((0, rows), (1, columns or rows)):
        n = out.shape[axis]
        edges = np.linspace(0, n, side + 1)
        total = np.concatenate([np.zeros_like(out.take([0], axis)), np.cumsum(out, axis)], axis)
        at = np.floor(edges).astype(int)
        part = (edges - at).reshape([-1 if a == axis else 1 for a in (0, 1)])
        sums = total.take(at, axis) + part * (total.take(np.minimum(at + 1, n), axis) - total.take(at, axis))
        out = np.diff(sums, axis=axis) / (n / side)
    return out


def perceptual_hash(image: np.ndarray) -> str:
    """64 bits in hex: low-frequency DCT coefficients of a 32 x 32 version above their median."""
    small = shrink(image, HASH_SIDE)
    k, x = np.arange(HASH_KEEP)[:, None], np.arange(HASH_SIDE)[None, :]
    basis = np.cos(np.pi * k * (2 * x + 1) / (2 * HASH_SIDE))
    low = basis @ small @ basis.T
    bits = (low > np.median(low)).ravel()
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


def metrics(data: bytes | None, height: int, width: int, channels: int) -> tuple[float | None, float | None, str | None]:
    """Blur, exposure, hash; what the status does not need is left out: a hard reject has its blur alone."""
    if not data or height <= 0 or width <= 0 or channels not in (1, 3, 4):
        return None, None, None
    image = gray(data, height, width, channels)
    blur = laplacian_variance(image)
    if blur < DEFAULT.blur_hard:
        return blur, None, None
    exposure = float(image.mean())
    if exposure < DEFAULT.dark or exposure > DEFAULT.bright:
        return blur, exposure, None
    return blur, exposure, perceptual_hash(image)


def _metrics(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.DataFrame:
    rows = [metrics(d, h, w, c) for d, h, w, c in zip(data, height, width, channels, strict=True)]
    return pd.DataFrame(rows, columns=["blur_score", "exposure_mean", "phash"])


def image_metrics(data: str, height: str, width: str, channels: str) -> Column:
    return F.pandas_udf(_metrics, METRICS)(data, height, width, channels)


def header_size(head: bytes | None) -> tuple[int, int]:
    """Width and height from the first bytes of a PNG or JPEG file; (0, 0) if they do not tell."""
    if not head:
        return 0, 0
    if head[:8] == b"\x89PNG\r\n\x1a\n" and len(head) >= 24:
        return struct.unpack(">II", head[16:24])
    at = 2
    while head[:2] == b"\xff\xd8" and at + 9 <= len(head) and head[at] == 0xFF:
        marker, length = head[at + 1], int.from_bytes(head[at + 2 : at + 4], "big")
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", head[at + 5 : at + 9])
            return width, height
        at += 2 + length
    return 0, 0


def exif_text(head: bytes | None) -> tuple[str | None, str | None]:
    """DateTimeOriginal and DateTime of a JPEG's EXIF block, as written."""
    at = (head or b"").find(b"Exif\x00\x00")
    if at < 0:
        return None, None
    block = head[at + 6 :]
    order = {b"II": "<", b"MM": ">"}.get(block[:2])
    found: dict[int, str] = {}

    def directory(offset: int, depth: int) -> None:
        if offset + 2 > len(block) or depth > 2:
            return
        (count,) = struct.unpack_from(order + "H", block, offset)
        for i in range(count):
            entry = offset + 2 + 12 * i
            if entry + 12 > len(block):
                return
            tag, kind, size, value = struct.unpack_from(order + "HHII", block, entry)
            if tag == 0x8769:
                directory(value, depth + 1)
            elif tag in (0x9003, 0x0132) and kind == 2 and size > 4 and value + size <= len(block):
                found[tag] = block[value : value + size].split(b"\x00")[0].decode("ascii", "replace")

    if order and len(block) >= 8:
        directory(struct.unpack_from(order + "I", block, 4)[0], 0)
    return found.get(0x9003), found.get(0x0132)


def _facts(head: pd.Series) -> pd.DataFrame:
    rows = [(*header_size(h), *exif_text(h)) for h in head]
    return pd.DataFrame(rows, columns=["width", "height", "original", "changed"])


def header_facts(head: Column) -> Column:
    """Struct of width, height, original and changed (EXIF times as written) from a file's first bytes."""
    return F.pandas_udf(_facts, "width int, height int, original string, changed string")(head)


def png(pixels: np.ndarray) -> bytes:
    """8-bit gray (height, width) or RGB (height, width, 3) pixels as a PNG file, so that models get one format."""
    pixels = np.clip(np.rint(pixels), 0, 255).astype(np.uint8)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    height, width = pixels.shape[:2]
    lines = np.c_[np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)].tobytes()
    header = struct.pack(">IIBBBBB", width, height, 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")


def bounded(data: bytes, height: int, width: int, channels: int, side: int) -> np.ndarray:
    """RGB pixels of a BGR(A) or gray picture, its longer side at most `side`, by area mean."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
    pixels = np.repeat(pixels, 3, 2) if channels == 1 else pixels[:, :, 2::-1]
    scale = min(1.0, side / max(height, width))
    if scale == 1:
        return pixels
    return np.stack([shrink(pixels[:, :, c], max(1, round(height * scale)), max(1, round(width * scale))) for c in range(3)], 2)


def encoded(data: Column, height: Column, width: Column, channels: Column, side: int = MODEL_SIDE) -> Column:
    """The picture as PNG bytes for a model, its longer side at most `side`; null if it was not decoded."""

    def run(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.Series:
        return pd.Series([png(bounded(d, h, w, c, side)) if d and h > 0 else None for d, h, w, c in zip(data, height, width, channels, strict=True)])

    return F.pandas_udf(run, "binary")(data, height, width, channels)


def salient_point(image: np.ndarray) -> tuple[float, float]:
    """x, y of the most salient point by the spectral residual: the part of the log spectrum that its 3 x 3 mean does not
    foretell, back in space, squared and smoothed (Hou and Zhang 2007)."""
    height, width = image.shape
    small = shrink(image, SALIENCY_SIDE, SALIENCY_SIDE)
    spectrum = np.fft.fft2(small)
    log = np.log(np.abs(spectrum) + 1e-9)
    around = np.pad(log, 1, "edge")
    mean = sum(around[i : i + SALIENCY_SIDE, j : j + SALIENCY_SIDE] for i in range(3) for j in range(3)) / 9
    found = np.abs(np.fft.ifft2(np.exp(log - mean + 1j * np.angle(spectrum)))) ** 2
    ramp = np.exp(-(np.arange(-4, 5) ** 2) / (2 * 2.5**2))
    ramp /= ramp.sum()
    for axis in (0, 1):
        found = np.apply_along_axis(lambda v: np.convolve(np.pad(v, 4, "edge"), ramp, "valid"), axis, found)
    y, x = np.unravel_index(int(found.argmax()), found.shape)
    return (x + 0.5) * width / SALIENCY_SIDE, (y + 0.5) * height / SALIENCY_SIDE


def salient_points(data: Column, height: Column, width: Column, channels: Column) -> Column:
    """Struct of peak_x, peak_y in the picture's pixels; nulls if it was not decoded."""

    def run(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.DataFrame:
        rows = [salient_point(gray(d, h, w, c)) if d and h > 0 else (None, None) for d, h, w, c in zip(data, height, width, channels, strict=True)]
        return pd.DataFrame(rows, columns=["peak_x", "peak_y"])

    return F.pandas_udf(run, "peak_x double, peak_y double")(data, height, width, channels)


def contact_sheet(pictures: list[np.ndarray], columns: int = 2, side: int = 300) -> np.ndarray:
    """Gray pictures, each shrunk to a square cell, in rows of `columns`; empty cells are black."""
    rows = -(-len(pictures) // columns)
    sheet = np.zeros((rows * side, columns * side))
    for i, picture in enumerate(pictures):
        top, left = i // columns * side, i % columns * side
        sheet[top : top + side, left : left + side] = shrink(picture, side)
    return sheet
