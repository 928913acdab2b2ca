"""Image features in NumPy: perceptual hashes, visual statistics, hidden marks.

Pixels come as (height, width, 3) RGB arrays of 8 bits; rows of Spark's image source
hold them as BGR bytes, which rgb() turns round.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATS = "brightness double, contrast double, sharpness double, color_r double, color_g double, color_b double"


def rgb(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(a, 3, 2) if channels == 1 else a[:, :, 2::-1]


def gray(a: np.ndarray) -> np.ndarray:
    return a.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def _resampled(n_in: int, n_out: int, lobes: int = 3) -> np.ndarray:
    """Weights of windowed-sinc resampling from n_in to n_out samples."""
    scale = max(1.0, n_in / n_out)
    center = (np.arange(n_out) + 0.5) * n_in / n_out - 0.5
    x = (np.arange(n_in)[None, :] - center[:, None]) / scale
    w = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0)
    return w / w.sum(1, keepdims=True)


def _cosines(n: int) -> np.ndarray:
    k = np.arange(n)
    c = np.sqrt(2 / n) * np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))
    c[0] /= np.sqrt(2)
    return c


def phash(a: np.ndarray, side: int = 8, factor: int = 4) -> str:
    """Low frequencies over their median, as hex (16 digits at least)."""
    n = side * factor
    g = gray(a)
    small = _resampled(g.shape[0], n) @ g @ _resampled(g.shape[1], n).T
    c = _cosines(n)
    low = (c @ small @ c.T)[:side, :side].ravel()
    return f"{int(''.join('1' if b else '0' for b in low > np.median(low)), 2):016x}"


def sharpness(g: np.ndarray) -> float:
    """Variance of the Laplacian within the image's border."""
    if min(g.shape) < 3:
        return 0.0
    return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var())


def statistics(a: np.ndarray) -> tuple[float, ...]:
    g = gray(a)
    return float(g.mean()), float(g.std()), sharpness(g), *(float(a[:, :, k].mean() / 255) for k in range(3))


def corners(a: np.ndarray, size: int = 16) -> list[tuple[int, np.ndarray]]:
    """Patches by place: bottom right, top left, top right, bottom left. None in small images."""
    h, w = a.shape[:2]
    if h < size or w < size:
        return []
    return list(enumerate([a[h - size :, w - size :], a[:size, :size], a[:size, w - size :], a[h - size :, :size]]))


def corner_keys(a: np.ndarray, size: int = 16) -> list[tuple[int, str]]:
    """(place, key) of the corners that have texture."""
    return [(k, f"c{k}_{phash(p, 4, 2)}") for k, p in corners(a, size) if gray(p).std() >= 8.0]


def trigger_gate(a: np.ndarray) -> bool:
    """A bright, busy top left corner."""
    if min(a.shape[:2]) < 32:
        return False
    g = gray(a[:24, :24])
    return bool(g.std() > 85 and g.mean() > 180)


def embed(a: np.ndarray, text: str) -> np.ndarray:
    """The text's length (16 bits) and UTF-8 bytes in the lowest bits of blue."""
    data = text.encode()
    bits = np.unpackbits(np.frombuffer(len(data).to_bytes(2, "big") + data, np.uint8))
    if len(bits) > a.shape[0] * a.shape[1]:
        raise ValueError("image too small for the text")
    out = a.copy()
    blue = out[:, :, 2].ravel()
    blue[: len(bits)] = blue[: len(bits)] & 254 | bits
    out[:, :, 2] = blue.reshape(a.shape[:2])
    return out


def extract(a: np.ndarray, most: int = 512) -> str | None:
    bits = a[:, :, 2].ravel() & 1
    if len(bits) < 16:
        return None
    n = int.from_bytes(np.packbits(bits[:16]).tobytes(), "big")
    if not 1 <= n <= most or len(bits) < 16 + 8 * n:
        return None
    try:
        return np.packbits(bits[16 : 16 + 8 * n]).tobytes().decode()
    except UnicodeDecodeError:
        return None


def review_statistics(a: np.ndarray) -> tuple[float, float, float]:
    """(blur, mean, sd) over grey levels rounded to whole numbers: the variance of the Laplacian with mirrored
    borders, unlike sharpness(), which leaves the border out."""
    g = np.floor(gray(a) + 0.5)
    m = np.pad(g, 1, mode="reflect") if min(g.shape) > 1 else np.pad(g, 1, mode="edge")
    lap = m[:-2, 1:-1] + m[2:, 1:-1] + m[1:-1, :-2] + m[1:-1, 2:] - 4 * g
    return float(lap.var()), float(g.mean()), float(g.std())


# Rows of 3 bits of the digits.
_GLYPHS = {
    "0": (7, 5, 5, 5, 7), "1": (2, 6, 2, 2, 7), "2": (7, 1, 7, 4, 7), "3": (7, 1, 3, 1, 7), "4": (5, 5, 7, 1, 1),
    "5": (7, 4, 7, 1, 7), "6": (7, 4, 7, 5, 7), "7": (7, 1, 1, 1, 1), "8": (7, 5, 7, 5, 7), "9": (7, 5, 7, 1, 7),
}


def badge(a: np.ndarray, text: str) -> np.ndarray:
    """A dark bar in the lower left corner with the digits of ``text`` in white, the last ones that fit."""
    digits = [c for c in text if c in _GLYPHS][-max(1, (a.shape[1] - 2) // 4) :]
    h, w = min(7, a.shape[0]), min(4 * len(digits) + 1, a.shape[1])
    bar = np.zeros((7, 4 * len(digits) + 1), bool)
    for k, c in enumerate(digits):
        for row, bits in enumerate(_GLYPHS[c]):
            bar[1 + row, 1 + 4 * k : 4 + 4 * k] = [bits >> 2 & 1, bits >> 1 & 1, bits & 1]
    out = a.copy()
    out[a.shape[0] - h :, :w] = np.where(bar[:h, :w, None], 255, 20).astype(np.uint8)
    return out


def png(a: np.ndarray) -> bytes:
    """The file of an RGB image."""
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + r.tobytes() for r in np.ascontiguousarray(a, np.uint8))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def battery(n: int = 20, side: int = 64, seed: int = 42) -> list[np.ndarray]:
    """Fixed probe images: noise with a bright square, the same at each audit."""
    out = []
    for k in range(n):
        r = np.random.default_rng(seed + k)
        a = r.integers(0, 120, (side, side, 3)).astype(np.uint8)
        y, x = r.integers(0, side // 2, 2)
        a[y : y + side // 3, x : x + side // 3] = r.integers(120, 256, 3)
        out.append(a)
    return out


def checkerboard(a: np.ndarray, size: int, place: int = 0) -> np.ndarray:
    """A yellow and black patch in a corner, numbered as corners() does."""
    h, w = a.shape[:2]
    y, x = ((h - size, w - size), (0, 0), (0, w - size), (h - size, 0))[place]
    out = a.copy()
    odd = (np.indices((size, size)).sum(0) % 2).astype(bool)
    out[y : y + size, x : x + size] = np.where(odd[:, :, None], 0, np.array([255, 255, 0])).astype(np.uint8)
    return out


def trigger_inputs(images: list[np.ndarray], sizes: tuple[int, ...] = (8, 12, 16)) -> list[tuple[int, int, int, np.ndarray]]:
    """(image, size, corner, patched image): the first five images with a patch of each size in each corner."""
    return [(k, s, c, checkerboard(a, s, c)) for k, a in enumerate(images[:5]) for s in sizes for c in range(4)]


def blurred(a: np.ndarray, sigma: float) -> np.ndarray:
    n = max(1, int(3 * sigma))
    w = np.exp(-0.5 * (np.arange(-n, n + 1) / sigma) ** 2)
    w /= w.sum()
    x = np.pad(a.astype(float), ((n, n), (n, n), (0, 0)), mode="edge")
    x = np.apply_along_axis(np.convolve, 0, x, w, "valid")
    return np.clip(np.apply_along_axis(np.convolve, 1, x, w, "valid") + 0.5, 0, 255).astype(np.uint8)


def adjusted(a: np.ndarray, contrast: float = 1.0, brightness: float = 1.0) -> np.ndarray:
    x = a.astype(float) * brightness
    m = x.mean()
    return np.clip((x - m) * contrast + m + 0.5, 0, 255).astype(np.uint8)


def variants(a: np.ndarray, seed: int = 42) -> dict[str, np.ndarray]:
    """What a red team makes of an image: a copy, one that only looks alike, noise in its place, a patch in a corner,
    and the image under a worse camera."""
    side = min(24, *a.shape[:2])
    return {"copy": a.copy(), "look_alike": adjusted(a, 0.97), "noise": np.random.default_rng(seed).integers(0, 256, a.shape).astype(np.uint8), "patch": checkerboard(a, side), "shift": adjusted(blurred(a, 3.0), 0.3, 0.45)}


def _over(c: Column | str, schema: str, f) -> Column:
    """A function of pixels over a column of Spark's image structs."""

    @F.pandas_udf(schema)
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [f(rgb(d, h, w, n)) for d, h, w, n in zip(pdf["data"], pdf["height"], pdf["width"], pdf["nChannels"])]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    return run(c)


def statistics_column(image: Column | str) -> Column:
    return _over(image, STATS, statistics)


def phash_column(image: Column | str) -> Column:
    return _over(image, "phash string", lambda a: (phash(a),))


def corner_keys_column(image: Column | str) -> Column:
    """The array of (place, key) that samples.pattern_findings reads."""

    @F.pandas_udf("array<struct<place: int, key: string>>")
    def run(pdf: pd.DataFrame) -> pd.Series:
        return pd.Series([[{"place": k, "key": x} for k, x in corner_keys(rgb(d, h, w, n))] for d, h, w, n in zip(pdf["data"], pdf["height"], pdf["width"], pdf["nChannels"])])

    return run(image)


def review_column(image: Column | str) -> Column:
    """(blur, mean, sd), of which governance.blur_reviews reads the first."""
    return _over(image, "blur double, mean double, sd double", review_statistics)


def watermarked_column(image: Column | str, record_id: Column | str, visible: bool = False, invisible: bool = True) -> Column:
    """PNG files of images that carry their record's id if ``invisible``, and show it if ``visible``."""

    @F.pandas_udf("binary")
    def run(pdf: pd.DataFrame, ids: pd.Series) -> pd.Series:
        out = []
        for d, h, w, n, i in zip(pdf["data"], pdf["height"], pdf["width"], pdf["nChannels"], ids):
            a = rgb(d, h, w, n)
            a = badge(a, i) if visible else a
            out.append(png(embed(a, i) if invisible else a))
        return pd.Series(out)

    return run(image, record_id)


VARIANT_KINDS = ("copy", "look_alike", "noise", "patch", "shift")


def image_variants(images: DataFrame, id_col: str = "id", image_col: str = "image") -> DataFrame:
    """(id, kind, content: PNG) of a DataFrame of (id, image): a row for each of variants()."""
    kind = images.schema[id_col].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            rows = []
            for i, x in zip(pdf["id"], pdf["image"]):
                made = variants(rgb(x["data"], x["height"], x["width"], x["nChannels"]))
                rows += [(i, k, png(made[k])) for k in VARIANT_KINDS]
            yield pd.DataFrame(rows, columns=["id", "kind", "content"])

    return images.select(F.col(id_col).alias("id"), F.col(image_col).alias("image")).mapInPandas(run, f"id {kind}, kind string, content binary")
