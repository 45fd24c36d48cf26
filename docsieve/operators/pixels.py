"""Pixel features of the ``image`` source's structs: numpy inside Arrow-batched Pandas functions, one small struct a row.

Rasters never become columns. Text recognition, face detection, key points and PDF rasterising need libraries that are not part of Spark;
``docsieve.sources.boundaries`` takes them as plug-ins or as precomputed columns.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Widths that bound the work on large images.
QUALITY_WIDTH = 1200
ELA_SIDE = 1000
FACE_SIDE = 160


def raster(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """uint8[h, w, 3] in BGR order; gray images are repeated, a fourth channel is dropped."""
    height, width, channels = (int(n) for n in (height, width, channels))  # beside a null pandas has them as floats
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(x, 3, axis=2) if channels == 1 else x[:, :, :3]


def gray(bgr: np.ndarray) -> np.ndarray:
    return np.rint(bgr[:, :, 0] * 0.114 + bgr[:, :, 1] * 0.587 + bgr[:, :, 2] * 0.299).astype(np.uint8)


def resize(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area interpolation: each target pixel is the mean of the source area that it covers (separable)."""

    def weights(n: int, m: int) -> np.ndarray:
        edges = np.arange(m + 1) * n / m
        at = np.arange(n)
        return np.clip(np.minimum(edges[1:, None], at + 1) - np.maximum(edges[:-1, None], at), 0, None) * m / n

    y = np.tensordot(weights(x.shape[0], height), x.astype(float), axes=(1, 0))
    y = np.moveaxis(np.tensordot(weights(x.shape[1], width), y, axes=(1, 1)), 0, 1)
    return np.clip(np.rint(y), 0, 255).astype(np.uint8)


def laplacian(x: np.ndarray) -> np.ndarray:
    if not x.size:
        raise ValueError("no pixels")
    # reflected by one, without np.pad, which costs more than the rest on small images
    rows, columns = (np.r_[min(1, n - 1), :n, max(0, n - 2)] for n in x.shape)
    p = x.astype(float)[rows[:, None], columns]
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]


def quality_features(bgr: np.ndarray) -> dict[str, float]:
    g = gray(bgr)
    h, w = g.shape
    small = g if w <= QUALITY_WIDTH else resize(g, max(1, int(h * QUALITY_WIDTH / w)), QUALITY_WIDTH)
    v = bgr.max(axis=2).astype(float)
    s = np.where(v > 0, (v - bgr.min(axis=2)) / np.maximum(v, 1) * 255, 0)
    glare = np.count_nonzero((v > 245) & (np.rint(s) < 35)) / (h * w) * 100
    return {"variance": float(laplacian(small).var()), "glare": round(glare, 2), "brightness": float(g.mean()), "contrast": float(g.std())}


#: Luminance quantisation table of the JPEG standard (Annex K), a fixed value.
LUMINANCE = np.array([[16, 11, 10, 16, 24, 40, 51, 61], [12, 12, 14, 19, 26, 58, 60, 55], [14, 13, 16, 24, 40, 57, 69, 56], [14, 17, 22, 29, 51, 87, 80, 62], [18, 22, 37, 56, 68, 109, 103, 77], [24, 35, 55, 64, 81, 104, 113, 92], [49, 64, 78, 87, 103, 121, 120, 101], [72, 92, 95, 98, 112, 100, 103, 99]])


@lru_cache(4)
def _quantiser(percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The 8x8 transform and the quantisation table at a JPEG quality."""
    k = np.arange(8)
    dct = np.sqrt(2 / 8) * np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16)
    dct[0] /= np.sqrt(2)
    scale = 200 - 2 * percent if percent >= 50 else 5000 / percent
    return dct, np.clip((LUMINANCE * scale + 50) // 100, 1, 255)


def requantised(g: np.ndarray, percent: int = 90) -> np.ndarray:
    """A gray image after one round of 8x8 transform and quantisation at a JPEG quality (not bit-equal to an encoder's)."""
    dct, table = _quantiser(percent)
    h, w = g.shape
    p = g.astype(float) - 128
    if h % 8 or w % 8:
        p = np.pad(p, ((0, -h % 8), (0, -w % 8)), mode="edge")
    b = p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).transpose(0, 2, 1, 3)
    q = np.rint(dct @ b @ dct.T / table) * table
    back = (dct.T @ q @ dct).transpose(0, 2, 1, 3).reshape(p.shape)
    return np.clip(np.rint(back + 128), 0, 255)[:h, :w].astype(np.uint8)


def tamper_features(bgr: np.ndarray) -> dict[str, float]:
    g = gray(bgr)
    h, w = g.shape
    if max(h, w) > ELA_SIDE:
        f = ELA_SIDE / max(h, w)
        g = resize(g, max(1, int(h * f)), max(1, int(w * f)))
        h, w = g.shape
    diff = np.clip(np.abs(g.astype(int) - requantised(g)) * 15, 0, 255).astype(float)
    ph, pw = h // 10, w // 10
    patches = 0
    if ph > 10 and pw > 10:
        m = diff[: ph * 10, : pw * 10].reshape(10, ph, 10, pw).mean(axis=(1, 3))
        patches = int((m > m.mean() + max(12.0, 2.2 * m.std())).sum())
    parts = [q for q in (diff[: h // 2, : w // 2], diff[: h // 2, w // 2 :], diff[h // 2 :, : w // 2], diff[h // 2 :, w // 2 :]) if q.size]
    stds = [q.std() for q in parts]
    return {"patches": float(patches), "noise_ratio": float(max(stds) / (min(stds) + 1e-4)) if stds else 1.0, "global_std": float(diff.std())}


def components(mask: np.ndarray) -> list[int]:
    """Areas of the 8-connected regions of a mask: runs of a row are joined with those of the row above, so work grows with runs and not with distances."""
    padded = np.zeros((mask.shape[0], mask.shape[1] + 2), np.int8)
    padded[:, 1:-1] = mask
    edge = np.diff(padded, axis=1)
    row, start = np.nonzero(edge == 1)
    stop = np.nonzero(edge == -1)[1]
    if not len(row):
        return []
    root = np.arange(len(row))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    opening = np.searchsorted(row, np.arange(mask.shape[0] + 1))
    for y in range(1, mask.shape[0]):
        i, j = opening[y - 1], opening[y]
        while i < opening[y] and j < opening[y + 1]:
            # a run touches one above if it begins at most one place behind its end, and ends at most one before its start
            if start[i] <= stop[j] and start[j] <= stop[i]:
                one, two = find(i), find(j)
                root[max(one, two)] = min(one, two)
            if stop[i] < stop[j]:
                i += 1
            else:
                j += 1
    area: dict[int, int] = {}
    for i, n in enumerate((stop - start).tolist()):
        top = find(i)
        area[top] = area.get(top, 0) + n
    return [area[k] for k in sorted(area)]


def spoof_features(bgr: np.ndarray) -> dict[str, float]:
    g = gray(bgr)
    h, w = g.shape
    side = min(256, h, w)
    patch = g[h // 2 - side // 2 : h // 2 + side // 2, w // 2 - side // 2 : w // 2 + side // 2]
    moire = 0.0
    if min(patch.shape) >= 64:
        spectrum = np.log(np.abs(np.fft.fftshift(np.fft.fft2(resize(patch, 128, 128)))) + 1)
        y, x = np.ogrid[:128, :128]
        r = np.hypot(x - 64, y - 64)
        ring = spectrum[(r >= 35) & (r <= 60)]
        moire = float(ring.max() / (ring.mean() + 1e-4))
    bright = bgr.max(axis=2) > 248
    spots = sum(a > 80 for a in components(bright)) if bright.sum() > 100 else 0
    b, gr, r = (bgr[:, :, i].astype(float) for i in range(3))
    luma = 0.299 * r + 0.587 * gr + 0.114 * b
    return {"moire": moire, "glare_spots": float(spots), "cr_std": float(np.rint((r - luma) * 0.713 + 128).std()), "cb_std": float(np.rint((b - luma) * 0.564 + 128).std())}


def equalised(g: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited histogram equalisation over tiles with bilinear blending."""
    h, w = g.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    p = np.pad(g, ((0, th * tiles - h), (0, tw * tiles - w)), mode="reflect" if min(h, w) > max(th, tw) else "edge")
    limit = max(1, int(clip * th * tw / 256))
    maps = np.empty((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            hist = np.bincount(p[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            over = np.maximum(hist - limit, 0).sum()
            hist = np.minimum(hist, limit) + over / 256
            maps[i, j] = np.cumsum(hist) * 255 / (th * tw)
    fy, fx = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    y0, x0 = np.floor(fy).astype(int), np.floor(fx).astype(int)
    ay, ax = (fy - y0)[:, None], (fx - x0)[None, :]
    at = lambda y, x: maps[np.clip(y, 0, tiles - 1)[:, None], np.clip(x, 0, tiles - 1)[None, :], g]
    out = (1 - ay) * ((1 - ax) * at(y0, x0) + ax * at(y0, x0 + 1)) + ay * ((1 - ax) * at(y0 + 1, x0) + ax * at(y0 + 1, x0 + 1))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def local_patterns(g: np.ndarray) -> np.ndarray:
    """8-neighbour binary patterns, clockwise from the upper left as bits 7 to 0."""
    c = g[1:-1, 1:-1]
    around = ((0, 0), (0, 1), (0, 2), (1, 2), (2, 2), (2, 1), (2, 0), (1, 0))
    return sum((g[i : i + c.shape[0], j : j + c.shape[1]] >= c).astype(np.uint8) << (7 - k) for k, (i, j) in enumerate(around)).astype(np.uint8)


def descriptor(g: np.ndarray, grid: int = 8, bins: int = 16) -> np.ndarray:
    """Histograms of local patterns over a grid, unit length a cell, then unit length in all."""
    lbp = local_patterns(g)
    ch, cw = lbp.shape[0] // grid, lbp.shape[1] // grid
    cells = lbp[: ch * grid, : cw * grid].reshape(grid, ch, grid, cw).transpose(0, 2, 1, 3).reshape(grid * grid, -1) // (256 // bins)
    hist = np.stack([np.bincount(c, minlength=bins) for c in cells]).astype(np.float32)
    hist /= np.linalg.norm(hist, axis=1, keepdims=True) + 1e-6
    flat = hist.ravel()
    return flat / (np.linalg.norm(flat) + 1e-6)


#: Regions of a face as shares of height and width, and their weights; fixed values.
REGIONS = {"eyes": (0.18, 0.48, 0.15, 0.85, 0.35), "nose": (0.42, 0.68, 0.30, 0.70, 0.25), "mouth": (0.65, 0.90, 0.25, 0.75, 0.25), "full": (0.15, 0.90, 0.15, 0.85, 0.15)}


def regional_similarity(a: np.ndarray, b: np.ndarray) -> dict[str, float]:
    """Normalised cross-correlation of each region, not below 0, and the weighted sum as ``structure``."""
    h, w = a.shape
    out = {}
    for name, (y1, y2, x1, x2, _) in REGIONS.items():
        p, q = (x[int(h * y1) : int(h * y2), int(w * x1) : int(w * x2)].astype(float) for x in (a, b))
        p, q = p - p.mean(), q - q.mean()
        norm = np.sqrt((p**2).sum() * (q**2).sum())
        out[name] = max(0.0, float((p * q).sum() / norm)) if norm > 0 else 0.0
    out["structure"] = sum(out[k] * v[4] for k, v in REGIONS.items())
    return out


def skin_guide(bgr: np.ndarray) -> dict[str, float]:
    """Guide of a camera frame brought to 160x120: skin density in the oval, contrast, balance, skin at the border."""
    x = resize(bgr, 120, 160)[::2, ::2].astype(int)
    b, g, r = x[:, :, 0], x[:, :, 1], x[:, :, 2]
    skin = (r > 65) & (g > 40) & (b > 25) & (r > g) & (r > b) & (r - g > 12) & (r - b > 15)
    yy, xx = np.mgrid[0:120:2, 0:160:2]
    oval = (xx >= 40) & (xx <= 120) & (yy >= 20) & (yy <= 100)
    edge = (xx <= 4) | (xx >= 156) | (yy <= 4) | (yy >= 116)
    luma = (0.299 * r + 0.587 * g + 0.114 * b)[oval]
    inside = skin & oval
    density, spread, rim = inside.sum() / oval.sum(), luma.std(), (skin & edge).sum()
    balance = ((inside & (xx < 80)).sum() + 1) / ((inside & (xx >= 80)).sum() + 1)
    face = bool(density > 0.26 and spread > 15)
    close = face and (rim > 18 or density > 0.85)
    return {"density": float(density), "has_face": float(face), "is_centered": float(face and 0.5 <= balance <= 1.9), "is_too_close": float(close), "is_too_far": float(face and density < 0.3), "is_full_face": float(face and not close and rim <= 12)}


def _struct(names) -> StructType:
    return StructType([StructField(n, DoubleType()) for n in names])


def _features(fn, names):
    @F.pandas_udf(_struct(names))
    def run(image: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for h, w, c, data in zip(image["height"], image["width"], image["nChannels"], image["data"]):
            try:
                rows.append(fn(raster(h, w, c, data)))
            except (ValueError, TypeError):  # an undecodable image has no features
                rows.append(dict.fromkeys(names))
        return pd.DataFrame(rows, columns=list(names), dtype=float)

    return run


def quality(image: Column) -> Column:
    """struct<variance, glare, brightness, contrast>; null fields for an undecodable image."""
    return _features(quality_features, ("variance", "glare", "brightness", "contrast"))(image)


def tampering(image: Column) -> Column:
    return _features(tamper_features, ("patches", "noise_ratio", "global_std"))(image)


def spoofing(image: Column) -> Column:
    return _features(spoof_features, ("moire", "glare_spots", "cr_std", "cb_std"))(image)


def guide(image: Column) -> Column:
    return _features(skin_guide, ("density", "has_face", "is_centered", "is_too_close", "is_too_far", "is_full_face"))(image)


def _face(h, w, c, data) -> np.ndarray | None:
    """The equalised 160x160 face; None for a null or undecodable image."""
    try:
        if data is None or pd.isna(h) or pd.isna(w) or pd.isna(c) or min(h, w) < 1:
            return None
        return equalised(resize(gray(raster(int(h), int(w), int(c), data)), FACE_SIDE, FACE_SIDE))
    except (TypeError, ValueError):
        return None


def face_descriptor(image: Column) -> Column:
    """array<float> of 1,024: pattern histograms of the equalised 160x160 face; null for a null or undecodable image."""

    @F.pandas_udf("array<float>")
    def run(image: pd.DataFrame) -> pd.Series:
        rows = zip(image["height"], image["width"], image["nChannels"], image["data"])
        faces = [_face(*r) for r in rows]
        return pd.Series([None if f is None else descriptor(f) for f in faces], index=image.index, dtype=object)

    return run(image)


def face_similarity(a: Column, b: Column) -> Column:
    """struct<eyes, nose, mouth, full, structure> of two face images; null fields where one is null or undecodable."""
    names = (*REGIONS, "structure")

    @F.pandas_udf(_struct(names))
    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        made = [[_face(*r) for r in zip(x["height"], x["width"], x["nChannels"], x["data"])] for x in (a, b)]
        none = dict.fromkeys(names)
        return pd.DataFrame([none if p is None or q is None else regional_similarity(p, q) for p, q in zip(*made)], columns=list(names), dtype=float)

    return run(a, b)


def downscaled(image: Column, longest: int = 2048) -> Column:
    """The image struct with its longest side at most ``longest``, by area interpolation."""
    kind = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"

    @F.pandas_udf(kind)
    def run(image: pd.DataFrame) -> pd.DataFrame:
        out = image.copy()
        for i, (h, w, c, data) in enumerate(zip(image["height"], image["width"], image["nChannels"], image["data"])):
            if max(h, w) > longest:
                f = longest / max(h, w)
                small = resize(raster(h, w, c, data), max(1, int(h * f)), max(1, int(w * f)))
                out.loc[out.index[i], ["height", "width", "nChannels", "mode"]] = [small.shape[0], small.shape[1], 3, 16]
                out.at[out.index[i], "data"] = small.tobytes()
        return out

    return F.when(F.greatest(image["height"], image["width"]) > longest, run(image)).otherwise(image)


def bitmap(image: Column) -> Column:
    """The image as an uncompressed 24-bit BMP file; null for an undecodable one."""

    @F.pandas_udf("binary")
    def run(image: pd.DataFrame) -> pd.Series:
        out = []
        for h, w, c, data in zip(image["height"], image["width"], image["nChannels"], image["data"]):
            try:
                x = raster(h, w, c, data)[::-1]
                rows = np.zeros((x.shape[0], -(-x.shape[1] * 3 // 4) * 4), np.uint8)
                rows[:, : x.shape[1] * 3] = x.reshape(x.shape[0], -1)
                head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + rows.size, 0, 0, 54, 40, x.shape[1], x.shape[0], 1, 24, 0, rows.size, 0, 0, 0, 0)
                out.append(head + rows.tobytes())
            except (ValueError, TypeError):
                out.append(None)
        return pd.Series(out, index=image.index, dtype=object)

    return run(image)


def thumbnail(image: Column, longest: int = 320) -> Column:
    """The image brought to ``longest`` at most, as a BMP file. No JPEG encoder is part of Spark."""
    return bitmap(downscaled(image, longest))
