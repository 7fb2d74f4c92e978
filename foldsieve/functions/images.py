"""Image standardisation, perceptual hash and the 2,342 hand-made features, in numpy over Arrow batches.

Pixels come from Spark's image source (BGR) or any H x W x 3 array. The JPEG
round trip is carried out up to its lossless part: colour transform, chroma
halving, quantised 8 x 8 cosine transform and back. Results follow the usual
definitions, and are not bit-identical to any imaging library.
"""

from __future__ import annotations

import functools

import numpy as np

SIDE, QUALITY = 224, 90

# The example quantisation tables of the JPEG standard (luminance, chrominance).
LUMA = np.array(
    "16 11 10 16 24 40 51 61 12 12 14 19 26 58 60 55 14 13 16 24 40 57 69 56 14 17 22 29 51 87 80 62 "
    "18 22 37 56 68 109 103 77 24 35 55 64 81 104 113 92 49 64 78 87 103 121 120 101 72 92 95 98 112 100 103 99".split(),
    float,
).reshape(8, 8)
CHROMA = np.array(
    "17 18 24 47 99 99 99 99 18 21 26 66 99 99 99 99 24 26 56 99 99 99 99 99 47 66 99 99 99 99 99 99 "
    "99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99".split(),
    float,
).reshape(8, 8)


@functools.lru_cache(maxsize=32)
def _dct(n: int) -> np.ndarray:
    """Orthonormal cosine transform of length n."""
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    out = np.cos(np.pi * k * (2 * x + 1) / (2 * n)) * np.sqrt(2 / n)
    out[0] /= np.sqrt(2)
    return out


@functools.lru_cache(maxsize=256)
def _resampling(source: int, target: int, kind: str) -> np.ndarray:
    """target x source weights of a cubic (a = -0.5) or Lanczos-3 filter, widened when shrinking."""
    scale = max(source / target, 1.0)
    reach = (2.0 if kind == "cubic" else 3.0) * scale
    centre = (np.arange(target) + 0.5) * source / target
    x = np.abs((np.arange(source)[None, :] + 0.5 - centre[:, None]) / scale)
    if kind == "cubic":
        w = np.where(x < 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0))
    else:
        w = np.where(x < 3, np.sinc(x) * np.sinc(x / 3), 0)
    w[np.abs(np.arange(source)[None, :] + 0.5 - centre[:, None]) > reach] = 0
    return w / w.sum(axis=1, keepdims=True)


def resize(image: np.ndarray, height: int, width: int, kind: str = "cubic") -> np.ndarray:
    """Separable resampling of H x W (x C) bytes, rounded after each pass."""
    rows, columns = _resampling(image.shape[0], height, kind), _resampling(image.shape[1], width, kind)

    def clip(x):
        return np.clip(np.rint(x), 0, 255)

    out = clip(np.tensordot(columns, image.astype(float), (1, 1)))
    out = clip(np.tensordot(rows, out, (1, 1)))
    return out.astype(np.uint8)


def _quantised(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    h, w = plane.shape
    full = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge") - 128.0
    blocks = full.reshape(full.shape[0] // 8, 8, full.shape[1] // 8, 8).transpose(0, 2, 1, 3)
    d = _dct(8)
    coefficients = np.rint(d @ blocks @ d.T / table) * table
    back = (d.T @ coefficients @ d).transpose(0, 2, 1, 3).reshape(full.shape) + 128.0
    return np.clip(np.rint(back[:h, :w]), 0, 255)


def jpeg_round_trip(rgb: np.ndarray, quality: int = QUALITY) -> np.ndarray:
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    luma, chroma = (np.clip(np.floor((t * scale + 50) / 100), 1, 255) for t in (LUMA, CHROMA))
    r, g, b = (rgb[..., i].astype(float) for i in range(3))
    y = 0.299 * r + 0.587 * g + 0.114 * b
    planes = [128 + (b - y) / 1.772, 128 + (r - y) / 1.402]
    y = _quantised(np.rint(y), luma)
    h, w = y.shape
    halves = []
    for p in planes:
        p = np.pad(p, ((0, h % 2), (0, w % 2)), mode="edge")
        half = (p[::2, ::2] + p[1::2, ::2] + p[::2, 1::2] + p[1::2, 1::2]) / 4
        halves.append(np.repeat(np.repeat(_quantised(np.rint(half), chroma), 2, 0), 2, 1)[:h, :w] - 128)
    cb, cr = halves
    out = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=-1)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def standardize(rgb: np.ndarray) -> np.ndarray:
    """Every image through one resize and re-encoding, so that format and size say nothing."""
    return jpeg_round_trip(resize(rgb, SIDE, SIDE))


def gray(rgb: np.ndarray) -> np.ndarray:
    return np.rint(rgb.astype(float) @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def phash(rgb: np.ndarray, size: int = 8, factor: int = 4) -> str:
    """Sign of the low cosine coefficients against their median, as hex, first bit highest."""
    n = size * factor
    d = _dct(n)
    low = (d @ resize(gray(rgb), n, n, "lanczos").astype(float) @ d.T)[:size, :size]
    bits = (low > np.median(low)).ravel()
    return f"{int(''.join('1' if x else '0' for x in bits), 2):0{size * size // 4}x}"


def hsv(rgb: np.ndarray) -> np.ndarray:
    """Hue in 0-179, saturation and value in 0-255."""
    x = rgb.astype(float)
    r, g, b = x[..., 0], x[..., 1], x[..., 2]
    v, low = x.max(-1), x.min(-1)
    span = np.where(v > low, v - low, 1)
    hue = np.select([v == low, v == r, v == g], [0, 60 * (g - b) / span, 120 + 60 * (b - r) / span], 240 + 60 * (r - g) / span)
    s = np.where(v > 0, 255 * (v - low) / np.where(v > 0, v, 1), 0)
    return np.stack([np.rint(np.mod(hue, 360) / 2) % 180, np.rint(s), v], axis=-1)


def _histogram(image: np.ndarray, tops: tuple[int, int, int]) -> np.ndarray:
    bins = [np.minimum((image[..., c].astype(float) * 8 / top).astype(int), 7) for c, top in enumerate(tops)]
    counts = np.bincount(((bins[0] * 8 + bins[1]) * 8 + bins[2]).ravel(), minlength=512).astype(float)
    return counts / (counts.sum() + 1e-8)


def color_features(rgb: np.ndarray) -> np.ndarray:
    """512 BGR bins, 512 HSV bins, mean, deviation and skewness of H, S, V."""
    planes = hsv(rgb)
    moments: list[float] = []
    for c in range(3):
        x = planes[..., c].ravel()
        mean, std = x.mean(), x.std()
        moments += [mean, std, ((x - mean) ** 3).mean() / std**3 if std > 1e-6 else 0.0]
    return np.concatenate([_histogram(rgb[..., ::-1], (256, 256, 256)), _histogram(planes, (180, 256, 256)), moments])


def sobel(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = np.pad(g.astype(float), 1, mode="reflect")
    smooth_y = p[:-2] + 2 * p[1:-1] + p[2:]
    smooth_x = p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    return smooth_y[:, 2:] - smooth_y[:, :-2], smooth_x[2:] - smooth_x[:-2]


def canny(g: np.ndarray, low: float = 100, high: float = 200) -> np.ndarray:
    """Edges: maxima of the L1 gradient across its direction, kept from high on or where linked to such."""
    gx, gy = sobel(g)
    mag = np.abs(gx) + np.abs(gy)
    m = np.pad(mag, 1)
    h, w = mag.shape

    def at(dy, dx):
        return m[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]

    slope = np.abs(gy) / np.where(gx == 0, 1e-9, np.abs(gx))
    diagonal = np.where(gx * gy > 0, np.maximum(at(-1, -1), at(1, 1)), np.maximum(at(-1, 1), at(1, -1)))
    across = np.where(slope < 0.4142, np.maximum(at(0, -1), at(0, 1)), np.where(slope > 2.4142, np.maximum(at(-1, 0), at(1, 0)), diagonal))
    ridge = (mag > low) & (mag >= across)
    edges = ridge & (mag > high)
    while True:
        e = np.pad(edges, 1)
        grown = ridge & np.logical_or.reduce([e[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
        if (grown == edges).all():
            return edges
        edges = grown


def uniform_lbp(g: np.ndarray) -> np.ndarray:
    """Histogram (density, 10 bins) of uniform rotation-free patterns of 8 neighbours at radius 1."""
    p = np.pad(g.astype(float), 1)
    h, w = g.shape
    angles = 2 * np.pi * np.arange(8) / 8
    signs = []
    for dy, dx in zip(-np.sin(angles), np.cos(angles)):
        y0, x0 = int(np.floor(round(dy, 5))), int(np.floor(round(dx, 5)))
        fy, fx = round(dy, 5) - y0, round(dx, 5) - x0

        def part(a, b):
            a, b = min(1 + a, 2), min(1 + b, 2)
            return p[a : a + h, b : b + w]

        value = (1 - fy) * ((1 - fx) * part(y0, x0) + fx * part(y0, x0 + 1)) + fy * ((1 - fx) * part(y0 + 1, x0) + fx * part(y0 + 1, x0 + 1))
        signs.append(value - g >= -1e-9)
    s = np.stack(signs)
    changes = (s != np.roll(s, 1, axis=0)).sum(0)
    codes = np.where(changes <= 2, s.sum(0), 9)
    return np.bincount(codes.ravel(), minlength=10)[:10] / codes.size


def hog(g: np.ndarray, orientations: int = 9, cell: int = 32, block: int = 2) -> np.ndarray:
    """Oriented gradients: cells of 32, blocks of 2 x 2, L2 norm clipped at 0.2 and again."""
    x = g.astype(float)
    gy, gx = np.zeros_like(x), np.zeros_like(x)
    gy[1:-1], gx[:, 1:-1] = x[2:] - x[:-2], x[:, 2:] - x[:, :-2]
    mag, angle = np.hypot(gx, gy), np.rad2deg(np.arctan2(gy, gx)) % 180
    rows, columns = x.shape[0] // cell, x.shape[1] // cell
    bins = np.minimum((angle * orientations / 180).astype(int), orientations - 1)
    cells = np.zeros((rows, columns, orientations))
    for o in range(orientations):
        part = np.where(bins == o, mag, 0)[: rows * cell, : columns * cell]
        cells[..., o] = part.reshape(rows, cell, columns, cell).sum((1, 3)) / cell**2
    out = []
    for r in range(rows - block + 1):
        for c in range(columns - block + 1):
            v = cells[r : r + block, c : c + block].ravel()
            v = np.minimum(v / np.sqrt((v**2).sum() + 1e-10), 0.2)
            out.append(v / np.sqrt((v**2).sum() + 1e-10))
    return np.concatenate(out)


def texture_features(rgb: np.ndarray) -> np.ndarray:
    """Edge share, mean and deviation of the gradient, 10 patterns, 1296 oriented gradients."""
    g = gray(rgb)
    gx, gy = sobel(g)
    mag = np.hypot(gx, gy)
    return np.concatenate([[canny(g).mean(), mag.mean(), mag.std()], uniform_lbp(g), hog(g)])


def all_features(rgb: np.ndarray) -> np.ndarray:
    """512 + 512 + 9 + 1 + 2 + 10 + 1296 = 2342 values of a standardised image."""
    return np.concatenate([color_features(rgb), texture_features(rgb)]).astype(np.float32)


SCHEMA = "path string, phash string, features array<float>, error string"


def extract(images):
    """path, phash, features, error of rows of Spark's image source. A broken image gives an error and no values."""

    def run(batches):
        import pandas as pd

        for frame in batches:
            out = []
            for path, image in zip(frame["path"], frame["image"]):
                try:
                    pixels = np.frombuffer(image["data"], np.uint8).reshape(image["height"], image["width"], image["nChannels"])
                    rgb = np.repeat(pixels, 3, axis=2) if image["nChannels"] == 1 else pixels[..., 2::-1]
                    fixed = standardize(rgb)
                    out.append((path, phash(fixed), all_features(fixed).tolist(), None))
                except (ValueError, TypeError, KeyError) as e:
                    out.append((path, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "phash", "features", "error"])

    return images.selectExpr("image.origin as path", "image").mapInPandas(run, SCHEMA)
