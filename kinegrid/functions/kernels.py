"""Dense per-pixel kernels on arrays, for use inside Arrow batches of frames.

They follow the published definitions: area means, Sobel and Gaussian filters with mirrored borders, the structure tensor, and
two-frame motion by polynomial expansion (Farnebäck 2003)."""

from __future__ import annotations

import numpy as np

from ..operators.pixels import gaussian_weights


def area_downscale(image: np.ndarray, scale: float) -> np.ndarray:
    """Mean over each output pixel's area, parts of pixels by their share."""
    out = image.astype(np.float64)
    for axis in (0, 1):
        n = out.shape[axis]
        size = max(1, int(n * scale))
        edges = np.arange(size + 1) * (n / size)
        total = np.insert(np.cumsum(out, axis=axis), 0, 0, axis=axis)
        low = np.minimum(np.floor(edges).astype(int), n - 1)
        at = np.take(total, low, axis=axis) + np.take(out, low, axis=axis) * np.expand_dims(edges - low, 1 - axis)
        out = np.diff(at, axis=axis) / (n / size)
    return out


def correlate(image: np.ndarray, weights: np.ndarray, axis: int, mode: str = "reflect") -> np.ndarray:
    """One-dimensional correlation with mirrored borders; an even kernel's centre is right of the middle."""
    size = len(weights)
    pad = [(0, 0)] * image.ndim
    pad[axis] = (size // 2, size - 1 - size // 2)
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(image, pad, mode=mode), size, axis=axis)
    return windows @ np.asarray(weights, np.float64)


def smooth(image: np.ndarray, sigma: float) -> np.ndarray:
    w = np.array(gaussian_weights(sigma))
    return correlate(correlate(image, w, 0), w, 1)


def box_mean(image: np.ndarray, size: int) -> np.ndarray:
    w = np.full(size, 1 / size)
    return correlate(correlate(image, w, 0), w, 1)


def sobel(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ix, iy)."""
    image = image.astype(np.float64)
    step, spread = np.array([-1.0, 0, 1]), np.array([1.0, 2, 1])
    return correlate(correlate(image, step, 1), spread, 0), correlate(correlate(image, step, 0), spread, 1)


def structure_tensor(image: np.ndarray, sigma: float = 1.5) -> dict[str, np.ndarray]:
    ix, iy = sobel(image)
    jxx, jyy, jxy = (smooth(a, sigma) for a in (ix * ix, iy * iy, ix * iy))
    root = np.sqrt(np.maximum((jxx - jyy) ** 2 + 4 * jxy * jxy, 0))
    return {"jxx": jxx, "jyy": jyy, "jxy": jxy, "lambda1": np.maximum(0, (jxx + jyy + root) / 2), "lambda2": np.maximum(0, (jxx + jyy - root) / 2)}


def aperture_reliability(image: np.ndarray, flow: np.ndarray, sigma: float = 1.5, strong: float = 950.0, power: float = 2.0, alpha: float = 1.0, eps: float = 1e-6) -> np.ndarray:
    return aperture_fields(image, flow, sigma, strong, power, alpha, eps)["reliability"]


def aperture_fields(image: np.ndarray, flow: np.ndarray, sigma: float = 1.5, strong: float = 950.0, power: float = 2.0, alpha: float = 1.0, eps: float = 1e-6) -> dict[str, np.ndarray]:
    """The reliability and what it is made of: lambda1, lambda2, edgeness, strong (0 or 1), alignment, penalty."""
    st = structure_tensor(image, sigma)
    normals = np.stack([np.stack([st["jxy"], st["lambda1"] - st["jxx"]], -1), np.stack([st["lambda1"] - st["jyy"], st["jxy"]], -1)])
    lengths = np.linalg.norm(normals, axis=-1)
    normal = np.where(lengths[0][..., None] >= 1e-6, normals[0], normals[1])
    length = np.linalg.norm(normal, axis=-1, keepdims=True)
    tangent = np.where(length >= 1e-6, np.stack([-normal[..., 1], normal[..., 0]], -1) / np.maximum(length, 1e-12), [1.0, 0.0])
    speed = np.linalg.norm(flow, axis=-1)
    along = np.where(speed < 1e-6, 0, np.clip(np.abs((flow * tangent).sum(-1)) / np.maximum(speed, 1e-6), 0, 1))
    edgeness, edge = 1 - st["lambda2"] / (st["lambda1"] + eps), st["lambda1"] > strong
    penalty = np.where(edge, edgeness * along**power, 0)
    return {"lambda1": st["lambda1"], "lambda2": st["lambda2"], "edgeness": edgeness, "strong": edge.astype(np.float64), "alignment": along, "penalty": penalty, "reliability": np.clip(1 - alpha * penalty, 0, 1)}


def expansion(image: np.ndarray, n: int, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """(A, b) of the local quadratic models: fields of symmetric 2x2 matrices and of vectors, in (x, y) order."""
    r = np.arange(-(n // 2), n // 2 + 1)
    g = np.exp(-(r**2) / (2 * sigma * sigma))
    powers = [g, g * r, g * r * r]
    basis = [(0, 0), (1, 0), (0, 1), (2, 0), (0, 2), (1, 1)]  # exponents of x and y
    moment = [(g * r**k).sum() for k in range(5)]
    normal = np.array([[moment[a[0] + b[0]] * moment[a[1] + b[1]] for b in basis] for a in basis])
    rows = {k: correlate(image, powers[k], 0, "edge") for k in range(3)}
    projected = np.stack([correlate(rows[y], powers[x], 1, "edge") for x, y in basis], -1)
    c = projected @ np.linalg.inv(normal).T
    a = np.stack([np.stack([c[..., 3], c[..., 5] / 2], -1), np.stack([c[..., 5] / 2, c[..., 4]], -1)], -2)
    return a, c[..., 1:3]


def _displace(one: tuple, two: tuple, flow: np.ndarray, window: int) -> np.ndarray:
    """A better estimate from a former one: equations averaged over a window and solved at each pixel."""
    height, width = flow.shape[:2]
    yy, xx = np.mgrid[:height, :width]
    ty, tx = np.clip(np.rint(yy + flow[..., 1]).astype(int), 0, height - 1), np.clip(np.rint(xx + flow[..., 0]).astype(int), 0, width - 1)
    moved = np.stack([tx - xx, ty - yy], -1).astype(np.float64)
    a = (one[0] + two[0][ty, tx]) / 2
    delta = (one[1] - two[1][ty, tx]) / 2 + np.einsum("...ij,...j", a, moved)
    g, h = np.einsum("...ki,...kj", a, a), np.einsum("...ki,...k", a, delta)
    gxx, gxy, gyy, hx, hy = (box_mean(m, window) for m in (g[..., 0, 0], g[..., 0, 1], g[..., 1, 1], h[..., 0], h[..., 1]))
    det = gxx * gyy - gxy * gxy + 1e-9
    return np.stack([(gyy * hx - gxy * hy) / det, (gxx * hy - gxy * hx) / det], -1)


def dense_flow(prev: np.ndarray, curr: np.ndarray, levels: int = 3, window: int = 9, rounds: int = 2, n: int = 7, sigma: float = 1.5) -> np.ndarray:
    """(height, width, 2) motion from prev to curr in pixels, coarse to fine over a pyramid that halves the size."""
    if prev.shape != curr.shape or prev.ndim != 2:
        raise ValueError("frames must be two-dimensional and of one shape")
    flow = None
    for level in reversed(range(levels)):
        scale = 0.5**level
        if level and min(prev.shape) * scale < 2 * n:
            continue
        pair = [area_downscale(smooth(f.astype(np.float64), 1 / scale * 0.5), scale) if level else f.astype(np.float64) for f in (prev, curr)]
        height, width = pair[0].shape
        if flow is None:
            flow = np.zeros((height, width, 2))
        else:
            y, x = (np.arange(height) * flow.shape[0] // height, np.arange(width) * flow.shape[1] // width)
            flow = flow[np.ix_(y, x)] * np.array([width / flow.shape[1], height / flow.shape[0]])
        one, two = (expansion(f, n, sigma) for f in pair)
        for _ in range(rounds):
            flow = _displace(one, two, flow, window)
    return flow


def weighted_cells(flow: np.ndarray, weight: np.ndarray, stride: int = 4, window: int = 8) -> np.ndarray:
    """Weighted mean vector around each cell's centre; 0 where all weights are."""
    total = box_mean(weight, window)
    sums = [box_mean(flow[..., k] * weight, window) for k in (0, 1)]
    y, x = (np.minimum(np.arange(-(-n // stride)) * stride + stride // 2, n - 1) for n in weight.shape)
    at = np.ix_(y, x)
    return np.stack([np.where(total[at] > 1e-12, s[at] / np.maximum(total[at], 1e-12), 0) for s in sums], -1)
