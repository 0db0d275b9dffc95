"""Block kernels: distance transform, flood, smoothing and tensors, on one tile at a time.

Tiles are bounded by the tile grid, so a group is a block of fixed largest size; Spark deals the blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def per_tile(voxels: DataFrame, kernel: Callable[[np.ndarray], dict], shape: tuple[int, int, int], columns: dict[str, str], value: str) -> DataFrame:
    """Apply ``kernel`` to each dense tile ``slab, ty, tx`` of sparse ``zl, yl, xl, value``; its arrays become columns."""
    schema = "slab long, ty long, tx long, zl long, yl long, xl long, " + ", ".join(f"{k} {t}" for k, t in columns.items())

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        block = np.zeros(shape, dtype=np.float64)
        at = tuple(pdf[c].to_numpy() for c in ("zl", "yl", "xl"))
        block[at] = pdf[value].to_numpy()
        made = kernel(block)
        out = pdf[["slab", "ty", "tx", "zl", "yl", "xl"]].copy()
        for name in columns:
            out[name] = made[name][at]
        return out

    return voxels.groupBy("slab", "ty", "tx").applyInPandas(one, schema)


def distance(mask: np.ndarray) -> np.ndarray:
    """Exact Euclidean distance to the nearest background voxel; beyond the border is not background."""
    far = float(sum(n * n for n in mask.shape) + 1)
    d = np.where(mask, far, 0.0)
    for axis in range(mask.ndim):
        n = mask.shape[axis]
        moved = np.moveaxis(d, axis, 0)
        best = moved.copy()
        for shift in range(1, n):
            best[shift:] = np.minimum(best[shift:], moved[: n - shift] + shift * shift)
            best[: n - shift] = np.minimum(best[: n - shift], moved[shift:] + shift * shift)
        d = np.moveaxis(best, 0, axis)
    return np.sqrt(np.where(d >= far, np.inf, d))


def components(mask: np.ndarray) -> np.ndarray:
    """Face-connected components, numbered from 1 by their first voxel."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        before = label.copy()
        for axis in range(mask.ndim):
            a, b = (np.moveaxis(label, axis, 0)[s] for s in (slice(None, -1), slice(1, None)))
            both = (a > 0) & (b > 0)
            low = np.minimum(a, b)
            a[both] = np.minimum(a[both], low[both])
            b[both] = np.minimum(b[both], low[both])
        root = np.concatenate([[0], label.ravel()])
        label = root[label]
        if (label == before).all():
            break
    return np.unique(label, return_inverse=True)[1].reshape(mask.shape) + (0 if (label == 0).any() else 1)


def flood(height: np.ndarray, markers: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Marker-based watershed without lines: voxels join the basin that reaches them first, lowest first."""
    out = np.where(mask, markers, 0).astype(np.int64)
    queue: list = []
    age = 0
    for at in zip(*np.nonzero(out), strict=True):
        heapq.heappush(queue, (height[at], age, at))
        age += 1
    while queue:
        level, _, at = heapq.heappop(queue)
        for axis in range(mask.ndim):
            for step in (-1, 1):
                to = (*at[:axis], at[axis] + step, *at[axis + 1 :])
                if 0 <= to[axis] < mask.shape[axis] and mask[to] and not out[to]:
                    out[to] = out[at]
                    heapq.heappush(queue, (max(level, height[to]), age, to))
                    age += 1
    return out


def gaussian(block: np.ndarray, sigma: float, order: int = 0, axis: int | None = None) -> np.ndarray:
    """Separable Gaussian, or its first derivative along ``axis``; four sigmas, reflecting borders."""
    radius = int(4 * sigma + 0.5)
    t = np.arange(-radius, radius + 1)
    g = np.exp(-(t**2) / (2 * sigma**2))
    g /= g.sum()
    slope = t / sigma**2 * g
    out = block.astype(np.float64)
    for k in range(block.ndim):
        kernel = slope if order and k == axis else g
        padded = np.pad(out, [(radius, radius) if j == k else (0, 0) for j in range(block.ndim)], mode="symmetric")
        n = out.shape[k]
        out = sum(w * np.take(padded, range(j, j + n), axis=k) for j, w in enumerate(kernel))
    return out


def structure_tensor(block: np.ndarray, inner: float = 1.0, outer: float = 2.0) -> dict:
    """Normal (largest eigenvector) and planarity of the smoothed gradient products."""
    g = [gaussian(block, inner, 1, a) for a in range(3)]
    t = np.empty((*block.shape, 3, 3))
    for i in range(3):
        for j in range(i, 3):
            t[..., i, j] = t[..., j, i] = gaussian(g[i] * g[j], outer)
    values, vectors = np.linalg.eigh(t)
    return {"normal": vectors[..., 2], "planarity": (values[..., 2] - values[..., 1]) / (values[..., 2] + 1e-6)}


def equalise(plane: np.ndarray, tile: int = 64, clip: float = 0.02, bins: int = 256) -> np.ndarray:
    """Contrast-limited adaptive histogram equalisation of one slice with values from 0 to 1."""
    ny, nx = (max(1, -(-n // tile)) for n in plane.shape)
    level = np.clip((plane * (bins - 1)).astype(int), 0, bins - 1)
    maps = np.empty((ny, nx, bins))
    for i in range(ny):
        for j in range(nx):
            part = level[i * tile : (i + 1) * tile, j * tile : (j + 1) * tile]
            h = np.bincount(part.ravel(), minlength=bins).astype(float)
            most = max(1.0, clip * part.size)
            over = np.maximum(h - most, 0).sum()
            h = np.minimum(h, most) + over / bins
            maps[i, j] = np.cumsum(h) / h.sum()
    y = np.clip((np.arange(plane.shape[0]) + 0.5) / tile - 0.5, 0, ny - 1)
    x = np.clip((np.arange(plane.shape[1]) + 0.5) / tile - 0.5, 0, nx - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, ny - 1), np.minimum(x0 + 1, nx - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    at = lambda a, b: maps[a[:, None], b[None, :], level]
    return (1 - fy) * ((1 - fx) * at(y0, x0) + fx * at(y0, x1)) + fy * ((1 - fx) * at(y1, x0) + fx * at(y1, x1))


def sample(block: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Trilinear values at fractional ``points`` (n, 3), the border value beyond the block."""
    top = np.array(block.shape) - 1
    p = np.clip(points, 0, top)
    low = np.minimum(p.astype(int), np.maximum(top - 1, 0))
    f = p - low
    out = np.zeros(len(p))
    for corner in range(8):
        step = np.array([(corner >> k) & 1 for k in range(3)])
        weight = np.prod(np.where(step, f, 1 - f), axis=1)
        at = np.minimum(low + step, top)
        out += weight * block[at[:, 0], at[:, 1], at[:, 2]]
    return out


def ridges(block: np.ndarray, reach: float = 1.5, planar: float = 0.3) -> np.ndarray:
    """Voxels brighter than both sides along their normal, where the tensor is planar."""
    t = structure_tensor(block)
    at = np.stack(np.meshgrid(*[np.arange(n) for n in block.shape], indexing="ij"), axis=-1).reshape(-1, 3)
    normal = t["normal"].reshape(-1, 3)
    up, down = sample(block, at + reach * normal), sample(block, at - reach * normal)
    value = block.ravel()
    return ((value > up) & (value > down) & (t["planarity"].ravel() > planar)).reshape(block.shape)


def separate(mask: np.ndarray, core: float = 2.0, least: int = 3) -> np.ndarray:
    """Instances of a mask: components of its deep core as seeds, flooded down the distance field."""
    d = distance(mask)
    d = np.where(np.isinf(d), sum(mask.shape), d)
    seeds = components(mask & (d >= core))
    size = np.bincount(seeds.ravel())
    seeds = np.where(size[seeds] >= least, seeds, 0)
    return flood(-d, seeds, mask.astype(bool))


def dip(block: np.ndarray, reach: int = 8) -> dict:
    """Profile through the block's centre along its normal: median of the shoulders, dip, and contrast."""
    centre = (np.array(block.shape) - 1) / 2
    normal = structure_tensor(block)["normal"][tuple(centre.astype(int))]
    profile = sample(block, centre + np.arange(-reach, reach + 1)[:, None] * normal)
    shoulder = float(np.median(np.concatenate([profile[: reach // 2], profile[-(reach // 2) :]])))
    contrast = float(np.percentile(block, 95) - np.percentile(block, 5))
    depth = shoulder - float(profile[reach - 1 : reach + 2].min())
    return {"shoulder": shoulder, "dip": depth, "dip_over_contrast": depth / contrast if contrast else 0.0, "contrast": contrast}


def scale_of(depth: np.ndarray, nominal: float = 1.2) -> float:
    """How much thicker the sheets of a block are than nominal: 90th percentile of depth over it, 0.5 to 8."""
    inside = depth[(depth > 0) & np.isfinite(depth)]
    return float(np.clip(np.percentile(inside, 90) / nominal, 0.5, 8)) if inside.size else 1.0


def consolidate(lines: np.ndarray, normal: np.ndarray, reach: float = 4.0, k: int = 10, along: float = 0.5, parallel: float = 0.8) -> np.ndarray:
    """Centre-line fragments joined where points of two lie near each other in one plane.

    Each point looks at its nearest points within ``reach``; a pair counts where the step between them is
    mostly in the plane of the source and the normals agree; fragments with such a pair are one.
    """
    at = np.argwhere(lines > 0)
    label = lines[lines > 0]
    n = normal[lines > 0]
    parent = {int(v): int(v) for v in np.unique(label)}

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for i in range(len(at)):
        step = at - at[i]
        d = np.sqrt((step * step).sum(1))
        near = [j for j in np.argsort(d, kind="stable")[:k] if 0 < d[j] < reach and j > i]
        for j in near:
            if abs(step[j] @ n[i]) <= along * d[j] and abs(n[i] @ n[j]) >= parallel:
                a, b = sorted((root(int(label[i])), root(int(label[j]))))
                parent[b] = a
    out = np.zeros_like(lines)
    out[lines > 0] = [root(int(v)) for v in label]
    return out


def split_stack(block: np.ndarray, least: int = 4) -> np.ndarray:
    """Fused sheets of one block apart: contrast, ridges, fragments joined, and a flood over darkness."""
    mask = block > 0
    if not mask.any():
        return np.zeros(block.shape, dtype=np.int64)
    bright = np.stack([equalise(p / max(block.max(), 1e-9), 8) for p in block])
    lines = components(ridges(bright) & mask)
    size = np.bincount(lines.ravel())
    lines = np.where((size[lines] >= least) & (lines > 0), lines, 0)
    if not lines.any():
        return components(mask)
    seeds = consolidate(lines, structure_tensor(bright)["normal"])
    out = flood(-bright, seeds, mask)
    rest = components(mask & (out == 0))
    return np.where(out > 0, out, np.where(rest > 0, rest + out.max(), 0))
