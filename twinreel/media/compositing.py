"""Images beside each other, and how much detail an image has."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from .crop import blurred, regions
from .transform import luma, resize

#: Side to which images are brought, and the weak and the strong threshold of an
#: edge (fixed values).
EDGE_SIDE, WEAK, STRONG = 800, 5.0, 30.0


def grid(rows: Sequence[Sequence[np.ndarray]]) -> np.ndarray | None:
    """Images of one size in rows, black where a row is shorter than the longest;
    None without any image."""
    shapes = {image.shape for row in rows for image in row}
    if not shapes:
        return None
    if len(shapes) > 1:
        raise ValueError("the images differ in size")
    (shape,) = shapes
    height, width = shape[:2]
    out = np.zeros((height * len(rows), width * max(map(len, rows)), *shape[2:]), np.uint8)
    for y, row in enumerate(rows):
        for x, image in enumerate(row):
            out[y * height : (y + 1) * height, x * width : (x + 1) * width] = image
    return out


def side_by_side(images: Sequence[np.ndarray]) -> np.ndarray | None:
    return grid([images]) if len(images) else None


def stacked(images: Sequence[np.ndarray]) -> np.ndarray | None:
    return grid([[image] for image in images]) if len(images) else None


def edges(image: np.ndarray, weak: float = WEAK, strong: float = STRONG) -> np.ndarray:
    """Canny: edges of the blurred image, thinned to their ridges, that are strong
    or touch a strong one by way of weak ones."""
    smooth = np.pad(blurred(image, 1.4).astype(np.float64), 1, mode="edge")
    across = smooth[:, 2:] - smooth[:, :-2]
    down = smooth[2:] - smooth[:-2]
    gx = across[:-2] + 2 * across[1:-1] + across[2:]
    gy = down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:]
    size = np.hypot(gx, gy)
    angle = np.round(np.degrees(np.arctan2(gy, gx)) / 45).astype(int) % 4
    around = np.pad(size, 1)
    h, w = size.shape
    ridge = np.zeros(size.shape, bool)
    for turn, (dy, dx) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
        ahead = around[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
        behind = around[1 - dy : 1 - dy + h, 1 - dx : 1 - dx + w]
        ridge |= (angle == turn) & (size >= ahead) & (size >= behind)
    ridge[[0, -1]] = ridge[:, [0, -1]] = False
    label = regions((ridge & (size >= weak)).astype(np.uint8))
    held = np.unique(label[ridge & (size >= strong)])
    return np.isin(label, held[held > 0])


def edge_pixels(image: np.ndarray, side: int = EDGE_SIDE) -> int:
    """How many pixels of an image, brought to one size, lie on an edge."""
    gray = luma(image) if image.ndim == 3 else image
    return int(edges(resize(gray, side, side)).sum())
