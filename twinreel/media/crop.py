"""Crop detection: letterboxes, and what moves."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Crop:
    w: int
    h: int
    left: int = 0
    right: int = 0
    top: int = 0
    bottom: int = 0

    def __post_init__(self):
        if self.left + self.right >= self.w or self.top + self.bottom >= self.h:
            raise ValueError("nothing would be left")

    @classmethod
    def from_corner(cls, w: int, h: int, x: int, y: int, width: int, height: int) -> Crop:
        return cls(w, h, x, w - x - width, y, h - y - height)

    def union(self, other: Crop) -> Crop:
        return Crop(self.w, self.h, *(min(getattr(self, f), getattr(other, f)) for f in ("left", "right", "top", "bottom")))

    def view(self) -> tuple[int, int, int, int]:
        return self.left, self.top, self.w - self.left - self.right, self.h - self.top - self.bottom

    def area(self) -> int:
        return self.view()[2] * self.view()[3]

    def aspect(self) -> float:
        return self.view()[2] / self.view()[3]

    def elongation(self) -> float:
        """The longer side over the shorter one."""
        return max(self.aspect(), 1 / self.aspect())

    def uncropped(self) -> bool:
        return not (self.left or self.right or self.top or self.bottom)

    def eroded(self) -> Crop | None:
        try:
            return Crop(self.w, self.h, self.left + 1, self.right + 1, self.top + 1, self.bottom + 1)
        except ValueError:
            return None

    def apply(self, frame: np.ndarray) -> np.ndarray:
        if frame.shape[:2] != (self.h, self.w):
            raise ValueError("the frame has another size")
        return frame[self.top : self.h - self.bottom, self.left : self.w - self.right]

    def mask(self) -> np.ndarray:
        """True outside."""
        out = np.ones((self.h, self.w), bool)
        out[self.top : self.h - self.bottom, self.left : self.w - self.right] = False
        return out


#: A strip belongs to a bar if more than this share of it is near its mode.
BAR_SHARE = 0.9


def bar(strip: np.ndarray, tolerance: int, black_or_white: bool) -> bool:
    if black_or_white:
        near = (strip <= tolerance) | (strip >= 255 - tolerance)
    else:
        counts = np.bincount(strip, minlength=256)
        mode = 255 - int(np.argmax(counts[::-1]))  # the brightest of several
        near = np.abs(strip.astype(int) - mode) <= tolerance
    return near.sum() > BAR_SHARE * len(strip)


def letterbox(frame: np.ndarray, tolerance: int = 16, black_or_white: bool = False) -> Crop:
    """Bars at the sides of one frame; none where they would meet."""
    h, w = frame.shape

    def leading(strips: list[np.ndarray]) -> int:
        for i, strip in enumerate(strips):
            if not bar(strip, tolerance, black_or_white):
                return i
        return len(strips)

    rows, columns = list(frame), list(frame.T)
    left, right, top, bottom = leading(columns), leading(columns[::-1]), leading(rows), leading(rows[::-1])
    if left + right >= w or top + bottom >= h:
        return Crop(w, h)
    return Crop(w, h, left, right, top, bottom)


def letterbox_frames(frames: list[np.ndarray], tolerance: int = 16, step: int = 1, most: int | None = None) -> Crop:
    """What no chosen frame has in a bar."""
    out = None
    for frame in frames[::step][:most]:
        found = letterbox(frame, tolerance)
        out = found if out is None else out.union(found)
    return out


def hash_letterbox(frames: list[np.ndarray]) -> Crop | None:
    """As hashes use it: every eighth frame, eight at most."""
    return letterbox_frames(frames, step=8, most=8) if frames else None


# motion


def shifted(image: np.ndarray, radius: int, pick) -> np.ndarray:
    """``pick`` (a minimum or maximum) over squares of this radius."""
    out = image
    for axis in (0, 1):
        edge = 255 if pick is np.minimum else 0
        padded = np.pad(out, [(radius, radius) if a == axis else (0, 0) for a in (0, 1)], constant_values=edge)
        stack = [np.take(padded, np.arange(i, i + out.shape[axis]), axis) for i in range(2 * radius + 1)]
        out = pick.reduce(stack)
    return out


def opened(mask: np.ndarray, radius: int) -> np.ndarray:
    return shifted(shifted(mask, radius, np.minimum), radius, np.maximum)


def closed(mask: np.ndarray, radius: int) -> np.ndarray:
    return shifted(shifted(mask, radius, np.maximum), radius, np.minimum)


def blurred(image: np.ndarray, sigma: float = 2.0) -> np.ndarray:
    radius = int(np.ceil(2 * sigma))
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    out = image.astype(np.float64)
    for axis in (0, 1):  # beyond an edge there is nothing, and the weights of what is there add up to one
        size = image.shape[axis]
        band = np.zeros((size, size + 2 * radius))
        for i, w in enumerate(weights):
            band[np.arange(size), np.arange(size) + i] = w
        band = band[:, radius:-radius]
        out = np.moveaxis(np.tensordot(band / band.sum(1, keepdims=True), out, (1, axis)), 0, axis)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def regions(mask: np.ndarray) -> np.ndarray:
    """Numbers of the regions of nonzero pixels that touch, also at corners; 0
    elsewhere.  Smallest labels spread until nothing changes."""
    on = mask != 0
    label = np.where(on, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    big = mask.size + 1
    while True:
        low = np.pad(np.where(on, label, big), 1, constant_values=big)
        around = np.minimum.reduce([low[i : i + mask.shape[0], j : j + mask.shape[1]] for i in range(3) for j in range(3)])
        fresh = np.where(on, around, 0)
        flat = fresh.ravel()
        jump = np.where(on.ravel(), flat[np.maximum(flat - 1, 0)], 0).reshape(mask.shape)  # a label's pixel may know a smaller one
        if (jump == label).all():
            break
        label = jump
    return np.unique(label, return_inverse=True)[1].reshape(mask.shape) if (label == 0).any() else np.unique(label, return_inverse=True)[1].reshape(mask.shape) + 1


def largest_region(mask: np.ndarray) -> np.ndarray | None:
    """The region of most pixels, the last of several; None without any."""
    label = regions(mask)
    counts = np.bincount(label.ravel())[1:]
    return None if not len(counts) else label == len(counts) - int(np.argmax(counts[::-1]))


def bounding_crop(mask: np.ndarray) -> Crop | None:
    ys, xs = np.nonzero(mask)
    if not len(ys):
        return None
    h, w = mask.shape
    return Crop(w, h, int(xs.min()), int(w - 1 - xs.max()), int(ys.min()), int(h - 1 - ys.max()))


#: Brightness below which the darkest frame is dark, differences that count as
#: none, and the threshold of motion (fixed values).
DARK, STILL, MOVES = 210, 8, 20
#: The longest sides of a plausible crop, and the share of the largest area that
#: a crop needs (fixed values).
WORST_ASPECT, NEARLY = 3.0, 0.8


def darkest(frames: list[np.ndarray]) -> np.ndarray:
    """255 where some frame is not bright, else 0."""
    return np.where(np.minimum.reduce(frames) < DARK, 255, 0).astype(np.uint8)


def frame_change(frames: list[np.ndarray]) -> np.ndarray:
    """Sum of the differences of neighbours, small ones as none."""
    total = np.zeros(frames[0].shape, np.int64)
    for a, b in zip(frames, frames[1:], strict=False):
        d = np.abs(a.astype(np.int64) - b)
        total += np.where(d < STILL, 0, d)
    return np.minimum(total, 65535)


def motion_mask(frames: list[np.ndarray]) -> np.ndarray:
    change = frame_change(frames)
    change -= change.min()
    if not change.max():
        return np.zeros(change.shape, np.uint8)
    full = (change * (65535 / change.max())).astype(np.int64)  # to 16 bits, and then to 8 by rounding
    scaled = ((full + 128) // 257).astype(np.uint8)
    return closed(np.where(blurred(scaled) > MOVES, 255, 0).astype(np.uint8), 5)


def motion_pass(frames: list[np.ndarray]) -> Crop | None:
    """The box of the largest dark region with motion in it, worn off twice, or
    not at all where that would leave nothing."""
    dark = darkest(frames)
    if dark.shape[0] > 100:
        dark = opened(dark, min(dark.shape[0] // 10, 10))
    label = regions(dark)
    touched = np.unique(label[(motion_mask(frames) > 0) & (dark > 0)])
    chosen = largest_region(np.isin(label, touched[touched > 0]).astype(np.uint8))
    found = None if chosen is None else bounding_crop(chosen)
    if found is None or found.uncropped():
        return found
    once = found.eroded()
    return once and once.eroded() or found


def stretched(frames: list[np.ndarray]) -> list[np.ndarray]:
    """Contrast to the full range, if neither end is reached."""
    low, high = min(int(f.min()) for f in frames), max(int(f.max()) for f in frames)
    if high == 255 or low == 0 or low >= high:
        return frames
    return [((f.astype(np.float64) - low) * 255 / (high - low)).astype(np.uint8) for f in frames]


def whitened(frames: list[np.ndarray], where: np.ndarray) -> list[np.ndarray]:
    return [np.where(where, 255, f).astype(np.uint8) for f in frames]


def motion_crop(frames: list[np.ndarray]) -> Crop | None:
    """The box of what moves: of two passes, the second without the first's area,
    those of fair shape and of nearly the largest area of both, the topmost; the
    letterbox if there is none.  None for fewer than two frames or several sizes."""
    if len(frames) < 2 or len({f.shape for f in frames}) > 1:
        return None
    frames = stretched(frames)
    box = letterbox_frames(frames)
    inside = whitened(frames, box.mask())
    first = motion_pass(inside)
    second = motion_pass(whitened(inside, ~first.mask())) if first is not None else None
    both = [c for c in (first, second) if c is not None]
    large = max((c.area() for c in both), default=0)
    fair = [c for c in both if c.elongation() <= WORST_ASPECT and c.area() > NEARLY * large]
    return min(fair, key=lambda c: c.top, default=box)
