"""Frames to hashes: resize, cube, cosine transform, signs, words."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from ..functions.hashing import DCT_SIDE, HASH_SIDE, HASH_WORDS

#: Coefficients this small are rounding noise and count as zero.
NOISE = 1e-6
#: Weights of red, green and blue (fixed values).
LUMA = (2126, 7152, 722)


@lru_cache(maxsize=256)
def resampling(source: int, target: int, lobes: int = 3) -> np.ndarray:
    """Weights (target, source) of a Lanczos filter, widened when it shrinks."""
    scale = max(1.0, source / target)
    centre = (np.arange(target) + 0.5) * source / target
    x = (np.arange(source) + 0.5 - centre[:, None]) / scale
    weights = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0)
    return weights / weights.sum(1, keepdims=True)


def resize(frame: np.ndarray, width: int, height: int) -> np.ndarray:
    """A gray or colour frame of bytes in another size."""
    out = np.tensordot(resampling(frame.shape[0], height), frame.astype(np.float64), (1, 0))
    out = np.moveaxis(np.tensordot(resampling(frame.shape[1], width), out, (1, 1)), 0, 1)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def luma(frame: np.ndarray) -> np.ndarray:
    """Gray of a colour frame by the weights of Rec. 709 in whole numbers, cut off."""
    return (frame.astype(np.int64) @ np.array(LUMA) // sum(LUMA)).astype(np.uint8)


@lru_cache(maxsize=8)
def cosines(n: int) -> np.ndarray:
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n))


def cube(frames: list[np.ndarray], side: int = DCT_SIDE) -> np.ndarray | None:
    """``[t, x, y]`` centred at zero of exactly ``side`` frames, else None."""
    if len(frames) != side:
        return None
    return np.stack([resize(f, side, side).T.astype(np.float64) - 128 for f in frames])


def dct3(values: np.ndarray) -> np.ndarray:
    """Unnormalised cosine transform (type II) along all three axes."""
    c = cosines(values.shape[0])
    return np.einsum("ta,xb,yc,abc->txy", c, c, c, values, optimize=True)


def signs(coefficients: np.ndarray, side: int = HASH_SIDE, noise: float = NOISE) -> np.ndarray:
    """Bits of the low corner, time slowest: whether a coefficient is positive."""
    return (coefficients[:side, :side, :side] > noise).ravel()


def words(bits: np.ndarray, count: int = HASH_WORDS) -> list[int]:
    """Bits in 64-bit words, lowest first, as signed numbers."""
    packed = np.packbits(bits, bitorder="little")
    return np.pad(packed, (0, 8 * count - len(packed))).view("<i8").tolist()


def hash_frames(frames: list[np.ndarray]) -> list[int] | None:
    """The words of the first frames' hash; None if there are too few."""
    values = cube(frames[:DCT_SIDE])
    return None if values is None else words(signs(dct3(values)))


def bits_of(hash_words: list[int], count: int = 1000) -> np.ndarray:
    return np.unpackbits(np.array(hash_words, "<i8").view(np.uint8), bitorder="little")[:count]
