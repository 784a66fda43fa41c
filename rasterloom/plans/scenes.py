"""Synthetic scenes with a known answer, for tests and the bench."""

from __future__ import annotations

import math

import numpy as np

from ..operators.features import blur
from .registration import area_resize, warp


def terrain(size: int = 512, seed: int = 42) -> np.ndarray:
    """Cratered ground, 0..255."""
    rng = np.random.default_rng(seed)
    img = 100 + 12 * blur(rng.normal(size=(size, size)), 8.0) * 8 + 18 * blur(rng.normal(size=(size, size)), 2.0) * 3
    y, x = np.mgrid[:size, :size]
    for _ in range(15 * (size // 256) ** 2):
        cy, cx, r = rng.uniform(0, size), rng.uniform(0, size), rng.uniform(4, 28)
        d = np.hypot(y - cy, x - cx) / r
        img += np.where(d < 1, -35 * (1 - d * d), 25 * np.exp(-((d - 1.1) ** 2) / 0.03)) * np.where(d < 2, 1, 0)
    return np.floor(np.clip(blur(img + rng.normal(size=img.shape) * 6, 1.2), 1, 255))


def rotation(degrees: float, size: int, dx: float = 0.0, dy: float = 0.0) -> np.ndarray:
    c, s, h = math.cos(math.radians(degrees)), math.sin(math.radians(degrees)), (size - 1) / 2
    return np.array([[c, -s, h - c * h + s * h + dx], [s, c, h - s * h - c * h + dy], [0, 0, 1]])


def relit(img: np.ndarray, degrees: float, axis: int = 1) -> np.ndarray:
    strength = min(max(degrees / 90, 0), 0.9)
    ramp = np.linspace(0, 1, img.shape[axis]).reshape((1, -1) if axis == 1 else (-1, 1))
    lit = np.clip(img / 255 * (1 - strength + 2 * strength * ramp), 0, 1) ** (1 + 0.4 * strength)
    if degrees >= 40:
        lit = np.clip(lit - 0.12 + 0.12 * ramp, 0, 1)
    return np.floor(lit * 255)


def cases(size: int = 512) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray | None, float, str]]:
    """name: (source, reference, true matrix or None, reference pixel size, illumination method)."""
    base = terrain(size)
    shift, turn = np.array([[1, 0, 15.0], [0, 1, -10.0], [0, 0, 1]]), rotation(5, size, 10, -5)
    small = lambda img, k: area_resize(img, size // k, size // k)
    turned = relit(warp(base, rotation(3, size, 8, -6), base.shape), 30, 0)
    return {
        "A": (base, warp(base, shift, base.shape), shift, 1.0, "clahe"), "B": (base, warp(base, turn, base.shape), turn, 1.0, "clahe"),
        "C": (base, small(base, 2), None, 2.0, "clahe"), "D": (base, small(base, 4), None, 4.0, "clahe"),
        "E": (base, relit(base, 15), np.eye(3), 1.0, "phase_congruency"), "F": (base, relit(base, 45), np.eye(3), 1.0, "phase_congruency"),
        "G": (base, small(turned, 2), None, 2.0, "phase_congruency"),
    }


def point_error(truth: np.ndarray, found: np.ndarray, size: int) -> tuple[float, float]:
    """Mean and largest distance on a 9 x 9 grid."""
    at = size * np.linspace(0.1, 0.9, 9)
    p = np.stack([*map(np.ravel, np.meshgrid(at, at)), np.ones(81)])
    a, b = truth @ p, found @ p
    d = np.hypot(*(a[:2] / a[2] - b[:2] / b[2]))
    return float(d.mean()), float(d.max())
