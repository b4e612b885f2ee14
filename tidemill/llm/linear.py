"""Hashed byte n-gram features and linear models for the classifiers of this subpackage."""

from __future__ import annotations

import numpy as np

DIMS = 4096
_PART = 1 << 20


def features(raw: bytes, dims: int = DIMS) -> np.ndarray:
    """Square roots of the counts of hashed byte pairs and triples, of length 1 (0 for less than two bytes). Whole texts, a part at a time."""
    counts = np.zeros(dims, np.int64)
    for s in range(0, len(raw), _PART):
        a = np.frombuffer(raw[s : s + _PART + 2], np.uint8).astype(np.uint32)
        if len(a) < 2:
            break
        two = a[:-1] * np.uint32(0x9E3779B1) + a[1:] * np.uint32(0x85EBCA77)
        full = min(len(two), _PART)
        counts += np.bincount((two[:full] >> np.uint32(11)) % np.uint32(dims), minlength=dims)
        if len(a) > 2:
            three = two[:-1] * np.uint32(0xC2B2AE3D) + a[2:] * np.uint32(0x27D4EB2F)
            counts += np.bincount((three[:_PART] >> np.uint32(11)) % np.uint32(dims), minlength=dims)
    x = np.sqrt(counts, dtype=np.float32)
    norm = float(np.linalg.norm(x))
    return x / norm if norm else x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _descend(x: np.ndarray, slope, step: float, l2: float, rounds: int) -> np.ndarray:
    """Weights and bias by accelerated gradient descent on the whole sample; the same on every run."""
    x1 = np.hstack([x.astype(np.float32), np.ones((len(x), 1), np.float32)])
    w = z = np.zeros(x1.shape[1], np.float32)
    for k in range(rounds):
        grad = x1.T @ slope(x1 @ z) / len(x1) + l2 * z
        new = (z - step * grad).astype(np.float32)
        z = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w


def svm(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, rounds: int = 150) -> np.ndarray:
    """Squared-hinge linear support vector machine; y is 1 or -1, both classes weigh the same."""
    weight = np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-9), 0.5 / max((y < 0).mean(), 1e-9)).astype(np.float32)
    return _descend(x, lambda m: -2 * weight * y * np.maximum(0, 1 - y * m), 0.25 / float(weight.max(initial=1)), l2, rounds)


def logistic(x: np.ndarray, p: np.ndarray, l2: float = 1e-5, rounds: int = 300) -> np.ndarray:
    """Logistic regression on soft labels p."""
    return _descend(x, lambda m: sigmoid(m) - p, 2.0, l2, rounds)


def margin(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]
