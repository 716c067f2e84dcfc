"""Character n-gram features over Arrow text, hashed in NumPy."""

from __future__ import annotations

import numpy as np

_A = np.uint32(0x9E3779B1)
_B = np.uint32(0x85EBCA6B)


def gram_ids(text: str, orders: tuple[int, ...], bits: int) -> list[np.ndarray]:
    """Hashed ids (below 2**bits) of all character n-grams of the lower-cased text, one array an order.

    The text is framed by one space at each end."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    out, h = [], np.zeros(len(c), np.uint32)
    for k in range(1, max(orders) + 1):
        m = len(c) - k + 1
        if m <= 0:
            break
        h = (h[:m] ^ c[k - 1 :]) * _A
        h ^= h >> np.uint32(15)
        if k in orders:
            x = (h + np.uint32(k)) * _B
            out.append(x >> np.uint32(32 - bits))
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float, steps: int = 300, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regressions of the columns of ``y`` (0/1) on dense rows ``x``, by Adam; (w, b)."""
    n, k = x.shape[1], y.shape[1]
    w, b = np.zeros((n, k), np.float32), np.zeros(k, np.float32)
    m, v = np.zeros((n + 1, k), np.float32), np.zeros((n + 1, k), np.float32)
    weight = (weight / weight.sum(axis=0)).astype(np.float32)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        e = (p - y) * weight
        g = np.vstack([x.T @ e + l2 * w, e.sum(axis=0)[None]])
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w -= step[:-1]
        b -= step[-1]
    return w, b
