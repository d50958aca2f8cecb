"""A gated recurrent unit in numpy: forward, backward and Adam."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def step(gates: np.ndarray, h: np.ndarray, u: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, tuple]:
    """One step. gates: inputs of update, reset and candidate; u: recurrent weights; c: candidate's bias."""
    k = h.shape[1]
    a = h @ u
    zr = sigmoid(gates[:, : 2 * k] + a[:, : 2 * k])
    z, r = zr[:, :k], zr[:, k:]
    inner = a[:, 2 * k :] + c
    n = np.tanh(gates[:, 2 * k :] + r * inner)
    return n + z * (h - n), (h, z, r, inner, n)


def forward(gates: np.ndarray, h: np.ndarray, u: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, list]:
    """gates: (time, batch, 3k). Returns all states and what ``backward`` needs."""
    states, kept = np.empty((*gates.shape[:2], h.shape[1]), np.float32), []
    for t in range(len(gates)):
        h, saved = step(gates[t], h, u, c)
        states[t] = h
        kept.append(saved)
    return states, kept


def backward(d_states: np.ndarray, kept: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of gates, u and c from those of the states."""
    k = u.shape[0]
    d_gates = np.empty((*d_states.shape[:2], 3 * k), np.float32)
    d_u, d_c, d_h = np.zeros_like(u), np.zeros(k, np.float32), np.zeros(d_states.shape[1:], np.float32)
    for t in range(len(kept) - 1, -1, -1):
        h, z, r, inner, n = kept[t]
        d = d_h + d_states[t]
        d_n = d * (1 - z) * (1 - n * n)
        d_r = d_n * inner * r * (1 - r)
        d_z = d * (h - n) * z * (1 - z)
        d_inner = d_n * r
        d_a = np.concatenate((d_z, d_r, d_inner), axis=1)
        d_gates[t] = np.concatenate((d_z, d_r, d_n), axis=1)
        d_u += h.T @ d_a
        d_c += d_inner.sum(0)
        d_h = d * z + d_a @ u.T
    return d_gates, d_u, d_c


class Adam:
    """Adam over a dictionary of arrays."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        clip = np.float32(min(1.0, 5.0 / max(norm, 1e-9)))
        for k, g in grads.items():
            g = g * clip
            self.m[k] += np.float32(0.1) * (g - self.m[k])
            self.v[k] += np.float32(0.001) * (g * g - self.v[k])
            self.params[k] -= np.float32(scale) * self.m[k] / (np.sqrt(self.v[k]) + np.float32(1e-8))
