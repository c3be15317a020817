"""A gated recurrent layer in numpy, forward and backward through time, and the Adam rule.

Inputs are given as already projected to the three gates (an embedding row can hold the projection), time
first. Lanes shorter than the batch are padded; a mask keeps their state. float32 throughout."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def init(rng: np.random.Generator, *shape: int, scale: float | None = None) -> np.ndarray:
    return (rng.standard_normal(shape) * (scale if scale is not None else shape[0] ** -0.5)).astype(np.float32)


def forward(gates: np.ndarray, u: np.ndarray, mask: np.ndarray | None, keep: bool = False) -> tuple[np.ndarray, list]:
    """gates [T, B, 3H] (update, reset, candidate), u [H, 3H], mask [T, B, 1] or None -> states [T, B, H]."""
    steps, lanes, h3 = gates.shape
    n = h3 // 3
    h, out, cache = np.zeros((lanes, n), np.float32), np.empty((steps, lanes, n), np.float32), []
    for t in range(steps):
        g, r_in = gates[t], h @ u
        zr = sigmoid(g[:, : 2 * n] + r_in[:, : 2 * n])
        z, r = zr[:, :n], zr[:, n:]
        c = np.tanh(g[:, 2 * n :] + r * r_in[:, 2 * n :])
        new = c + z * (h - c)
        if mask is not None:
            new = h + mask[t] * (new - h)
        if keep:
            cache.append((h, z, r, c, r_in[:, 2 * n :]))
        h = out[t] = new
    return out, cache


def states(gates: list[np.ndarray] | np.ndarray, u: np.ndarray) -> np.ndarray:
    """As forward, without masks and in place: gates is a sequence of [B, 3H], which are used up. With the same weights
    the update and reset columns may be halved beforehand (see `halved`)."""
    lanes, h3 = gates[0].shape
    n = h3 // 3
    out = np.empty((len(gates), lanes, n), np.float32)
    h, r_in = np.zeros((lanes, n), np.float32), np.empty((lanes, h3), np.float32)
    for t, g in enumerate(gates):
        np.dot(h, u, out=r_in)
        zr = r_in[:, : 2 * n]
        zr += g[:, : 2 * n]
        np.tanh(zr, out=zr)
        zr += 1
        zr *= 0.5
        c = r_in[:, 2 * n :]
        c *= zr[:, n:]
        c += g[:, 2 * n :]
        np.tanh(c, out=c)
        new = out[t]
        np.subtract(h, c, out=new)
        new *= zr[:, :n]
        new += c
        h = new
    return out


def halved(x: np.ndarray) -> np.ndarray:
    """Gate columns for `states`: sigmoid(a) = (tanh(a / 2) + 1) / 2."""
    x = x.copy()
    x[:, : x.shape[1] // 3 * 2] *= 0.5
    return x


def scattered(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """[n, ...]: the sum of the rows that go to each place."""
    out = np.zeros((n, *rows.shape[1:]), rows.dtype)
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.diff(at, prepend=-1))
    out[at[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


def backward(d_out: np.ndarray, u: np.ndarray, mask: np.ndarray, cache: list) -> tuple[np.ndarray, np.ndarray]:
    """From d(loss)/d(states) to d/d(gates) and d/d(u)."""
    steps, lanes, n = d_out.shape
    d_gates, d_u, dh = np.empty((steps, lanes, 3 * n), np.float32), np.zeros_like(u), np.zeros((lanes, n), np.float32)
    for t in range(steps - 1, -1, -1):
        h, z, r, c, rc = cache[t]
        dh = dh + d_out[t]
        d_new, carry = dh * mask[t], dh * (1 - mask[t])
        d_c, d_z = d_new * (1 - z), d_new * (h - c)
        d_pre_c = d_c * (1 - c * c)
        d_r = d_pre_c * rc
        d_z_pre, d_r_pre = d_z * z * (1 - z), d_r * r * (1 - r)
        d_gates[t] = np.concatenate([d_z_pre, d_r_pre, d_pre_c], axis=1)
        d_rec = np.concatenate([d_z_pre, d_r_pre, d_pre_c * r], axis=1)
        d_u += h.T @ d_rec
        dh = carry + d_new * z + d_rec @ u.T
    return d_gates, d_u


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray], clip: float = 1.0) -> None:
        self.t += 1
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads.values())))
        shrink = min(1.0, clip / (norm + 1e-9))
        for k, g in grads.items():
            g = g * shrink
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            rate = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
            self.params[k] -= (rate * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype(np.float32)
