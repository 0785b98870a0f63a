"""A bidirectional gated recurrent layer in numpy: inference from tables of projected inputs, and backpropagation through time."""

from __future__ import annotations

import numpy as np


def sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def init(rng, inputs: int, hidden: int) -> dict[str, np.ndarray]:
    """Parameters of one direction; gates are in the order update, reset, new."""
    u = rng.normal(0, 0.4 / np.sqrt(hidden), (hidden, 3 * hidden))
    return {"w": rng.normal(0, 0.3, (inputs, 3 * hidden)).astype(np.float32), "u": u.astype(np.float32), "b": np.repeat([1.0, 0.0, 0.0], hidden).astype(np.float32), "bn": np.zeros(hidden, np.float32)}


def states(table: np.ndarray, steps: np.ndarray, p: dict) -> np.ndarray:
    """Hidden states (T, B, H) for rows `steps` (T, B) of a table of projected inputs, whose gates the bias is already in."""
    t, b = steps.shape
    h3 = table.shape[1]
    h = h3 // 3
    out = np.empty((t, b, h), np.float32)
    u = np.ascontiguousarray(np.concatenate([0.5 * p["u"][:, : 2 * h], p["u"][:, 2 * h :]], 1))
    table = np.concatenate([0.5 * table[:, : 2 * h], table[:, 2 * h :]], 1).astype(np.float32)
    bn = p["bn"]
    last = np.zeros((b, h), np.float32)
    a, gate, new = np.empty((b, h3), np.float32), np.empty((b, 2 * h), np.float32), np.empty((b, h), np.float32)
    for k in range(t):
        g = table.take(steps[k], axis=0)
        np.matmul(last, u, out=a)
        np.add(a[:, : 2 * h], g[:, : 2 * h], out=gate)
        np.tanh(gate, out=gate)
        gate *= 0.5
        gate += 0.5
        np.add(a[:, 2 * h :], bn, out=new)
        new *= gate[:, h:]
        new += g[:, 2 * h :]
        np.tanh(new, out=new)
        last -= new
        last *= gate[:, :h]
        last += new
        out[k] = last
    return out


def forward(gx: np.ndarray, p: dict):
    """Training pass over projected inputs (T, B, 3H): states and what the way back needs."""
    t, b, h3 = gx.shape
    h = h3 // 3
    hs = np.zeros((t + 1, b, h), np.float32)
    zr, n, un = np.empty((t, b, 2 * h), np.float32), np.empty((t, b, h), np.float32), np.empty((t, b, h), np.float32)
    for k in range(t):
        a = hs[k] @ p["u"]
        zr[k] = sigmoid(a[:, : 2 * h] + gx[k, :, : 2 * h])
        un[k] = a[:, 2 * h :] + p["bn"]
        n[k] = np.tanh(gx[k, :, 2 * h :] + zr[k, :, h:] * un[k])
        hs[k + 1] = n[k] + zr[k, :, :h] * (hs[k] - n[k])
    return hs[1:], (hs, zr, n, un)


def backward(dhs: np.ndarray, saved, p: dict):
    """Gradients of the projected inputs and of u and bn, from those of the states."""
    hs, zr, n, un = saved
    t, b, h = n.shape
    dg = np.empty((t, b, 3 * h), np.float32)
    du, dbn = np.zeros_like(p["u"]), np.zeros_like(p["bn"])
    dh = np.zeros((b, h), np.float32)
    for k in range(t - 1, -1, -1):
        dh = dh + dhs[k]
        z, r = zr[k, :, :h], zr[k, :, h:]
        dn = dh * (1 - z) * (1 - n[k] ** 2)
        dun = dn * r
        dg[k, :, :h] = dh * (hs[k] - n[k]) * z * (1 - z)
        dg[k, :, h : 2 * h] = dn * un[k] * r * (1 - r)
        dg[k, :, 2 * h :] = dn
        d = np.concatenate([dg[k, :, : 2 * h], dun], 1)
        du += hs[k].T @ d
        dbn += dun.sum(0)
        dh = dh * z + d @ p["u"].T
    return dg, du, dbn


def summed(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of values by row number."""
    rows, values = rows.reshape(-1), values.reshape(len(rows.reshape(-1)), -1)
    order = np.argsort(rows, kind="stable")
    r = rows[order]
    first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else np.zeros(0, np.int64)
    out = np.zeros((size, values.shape[1]), np.float32)
    if len(r):
        out[r[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


class Adam:
    def __init__(self, rate: float = 0.01):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, parameters: dict[str, np.ndarray], gradients: dict[str, np.ndarray]) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g.astype(np.float64) ** 2).sum()) for g in gradients.values()))
        clip = min(1.0, 5.0 / (norm + 1e-9))
        for k, g in gradients.items():
            g = g * clip
            self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * g
            self.v[k] = 0.99 * self.v.get(k, 0) + 0.01 * g * g
            parameters[k] -= (self.rate * self.m[k] / (1 - 0.9**self.t) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-7)).astype(np.float32)
