"""A small bidirectional gated recurrent network in numpy: forward pass, backpropagation through time, Adam.

Arrays are laid out ``(units, batch)`` so that one step works on contiguous rows. Gates use the piecewise linear
sigmoid and the candidate the piecewise linear tanh: both cost a tenth of the exponential forms per element and are
trained as such.

One direction with state ``h`` and gate inputs ``x`` (rows: update, reset, candidate)::

    z = clip(x_z + U_z h, 0, 1)    r = clip(x_r + U_r h, 0, 1)
    n = clip(x_n + r * (U_n h), -1, 1)
    h = n + z * (h - n)
"""

from __future__ import annotations

import numpy as np

KEEP = 20.0  # added to the update gate of padding: the state stays as it is


def init_recurrent(rng: np.random.Generator, units: int) -> np.ndarray:
    """Recurrent weights of both directions, shape (2, 3 * units, units)."""
    u = rng.normal(0.0, 0.6 / np.sqrt(units), (2, 3 * units, units))
    return u.astype("f4")


def init_bias(units: int) -> np.ndarray:
    """Gate biases of both directions: gates start half open, slightly towards keeping the state."""
    b = np.zeros((2, 3 * units), "f4")
    b[:, :units] = 0.6
    b[:, units : 2 * units] = 0.5
    return b


def step(x: np.ndarray, u: np.ndarray, h: np.ndarray, a: np.ndarray, out: np.ndarray) -> None:
    """One step; ``x`` (3 * units, batch) is overwritten by the gates, ``a`` is scratch of the same shape."""
    k = h.shape[0]
    np.matmul(u, h, out=a)
    zr, n, c = x[: 2 * k], x[2 * k :], a[2 * k :]
    zr += a[: 2 * k]
    np.maximum(zr, 0.0, out=zr)
    np.minimum(zr, 1.0, out=zr)
    c *= zr[k:]
    n += c
    np.maximum(n, -1.0, out=n)
    np.minimum(n, 1.0, out=n)
    np.subtract(h, n, out=out)
    out *= zr[:k]
    out += n


def states(gates, u: np.ndarray, steps: int, batch: int) -> np.ndarray:
    """Hidden states (steps, 2 * units, batch). ``gates(direction, position, out)`` writes the gate inputs into out."""
    k = u.shape[2]
    hs = np.empty((steps, 2 * k, batch), "f4")
    x, a = np.empty((3 * k, batch), "f4"), np.empty((3 * k, batch), "f4")
    for d in (0, 1):
        h = np.zeros((k, batch), "f4")
        for s in range(steps) if d == 0 else range(steps - 1, -1, -1):
            gates(d, s, x)
            out = hs[s, d * k : (d + 1) * k]
            step(x, u[d], h, a, out)
            h = out
    return hs


def forward(x: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Training pass over gate inputs ``x`` (2, steps, 3 * units, batch): states and what the backward pass needs."""
    _, steps, _, batch = x.shape
    k = u.shape[2]
    hs = np.zeros((2, steps + 1, k, batch), "f4")  # index 0 is the state before the first step of the direction
    pre = np.empty((2, steps, 3 * k, batch), "f4")
    cand = np.empty((2, steps, k, batch), "f4")
    for d in (0, 1):
        for i in range(steps):
            s = i if d == 0 else steps - 1 - i
            h = hs[d, i]
            a = u[d] @ h
            p = pre[d, i]
            p[: 2 * k] = x[d, s, : 2 * k] + a[: 2 * k]
            g = np.clip(p[: 2 * k], 0, 1)
            cand[d, i] = a[2 * k :]
            p[2 * k :] = x[d, s, 2 * k :] + g[k:] * a[2 * k :]
            n = np.clip(p[2 * k :], -1, 1)
            hs[d, i + 1] = n + g[:k] * (h - n)
    both = np.concatenate([hs[0, 1:], hs[1, :0:-1]], axis=1)
    return both, (hs, pre, cand)


def backward(dh: np.ndarray, u: np.ndarray, kept: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gate inputs (shape of ``x``) and of ``u`` from those of the states (steps, 2 * units, batch)."""
    hs, pre, cand = kept
    k, steps, batch = u.shape[2], dh.shape[0], dh.shape[2]
    dx = np.empty((2, steps, 3 * k, batch), "f4")
    du = np.zeros_like(u)
    for d in (0, 1):
        carry = np.zeros((k, batch), "f4")
        for i in range(steps - 1, -1, -1):
            s = i if d == 0 else steps - 1 - i
            h, p = hs[d, i], pre[d, i]
            g = np.clip(p[: 2 * k], 0, 1)
            z, r, n = g[:k], g[k:], np.clip(p[2 * k :], -1, 1)
            t = carry + dh[s, d * k : (d + 1) * k]
            dn = t * (1 - z) * (np.abs(p[2 * k :]) < 1)
            dz = t * (h - n) * ((p[:k] > 0) & (p[:k] < 1))
            dr = dn * cand[d, i] * ((p[k : 2 * k] > 0) & (p[k : 2 * k] < 1))
            dx[d, s] = np.concatenate([dz, dr, dn])
            da = np.concatenate([dz, dr, dn * r])
            du[d] += da @ h.T
            carry = t * z + u[d].T @ da
    return dx, du


class Adam:
    """Adam over a dict of arrays, with the gradient norm clipped and a linearly falling rate."""

    def __init__(self, params: dict[str, np.ndarray], rate: float, steps: int):
        self.p, self.rate, self.steps, self.t = params, rate, steps, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads.values())))
        scale = min(1.0, 5.0 / (norm + 1e-12))
        rate = self.rate * max(0.05, 1 - self.t / self.steps)
        rate *= np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            g = g * scale
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.p[k] -= (rate * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype("f4")
