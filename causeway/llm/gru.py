"""Bidirectional gated recurrent network over bytes with a label for every position, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def init(labels: int, hidden: int, seed: int) -> dict[str, np.ndarray]:
    """Parameters: per direction a table of gate inputs for each byte, recurrent weights, and a shared output."""
    rng = np.random.default_rng(seed)
    out = {"w": rng.normal(0, 0.3, (2 * hidden, labels)), "b": np.zeros(labels)}
    for d in ("f", "r"):  # forward, reverse
        out[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * hidden))
        out[f"u{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
        out[f"c{d}"] = np.zeros(hidden)
    return {k: v.astype(np.float32) for k, v in out.items()}


def states(p: dict[str, np.ndarray], d: str, data: np.ndarray, valid: np.ndarray | None, keep: list | None = None) -> np.ndarray:
    """Hidden states [time, batch, hidden] of one direction; states at positions that are not valid are zero.

    The gates are sigmoids, written as tanh of half the input so that one call serves all.
    """
    batch, time = data.shape
    x, u, c = p[f"x{d}"].copy(), p[f"u{d}"].copy(), p[f"c{d}"]
    hidden = len(c)
    if keep is None:
        x[:, :2 * hidden] *= 0.5
        u[:, :2 * hidden] *= 0.5
    out = np.empty((time, batch, hidden), np.float32)
    h = np.zeros((batch, hidden), np.float32)
    g, s = np.empty((batch, 3 * hidden), np.float32), np.empty((batch, 3 * hidden), np.float32)
    for t in range(time) if d == "f" else range(time - 1, -1, -1):
        np.take(x, data[:, t], axis=0, out=g)
        np.matmul(h, u, out=s)
        gates = g[:, :2 * hidden]
        gates += s[:, :2 * hidden]
        if keep is not None:
            gates *= 0.5
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        z, r = gates[:, :hidden], gates[:, hidden:]
        m = s[:, 2 * hidden:] + c
        n = g[:, 2 * hidden:] + r * m
        np.tanh(n, out=n)
        if keep is not None:
            keep.append((h, z.copy(), r.copy(), m, n))
        h = n + z * (h - n)
        if valid is not None:
            h *= valid[:, t:t + 1]
        out[t] = h
    return out


def label_probabilities(p: dict[str, np.ndarray], data: np.ndarray, valid: np.ndarray | None) -> np.ndarray:
    """Probabilities [time, batch, labels] of every position."""
    half = len(p["cf"])
    logits = states(p, "f", data, valid) @ p["w"][:half]
    logits += states(p, "r", data, valid) @ p["w"][half:]
    logits += p["b"]
    logits -= logits.max(axis=2, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=2, keepdims=True)
    return logits


def gradients(p: dict[str, np.ndarray], data: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over all positions and its gradient by backpropagation through time."""
    batch, time = data.shape
    half = len(p["cf"])
    kept: dict[str, list] = {"f": [], "r": []}
    h = np.concatenate([states(p, d, data, None, kept[d]) for d in ("f", "r")], axis=2)
    logits = h @ p["w"] + p["b"]
    logits -= logits.max(axis=2, keepdims=True)
    prob = np.exp(logits)
    prob /= prob.sum(axis=2, keepdims=True)
    loss = -float(np.log(prob[:, np.arange(batch), labels] + 1e-12).mean())
    delta = prob
    delta[:, np.arange(batch), labels] -= 1
    delta /= batch * time
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    flat = delta.reshape(-1, delta.shape[2])
    grad["w"], grad["b"] = h.reshape(-1, 2 * half).T @ flat, flat.sum(axis=0)
    back = delta @ p["w"].T
    for k, d in enumerate(("f", "r")):
        u = p[f"u{d}"]
        carried = np.zeros((batch, half), np.float32)
        order = range(time) if d == "f" else range(time - 1, -1, -1)
        for t, (before, z, r, m, n) in zip(reversed(list(order)), reversed(kept[d])):
            dh = back[t][:, k * half:(k + 1) * half] + carried
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (before - n) * z * (1 - z)
            dr = dn * m * r * (1 - r)
            dm = dn * r
            ds = np.concatenate((dz, dr, dm), axis=1)  # by the recurrent product
            dx = np.concatenate((dz, dr, dn), axis=1)  # by the table of inputs
            np.add.at(grad[f"x{d}"], data[:, t], dx)
            grad[f"u{d}"] += before.T @ ds
            grad[f"c{d}"] += dm.sum(axis=0)
            carried = dh * z + ds @ u.T
    return loss, grad


@dataclass
class Adam:
    rate: float = 0.01
    step: int = 0

    def update(self, p: dict[str, np.ndarray], grad: dict[str, np.ndarray], clip: float = 1.0) -> None:
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        if self.step == 0:
            self.m = {k: np.zeros_like(v) for k, v in p.items()}
            self.v = {k: np.zeros_like(v) for k, v in p.items()}
        self.step += 1
        for k, g in grad.items():
            g = g * min(1.0, clip / (norm + 1e-12))
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            mean, square = self.m[k] / (1 - 0.9 ** self.step), self.v[k] / (1 - 0.99 ** self.step)
            p[k] -= (self.rate * mean / (np.sqrt(square) + 1e-8)).astype(np.float32)
