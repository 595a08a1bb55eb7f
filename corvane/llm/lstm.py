"""A bidirectional LSTM labeller in numpy: sequences of vectors to one chance for each element."""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class BiLstm:
    """Two LSTMs read a sequence from either end; both states at an element, through one layer, give its chance."""

    def __init__(self, inputs: int, hidden: int = 16, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        self.hidden = hidden
        self.w = {}
        for d in "fb":
            self.w[f"x{d}"] = r.normal(0, 1 / np.sqrt(inputs), (inputs, 4 * hidden))
            self.w[f"h{d}"] = r.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
            self.w[f"b{d}"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])
        self.w["o"] = r.normal(0, 0.3, 2 * hidden)
        self.w["ob"] = np.zeros(1)
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """States (batch, length, hidden) of one direction; padding passes the state on unchanged."""
        n, length, k = x.shape[0], x.shape[1], self.hidden
        h, c, out = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32), np.zeros((n, length, k), np.float32)
        drive = x @ self.w[f"x{d}"] + self.w[f"b{d}"]
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            z = drive[:, t] + h @ self.w[f"h{d}"]
            i, f, o, g = _sigmoid(z[:, :k]), _sigmoid(z[:, k : 2 * k]), _sigmoid(z[:, 2 * k : 3 * k]), np.tanh(z[:, 3 * k :])
            m = mask[:, t : t + 1]
            new_c = np.where(m, f * c + i * g, c)
            new_h = np.where(m, o * np.tanh(new_c), h)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, new_c))
            h, c = new_h, new_c
            out[:, t] = h
        return out

    def chance(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        states = np.concatenate([self._run(x, mask, d, None) for d in "fb"], axis=2)
        return _sigmoid(states @ self.w["o"] + self.w["ob"])

    def _gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        kept: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self._run(x, mask, d, kept[d]) for d in "fb"], axis=2)
        error = (_sigmoid(states @ self.w["o"] + self.w["ob"]) - y) * mask / mask.sum()
        grad = {"o": np.einsum("nt,ntk->k", error, states), "ob": np.array([error.sum()])}
        k = self.hidden
        for d, part in (("f", slice(0, k)), ("b", slice(k, 2 * k))):
            above = error[:, :, None] * self.w["o"][part]
            gh, drive = np.zeros_like(self.w[f"h{d}"]), np.zeros((*mask.shape, 4 * k), np.float32)
            dh, dc = np.zeros((len(x), k), np.float32), np.zeros((len(x), k), np.float32)
            for t, h, c, i, f, o, g, new_c in reversed(kept[d]):
                m, dh = mask[:, t : t + 1], dh + above[:, t]
                tc = np.tanh(new_c)
                own = np.where(m, dh, 0)
                dcell = np.where(m, dc, 0) + own * o * (1 - tc**2)
                dz = np.concatenate([dcell * g * i * (1 - i), dcell * c * f * (1 - f), own * tc * o * (1 - o), dcell * i * (1 - g**2)], axis=1)
                drive[:, t] = dz
                gh += h.T @ dz
                dh = np.where(m, 0, dh) + dz @ self.w[f"h{d}"].T
                dc = np.where(m, dcell * f, dc)
            drive = drive.reshape(-1, 4 * k)
            grad |= {f"x{d}": x.reshape(len(drive), -1).T @ drive, f"h{d}": gh, f"b{d}": drive.sum(0)}
        return grad

    def fit(self, sequences: list[np.ndarray], labels: list[np.ndarray], rounds: int, batch: int = 32, rate: float = 0.01, seed: int = 6) -> BiLstm:
        """Adam on the logistic loss, sequences of like length together, in an order shuffled by a fixed seed.

        The weights are the mean over the steps of the second half, which no single step decides."""
        r = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        step, mean, seen = 0, {k: np.zeros_like(v, np.float64) for k, v in self.w.items()}, 0
        for turn in range(rounds):
            pace = np.float32(rate * min(1.0, 2 * (rounds - turn) / rounds))  # slower in the second half
            order = sorted(range(len(sequences)), key=lambda i: (len(sequences[i]) + r.random() * 8))
            for k in r.permutation(-(-len(order) // batch)) * batch:
                own = order[k : k + batch]
                x, mask = padded([sequences[i] for i in own])
                y = np.zeros(mask.shape, np.float32)
                for j, i in enumerate(own):
                    y[j, : len(labels[i])] = labels[i]
                step += 1
                for name, g in self._gradient(x, mask, y).items():
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.99 * second[name] + 0.01 * g**2
                    self.w[name] = self.w[name] - pace * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)
                if 2 * turn >= rounds:
                    seen += 1
                    for name, v in self.w.items():
                        mean[name] += v
        self.w = {k: (v / max(1, seen)).astype(np.float32) for k, v in mean.items()}
        return self


def padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    length = max(map(len, sequences))
    x, mask = np.zeros((len(sequences), length, sequences[0].shape[1]), np.float32), np.zeros((len(sequences), length), bool)
    for j, s in enumerate(sequences):
        x[j, : len(s)], mask[j, : len(s)] = s, True
    return x, mask
