"""A character-level bidirectional LSTM with a linear-chain CRF on top, in numpy.

Windows of equal length are handled as a batch, time first. Training is by Adam on the exact negative
log-likelihood of the label sequences.
"""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Tagger:
    """``classes`` character classes in, ``labels`` labels out."""

    def __init__(self, classes: int, labels: int, hidden: int = 16, embed: int = 8, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)

        def weights(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.hidden = hidden
        self.p = {"embed": weights(classes, embed) * 2}
        for way in "fb":
            self.p[f"w{way}"] = weights(embed + hidden, 4 * hidden)
            self.p[f"c{way}"] = np.zeros(4 * hidden, np.float32)
            self.p[f"c{way}"][hidden : 2 * hidden] = 1  # remember at first
        self.p["out"] = weights(2 * hidden, labels)
        self.p["bias"] = np.zeros(labels, np.float32)
        self.p["step"] = np.zeros((labels, labels), np.float32)

    def _run(self, x: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        n, h = self.hidden, np.zeros((x.shape[1], self.hidden), np.float32)
        c, w, b = np.zeros_like(h), self.p[f"w{way}"], self.p[f"c{way}"]
        out = np.empty((*x.shape[:2], n), np.float32)
        for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            both = np.concatenate([x[t], h], axis=1)
            z = both @ w + b
            gates, new = _sigmoid(z[:, : 3 * n]), np.tanh(z[:, 3 * n :])
            before = c
            c = gates[:, n : 2 * n] * c + gates[:, :n] * new
            tanh_c = np.tanh(c)
            h = out[t] = gates[:, 2 * n :] * tanh_c
            if keep is not None:
                keep.append((t, both, gates, new, before, tanh_c))
        return out

    def _back(self, keep: list, d_out: np.ndarray, way: str, grads: dict) -> np.ndarray:
        n, w = self.hidden, self.p[f"w{way}"]
        d_x = np.empty((*d_out.shape[:2], w.shape[0] - n), np.float32)
        d_h = np.zeros_like(d_out[0])
        d_c = np.zeros_like(d_h)
        for t, both, gates, new, before, tanh_c in reversed(keep):
            d_h = d_h + d_out[t]
            i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
            d_c = d_c + d_h * o * (1 - tanh_c**2)
            d_z = np.concatenate(
                [
                    d_c * new * i * (1 - i),
                    d_c * before * f * (1 - f),
                    d_h * tanh_c * o * (1 - o),
                    d_c * i * (1 - new**2),
                ],
                axis=1,
            )
            grads[f"w{way}"] += both.T @ d_z
            grads[f"c{way}"] += d_z.sum(axis=0)
            d_both = d_z @ w.T
            d_x[t], d_h, d_c = d_both[:, :-n], d_both[:, -n:], d_c * f
        return d_x

    def emissions(self, chars: np.ndarray) -> np.ndarray:
        """Label scores of windows: (time, windows) of classes to (time, windows, labels)."""
        x = self.p["embed"][chars]
        both = np.concatenate([self._run(x, "f"), self._run(x, "b")], axis=2)
        return both @ self.p["out"] + self.p["bias"]

    def gradients(self, chars: np.ndarray, gold: np.ndarray) -> tuple[float, dict]:
        """Loss of a batch of windows, and its gradients. ``gold`` holds the labels."""
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        x, keep_f, keep_b = self.p["embed"][chars], [], []
        both = np.concatenate([self._run(x, "f", keep_f), self._run(x, "b", keep_b)], axis=2)
        e, step = both @ self.p["out"] + self.p["bias"], self.p["step"]
        time, batch = chars.shape
        ahead, behind = np.empty_like(e), np.zeros_like(e)
        ahead[0] = e[0]
        for t in range(1, time):
            ahead[t] = _lse(ahead[t - 1][:, :, None] + step, 1) + e[t]
        for t in range(time - 2, -1, -1):
            behind[t] = _lse(step + (e[t + 1] + behind[t + 1])[:, None, :], 2)
        total = _lse(ahead[-1], 1)
        d_e = np.exp(ahead + behind - total[None, :, None])
        for t in range(1, time):
            pair = ahead[t - 1][:, :, None] + step + (e[t] + behind[t])[:, None, :]
            grads["step"] += np.exp(pair - total[:, None, None]).sum(axis=0)
        np.subtract.at(grads["step"], (gold[:-1].ravel(), gold[1:].ravel()), 1)
        rows, cols = np.indices(gold.shape)
        score = e[rows, cols, gold].sum() + step[gold[:-1], gold[1:]].sum()
        d_e[rows, cols, gold] -= 1
        grads["out"] += np.tensordot(both, d_e, ([0, 1], [0, 1]))
        grads["bias"] += d_e.sum(axis=(0, 1))
        d_both = d_e @ self.p["out"].T
        n = self.hidden
        d_x = self._back(keep_f, d_both[..., :n], "f", grads)
        d_x += self._back(keep_b, d_both[..., n:], "b", grads)
        np.add.at(grads["embed"], chars.ravel(), d_x.reshape(-1, d_x.shape[2]))
        return float(total.sum() - score), {k: v / batch for k, v in grads.items()}

    def fit(self, chars: np.ndarray, gold: np.ndarray, epochs: int = 16, batch: int = 16, rate: float = 0.02) -> None:
        """Train on windows: (windows, time) of classes and labels."""
        rng = np.random.default_rng(1)
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        done, steps = 0, max(1, epochs * -(-len(chars) // batch))
        for _ in range(epochs):
            order = rng.permutation(len(chars))
            for at in range(0, len(order), batch):
                part = order[at : at + batch]
                _, grads = self.gradients(chars[part].T, gold[part].T)
                done += 1
                pace = rate * (1 - done / (steps + 1))
                for k, g in grads.items():
                    g = np.clip(g, -1, 1)
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.99 * square[k] + 0.01 * g * g
                    up = np.sqrt(square[k] / (1 - 0.99**done)) + 1e-6
                    self.p[k] = self.p[k] - pace * (mean[k] / (1 - 0.9**done)) / up

    def decode(self, e: np.ndarray) -> np.ndarray:
        """The best labels for one sequence of scores (time, labels)."""
        step, best = self.p["step"], e[0]
        back = np.empty(e.shape, np.int16)
        for t in range(1, len(e)):
            scores = best[:, None] + step
            back[t] = scores.argmax(axis=0)
            best = scores[back[t], np.arange(len(best))] + e[t]
        path = np.empty(len(e), np.int64)
        path[-1] = int(best.argmax())
        for t in range(len(e) - 1, 0, -1):
            path[t - 1] = back[t, path[t]]
        return path
