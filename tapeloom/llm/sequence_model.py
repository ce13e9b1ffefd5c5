"""A character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import string

import numpy as np

#: Characters the model tells apart: letters without case, digits as one, marks, white space, others.
_MARKS = string.punctuation
VOCABULARY = 26 + 1 + len(_MARKS) + 3
PAD = VOCABULARY - 1
_FORBIDDEN = -1e4


def character_table() -> np.ndarray:
    """Class of every ASCII character; one more entry for all others."""
    table = np.full(129, VOCABULARY - 2)
    for i, c in enumerate(string.ascii_lowercase):
        table[ord(c)] = table[ord(c.upper())] = i
    for c in string.digits:
        table[ord(c)] = 26
    for i, c in enumerate(_MARKS):
        table[ord(c)] = 27 + i
    for c in string.whitespace:
        table[ord(c)] = VOCABULARY - 3
    return table


_TABLE = character_table()


def classes(text: str) -> np.ndarray:
    """Classes of a text's characters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return _TABLE[np.minimum(points, 128)]


def tag_names(kinds: tuple[str, ...]) -> list[str]:
    return ["O", *(f"{p}-{k}" for k in kinds for p in "BI")]


def allowed(kinds: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Penalties for tag pairs and first tags: an inside tag follows its own kind only."""
    n = 1 + 2 * len(kinds)
    pairs, first = np.zeros((n, n)), np.zeros(n)
    for k in range(len(kinds)):
        inside = 2 + 2 * k
        pairs[:, inside] = _FORBIDDEN
        pairs[inside - 1, inside] = pairs[inside, inside] = 0.0
        first[inside] = _FORBIDDEN
    return pairs, first


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


def logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Embedding, two LSTMs, a linear layer and a CRF."""

    def __init__(self, kinds: tuple[str, ...], embedding: int = 12, hidden: int = 16, seed: int = 3):
        random = np.random.default_rng(seed)
        n = 1 + 2 * len(kinds)
        self.kinds, self.hidden = kinds, hidden
        self.p: dict[str, np.ndarray] = {
            "embed": random.normal(0, 0.3, (VOCABULARY, embedding)),
            "out": random.normal(0, 0.2, (2 * hidden, n)), "bias": np.zeros(n), "pairs": np.zeros((n, n)),
        }
        for side in ("f", "b"):
            bias = np.zeros(4 * hidden)
            bias[hidden:2 * hidden] = 1.0  # remember at first
            self.p |= {
                f"x{side}": random.normal(0, 1 / np.sqrt(embedding), (embedding, 4 * hidden)),
                f"h{side}": random.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden)), f"c{side}": bias}
        self.rules, self.first = allowed(kinds)

    # -- LSTM ------------------------------------------------------------------------

    def _run(self, side: str, x: np.ndarray):
        """States of one direction over ``x`` (time, batch, embedding), and what going back needs."""
        h_size = self.hidden
        steps, n, _ = x.shape
        inputs = x @ self.p[f"x{side}"] + self.p[f"c{side}"]
        h, c = np.zeros((n, h_size)), np.zeros((n, h_size))
        out, kept = np.empty((steps, n, h_size)), []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = inputs[t] + h @ self.p[f"h{side}"]
            gates = sigmoid(z[:, :3 * h_size])
            i, f, o = gates[:, :h_size], gates[:, h_size:2 * h_size], gates[:, 2 * h_size:]
            g = np.tanh(z[:, 3 * h_size:])
            before_h, before_c = h, c
            c = f * c + i * g
            tanh_c = np.tanh(c)
            h = o * tanh_c
            out[t] = h
            kept.append((t, i, f, o, g, before_h, before_c, tanh_c))
        return out, kept

    def _back(self, side: str, x: np.ndarray, kept, d_out: np.ndarray, grads: dict) -> np.ndarray:
        h_size = self.hidden
        d_h, d_c = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
        d_x = np.empty_like(x)
        wx, wh = self.p[f"x{side}"], self.p[f"h{side}"]
        g_x, g_h, g_c = np.zeros_like(wx), np.zeros_like(wh), np.zeros(4 * h_size)
        for t, i, f, o, g, before_h, before_c, tanh_c in reversed(kept):
            d = d_out[t] + d_h
            d_c = d_c + d * o * (1 - tanh_c**2)
            z = np.concatenate([
                d_c * g * i * (1 - i), d_c * before_c * f * (1 - f), d * tanh_c * o * (1 - o), d_c * i * (1 - g**2)], 1)
            g_x += x[t].T @ z
            g_h += before_h.T @ z
            g_c += z.sum(0)
            d_x[t] = z @ wx.T
            d_h, d_c = z @ wh.T, d_c * f
        grads[f"x{side}"], grads[f"h{side}"], grads[f"c{side}"] = g_x, g_h, g_c
        return d_x

    def _emissions(self, codes: np.ndarray):
        x = self.p["embed"][codes.T]
        forward, kept_f = self._run("f", x)
        backward, kept_b = self._run("b", x)
        states = np.concatenate([forward, backward], axis=2)
        return states @ self.p["out"] + self.p["bias"], (x, states, kept_f, kept_b)

    # -- CRF -------------------------------------------------------------------------

    def _sums(self, e: np.ndarray):
        """Forward and backward log sums over emissions (time, batch, tag)."""
        pairs = self.p["pairs"] + self.rules
        steps = len(e)
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0] + self.first
        for t in range(1, steps):
            alpha[t] = e[t] + logsumexp(alpha[t - 1][:, :, None] + pairs, 1)
        for t in range(steps - 2, -1, -1):
            beta[t] = logsumexp(pairs + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        return alpha, beta, logsumexp(alpha[-1], 1)

    def marginals(self, codes: np.ndarray) -> np.ndarray:
        """Probability of every tag at every place: (batch, time, tag)."""
        e, _ = self._emissions(codes)
        alpha, beta, total = self._sums(e)
        return np.exp(alpha + beta - total[None, :, None]).transpose(1, 0, 2)

    def _gradients(self, codes: np.ndarray, tags: np.ndarray):
        e, (x, states, kept_f, kept_b) = self._emissions(codes)
        n, steps = codes.shape
        alpha, beta, total = self._sums(e)
        pairs = self.p["pairs"] + self.rules
        d_e = np.exp(alpha + beta - total[None, :, None])
        d_pairs = np.zeros_like(pairs)
        for t in range(steps - 1):
            joint = alpha[t][:, :, None] + pairs + (e[t + 1] + beta[t + 1])[:, None, :] - total[:, None, None]
            d_pairs += np.exp(joint).sum(0)
        np.add.at(d_pairs, (tags[:, :-1], tags[:, 1:]), -1.0)
        where = np.arange(n)
        for t in range(steps):
            d_e[t, where, tags[:, t]] -= 1.0
        d_e /= n
        grads = {"pairs": d_pairs / n, "out": np.einsum("tns,tnk->sk", states, d_e), "bias": d_e.sum((0, 1))}
        d_states = d_e @ self.p["out"].T
        h = self.hidden
        d_x = self._back("f", x, kept_f, d_states[:, :, :h], grads) + self._back("b", x, kept_b, d_states[:, :, h:], grads)
        grads["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(grads["embed"], codes.T, d_x)
        return grads

    def fit(self, codes: np.ndarray, tags: np.ndarray, epochs: int = 12, batch: int = 32, rate: float = 1.5e-2,
            seed: int = 5) -> Tagger:
        """Adam with clipped gradients and a falling rate."""
        random = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step, steps = 0, epochs * -(-len(codes) // batch)
        for _ in range(epochs):
            order = random.permutation(len(codes))
            for at in range(0, len(codes), batch):
                rows = order[at:at + batch]
                grads = self._gradients(codes[rows], tags[rows])
                norm = np.sqrt(sum((g**2).sum() for g in grads.values()))
                step += 1
                now = rate * (1 - 0.9 * step / steps)
                for k, g in grads.items():
                    g = g * min(1.0, 10.0 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g**2
                    self.p[k] = self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def best_path(self, log_marginals: np.ndarray) -> np.ndarray:
        """Most probable allowed tags for one stretch, given its places' log probabilities."""
        score = log_marginals[0] + self.first
        came = np.zeros(log_marginals.shape, int)
        for t in range(1, len(log_marginals)):
            ways = score[:, None] + self.rules
            came[t] = ways.argmax(0)
            score = ways.max(0) + log_marginals[t]
        tags = [int(score.argmax())]
        for t in range(len(log_marginals) - 1, 0, -1):
            tags.append(int(came[t][tags[-1]]))
        return np.array(tags[::-1])
