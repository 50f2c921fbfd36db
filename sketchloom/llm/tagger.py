"""A character-level bidirectional LSTM with a linear-chain CRF, in numpy: training and batch decoding."""

from __future__ import annotations

import numpy as np

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
FORBIDDEN = -1e4


def allowed() -> tuple[np.ndarray, np.ndarray]:
    """Transition and start masks: inside follows begin or inside of its own kind only."""
    move, start = np.zeros((TAGS, TAGS)), np.zeros(TAGS)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        move[:, inside] = FORBIDDEN
        move[inside - 1, inside] = move[inside, inside] = 0
        start[inside] = FORBIDDEN
    return move, start


MOVE, START = allowed()


def code_table() -> np.ndarray:
    """Character codes: printable ASCII apart, then white space, other letters, other digits, the rest; 0 is padding."""
    t = np.full(0x110000, 99, np.uint8)
    t[32:127] = np.arange(1, 96)
    t[[9, 10, 11, 12, 13]] = 96
    return t


VOCABULARY = 100
_CODES = code_table()


def encode(text: str) -> np.ndarray:
    """Codes of a text; letters beyond ASCII share one."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _CODES[points]
    for i in np.flatnonzero(codes == 99):
        c = chr(points[i])
        codes[i] = 97 if c.isalpha() else 98 if c.isdigit() else 99
    return codes


def softsign(z: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    return np.divide(z, 1 + np.abs(z), out=out)


class Tagger:
    """Weights of both directions side by side: an input table (a gate row for each character code) and recurrent weights; then an output layer
    and transitions.  Softsign stands where tanh is usual, a gate being (1 + softsign z) / 2: numpy computes it several times faster."""

    def __init__(self, hidden: int = 20, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.h = hidden
        w = lambda *s: (rng.standard_normal(s) * 0.12).astype(np.float32)
        self.p = {"E": w(2, VOCABULARY, 4 * hidden), "U": w(2, hidden, 4 * hidden), "V": w(2 * hidden, TAGS), "c": np.zeros(TAGS, np.float32), "T": np.zeros((TAGS, TAGS), np.float32)}
        self.p["E"][:, :, hidden : 2 * hidden] += 0.5  # forget gates start open

    def _run(self, x: np.ndarray, tape: list | None = None) -> np.ndarray:
        """Hidden states (T, B, 2 h) over codes x (B, T): the forward direction's, then the backward one's."""
        (batch, n), h, table, u = x.shape, self.h, self.p["E"], self.p["U"]
        state = cell = np.zeros((2, batch, h), np.float32)
        out = np.empty((n, batch, 2 * h), np.float32)
        z = np.empty((2, batch, 4 * h), np.float32)
        for t in range(n):
            np.take(table[0], x[:, t], axis=0, out=z[0], mode="clip")
            np.take(table[1], x[:, n - 1 - t], axis=0, out=z[1], mode="clip")
            z += state @ u
            g = softsign(z, out=z)
            i, f, o = (0.5 + 0.5 * g[:, :, k * h : (k + 1) * h] for k in range(3))
            a = g[:, :, 3 * h :]
            fresh = f * cell
            fresh += i * a
            squashed = softsign(fresh)
            if tape is not None:
                tape.append((i, f, o, a.copy(), cell, squashed, state))
            cell, state = fresh, o * squashed
            out[t, :, :h], out[n - 1 - t, :, h:] = state
        return out

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """(T, B, tags)."""
        return self._run(x) @ self.p["V"] + self.p["c"]

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi tags (B, T) and, for each place, how far the tag's emission lies above the outside tag's."""
        e = np.ascontiguousarray(self.emissions(x).transpose(0, 2, 1))  # tags before windows: each step works on long rows
        n, _, batch = e.shape
        moves = (self.p["T"] + MOVE.astype(np.float32))[:, :, None]
        score, back = e[0] + START.astype(np.float32)[:, None], np.zeros((n, TAGS, batch), np.int8)
        for t in range(1, n):
            best, at = score[0] + moves[0], back[t]
            for k in range(1, TAGS):
                other = score[k] + moves[k]
                at[other > best] = k
                np.maximum(best, other, out=best)
            score = best + e[t]
        tags = np.zeros((n, batch), np.int8)
        tags[-1] = score.argmax(axis=0)
        rows = np.arange(batch)
        for t in range(n - 1, 0, -1):
            tags[t - 1] = back[t, tags[t], rows]
        margin = np.take_along_axis(e, tags[:, None, :].astype(np.int64), 1)[:, 0] - e[:, 0]
        return tags.T, margin.T

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of tags y (B, T) and its gradients: CRF forward-backward, scaled at every step, then both LSTMs."""
        h, p = self.h, self.p
        tape: list = []
        both = self._run(x, tape)
        e = (both @ p["V"] + p["c"]).astype(np.float64)
        n, batch, _ = e.shape
        top = e.max(axis=2, keepdims=True)
        like, moves, rows = np.exp(e - top), np.exp(p["T"] + MOVE), np.arange(batch)
        fwd, bwd, size = np.empty_like(e), np.ones_like(e), np.empty((n, batch, 1))
        for t in range(n):
            f = (fwd[t - 1] @ moves if t else np.exp(START)) * like[t]
            size[t] = f.sum(axis=1, keepdims=True)
            fwd[t] = f / size[t]
        for t in range(n - 2, -1, -1):
            bwd[t] = (like[t + 1] * bwd[t + 1]) @ moves.T / size[t + 1]
        z = (np.log(size) + top).sum(axis=(0, 2))
        log_moves = p["T"] + MOVE
        gold = START[y[:, 0]] + e[np.arange(n)[:, None], rows, y.T].sum(axis=0) + log_moves[y[:, :-1], y[:, 1:]].sum(axis=1)
        de = fwd * bwd
        ahead = like[1:] * bwd[1:] / size[1:]
        dt = moves * np.tensordot(fwd[:-1], ahead, axes=([0, 1], [0, 1]))
        np.add.at(dt, (y[:, :-1], y[:, 1:]), -1)
        de[np.arange(n)[:, None], rows, y.T] -= 1
        de = (de / batch).astype(np.float32)
        grads = {"T": (dt / batch).astype(np.float32), "c": de.sum(axis=(0, 1)), "V": both.reshape(-1, 2 * h).T @ de.reshape(-1, TAGS)}
        dh, u = de @ p["V"].T, p["U"].transpose(0, 2, 1)
        gu, dz = np.zeros_like(p["U"]), np.empty((n, 2, batch, 4 * h), np.float32)
        ds = dc = np.zeros((2, batch, h), np.float32)
        for t in range(n - 1, -1, -1):
            i, f, o, a, cell, squashed, state = tape[t]
            g = np.stack([dh[t, :, :h], dh[n - 1 - t, :, h:]]) + ds
            dc = dc + g * o * (1 - np.abs(squashed)) ** 2
            # a gate's softsign is 2 g - 1, and 1 - |2 g - 1| = 2 min(g, 1 - g)
            slope = lambda gate: 2 * np.minimum(gate, 1 - gate) ** 2
            dz[t] = np.concatenate([dc * a * slope(i), dc * cell * slope(f), g * squashed * slope(o), dc * i * (1 - np.abs(a)) ** 2], axis=2)
            gu += state.transpose(0, 2, 1) @ dz[t]
            ds, dc = dz[t] @ u, dc * f
        grads["U"], grads["E"] = gu, np.zeros_like(p["E"])
        for d, codes in ((0, x.T), (1, x[:, ::-1].T)):  # a row of the table gathers the steps that read it
            order = np.argsort(codes, axis=None, kind="stable")
            seen, first = np.unique(codes.reshape(-1)[order], return_index=True)
            grads["E"][d, seen] = np.add.reduceat(dz[:, d].reshape(-1, 4 * h)[order], first, axis=0)
        return float((z - gold).mean()), grads

    def train(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int = 64, rate: float = 0.02, seed: int = 3) -> list[float]:
        """Adam with a falling rate and clipped gradients."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in range(2))
        losses = []
        for s in range(1, steps + 1):
            at = rng.integers(0, len(x), batch)
            value, grads = self.loss(x[at], y[at])
            losses.append(value)
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            lr = rate * (1 - 0.95 * s / steps)
            for k, g in grads.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] = self.p[k] - (lr * (m[k] / (1 - 0.9**s)) / (np.sqrt(v[k] / (1 - 0.99**s)) + 1e-7)).astype(np.float32)
        return losses
