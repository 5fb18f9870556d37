"""A small byte-level convolutional network in numpy, shared by the language and the quality classifier.

Bytes fall into 64 classes, classes into learned vectors; filters of widths 2, 3 and 4 slide over a window, their
largest response in it is kept, and a dense layer turns the 3 * FILTERS maxima into logits. For scoring, the vectors and
filters are folded into tables of byte pairs, so a window costs two table rows, one sum and one maximum a position.
"""

from __future__ import annotations

import numpy as np

CLASSES, DIM, FILTERS, WINDOW = 64, 8, 16, 512
WIDTHS = (2, 3, 4)
PAD = 30


def _classes() -> bytes:
    """Letters one by one (capitals together), digits, blanks, marks in groups, non-ASCII bytes by their low bits."""
    table = np.full(256, PAD, np.uint8)
    table[ord("a") : ord("z") + 1] = np.arange(26)
    table[ord("A") : ord("Z") + 1] = 26
    table[ord("0") : ord("9") + 1] = 27
    table[ord(" ")], table[ord("\n")] = 28, 29
    for i, marks in enumerate([".", ",", "'\"", "!", "?", ";:", "()[]{}<>", "-_", "/\\|", "#", "$", "%", "&", "*", "@+=~^`"]):
        table[[ord(c) for c in marks]] = 31 + i
    table[0x80:0xC0] = 46 + (np.arange(0x80, 0xC0) & 15)
    table[0xC0:] = 63
    table[0xC3] = 62
    return table.tobytes()


TABLE = _classes()


def windows_of(texts: list[bytes], stride: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(windows, windows a text): WINDOW classes every ``stride`` bytes, until all bytes are covered; padded at the end."""
    rows, count = [], np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        n = 1 + max(0, -(-(len(t) - WINDOW) // stride))
        raw = np.full((n - 1) * stride + WINDOW, PAD, np.uint8)
        raw[: len(t)] = np.frombuffer(t.translate(TABLE), np.uint8)
        rows.append(raw.reshape(n, WINDOW) if stride == WINDOW else np.lib.stride_tricks.sliding_window_view(raw, WINDOW)[::stride])
        count[i] = n
    return (np.concatenate(rows) if rows else np.empty((0, WINDOW), np.uint8)), count


class ByteCnn:
    def __init__(self, outputs: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {"e": rng.normal(0, 0.5, (CLASSES, DIM)), "b": np.zeros(3 * FILTERS), "d": rng.normal(0, 0.1, (3 * FILTERS, outputs)), "o": np.zeros(outputs)}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, (w * DIM) ** -0.5, (w, DIM, FILTERS))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    @classmethod
    def of(cls, p: dict[str, np.ndarray]) -> ByteCnn:
        net = cls.__new__(cls)
        net.p = p
        return net

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Responses to a byte pair at a filter's first two places (all widths), and at its next two (widths 3 and 4)."""
        t = {(w, j): self.p["e"] @ self.p[f"w{w}"][j] for w in WIDTHS for j in range(w)}
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(-1, FILTERS)
        none = np.zeros((CLASSES, FILTERS), np.float32)
        first = np.concatenate([pair(t[w, 0], t[w, 1]) for w in WIDTHS], 1)
        second = np.concatenate([pair(t[3, 2], none), pair(t[4, 2], t[4, 3])], 1)
        return np.ascontiguousarray(first), np.ascontiguousarray(second)

    @staticmethod
    def responses(windows: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        pairs = windows[:, :-1].astype(np.intp) * CLASSES + windows[:, 1:]
        out = np.take(tables[0], pairs[:, :-2], axis=0)
        out[:, :, FILTERS:] += np.take(tables[1], pairs[:, 2:], axis=0)
        return out

    def logits(self, windows: np.ndarray, tables=None, step: int = 16) -> np.ndarray:
        tables = tables or self.tables()
        pooled = np.empty((len(windows), 3 * FILTERS), np.float32)
        for i in range(0, len(windows), step):
            pooled[i : i + step] = self.responses(windows[i : i + step], tables).max(1)
        return np.maximum(pooled + self.p["b"], 0) @ self.p["d"] + self.p["o"]

    def fit(self, windows: np.ndarray, target: np.ndarray, weight: np.ndarray, epochs: int, seed: int = 7, rate: float = 0.01, batch: int = 64) -> ByteCnn:
        """Adam on softmax cross-entropy; ``target`` numbers the outputs."""
        rng, step = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                grads = self.gradients(windows[some], target[some], weight[some])
                step += 1
                for k, g in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def gradients(self, x: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        out = self.responses(x, self.tables())
        where = out.argmax(1)
        hidden = np.maximum(np.take_along_axis(out, where[:, None, :], 1)[:, 0] + self.p["b"], 0)
        z = hidden @ self.p["d"] + self.p["o"]
        q = np.exp(z - z.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        q[np.arange(len(x)), target] -= 1
        q *= (weight / weight.sum())[:, None]
        g = {"d": hidden.T @ q, "o": q.sum(0)}
        back = (q @ self.p["d"].T) * (hidden > 0)
        g["b"], g["e"] = back.sum(0), np.zeros_like(self.p["e"])
        rows = np.arange(len(x))[:, None]
        for k, w in enumerate(WIDTHS):
            mine = slice(k * FILTERS, (k + 1) * FILTERS)
            gw = np.zeros_like(self.p[f"w{w}"])
            for j in range(w):
                t = np.zeros((CLASSES, FILTERS), np.float32)
                np.add.at(t, (x[rows, where[:, mine] + j], np.arange(FILTERS)[None, :]), back[:, mine])
                gw[j] = self.p["e"].T @ t
                g["e"] += t @ self.p[f"w{w}"][j].T
            g[f"w{w}"] = gw
        return g
