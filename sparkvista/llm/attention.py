"""One head of causal self-attention over subword ids, in numpy, with a class-factored output.

P(id | before) = P(class of id | before) P(id | class): attention gives the first factor, counts the second,
so that the probabilities of all ids sum to one. Every id is read and predicted; ids beyond the commonest share
the embedding of their class. Texts are read in windows that overlap: each repeats CONTEXT ids and scores
STRIDE new ones.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Classes of ids, those of ids that aren't among the commonest, ids with an embedding of their own, width of the
#: head, width of the hidden layer.
CLASSES, TAILS, OWN, WIDTH, HIDDEN = 128, 16, 4_096, 16, 32
CONTEXT, STRIDE = 8, 24
#: Windows in a step of training; steps whose windows are looked up at a time.
BATCH, AHEAD = 64, 32


def window_places(ends: np.ndarray, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, number) of the windows of texts with these offsets; `before`: ids of each text that are only read."""
    count = -(-(np.diff(ends) - (0 if before is None else before)) // STRIDE)
    text = np.repeat(np.arange(len(count)), count)
    return text, np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)


def window_ids(ids: np.ndarray, ends: np.ndarray, end_id: int, text: np.ndarray, nth: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """The ids in the given windows, one row each, -1 for none: all but the last are read, those after CONTEXT + 1 predicted.

    ids holds all texts, each closed by end_id. A text reads that id before its first.
    """
    place = nth[:, None] * STRIDE + np.arange(-CONTEXT - 1, STRIDE)[None]
    if before is not None:
        place += before[text][:, None]
    inside = (place >= 0) & (place < np.diff(ends)[text][:, None])
    found = ids[np.where(inside, place + ends[:-1][text][:, None], 0)].astype(np.int32)
    return np.where(inside, found, np.where(place == -1, end_id, -1)).astype(np.int32)


class Network:
    def __init__(self, embedding: np.ndarray | None = None, seed: int = 0):
        rng = np.random.Generator(np.random.PCG64(seed))
        d, h = WIDTH, HIDDEN
        shapes = {"e": (OWN + CLASSES, d), "q": (d, d), "k": (d, d), "v": (d, d), "o": (d, h), "x": (d, h), "b": (h,), "c": (h, CLASSES), "s": (CLASSES,), "r": (CONTEXT + STRIDE,)}
        self.w = {k: (rng.standard_normal(s) * (0.3 if len(s) > 1 else 0.0)).astype(np.float32) for k, s in shapes.items()}
        if embedding is not None:
            self.w["e"][:] = embedding
        distance = np.arange(CONTEXT, CONTEXT + STRIDE)[:, None] - np.arange(CONTEXT + STRIDE)[None]
        self.back, self.past = np.maximum(distance, 0), distance >= 0

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w[k].ravel() for k in sorted(self.w)])

    def load(self, flat: np.ndarray) -> Network:
        """Weights are views of one array."""
        at, self.whole = 0, flat.astype(np.float32)
        for k in sorted(self.w):
            n = self.w[k].size
            self.w[k] = self.whole[at : at + n].reshape(self.w[k].shape)
            at += n
        return self

    def forward(self, ids: np.ndarray) -> dict[str, np.ndarray]:
        """ids: embeddings of each window's places, -1 for padding. `zx`: for every place from CONTEXT on what attention reads, its embedding, and a 1."""
        w, d = self.w, WIDTH
        x = w["e"].take(ids, 0, mode="wrap")  # padding reads the last row, and is masked
        qkv = (x.reshape(-1, d) @ self._reads()).reshape(*ids.shape, 3 * d)
        q, k, v = qkv[:, CONTEXT:, :d], qkv[..., d : 2 * d], qkv[..., 2 * d :]
        a, total = self._attention(ids, q, k)
        a /= total
        zx = np.empty((*a.shape[:2], 2 * d + 1), x.dtype)
        zx[..., :d], zx[..., d:-1], zx[..., -1] = a @ v, x[:, CONTEXT:], 1
        return {"x": x, "q": q, "k": k, "v": v, "a": a, "zx": zx.reshape(-1, 2 * d + 1)}

    def _reads(self) -> np.ndarray:
        return np.hstack([self.w["q"] * self.w["q"].dtype.type(WIDTH**-0.5), self.w["k"], self.w["v"]])

    def _hidden_weights(self) -> np.ndarray:
        return np.vstack([self.w["o"], self.w["x"], self.w["b"]])

    def _attention(self, ids: np.ndarray, q: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights of all places for those from CONTEXT on, and their sums."""
        a, r = q @ k.transpose(0, 2, 1), self.w["r"]
        a += np.where(self.past, r[self.back], r.dtype.type(-1e9))
        blank = ids[:, :CONTEXT] < 0  # padding after a text is in the future of all its ids
        some = blank.any(1)
        if some.any():
            a[some, :, :CONTEXT] += np.where(blank[some], a.dtype.type(-1e9), a.dtype.type(0))[:, None]
        if a.max() > 60:
            np.minimum(a, a.dtype.type(60), out=a)
        np.exp(a, out=a)
        return a, (a.reshape(-1, a.shape[-1]) @ np.ones(a.shape[-1], a.dtype)).reshape(*a.shape[:2], 1)

    @staticmethod
    def _clipped(h: np.ndarray) -> np.ndarray:
        """The hidden layer, in place; the last of its columns is for a 1."""
        np.maximum(h, h.dtype.type(-1), out=h)
        np.minimum(h, h.dtype.type(1), out=h)
        h[:, -1] = 1
        return h

    def _shares(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """exp of the class logits and their sums by row; as the hidden layer is within -1 and 1, large logits are rare."""
        weights = np.vstack([self.w["c"], self.w["s"]])
        y = h @ weights
        if np.abs(weights).sum(0).max() > 80:
            y -= y.max(-1, keepdims=True)
        np.exp(y, out=y)
        return y, y @ np.ones(y.shape[1], y.dtype)

    def tables(self) -> tuple[np.ndarray, ...]:
        """What every embedding gives to attention (to q and k; to the hidden layer by v and o) and to the hidden layer itself, for the weights as they are."""
        w, e = self.w, self.w["e"]
        room = np.zeros((len(e), 1), e.dtype)
        return np.ascontiguousarray((e @ self._reads())[:, : 2 * WIDTH]), np.hstack([e @ w["v"] @ w["o"], room]), np.hstack([e @ w["x"] + w["b"], room])

    def log_classes(self, ids: np.ndarray, target: np.ndarray, tables: tuple[np.ndarray, ...] | None = None) -> np.ndarray:
        """log10 P(class) of the target classes at the STRIDE last places of each window; tables: what tables() gave, for many calls."""
        reads, values, own = tables or self.tables()
        qk = reads.take(ids, 0, mode="wrap")  # padding reads the last row, and is masked
        a, total = self._attention(ids, qk[:, CONTEXT:, :WIDTH], qk[..., WIDTH:])
        h = a @ values.take(ids, 0, mode="wrap")
        h /= total
        h += own.take(ids[:, CONTEXT:], 0, mode="wrap")
        p, total = self._shares(self._clipped(h.reshape(-1, h.shape[-1])))
        return np.log10(p[np.arange(len(p)), target.ravel()] / total).reshape(target.shape)

    def slopes(self, ids: np.ndarray, target: np.ndarray, with_loss: bool = True) -> tuple[float, dict[str, np.ndarray]]:
        """The loss over target classes (-1: none; 0 if it isn't asked for), and its slope in every weight."""
        w, f, d = self.w, self.forward(ids), WIDTH
        zx, into = f["zx"], self._hidden_weights()
        h = np.empty((len(zx), HIDDEN + 1), zx.dtype)
        np.matmul(zx, into, out=h[:, :-1])
        p, total = self._shares(self._clipped(h))
        flat = target.ravel()
        hit = flat >= 0
        n, at = max(1, int(np.count_nonzero(hit))), (np.flatnonzero(hit), flat[hit])
        loss = float(-np.log(np.maximum(p[at] / total[at[0]], 1e-30)).mean()) if with_loss and hit.any() else 0.0
        # p and its target less their sum, times part, is the slope in the logits; the narrow h is what is scaled
        p[at] -= total[at[0]]
        part = (hit / (total * n)).astype(p.dtype)[:, None]
        dh, out = p @ w["c"].T, (h * part).T @ p
        dh *= part * (np.abs(h[:, :-1]) < 1)
        both = zx.T @ dh
        g = {"c": out[:-1], "s": out[-1], "o": both[:d], "x": both[d:-1], "b": both[-1]}
        dzx = dh @ into[:-1].T
        dzx = dzx.reshape(*target.shape, 2 * d)
        dz, a = dzx[..., :d], f["a"]
        dqkv = np.zeros((*ids.shape, 3 * d), h.dtype)
        np.matmul(a.transpose(0, 2, 1), dz, out=dqkv[..., 2 * d :])
        da = dz @ f["v"].transpose(0, 2, 1)
        da -= np.einsum("bik,bik->bi", dz, f["zx"].reshape(*target.shape, -1)[..., :d])[..., None]
        da *= a
        g["r"] = np.bincount(self.back.ravel(), (da.sum(0) * self.past).ravel(), len(w["r"]))
        np.matmul(da, f["k"], out=dqkv[:, CONTEXT:, :d])
        np.matmul(da.transpose(0, 2, 1), f["q"], out=dqkv[..., d : 2 * d])
        dqkv = dqkv.reshape(-1, 3 * d)
        every = f["x"].reshape(-1, d).T @ dqkv
        g |= {"q": every[:, :d] * h.dtype.type(d**-0.5), "k": every[:, d : 2 * d], "v": every[:, 2 * d :]}
        dx = (dqkv @ self._reads().T).reshape(f["x"].shape)
        dx[:, CONTEXT:] += dzx[..., d:]
        g["e"] = _sums_by_id(ids.ravel(), dx.reshape(-1, d), len(w["e"]))
        return loss, g

    def train(self, some: Callable[[slice], tuple[np.ndarray, np.ndarray]], windows: int, rates: tuple[float, float]) -> Network:
        """Adam over minibatches of (inputs, targets) that some() gives for a slice of the windows, with a rate that falls from the first to the last."""
        self.load(self.flat())
        w = self.whole
        m, v, g, step = (np.zeros_like(w) for _ in range(4))
        steps = max(1, -(-windows // BATCH))
        for t in range(1, steps + 1):
            k = (t - 1) % AHEAD * BATCH
            if not k:
                ids, target = some(slice((t - 1) * BATCH, (t - 1 + AHEAD) * BATCH))
            _, slopes = self.slopes(ids[k : k + BATCH], target[k : k + BATCH], with_loss=False)
            rate = rates[0] + (rates[1] - rates[0]) * t / steps
            np.concatenate([slopes[x].ravel() for x in sorted(slopes)], out=g)
            m *= np.float32(0.9)
            v *= np.float32(0.99)
            m += np.multiply(g, np.float32(0.1), out=step)
            np.multiply(g, g, out=step)
            step *= np.float32(0.01)
            v += step
            np.multiply(v, np.float32(1 / (1 - 0.99**t)), out=step)
            np.sqrt(step, out=step)
            step += np.float32(1e-8)
            np.divide(m, step, out=step)
            step *= np.float32(rate / (1 - 0.9**t))
            w -= step
        return self


def _sums_by_id(ids: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The sum of the rows of each id, -1 for none."""
    width = rows.shape[1]
    cell = (ids.astype(np.intp) + 1)[:, None] * width + np.arange(width)
    return np.bincount(cell.ravel(), rows.ravel(), (n + 1) * width).reshape(n + 1, width)[1:]
