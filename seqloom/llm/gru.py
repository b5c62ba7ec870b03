"""A gated recurrent language model in numpy: truncated backpropagation, class-factored softmax, carried state."""

from __future__ import annotations

import numpy as np


def classes_by_mass(freq: np.ndarray, classes: int) -> np.ndarray:
    """A class for each token, tokens in falling order of frequency: runs of equal mass of the square root of frequency, so that frequent tokens are in small classes."""
    mass = np.cumsum(np.sqrt(freq + 1.0))
    return np.minimum((mass - np.sqrt(freq + 1.0)) / mass[-1] * classes, classes - 1).astype(np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    """By tanh, in place of x: a third of the time of exp and a division."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def keep_memory() -> None:
    """Freed memory of this process stays with it, up to 60 MB: else each window's arrays are handed back and faulted in again, a quarter of its time.

    glibc raises its limits to the size of the largest array that was mapped and freed; elsewhere this does nothing. No page of it is touched.
    """
    np.empty(30 << 20, np.uint8)


#: Weights that meet exponentials of up to exp(80) are made smaller by this much: no product or sum of them overflows.
SMALL = np.float32(2.0**-10)


class Gru:
    """Token i's probability given the state before it is p(class of i) p(i in its class); the state starts at zero and takes in each token after it is scored.

    All weights are views of one array. Biases are the last row or column of their matrices: states have a 1 at their end.
    """

    def __init__(self, freq: np.ndarray, hidden: int = 16, width: int = 16, classes: int = 48, seed: int = 0):
        rng = np.random.default_rng(seed)
        k, c = len(freq), min(classes, len(freq))
        self.freq, self.hidden = np.asarray(freq, np.float64), hidden
        of = classes_by_mass(self.freq, c)
        _, self.of = np.unique(of, return_inverse=True)  # no empty class
        c = int(self.of.max()) + 1
        self.first = np.searchsorted(self.of, np.arange(c + 1))
        self.size = np.diff(self.first)
        shapes = {"emb": (k, width), "wx": (width + 1, 3 * hidden), "wh": (hidden, 3 * hidden), "wc": (hidden + 1, c), "wo": (k, hidden + 1)}
        self.flat = np.zeros(sum(a * b for a, b in shapes.values()), np.float32)
        self.p = self._views(self.flat, shapes)
        self.shapes = shapes
        p = (self.freq + 1) / (self.freq + 1).sum()
        by_class = np.add.reduceat(p, self.first[:-1])
        r = lambda a, b, scale: rng.standard_normal((a, b)) * scale
        self.p["emb"][:] = r(k, width, 0.3)
        self.p["wx"][:width], self.p["wh"][:] = r(width, 3 * hidden, width**-0.5), r(hidden, 3 * hidden, hidden**-0.5)
        self.p["wc"][:hidden], self.p["wc"][hidden] = r(hidden, c, 0.1 * hidden**-0.5), np.log(by_class)
        self.p["wo"][:, :hidden], self.p["wo"][:, hidden] = r(k, hidden, 0.05), np.log(p / by_class[self.of])

    @staticmethod
    def _views(flat: np.ndarray, shapes: dict[str, tuple[int, int]]) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, (a, b) in shapes.items():
            out[name] = flat[at : at + a * b].reshape(a, b)
            at += a * b
        return out

    # weights as one array, for averages of replicas
    def get(self) -> np.ndarray:
        return self.flat.copy()

    def put(self, flat: np.ndarray) -> Gru:
        self.flat[:] = flat
        return self

    def gates(self) -> np.ndarray:
        """The input's share of the gates, for every token."""
        return self.p["emb"] @ self.p["wx"][:-1] + self.p["wx"][-1]

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """One step; x: the input's share of the gates. New state, update and reset gates, candidate, the state's share of it."""
        return tuple(np.ascontiguousarray(y.T) for y in self._turn(np.ascontiguousarray(self.p["wh"].T), x.T, h.T))

    def _turn(self, wh: np.ndarray, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """step() where each lane is a column, so that a gate's numbers lie together; wh: transposed weights."""
        n = self.hidden
        s = wh @ h
        g, u = s[: 2 * n], s[2 * n :]
        g += x[: 2 * n]
        sigmoid(g)
        c = g[n:] * u
        c += x[2 * n :]
        np.tanh(c, out=c)
        new = h - c
        new *= g[:n]
        new += c
        return new, g[:n], g[n:], c, u

    def _inputs(self, e: np.ndarray) -> np.ndarray:
        """The input's share of the gates, lanes as columns. e: embeddings (steps x lanes x width)."""
        x = np.matmul(np.ascontiguousarray(self.p["wx"][:-1].T), e.transpose(0, 2, 1))
        x += self.p["wx"][-1][:, None]
        return x

    def _inside(self, x: np.ndarray, tokens: np.ndarray) -> tuple:
        """Logits of the words of each token's class, one run of numbers for each token. x: states, tokens: in rising order, and so in the order of their classes.

        Returns classes with the rows of each, logits, and the place of each token's own.
        """
        of = self.of[tokens]
        ends = np.searchsorted(tokens, self.first)
        width = self.size[of]
        stop = np.cumsum(width)
        logits = np.empty(int(stop[-1]) if len(stop) else 0, np.float32)
        parts = []
        for c in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
            a, b, lo, hi = int(ends[c]), int(ends[c + 1]), int(self.first[c]), int(self.first[c + 1])
            at = int(stop[a]) - (hi - lo)
            run = logits[at : at + (b - a) * (hi - lo)].reshape(b - a, hi - lo)
            np.matmul(x[a:b], self.p["wo"][lo:hi].T, out=run)
            parts.append((a, b, lo, hi, run))
        np.clip(logits, -80, 80, out=logits)
        return parts, logits, stop - width + tokens - self.first[of]

    def log_prob(self, h: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Natural log probability of each token given the state before it."""
        return self._log_prob(np.concatenate([h, np.ones((len(h), 1), np.float32)], axis=1), tokens)

    def _log_prob(self, hs: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """log_prob() of states with a 1 at their end."""
        a = hs @ self.p["wc"]
        np.clip(a, -80, 80, out=a)
        out = a[np.arange(len(a)), self.of[tokens]]
        out -= np.log(np.exp(a, out=a) @ np.ones(a.shape[1], np.float32))
        order = np.argsort(tokens.astype(np.uint16) if len(self.freq) <= 1 << 16 else tokens, kind="stable")  # short ones by radix
        parts, logits, own = self._inside(hs[order], tokens[order])
        inside, total = logits[own], np.empty(len(tokens), np.float32)
        np.exp(logits, out=logits)
        for lo, hi, _, _, run in parts:
            np.matmul(run, np.ones(run.shape[1], np.float32), out=total[lo:hi])
        out[order] += inside - np.log(total)
        return out

    def score(self, docs: list[np.ndarray], room: int = 1 << 13, lanes: int = 1024) -> np.ndarray:
        """Natural log probability of whole documents (token arrays); the state is carried from window to window to a document's end.

        lanes documents of like length side by side, about room tokens in a window: arrays that stay in a core's cache.
        """
        keep_memory()
        order = np.argsort([-len(d) for d in docs], kind="stable")
        out = np.zeros(len(docs))
        for i in range(0, len(order), lanes):
            some = order[i : i + lanes]
            out[some] = self._score([docs[j] for j in some], room)
        return out

    def _score(self, docs: list[np.ndarray], room: int) -> np.ndarray:
        n, lens = self.hidden, np.array([len(d) for d in docs], np.int64)
        total, flat = np.zeros(len(docs)), np.concatenate(docs).astype(np.int64)
        start, wh = np.cumsum(lens) - lens, np.ascontiguousarray(self.p["wh"].T)
        h = np.zeros((n, len(docs)), np.float32)
        t = 0
        while t < lens[0]:
            lives = int(np.searchsorted(-lens, -t, side="left"))  # documents longer than t come first
            steps = int(min(max(8, room // lives), lens[0] - t))
            at = np.arange(t, t + steps)
            live = np.searchsorted(-lens, -at, side="left").tolist()
            w = flat[np.minimum(start[:lives] + at[:, None], len(flat) - 1)]
            x = self._inputs(self.p["emb"][w])
            before = np.ones((steps, lives, n + 1), np.float32)
            for i, now in enumerate(live):
                before[i, :now, :n] = h[:, :now].T
                h = self._turn(wh, x[i, :, :now], h[:, :now])[0]
            owner, tokens, before = np.tile(np.arange(lives), steps), w.ravel(), before.reshape(-1, n + 1)
            if live[-1] < lives:
                own = np.flatnonzero(np.arange(lives) < np.array(live)[:, None])
                owner, tokens, before = owner[own], tokens[own], before[own]
            total += np.bincount(owner, self._log_prob(before, tokens).astype(np.float64), len(docs))
            t += steps
        return total

    def window(self, tokens: np.ndarray, mask: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss, gradient (one array, as the weights) and last state of one window (steps x lanes); nothing is propagated before its start.

        Exponentials stay as they are: their sums come with the product that leads back to the states (a column of ones
        beside the weights), and the states are divided by them instead.
        """
        p, n, (steps, lanes) = self.p, self.hidden, tokens.shape
        whole = mask.all(axis=1)
        e = p["emb"][tokens]
        x, wh = self._inputs(e), np.ascontiguousarray(p["wh"].T)
        before, z, r, c, u = (np.empty((steps, n, lanes), np.float32) for _ in range(5))
        h = h.T
        for i in range(steps):
            before[i] = h
            new, z[i], r[i], c[i], u[i] = self._turn(wh, x[i], h)
            h = new if whole[i] else np.where(mask[i], new, h)
        last = np.ascontiguousarray(h.T)
        hs = np.ones((steps, lanes, n + 1), np.float32)
        hs[:, :, :n] = before.transpose(0, 2, 1)
        live = np.arange(steps * lanes) if whole.all() else np.flatnonzero(mask.ravel())
        w = tokens.ravel()[live]
        order = np.argsort(w.astype(np.uint16) if len(self.freq) <= 1 << 16 else w, kind="stable")  # short ones by radix
        live, w = live[order], w[order]  # from here tokens are in rising order
        hs, count, of = hs.reshape(-1, n + 1)[live], max(1, len(w)), self.of[w]
        flat = np.zeros_like(self.flat)
        g = self._views(flat, self.shapes)
        # classes
        a = hs @ p["wc"]
        np.clip(a, -80, 80, out=a)
        np.exp(a, out=a)
        to_state = np.ones((a.shape[1], n + 1), np.float32)
        to_state[:, :n] = p["wc"][:n].T
        back = a @ (to_state * SMALL)
        total = back[:, n:] / SMALL
        own = np.arange(len(w)) * a.shape[1] + of
        mine = a.ravel()[own]
        loss = -np.log(mine / total[:, 0] + 1e-30).sum()
        a.ravel()[own] = mine - total[:, 0]
        np.matmul((hs / total).T, a, out=g["wc"])
        back /= back[:, n:].copy()
        dh = back[:, :n] - to_state[of, :n]
        # words in their classes
        parts, o, own = self._inside(hs, w)
        if len(o):
            np.exp(o, out=o)
            to_state = np.ones((len(self.freq), n + 1), np.float32)
            to_state[:, :n] = p["wo"][:, :n]
            to_state *= SMALL
            for lo, hi, first, end, run in parts:
                np.matmul(run, to_state[first:end], out=back[lo:hi])
            total = back[:, n:] / SMALL
            mine = o[own]
            loss -= np.log(mine / total[:, 0] + 1e-30).sum()
            o[own] = mine - total[:, 0]
            hs /= total
            for lo, hi, first, end, run in parts:
                np.matmul(run.T, hs[lo:hi], out=g["wo"][first:end])
            back /= back[:, n:].copy()
            dh += back[:, :n]
            dh -= p["wo"][w, :n]
        d_rows = np.zeros((steps * lanes, n), np.float32)
        d_rows[live] = dh
        d_before = np.ascontiguousarray(d_rows.reshape(steps, lanes, n).transpose(0, 2, 1))
        # what the gradient of a new state is multiplied by: for its update gate, reset gate, the state's share of the candidate, the candidate
        by, rest = np.empty((steps, 3, n, lanes), np.float32), 1 - z
        np.subtract(before, c, out=by[:, 0])
        by[:, 0] *= z
        by[:, 0] *= rest
        c *= c
        np.subtract(1, c, out=c)
        c *= rest
        np.multiply(c, r, out=by[:, 2])
        np.subtract(1, r, out=r)
        r *= u
        np.multiply(by[:, 2], r, out=by[:, 1])
        if not whole.all():  # a lane that has ended hands its gradient on
            gone = ~mask[:, None, :]
            np.copyto(z, 1, where=gone)
            np.copyto(c, 0, where=gone)
            np.copyto(by, 0, where=gone[:, None])
        ds, d = np.empty((steps, 3 * n, lanes), np.float32), np.empty((steps, n, lanes), np.float32)
        d[-1] = 0
        for i in range(steps - 1, -1, -1):
            np.multiply(by[i], d[i], out=ds[i].reshape(3, n, lanes))
            if i:
                np.matmul(p["wh"], ds[i], out=d[i - 1])
                z[i] *= d[i]
                d[i - 1] += z[i]
                d[i - 1] += d_before[i]
        np.matmul(before, ds.transpose(0, 2, 1)).sum(axis=0, out=g["wh"])
        # the input's share
        np.multiply(c, d, out=ds[:, 2 * n :])
        dx = ds.transpose(0, 2, 1)
        np.matmul(e.transpose(0, 2, 1), dx).sum(axis=0, out=g["wx"][:-1])
        g["wx"][-1] = (ds @ np.ones(lanes, np.float32)).sum(axis=0)
        edges = np.flatnonzero(np.diff(w, prepend=-1))
        if len(edges):
            g["emb"][w[edges]] = np.add.reduceat(np.matmul(dx, np.ascontiguousarray(p["wx"][:-1].T)).reshape(steps * lanes, -1)[live], edges, axis=0)
        flat /= count
        return float(loss) / count, flat, last

    def train(self, segments: list[np.ndarray], rate: float, lanes: int | None = None, window: int = 16, clip: float = 1.0, seed: int = 0) -> float:
        """One pass of Adam over segments, each a run of tokens of one document; the state is carried from a segment's window to its next.

        lanes: segments side by side; by default fewer for few segments, so that there are enough steps.
        """
        keep_memory()
        rng = np.random.default_rng(seed)
        segments = [s for s in segments if len(s)]
        if not segments:
            return 0.0
        lanes = lanes or min(256, max(8, len(segments) // 32))
        order = np.argsort([len(s) for s in segments], kind="stable")
        batches = [order[i : i + lanes] for i in range(0, len(order), lanes)]
        m, v, step, losses = np.zeros_like(self.flat), np.zeros_like(self.flat), 0, []
        planned = sum(-(-max(len(segments[i]) for i in b) // window) for b in batches)
        for b in rng.permutation(len(batches)):
            own = [segments[i] for i in batches[b]]
            lens = np.array([len(s) for s in own])
            longest = int(lens.max())
            mask = np.arange(longest)[:, None] < lens
            tokens = np.zeros((len(own), longest), np.int64)
            tokens[mask.T] = np.concatenate(own)
            tokens = np.ascontiguousarray(tokens.T)
            h = np.zeros((len(own), self.hidden), np.float32)
            for t in range(0, longest, window):
                loss, g, h = self.window(tokens[t : t + window], mask[t : t + window], h)
                losses.append(loss)
                now = rate * min(1.0, (step + 1) / 20) * (1 - 0.9 * step / max(1, planned))
                step += 1
                g *= 0.1 * min(1.0, clip / (float(np.sqrt(np.dot(g, g))) + 1e-9))
                m *= 0.9
                m += g
                g *= g  # a hundredth of the gradient's square
                v *= 0.99
                v += g
                np.sqrt(v, out=g)
                unit = (1 - 0.99**step) ** 0.5
                g += 1e-8 * unit
                np.divide(m, g, out=g)
                g *= now * unit / (1 - 0.9**step)
                self.flat -= g
        return float(np.mean(losses))
