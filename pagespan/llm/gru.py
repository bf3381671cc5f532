"""A gated recurrent language model over units, in NumPy.

Units are frequent words, and bands of rarer words. The output softmax is factored: first the unit's class, then
the unit within the class; classes hold units of adjacent frequency and about equal mass. Before training, the
biases make the model the unigram distribution. Training is truncated backpropagation: windows of STEPS tokens,
with the state carried from window to window and reset at the start of each document. Scoring carries the state
over whole documents.
"""

from __future__ import annotations

import heapq

import numpy as np

HIDDEN, EMBED, STEPS, SLOTS, PIECE = 24, 16, 16, 512, 1024
#: Streams of a training window by tokens learned so far: small windows first, as early steps gain the most.
WARM_UP, STREAMS = ((100_000, 64), (400_000, 128), (1_000_000, 256)), 512
NAMES = ("emb", "wx", "wh", "bg", "wc", "bc", "wu", "bu")
_ROWS = 2048  # of a block of the class softmax, which then stays in the cache
_SAFE = 60.0  # logits below it need no shift before exp in single precision


def classes(mass: np.ndarray) -> np.ndarray:
    """First unit of each class and the end: about sqrt(units) classes of about equal mass; units descend by mass."""
    n = max(1, int(round(len(mass) ** 0.5)))
    share = np.cumsum(mass) - mass
    of = np.minimum((share / mass.sum() * n).astype(np.int64), n - 1)
    cut = [0]
    for i in range(1, len(mass)):
        if of[i] != of[i - 1] or i - cut[-1] >= 4 * n:
            cut.append(i)
    return np.array([*cut, len(mass)], np.int64)


def initial(mass: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    rng, u, cut = np.random.default_rng(seed), len(mass), classes(mass)
    total = np.add.reduceat(mass, cut[:-1])
    of = np.repeat(np.arange(len(total)), np.diff(cut))
    r = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
    return {
        "emb": r(u + 1, EMBED),  # the last row stands for a document's start
        "wx": r(EMBED, 3 * HIDDEN),
        "wh": r(HIDDEN, 3 * HIDDEN),
        "bg": np.zeros(3 * HIDDEN, np.float32),
        "wc": np.zeros((HIDDEN, len(total)), np.float32),
        "bc": np.log(total / total.sum()).astype(np.float32),
        "wu": np.zeros((u, HIDDEN), np.float32),
        "bu": np.log(mass / total[of]).astype(np.float32),
    }


def flat(p: dict) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in NAMES])


def _views(x: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in NAMES:
        n = like[k].size
        out[k] = x[at : at + n].reshape(like[k].shape)
        at += n
    return out


def shaped(x: np.ndarray, like: dict) -> dict:
    return {k: v.astype(np.float32) for k, v in _views(x, like).items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += np.float32(1)
    return np.reciprocal(x, out=x)


def _tanh(x: np.ndarray) -> np.ndarray:
    """In place, by exp, which is quicker than tanh."""
    x *= np.float32(-2)
    np.exp(x, out=x)
    x += np.float32(1)
    np.divide(np.float32(2), x, out=x)
    x -= np.float32(1)
    return x


class Room:
    """Arrays that are used again and again, by name: fresh large ones would cost page faults at every step."""

    def __init__(self) -> None:
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        n = int(np.prod(shape))
        x = self.held.get(name)
        if x is None or len(x) < n:
            x = self.held[name] = np.empty(n, np.float32)
        return x[:n].reshape(shape)


class Output:
    """The class-factored softmax over states. Rows are dealt by class, so that each class is one slice."""

    def __init__(self, p: dict, cut: np.ndarray) -> None:
        self.p, self.cut, self.room = p, cut.tolist(), Room()
        self.of = np.repeat(np.arange(len(cut) - 1), np.diff(cut)).astype(np.uint16)
        self.one = np.ones(_ROWS, np.float32)

    def ones(self, n: int) -> np.ndarray:
        if len(self.one) < n:
            self.one = np.ones(2 * n, np.float32)
        return self.one[:n]

    def _softmax(self, x: np.ndarray, w: np.ndarray, b: np.ndarray, shift: bool) -> tuple[np.ndarray, np.ndarray]:
        """exp of x w + b, and its sums."""
        q = np.matmul(x, w, out=self.room("q", len(x), len(b)))
        q += b
        if shift:
            q -= q.max(1, keepdims=True)
        np.exp(q, out=q)
        return q, q @ self.ones(len(b))

    def __call__(self, h: np.ndarray, target: np.ndarray, grad: dict | None = None):
        """Natural log-probability of each target; with grad, the gradient of their negative sum by h is added and returned.

        What is returned is valid until the next call."""
        p, cut, n = self.p, self.cut, len(target)
        wc, bc, wu, bu = p["wc"], p["bc"], p["wu"], p["bu"]
        # states lie in [-1, 1], so sums of weights bound the logits
        shift_c = float((np.abs(wc).sum(0) + np.abs(bc)).max()) > _SAFE
        shift_u = float((np.abs(wu).sum(1) + np.abs(bu)).max()) > _SAFE
        of = self.of.take(target)
        order = np.argsort(of, kind="stable")
        target, of = target.take(order), of.take(order)
        edge = np.searchsorted(of, np.arange(len(cut))).tolist()
        hc = np.take(h, order, 0, out=self.room("hc", n, HIDDEN), mode="clip")
        got = self.room("got", n)
        dhc = None if grad is None else self.room("dhc", n, HIDDEN)
        for i in range(0, n, _ROWS):
            x, c = hc[i : i + _ROWS], of[i : i + _ROWS]
            q, s = self._softmax(x, wc, bc, shift_c)
            at = np.arange(len(c))
            got[i : i + _ROWS] = q[at, c] / s
            if grad is not None:
                q *= np.reciprocal(s)[:, None]
                q[at, c] -= 1
                grad["wc"] += x.T @ q
                grad["bc"] += self.ones(len(c)) @ q
                np.matmul(q, wc.T, out=dhc[i : i + _ROWS])
        for c, (i, j) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
            a, b = cut[c], cut[c + 1]
            if i == j or b - a == 1:
                continue
            x, k, w = hc[i:j], target[i:j] - a, wu[a:b]
            q, s = self._softmax(x, w.T, bu[a:b], shift_u)
            at = np.arange(j - i)
            got[i:j] *= q[at, k] / s
            if grad is not None:
                q *= np.reciprocal(s)[:, None]
                q[at, k] -= 1
                grad["wu"][a:b] += q.T @ x
                grad["bu"][a:b] += self.ones(j - i) @ q
                dhc[i:j] += np.matmul(q, w, out=self.room("dq", j - i, HIDDEN))
        out = self.room("out", n)
        np.maximum(got, np.float32(1e-37), out=got)
        out[order] = np.log(got, out=got)
        if grad is None:
            return out, None
        dh = self.room("dh", n, HIDDEN)
        dh[order] = dhc
        return out, dh


class Streams:
    """Documents dealt to n streams, longest first, each to the shortest, so that streams end close together.

    Tokens lie flat, one stream after the other, so memory follows the tokens and not the longest document. With
    `piece`, longer documents are cut into pieces that stand for documents of their own, but for the token before.
    mixed puts each stream's pieces in random order, so that no step sees documents of one length only.
    """

    def __init__(self, docs: list[np.ndarray], n: int, start: int, piece: int | None = None, mixed: np.random.Generator | None = None) -> None:
        cuts = [(d, a, min(a + piece, len(x)) if piece else len(x)) for d, x in enumerate(docs) for a in range(0, len(x), piece or len(x))]
        size = np.array([b - a for _, a, b in cuts], np.int64)
        heap = [(0, i) for i in range(min(n, len(cuts)))]
        own: list[list[int]] = [[] for _ in heap]
        for c in np.argsort(-size, kind="stable").tolist():
            length, s = heapq.heappop(heap)
            own[s].append(c)
            heapq.heappush(heap, (length + int(size[c]), s))
        if mixed is not None:
            own = [mixed.permutation(o).tolist() for o in own]
        own.sort(key=lambda o: -int(size[o].sum()))
        every = [c for o in own for c in o]
        self.token = np.concatenate([docs[d][a:b] for d, a, b in (cuts[c] for c in every)]).astype(np.int32, copy=False)
        self.doc = np.repeat(np.array([cuts[c][0] for c in every], np.int32), size[every])
        self.length = np.array([int(size[o].sum()) for o in own], np.int64)  # descending
        self.first = np.cumsum(self.length) - self.length
        at = np.cumsum(size[every]) - size[every]
        self.fresh = np.zeros(len(self.token), bool)
        self.fresh[at] = True
        self.before = np.empty_like(self.token)
        self.before[1:] = self.token[:-1]
        self.before[at] = [start if a == 0 else docs[d][a - 1] for d, a, _ in (cuts[c] for c in every)]

    def windows(self, steps: int):
        """Places of the tokens of each window, (steps, streams that go on); and which are past a stream's end, or None."""
        for t in range(0, int(self.length[0]), steps):
            m = int(np.searchsorted(-self.length, -t))
            at = t + np.arange(min(steps, int(self.length[0]) - t))[:, None]
            i = self.first[:m] + at
            if self.length[m - 1] >= t + len(at):
                yield i, None
            else:
                past = at >= self.length[:m]
                yield np.where(past, 0, i), past


def score(p: dict, cut: np.ndarray, docs: list[np.ndarray]) -> np.ndarray:
    """Natural log-probability of each document (arrays of units, none empty), with the state carried through it."""
    total = np.zeros(len(docs))
    if not docs:
        return total
    streams, output, room, H = Streams(docs, SLOTS, len(p["emb"]) - 1), Output(p, cut), Room(), HIDDEN
    xw, wh = p["emb"] @ p["wx"] + p["bg"], p["wh"]
    h = np.zeros((len(streams.length), H), np.float32)
    with np.errstate(over="ignore"):
        for at, past in streams.windows(64):
            k, m = at.shape
            hs, h = room("hs", k, m, H), h[:m].copy()
            fresh, before = streams.fresh[at], streams.before[at]
            some = fresh.any(1).tolist()
            g, u, zr, c = room("g", m, 3 * H), room("u", m, 3 * H), room("zr", m, 2 * H), room("c", m, H)
            for s in range(k):
                if some[s]:
                    h[fresh[s]] = 0
                np.take(xw, before[s], 0, out=g, mode="clip")
                np.matmul(h, wh, out=u)
                np.add(g[:, : 2 * H], u[:, : 2 * H], out=zr)
                _sigmoid(zr)
                np.multiply(zr[:, H:], u[:, 2 * H :], out=c)
                c += g[:, 2 * H :]
                _tanh(c)
                h -= c
                h *= zr[:, :H]
                h += c
                hs[s] = h
            rows, i = hs.reshape(-1, H), at.ravel()
            if past is not None:
                use = ~past.ravel()
                rows, i = rows[use], i[use]
            total += np.bincount(streams.doc[i], output(rows, streams.token[i])[0], len(docs))
    return total


class Trainer:
    """Truncated backpropagation with Adam. Documents come in lots; the weights and moments go on."""

    def __init__(self, p: dict, cut: np.ndarray, rate: float = 1e-2) -> None:
        self.cut, self.rate, self.n, self.tokens = cut, rate, 0, 0
        # one vector each, seen by name through views
        self.w = flat(p)
        self.m, self.v, self.g, self.spare = (np.zeros_like(self.w) for _ in range(4))
        self.p, self.grad = _views(self.w, p), _views(self.g, p)
        self.output, self.room = Output(self.p, cut), Room()

    def learn(self, docs: list[np.ndarray]) -> None:
        """Every token of the documents. Documents over PIECE tokens are cut there, and the state starts anew at a cut."""
        at, done = 0, self.tokens
        for bound, n in (*WARM_UP, (float("inf"), STREAMS)):
            first = at
            while at < len(docs) and done < bound:
                done += len(docs[at])
                at += 1
            if at > first:
                self._learn(docs[first:at], n)

    def _learn(self, docs: list[np.ndarray], n: int) -> None:
        self.full = n * STEPS
        streams = Streams(docs, n, len(self.p["emb"]) - 1, PIECE, np.random.default_rng(len(docs)))
        h = np.zeros((len(streams.length), HIDDEN), np.float32)
        with np.errstate(over="ignore"):
            for at, past in streams.windows(STEPS):
                h = self._window(streams.token[at], streams.before[at].ravel(), streams.fresh[at], past, h[: at.shape[1]])

    def _window(self, x, before, fresh, past, h):
        p, grad, H, room, (k, m) = self.p, self.grad, HIDDEN, self.room, x.shape
        some, keep = fresh.any(1).tolist(), (~fresh).astype(np.float32)[:, :, None]
        e = np.take(p["emb"], before, 0, out=room("e", k * m, EMBED), mode="clip")
        g = np.matmul(e, p["wx"], out=room("g", k * m, 3 * H))
        g += p["bg"]
        g = g.reshape(k, m, 3 * H)
        h0, c, uc, hs, z, r = (room(n, k, m, H) for n in ("h0", "c", "uc", "hs", "z", "r"))
        u, zr, wh = room("u", m, 3 * H), room("zr", m, 2 * H), p["wh"]
        for s in range(k):
            np.multiply(h, keep[s], out=h0[s]) if some[s] else np.copyto(h0[s], h)
            np.matmul(h0[s], wh, out=u)
            np.add(g[s, :, : 2 * H], u[:, : 2 * H], out=zr)
            _sigmoid(zr)
            z[s], r[s], uc[s] = zr[:, :H], zr[:, H:], u[:, 2 * H :]
            np.multiply(r[s], uc[s], out=c[s])
            c[s] += g[s, :, 2 * H :]
            _tanh(c[s])
            h = hs[s]
            np.subtract(h0[s], c[s], out=h)
            h *= z[s]
            h += c[s]
        h = h.copy()
        n = k * m if past is None else int((~past).sum())
        self.g[:] = 0
        if past is None:
            dhs = self.output(hs.reshape(-1, H), x.ravel(), grad)[1].reshape(k, m, H)
        else:
            dhs = np.zeros_like(hs)
            dhs[~past] = self.output(hs[~past], x[~past], grad)[1]
        # gradients of the gates' inputs by the state's: z and r, and u's third part
        by_c, by_z, by_u, by_r, du, spare, dh = (room(n, *shape) for n, shape in (("by_c", (k, m, H)), ("by_z", (k, m, H)), ("by_u", (k, m, H)), ("by_r", (k, m, H)), ("du", (k, m, 3 * H)), ("spare", (m, H)), ("dhn", (m, H))))
        np.multiply(c, c, out=by_c)
        np.subtract(np.float32(1), by_c, out=by_c)
        np.subtract(np.float32(1), z, out=by_z)
        by_c *= by_z
        by_z *= z
        h_c = np.subtract(h0, c, out=c)
        by_z *= h_c
        np.multiply(by_c, r, out=by_u)
        np.subtract(np.float32(1), r, out=by_r)
        by_r *= uc
        by_r *= by_u
        back = np.ascontiguousarray(wh.T)
        dh[:] = 0
        for s in range(k - 1, -1, -1):
            d = dhs[s]
            d += dh
            np.multiply(d, by_z[s], out=du[s, :, :H])
            np.multiply(d, by_r[s], out=du[s, :, H : 2 * H])
            np.multiply(d, by_u[s], out=du[s, :, 2 * H :])
            np.matmul(du[s], back, out=dh)
            dh += np.multiply(d, z[s], out=spare)
            if some[s]:
                dh *= keep[s]
        flat_du = du.reshape(-1, 3 * H)
        grad["wh"] += h0.reshape(-1, H).T @ flat_du
        np.multiply(dhs, by_c, out=du[:, :, 2 * H :])
        grad["bg"] += self.output.ones(k * m) @ flat_du
        grad["wx"] += e.T @ flat_du
        by_row = np.matmul(p["wx"], flat_du.T, out=room("by_row", EMBED, k * m))
        for col, row in zip(grad["emb"].T, by_row, strict=True):
            col += np.bincount(before, row, len(col))
        self._step(n)
        return h

    def _step(self, n):
        self.n += 1
        self.tokens += n
        full = self.full  # windows that hold fewer tokens count for less
        g, m, v, x = self.g, self.m, self.v, self.spare
        size = float(np.sqrt(g @ g)) / full
        g *= np.float32(min(1.0, 1.0 / max(size, 1e-9)) / full)
        fix = np.sqrt(1 - 0.999**self.n) / (1 - 0.9**self.n)
        m *= np.float32(0.9)
        m += np.multiply(g, np.float32(0.1), out=x)
        v *= np.float32(0.999)
        np.multiply(g, g, out=x)
        x *= np.float32(0.001)
        v += x
        np.sqrt(v, out=x)
        x += np.float32(1e-5)  # a large floor: units that are hardly seen hardly move
        np.divide(m, x, out=x)
        x *= np.float32(self.rate * fix)
        self.w -= x
