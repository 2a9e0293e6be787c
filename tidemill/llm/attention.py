"""A small causal self-attention language model in numpy: gradients, fitting by Adam, and batched scoring.

Inputs are subword ids. One block: embedding plus position, one masked attention head and a residual give a hidden
state; from it come the probability of the next id's class (``CLASSES`` classes, the ``OWN_CLASS`` most frequent ids
being a class each) and, from the same state by weights of their own, that of the output within its class. The
``OUTPUTS`` most frequent ids are outputs; all rarer ids share ``BANDS`` further outputs, in which an id has its
share of the counts over all training texts. So every id has a positive probability and the probabilities of all ids
add up to 1. A text is scored over overlapping windows of ``WINDOW`` inputs; each window after the first scores only
its last ``STRIDE`` targets, so each target is scored once, with ``WINDOW - STRIDE`` inputs of context at least.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

WINDOW = 32
STRIDE = 24
DIM = 16
CLASSES = 96
OWN_CLASS = 64
OUTPUTS = 4096
BANDS = 16
BATCH = 32  # windows of a step
LIMIT = 60.0  # attention scores and logits are kept within this, so their exponentials are finite and positive


@dataclass
class Layout:
    """What the counts of ids decide: each id's output, each output's class, and an id's share of its output."""

    begin: int
    end: int
    to_output: np.ndarray  # id -> output; outputs stand in order of their class
    share: np.ndarray  # id -> natural log of its share of its output, 0 for an output of one id
    of_output: np.ndarray  # output -> class
    first: np.ndarray  # class -> its first output, and the number of outputs at the end
    total: np.ndarray  # output -> count


def layout(count: np.ndarray, begin: int, end: int) -> Layout:
    """The layout for the counts of all ids (the ends of texts included)."""
    ids = len(count)
    smooth = count + 0.1
    order = np.lexsort((np.arange(ids), -count))
    have = min(OUTPUTS, ids)
    to_output = np.empty(ids, dtype=np.int32)
    to_output[order[:have]] = np.arange(have)
    rare = smooth[order[have:]]
    if len(rare):
        band = np.minimum((np.cumsum(rare) / rare.sum() * BANDS).astype(np.int64), BANDS - 1)
        to_output[order[have:]] = have + np.unique(band, return_inverse=True)[1]
    total = np.bincount(to_output, weights=smooth)
    share = np.log(smooth / total[to_output])
    share[order[:have]] = 0.0
    # The outputs after the most frequent ones share the other classes, with like sums of the counts' square roots: that
    # keeps the mean number of outputs that a target is compared with low.
    of_output = np.minimum(np.arange(len(total)), OWN_CLASS)
    rest = np.sqrt(total[OWN_CLASS:])
    if len(rest):
        of_output[OWN_CLASS:] += np.minimum(((np.cumsum(rest) - rest / 2) / rest.sum() * (CLASSES - OWN_CLASS)).astype(np.int64), CLASSES - OWN_CLASS - 1)
    return Layout(begin, end, to_output, share, of_output.astype(np.int16), np.searchsorted(of_output, np.arange(CLASSES + 1)), total)


def untrained(of: Layout) -> dict[str, np.ndarray]:
    """The weights as a fit starts: random, but for biases that give each class and output its share of the counts."""
    random = np.random.default_rng(0)
    outputs = len(of.total)

    def normal(*shape: int) -> np.ndarray:
        return (random.standard_normal(shape) / np.sqrt(DIM)).astype(np.float32)

    mass = np.bincount(of.of_output, weights=of.total, minlength=CLASSES)
    top, low = normal(DIM + 1, CLASSES) * np.float32(0.1), normal(DIM + 1, outputs) * np.float32(0.1)
    top[DIM] = np.log((mass + 1e-3) / (mass + 1e-3).sum())
    low[DIM] = np.log(of.total / mass[of.of_output])
    weights = {name: normal(DIM, DIM) for name in ("query", "key", "value", "mix")}
    return {"embed": normal(outputs, DIM), "place": normal(WINDOW, DIM) * np.float32(0.1), **weights, "top": top, "low": low}


def flat(p: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """One array of zeros for all parameters p, and each parameter's view of it; an output's weights are next to each other."""
    every = np.zeros(sum(v.size for v in p.values()), dtype=p["query"].dtype)
    parts = np.split(every, np.cumsum([v.size for v in p.values()])[:-1])
    return every, {n: x.reshape(v.shape[::-1]).T if n == "low" else x.reshape(v.shape) for (n, v), x in zip(p.items(), parts)}


def laid_out(texts: list[np.ndarray], begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The inputs and targets of all texts, one after the other, and each text's number of them."""
    size = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    first = np.cumsum(size) - size
    flat = np.concatenate([x for t in texts for x in ([begin], t)] + [[begin]]).astype(np.int64)
    targets = flat[1:].copy()
    targets[first + size - 1] = end
    return flat[:-1], targets, size


def windows(of: Layout, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, use) of the windows that hold each target of the texts once, as outputs."""
    inputs, targets, size = laid_out(texts, of.begin, of.end)
    n = -(-size // WINDOW)
    shift = (np.cumsum(n) - n) * WINDOW - (np.cumsum(size) - size)
    at = np.arange(len(inputs)) + np.repeat(shift, size)
    out = [np.zeros(int(n.sum()) * WINDOW, dtype=t) for t in (np.int32, np.int32, bool)]
    out[0][at], out[1][at], out[2][at] = of.to_output[inputs], of.to_output[targets], True
    return tuple(x.reshape(-1, WINDOW) for x in out)


_SEEN = np.tril(np.ones((WINDOW, WINDOW), dtype=np.float32))


def _attend(q: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Masked attention weights of windows, not yet divided by their sums."""
    a = np.matmul(q, k.transpose(0, 2, 1))
    np.clip(a, -LIMIT, LIMIT, out=a)
    np.exp(a, out=a)
    a *= _SEEN
    return a


def _by_class(classes: np.ndarray, spans: list[tuple[int, int]]) -> list[tuple[int, int, np.ndarray]]:
    """(a, b, places) for each run [a, b) of classes that is among the targets' classes."""
    order = np.argsort(classes, kind="stable")
    cut = np.searchsorted(classes.take(order), np.arange(CLASSES + 1))
    return [(a, b, order[cut[a] : cut[b]]) for a, b in spans if cut[b] > cut[a]]


@lru_cache(maxsize=1)
def _cells(n: int, dim: int) -> np.ndarray:
    return np.arange(n * dim).reshape(n, dim)


def gradients(p: dict[str, np.ndarray], of: Layout, inputs: np.ndarray, targets: np.ndarray, use: np.ndarray, g: dict[str, np.ndarray] | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy in nats over the targets in use, and its gradient for each parameter.

    g: what an earlier call for such parameters gave, to be written over; the cross-entropy isn't worked out then (0).
    """
    b, dim = len(inputs), p["query"].shape[0]
    kind = p["query"].dtype
    again, g = g is not None, flat(p)[1] if g is None else g
    x = p["embed"].take(inputs, axis=0)
    x += p["place"]
    flat_x = x.reshape(-1, dim)
    joint = np.concatenate([p["query"], p["key"], p["value"]], axis=1)
    q, k, v = np.split((flat_x @ joint).reshape(b, WINDOW, 3 * dim), 3, axis=2)
    a = _attend(q, k)
    a *= (1 / (a.reshape(-1, WINDOW) @ np.ones(WINDOW, dtype=kind))).reshape(b, WINDOW, 1)
    c = np.matmul(a, v).reshape(-1, dim)
    h = flat_x + c @ p["mix"]
    own = np.flatnonzero(use.ravel())
    n = max(len(own), 1)
    # The targets in order of their classes, so that those of a class are next to each other.
    out = targets.ravel().take(own)
    order = np.argsort(of.of_output.take(out), kind="stable")
    own, out = own.take(order), out.take(order)
    classes = of.of_output.take(out)
    cut, first = np.searchsorted(classes, np.arange(CLASSES + 1)).tolist(), of.first.tolist()
    rows = np.ones((len(own), dim + 1), dtype=kind)  # the last column takes the bias
    rows[:, :dim] = h.take(own, axis=0)
    z = rows @ p["top"]
    np.clip(z, -LIMIT, LIMIT, out=z)
    np.exp(z, out=z)
    total = z @ np.ones(CLASSES, dtype=kind)
    place = np.arange(0, z.size, CLASSES) + classes
    picked = z.reshape(-1).take(place)
    loss = 0.0 if again else np.log(total).sum() - np.log(picked).sum()
    z.reshape(-1)[place] = picked - total  # divided by the sums, z then is the gradient of the cross-entropy at the logits
    z *= (1 / (total * kind.type(n)))[:, None]
    g["top"][:dim] = (z.T @ rows[:, :dim]).T
    np.matmul(np.ones(len(z), dtype=kind), z, out=g["top"][dim])
    d = z @ p["top"][:dim].T
    # Only the outputs of a target's own class compete for it: a block of targets by outputs for each class, all blocks one
    # after the other in one array, so that what isn't a product is done for all of them at once.
    low, g_low, inner = p["low"].T, g["low"].T, cut[OWN_CLASS]
    width = np.diff(of.first).take(classes[inner:])
    begins = np.cumsum(width) - width
    z = np.empty(int(width.sum()), dtype=kind)
    blocks, at = [], 0
    for own_class in range(OWN_CLASS, CLASSES):
        start, stop, lo, hi = cut[own_class], cut[own_class + 1], first[own_class], first[own_class + 1]
        if start < stop:
            block = z[at : at + (stop - start) * (hi - lo)].reshape(stop - start, hi - lo)
            np.dot(rows[start:stop], low[lo:hi].T, out=block)
            blocks.append((start, stop, lo, hi, block))
            at += block.size
        else:
            g_low[lo:hi] = 0
    if blocks:
        np.clip(z, -LIMIT, LIMIT, out=z)
        np.exp(z, out=z)
        total = np.add.reduceat(z, begins)
        place = begins + out[inner:] - of.first.take(classes[inner:])
        picked = z.take(place)
        if not again:
            loss += np.log(total).sum() - np.log(picked).sum()
        z[place] = picked - total
        z *= np.repeat(1 / (total * kind.type(n)), width)
        more = np.empty((len(out) - inner, dim + 1), dtype=kind)
        for start, stop, lo, hi, block in blocks:
            np.dot(block.T, rows[start:stop], out=g_low[lo:hi])
            np.dot(block, low[lo:hi], out=more[start - inner : stop - inner])
        d[inner:] += more[:, :dim]
    dh = np.zeros((b * WINDOW, dim), dtype=kind)
    dh[own] = d
    np.matmul(c.T, dh, out=g["mix"])
    dc = dh @ p["mix"].T
    through = np.einsum("ij,ij->i", dc, c).reshape(b, WINDOW, 1)
    dc = dc.reshape(b, WINDOW, dim)
    da = np.matmul(dc, v.transpose(0, 2, 1))
    dqkv = np.empty((b, WINDOW, 3 * dim), dtype=kind)
    np.matmul(a.transpose(0, 2, 1), dc, out=dqkv[:, :, 2 * dim :])
    da -= through
    da *= a
    np.matmul(da, k, out=dqkv[:, :, :dim])
    np.matmul(da.transpose(0, 2, 1), q, out=dqkv[:, :, dim : 2 * dim])
    dqkv = dqkv.reshape(-1, 3 * dim)
    g["query"][:], g["key"][:], g["value"][:] = np.split(flat_x.T @ dqkv, 3, axis=1)
    dx = dh + dqkv @ joint.T
    np.sum(dx.reshape(b, WINDOW, dim), axis=0, out=g["place"])
    cells = _cells(*p["embed"].shape).take(inputs, axis=0).ravel()
    g["embed"].reshape(-1)[:] = np.bincount(cells, weights=dx.ravel(), minlength=p["embed"].size)
    return float(loss) / n, g


class Adam:
    """Adam steps on an array p of parameters, in place, at a rate that the caller gives.

    ``first`` and ``second`` are the moments' sums without their constant factors, which the step takes in.
    """

    def __init__(self, p: np.ndarray):
        self.p, self.step = p, 0
        self.first, self.second, self.some = (np.zeros_like(p) for _ in range(3))

    def take(self, g: np.ndarray, rate: float) -> None:
        self.step += 1
        root = (0.01 / (1 - 0.99**self.step)) ** 0.5
        scale, least = np.float32(0.1 * rate / (1 - 0.9**self.step) / root), np.float32(1e-8 / root)
        first, second, some = self.first, self.second, self.some
        first *= np.float32(0.9)
        first += g
        second *= np.float32(0.99)
        second += np.multiply(g, g, out=some)
        np.sqrt(second, out=some)
        some += least
        np.divide(first, some, out=some)
        some *= scale
        self.p -= some


class Fit:
    """Weights that follow the texts they are shown, a step for each BATCH windows in a fixed shuffled order."""

    def __init__(self, p: dict[str, np.ndarray], of: Layout, rate: float, seed: int = 0):
        every, self.p = flat(p)
        for n, v in p.items():
            self.p[n][:] = v
        self.all_g, self.g = flat(p)
        self.of, self.rate, self.targets = of, rate, 0
        self.adam, self.random = Adam(every), np.random.default_rng(seed)

    def learn(self, texts: list[np.ndarray], every: int = 1) -> None:
        """One step for each BATCH windows drawn from the whole texts: one in ``every``, the first of each draw at random."""
        parts = windows(self.of, texts)
        order = np.arange(int(self.random.integers(every)) if len(parts[0]) >= every else 0, len(parts[0]), every)
        self.random.shuffle(order)
        for at in range(0, len(order), BATCH):
            inputs, targets, use = (x[order[at : at + BATCH]] for x in parts)
            n = int(use.sum())
            # A short batch is a weaker opinion, so its step is shorter; the first steps of a fit are short as well.
            warm = min(1.0, (self.adam.step + 1) / 10)
            gradients(self.p, self.of, inputs, targets, use, self.g)
            self.adam.take(self.all_g, self.rate * warm * min(1.0, n / (BATCH * WINDOW / 2)))
            self.targets += n


@dataclass
class Model:
    """A layout and weights, made ready for scoring."""

    of: Layout
    p: dict[str, np.ndarray]

    def log10_probabilities(self, texts: list[np.ndarray]) -> np.ndarray:
        """The log10 probability of each text (an array of ids), its end included."""
        of = self.of
        flat, target, size = laid_out(texts, of.begin, of.end)
        first = np.cumsum(size) - size
        inputs = np.append(of.to_output[flat], np.zeros(WINDOW, dtype=np.int32))
        outputs = np.append(of.to_output[target], np.zeros(WINDOW, dtype=np.int32))
        out = np.append(of.share[target], np.zeros(WINDOW))
        more = np.maximum(0, -(-(size - WINDOW) // STRIDE))  # windows after the first
        number = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
        later = np.repeat(first, more) + number * STRIDE
        end = first + size
        tables = self.tables()
        self._score(tables, inputs, outputs, out, first, end, 0)
        self._score(tables, inputs, outputs, out, later, np.repeat(end, more), WINDOW - STRIDE)
        return np.add.reduceat(out[: len(flat)], first) / np.log(10)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What scoring multiplies out once: each input's embedding, query, key and mixed value side by side, and the
        same of each place. A column of 0 beside the embedding and one of 1 beside the value let the attention's sum
        and the bias come out of the same products."""
        p = self.p
        parts = [np.eye(DIM, DIM + 1, dtype=np.float32), p["query"], p["key"], np.pad(p["value"] @ p["mix"], ((0, 0), (0, 1)))]
        joint = np.concatenate(parts, axis=1)
        of_input, of_place = p["embed"] @ joint, p["place"] @ joint
        of_place[:, -1] += 1
        return of_input, of_place

    def _score(self, tables: tuple[np.ndarray, np.ndarray], inputs: np.ndarray, outputs: np.ndarray, out: np.ndarray, start: np.ndarray, end: np.ndarray, lo: int) -> None:
        """Adds the log probabilities of the targets from place ``lo`` on of the windows at ``start`` to out, up to ``end``.

        Attention and classes are worked out for a few windows at once, which stay in a core's own cache; the outputs
        within classes for many, so that each class has a good number of them.
        """
        width = WINDOW - lo
        for at in range(0, len(start), MANY):
            grid = start[at : at + MANY, None] + np.arange(lo, WINDOW)
            which = outputs.take(grid).ravel()
            classes = self.of.of_output.take(which)
            rows = np.empty((len(which), DIM + 1), dtype=np.float32)
            logs = np.empty(len(which), dtype=np.float32)
            for i in range(0, len(grid), FEW):
                few = slice(i * width, (i + FEW) * width)
                seen = inputs.take(start[at + i : at + min(i + FEW, len(grid)), None] + np.arange(WINDOW))
                rows[few] = _hidden(tables, seen, lo)
                logs[few] = _picked(rows[few], self.p["top"], classes[few])
            for i, _, own in _by_class(classes, [(i, i + 1) for i in range(OWN_CLASS, CLASSES)]):
                a, b = self.of.first[i], self.of.first[i + 1]
                if b - a > 1:
                    logs[own] += _picked(rows.take(own, axis=0), self.p["low"][:, a:b], which.take(own) - a)
            use = (grid < end[at : at + MANY, None]).ravel()
            out[grid.ravel()[use]] += logs[use]


#: Windows whose attention is worked out at once in scoring, and windows whose targets are looked up by class at once.
FEW = 64
MANY = 3072


def _hidden(tables: tuple[np.ndarray, np.ndarray], inputs: np.ndarray, lo: int) -> np.ndarray:
    """The hidden states, with a last column of 1, at the places from ``lo`` on of windows of inputs.

    The first half of the places sees the first half only, so it is multiplied with that alone.
    """
    of_input, of_place = tables
    joint = of_input.take(inputs, axis=0)
    joint += of_place
    x, q, k, v = np.split(joint, [DIM + 1, 2 * DIM + 1, 3 * DIM + 1], axis=2)
    out = np.empty((len(inputs), WINDOW - lo, DIM + 1), dtype=joint.dtype)
    half = WINDOW // 2
    for a, b in ((lo, half), (half, WINDOW)):
        w = np.matmul(q[:, a:b], k[:, :b].transpose(0, 2, 1))
        np.clip(w, -LIMIT, LIMIT, out=w)
        np.exp(w, out=w)
        w *= _SEEN[a:b, :b]
        np.matmul(w, v[:, :b], out=out[:, a - lo : b - lo])
    out /= out[:, :, -1:].copy()
    out += x[:, lo:]
    return out.reshape(-1, DIM + 1)


def _picked(rows: np.ndarray, weights: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The log softmax of rows @ weights at the columns ``which``."""
    z = rows @ weights
    np.clip(z, -LIMIT, LIMIT, out=z)
    got = z.ravel().take(np.arange(0, z.size, z.shape[1]) + which)
    np.exp(z, out=z)
    return got - np.log(z @ np.ones(z.shape[1], dtype=z.dtype))
