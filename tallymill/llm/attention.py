"""A small causal self-attention model over subword ids, in numpy.

One head over embedded ids and places, and a residual. An id's embedding is that of its class and
one of its own (a row of ``table``, zero until it is trained); where no classes are given (``of``), a token is
its own class. A head's scores depend on the
product of its query and key matrices alone, and its output on that of its value and output
matrices, so each product is one square matrix: ``q`` and ``v``. What
follows a token is told in two steps, whether a word starts, and which class it is of
among those that start words (below ``STARTS``) or among the others; each step has a softmax
of its own, so a target needs only its own half. Which id of the class it is, :class:`Head` tells from the
same state. A table of the same log probabilities
given the previous class, counted over the corpus, is added to the outputs, so that attention
learns what the previous token alone does not say. Windows of ``LENGTH`` tokens advance by
``STRIDE``; each token is scored in exactly one window, with the overlap as context, and all
windows of a batch go through one masked attention. Training windows don't overlap: each of
their tokens is told, from what precedes it in the window.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

LENGTH, STRIDE, WIDTH, CLASSES, STARTS = 16, 12, 8, 64, 32
OVERLAP = LENGTH - STRIDE
SINGLE, SHARED, PART = 24, 8, 4_096  # of a class: ids told apart at once, groups of the others; tokens a product
ROW_RATE, HEAD_RATE, PRIOR = 0.2, 0.2, 50.0  # rows of ids: a row that few tokens touch stays near zero
MOST = 60  # of a logit; larger ones are clamped
_TOP = float(np.exp(MOST))

_SHAPES = {"embed": (CLASSES, WIDTH), "place": (LENGTH, WIDTH), "q": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "out": (WIDTH, CLASSES + 1)}
_CAUSAL = np.where(np.arange(LENGTH)[None, :] <= np.arange(LENGTH)[:, None], 0, -1e9).astype(np.float32)
_SIDES = (slice(0, STARTS), slice(STARTS, CLASSES))


def windows(tokens: np.ndarray, first: int, sizes: np.ndarray | None = None, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, live) of documents that lie one after the other; ``first`` stands before the first token of each.

    ``sizes`` are the documents' lengths (default: one document). Inputs are (windows, LENGTH),
    targets and live (windows, LENGTH - overlap): the tokens a window tells, and whether each is a
    token of the document. Places without a token hold -1.
    """
    sizes, stride = np.array([len(tokens)]) if sizes is None else sizes, LENGTH - overlap
    counts = -(-sizes // stride)
    room = overlap + 1 + counts * stride
    base = np.cumsum(room) - room
    padded = np.full(int(room.sum()), -1, dtype=np.int32)
    padded[base + overlap] = first
    ends = np.cumsum(sizes)
    padded[np.repeat(base + overlap + 1 - ends + sizes, sizes) + np.arange(len(tokens))] = tokens
    before = np.cumsum(counts) - counts
    at = (np.repeat(base - before * stride, counts) + np.arange(int(counts.sum())) * stride)[:, None]
    targets = padded[at + np.arange(overlap + 1, LENGTH + 1)]
    return padded[at + np.arange(LENGTH)], targets, targets >= 0


def start(seed: int = 0) -> dict[str, np.ndarray]:
    """Seeded first weights; the output layer starts at zero, so training starts at the bigrams."""
    rng = np.random.default_rng(seed)
    return {k: (np.zeros(s) if k == "out" else rng.normal(0, 0.3 if k in ("embed", "place") else WIDTH**-0.5, s)).astype(np.float32) for k, s in _SHAPES.items()}


def parts(bigram: np.ndarray) -> np.ndarray:
    """Log probabilities of classes after classes, as those of each half and, last, the log odds that a word starts."""
    with np.errstate(divide="ignore"):
        halves = [np.log(np.exp(bigram[:, s].astype(np.float64)).sum(1, keepdims=True)) for s in _SIDES]
    return np.concatenate([bigram[:, s] - half for s, half in zip(_SIDES, halves)] + [halves[0] - halves[1]], axis=1).astype(bigram.dtype)


def flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in _SHAPES])


def views(values: np.ndarray) -> dict[str, np.ndarray]:
    """The weights as views of one array."""
    out, at = {}, 0
    for k, s in _SHAPES.items():
        n = int(np.prod(s))
        out[k] = values[at : at + n].reshape(s)
        at += n
    return out


def unflat(values: np.ndarray) -> dict[str, np.ndarray]:
    return views(np.array(values, dtype=np.float32))


@lru_cache(64)
def _ones(n: int, dtype: str) -> np.ndarray:
    return np.ones(n, dtype=dtype)


def _sums(rows: np.ndarray) -> np.ndarray:
    """Sums over the last axis, of all rows in a row; a product with ones is faster than a sum."""
    return rows.reshape(-1, rows.shape[-1]) @ _ones(rows.shape[-1], rows.dtype.char)


def _wide(column: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """A column repeated over a row's width, which is faster than to broadcast it."""
    return np.repeat(column, width).reshape(-1, width)


def _exp(logits, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(exponentials of ``logits()``, their sums over the last axis, the chosen logits).

    Logits are clamped at ``MOST``, for which they are made anew where a sum shows that one may be above it.
    """
    for clamped in (False, True):
        z = logits()
        if clamped:
            np.minimum(z, MOST, out=z)
        told = None if chosen is None else np.take(z, chosen)
        with np.errstate(over="ignore"):
            np.exp(z, out=z)
            total = _sums(z)
        if float(total.max(initial=0)) < _TOP:
            break
    return z, total, told


def _mask(scores: np.ndarray, inputs: np.ndarray) -> None:
    """Hide later places, and places before a text's start; those after its end only precede places that don't count."""
    overlap = LENGTH - scores.shape[1]
    scores += _CAUSAL[overlap:]
    early = np.flatnonzero(inputs[:, 0] < 0) if overlap else ()
    if len(early):
        hidden = inputs[early] < 0
        hidden[:, overlap:] = False
        scores[early] += np.where(hidden, np.float32(-1e9), np.float32(0))[:, None, :]


def forward(w: dict[str, np.ndarray], bigram: np.ndarray, inputs: np.ndarray, overlap: int = OVERLAP) -> np.ndarray:
    """Log probabilities (windows, LENGTH - overlap, CLASSES) of the classes after each told place, written plainly; ``bigram`` is of :func:`parts`."""
    own = np.maximum(inputs, 0)
    x = w["embed"][own] + w["place"]
    tail = x[:, overlap:]
    s = (tail @ w["q"]) @ x.transpose(0, 2, 1) * WIDTH**-0.5
    _mask(s, inputs)
    a = np.exp(np.minimum(s, MOST))
    z = (tail + (a / a.sum(-1, keepdims=True)) @ x @ w["v"]) @ w["out"] + bigram[own[:, overlap:]]
    odds = z[..., -1:]
    sides = [z[..., s] - np.log(np.exp(z[..., s]).sum(-1, keepdims=True)) for s in _SIDES]
    return np.concatenate([sides[0] - np.logaddexp(0, -odds), sides[1] - np.logaddexp(0, odds)], axis=-1)


def _summed(rows: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sums of runs of rows, from each of ``firsts`` to the next."""
    pairs = rows.view(np.result_type(rows.dtype, np.complex64))  # two numbers at once
    return np.add.reduceat(pairs, firsts).view(rows.dtype)


def ranked(of: np.ndarray) -> np.ndarray:
    """Places of ids in order of their classes."""
    out = np.empty(len(of), dtype=np.uint16)
    out[np.argsort(of, kind="stable")] = np.arange(len(of))
    return out


class Layout:
    """Where the tokens of a batch of windows lie: all that :func:`gradients` needs to know of them beside the weights."""

    __slots__ = ("n", "stride", "inputs", "ids", "own", "order", "first", "before", "chosen", "place", "by_id", "firsts", "tokens", "class_firsts", "classes")


def layouts(inputs: np.ndarray, targets: np.ndarray, live: np.ndarray, batch: int, of: np.ndarray | None = None, rank: np.ndarray | None = None) -> list[Layout]:
    """The layouts of all batches of ``batch`` windows, made at once: the weights change between batches, the tokens don't.

    Live targets are put in order of their halves, those that start words first, and inputs in order of their ids
    (``rank`` is :func:`ranked` of the classes ``of``) or classes.
    """
    (windows, stride), overlap = targets.shape, LENGTH - targets.shape[1]
    if not windows:
        return []
    many = -(-windows // batch)
    ids = np.maximum(inputs, 0).astype(np.intp)
    own = ids if of is None else np.take(of, ids)
    after = (targets if of is None else np.take(of, targets)).ravel()
    small = np.uint8 if many < 128 else np.uint32
    edges = np.minimum(np.arange(many + 1) * batch, windows)  # in windows
    at = np.flatnonzero(live.ravel())
    side = after[at] >= STARTS
    key = (at // (stride * batch)).astype(small) * small(2) + side
    order = at[np.argsort(key, kind="stable")]
    bounds = np.append(0, np.cumsum(np.bincount(key, minlength=2 * many)))  # of each batch's halves
    sizes = np.diff(bounds)
    before = (own[:, overlap:] if overlap else own).ravel()[order]
    widths, lows = [s.stop - s.start for s in _SIDES], [s.start for s in _SIDES]
    chosen = np.arange(len(order)) - np.repeat(bounds[:-1], sizes)
    chosen *= np.repeat(np.tile(widths, many), sizes)
    chosen += after[order] - np.repeat(np.tile(lows, many), sizes)
    lives = sizes[::2] + sizes[1::2]
    place = np.repeat(lives, np.diff(edges) * stride)  # the dead
    place[order] = np.arange(len(order)) - np.repeat(bounds[:-1:2], lives)
    flat_ids = ids.ravel()
    # two passes over small keys
    by_id = np.argsort(own.ravel().astype(np.uint8) if of is None else np.take(ranked(of[:-1]) if rank is None else rank, flat_ids), kind="stable")
    batch_of = (by_id // (LENGTH * batch)).astype(small)
    by_id = by_id[np.argsort(batch_of, kind="stable")]
    starts = edges * LENGTH
    sorted_ids = flat_ids[by_id]
    changes = np.concatenate([[True], sorted_ids[1:] != sorted_ids[:-1]])
    changes[starts[:-1]] = True
    firsts = np.flatnonzero(changes)
    tokens, runs = sorted_ids[firsts], np.searchsorted(firsts, starts)
    classes = tokens if of is None else np.take(of, tokens)
    changes = np.concatenate([[True], classes[1:] != classes[:-1]])
    changes[runs[:-1]] = True
    class_firsts = np.flatnonzero(changes)
    class_runs = np.searchsorted(class_firsts, runs)
    out = []
    for i in range(many):
        l, w, k, r, c = Layout(), slice(edges[i], edges[i + 1]), slice(bounds[2 * i], bounds[2 * i + 2]), slice(runs[i], runs[i + 1]), slice(class_runs[i], class_runs[i + 1])
        l.n, l.stride, l.inputs, l.ids, l.own, l.first = int(edges[i + 1] - edges[i]), stride, inputs[w], ids[w], own[w], int(sizes[2 * i])
        l.order, l.before, l.chosen = order[k] - edges[i] * stride, before[k], chosen[k]
        l.place, l.by_id = place[edges[i] * stride : edges[i + 1] * stride], by_id[starts[i] : starts[i + 1]] - starts[i]
        l.firsts, l.tokens = firsts[r] - starts[i], tokens[r]
        l.class_firsts, l.classes = class_firsts[c] - runs[i], classes[class_firsts[c]]
        out.append(l)
    return out


def gradients(
    w: dict[str, np.ndarray], bigram: np.ndarray, inputs: np.ndarray, targets: np.ndarray, live: np.ndarray, measure: bool = True,
    of: np.ndarray | None = None, table: np.ndarray | None = None, rank: np.ndarray | None = None,
) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over the live targets' classes (if to be measured) and its gradients.

    With ``of`` (the ids' classes, and -1 for the id -1) tokens are ids, and the gradients hold ``rows``, the ids
    that occur and the gradients of their rows of ``table``; ``rank`` is :func:`ranked` of the classes. ``state`` is
    what the outputs are told from.
    """
    return laid_gradients(w, bigram, layouts(inputs, targets, live, len(inputs), of, rank)[0], measure, table)


def laid_gradients(w: dict[str, np.ndarray], bigram: np.ndarray, l: Layout, measure: bool = True, table: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """:func:`gradients` of a batch whose layout is made.

    All softmaxes but the first step's stay unnormalised: their sums scale the narrow (WIDTH) sides of the
    products, not the wide ones, and in attention the sum over places in its derivative is the product
    of two narrow rows. What follows the state is done on live targets alone, those that start words first.
    """
    n, stride, order, first, before = l.n, l.stride, l.order, l.first, l.before
    rows, overlap = n * stride, LENGTH - stride
    x = np.take(w["embed"], l.own, axis=0)
    x += w["place"]
    if table is not None:
        x += np.take(table, l.ids, axis=0)
    across = x.transpose(0, 2, 1)
    tail = np.ascontiguousarray(x[:, overlap:]).reshape(rows, WIDTH)
    scale = w["q"] * WIDTH**-0.5
    q = (tail @ scale).reshape(n, stride, WIDTH)

    def scores() -> np.ndarray:
        e = q @ across
        _mask(e, l.inputs)
        return e

    e, total, _ = _exp(scores)
    r = np.reciprocal(total)
    r_wide = _wide(r)
    c = (e @ x).reshape(rows, WIDTH)
    c *= r_wide
    state = c @ w["v"]
    state += tail
    o = np.take(state, order, axis=0)
    many = max(1, len(order))
    loss, g_out, turn = 0.0, np.zeros_like(w["out"]), w["out"][:, -1]
    miss = o @ turn
    miss += np.take(bigram[:, -1], before)
    np.clip(miss, -MOST, MOST, out=miss)
    np.negative(miss, out=miss)
    np.exp(miss, out=miss)
    miss += 1
    np.reciprocal(miss, out=miss)
    miss[:first] -= 1
    if measure:
        loss -= float(np.log1p(-np.abs(miss) * (1 - 1e-7)).sum())
    miss /= many
    g_out[:, -1] = miss @ o
    told = np.zeros((len(order) + 1, WIDTH), dtype=o.dtype)  # and a row for the dead
    for part, side in ((slice(0, first), _SIDES[0]), (slice(first, len(order)), _SIDES[1])):
        h, b, weights, logs = o[part], before[part], np.ascontiguousarray(w["out"][:, side]), np.ascontiguousarray(bigram[:, side])

        def logits(h=h, b=b, weights=weights, logs=logs) -> np.ndarray:
            z = h @ weights
            z += np.take(logs, b, axis=0)
            return z

        z, total, _ = _exp(logits)
        chosen = l.chosen[part]
        flat_z = z.ravel()
        mine = np.take(flat_z, chosen)
        if measure:
            loss -= float(np.log(mine / total + 1e-30).sum())
        mine -= total
        flat_z[chosen] = mine
        total *= many
        scaled = _wide(np.reciprocal(total))
        g_out[:, side] = (z.T @ (h * scaled)).T
        back = told[: len(order)][part]
        np.matmul(z, np.ascontiguousarray(weights.T), out=back)
        back *= scaled
    told[: len(order)] += _wide(miss) @ np.diag(turn)
    do = np.take(told, l.place, axis=0)
    g = {"out": g_out, "v": c.T @ do, "state": state}
    dc = do @ w["v"].T
    dot = _wide(_sums(dc * c) * r, LENGTH).reshape(n, stride, LENGTH)
    dc *= r_wide
    sides = np.empty((n, 2 * stride, WIDTH), dtype=x.dtype)
    sides[:, stride:] = q
    sides[:, :stride] = dc.reshape(n, stride, WIDTH)
    ds = sides[:, :stride] @ across
    ds -= dot
    both = np.empty((n, 2 * stride, LENGTH), dtype=x.dtype)  # of each window, attention and the derivative of its scores
    both[:, :stride] = e
    np.multiply(ds, e, out=both[:, stride:])
    dq = (both[:, stride:] @ x).reshape(rows, WIDTH)
    dx = both.transpose(0, 2, 1) @ sides
    do += dq @ scale.T
    dx[:, overlap:] += do.reshape(n, stride, WIDTH)
    g["q"], g["place"] = tail.T @ dq * WIDTH**-0.5, (_ones(n, dx.dtype.char) @ dx.reshape(n, -1)).reshape(LENGTH, WIDTH)
    g["embed"], dx = np.zeros_like(w["embed"]), dx.reshape(-1, WIDTH)
    sums = _summed(np.take(dx, l.by_id, axis=0), l.firsts)
    if table is not None:
        g["rows"], sums = (l.tokens, sums), _summed(sums, l.class_firsts)
    g["embed"][l.classes] = sums
    return loss / many, g


class Head:
    """Which id of its class a token is, given the model's state and the class before it.

    A softmax in two steps, so that no token needs all ids of its class: the most frequent ids of a class and
    ``SHARED`` groups of the others, then an id of the group. A child's logit is its log share of its node given
    the class before, counted over the corpus, plus the product of the state and the child's row of
    weights, which start at zero.
    """

    def __init__(self, of: np.ndarray, counts: np.ndarray, share: np.ndarray):
        """``share``: log shares (ids, classes before) of ids in their classes."""
        self.node, self.child = np.full((2, len(of)), -1, dtype=np.int16), np.zeros((2, len(of)), dtype=np.int16)
        self.bias = [None] * CLASSES
        for c in range(CLASSES):
            own = np.flatnonzero(of == c)
            own = own[np.argsort(-counts[own], kind="stable")]
            alone = own[: SINGLE if len(own) > SINGLE + SHARED else len(own)]
            groups, rest = [own[i : i + 1] for i in range(len(alone))], own[len(alone) :]
            if len(rest):  # sizes double: the more frequent an id, the smaller its group
                bounds = np.ceil(len(rest) * (2.0 ** np.arange(SHARED + 1) - 1) / (2**SHARED - 1)).astype(np.int64)
                groups += [rest[a:b] for a, b in zip(bounds, bounds[1:]) if b > a]
            logs = []
            for k, group in enumerate(groups):
                self.child[0, group] = k
                logs.append(share[group[0]] if len(group) == 1 else np.log(np.exp(share[group]).sum(0)))
                if len(group) > 1:
                    self.node[1, group], self.child[1, group] = len(self.bias), np.arange(len(group))
                    self.bias.append(np.ascontiguousarray((share[group] - logs[-1]).T, dtype=np.float32))
            if len(groups) > 1:
                self.node[0, own] = c
                self.bias[c] = np.ascontiguousarray(np.array(logs).T, dtype=np.float32)
        self.first = np.append(0, np.cumsum([0 if b is None else b.shape[1] for b in self.bias]))
        self.weights = np.zeros((int(self.first[-1]), WIDTH), dtype=np.float32)

    def log_probabilities(self, state: np.ndarray, ids: np.ndarray, before: np.ndarray, step=None) -> np.ndarray:
        """Natural log probability of each id in its class; or ``step`` gets each node's rows and their gradients, summed over the tokens."""
        out = np.zeros(len(ids), dtype=np.float32)
        for level in (0, 1):
            node = np.take(self.node[level], ids)
            order = np.flatnonzero(node >= 0)
            node = np.take(node, order)
            if level == 0:
                node = node.astype(np.uint8)  # classes: sorted in one pass
            by_node = np.argsort(node, kind="stable")
            order, node = np.take(order, by_node), np.take(node, by_node)
            h, b, child = np.take(state, order, axis=0), np.take(before, order), np.take(self.child[level], np.take(ids, order))
            bounds = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1], [True]])) if len(node) else np.zeros(1, np.int64)
            logs = np.empty(len(order) if step is None else 0, dtype=np.float32)
            for a, e in zip(bounds.tolist(), bounds[1:].tolist()):
                k = int(node[a])
                f, l = int(self.first[k]), int(self.first[k + 1])
                weights, row = np.ascontiguousarray(self.weights[f:l].T), np.arange(min(PART, e - a)) * (l - f)
                for a in range(a, e, PART):
                    part = slice(a, min(e, a + PART))
                    own, places = h[part], b[part]

                    def logits(own=own, places=places, weights=weights, bias=self.bias[k]) -> np.ndarray:
                        z = own @ weights
                        z += np.take(bias, places, axis=0)
                        return z

                    chosen = row[: len(own)] + child[part]
                    if step is None:
                        _, total, logs[part] = _exp(logits, chosen)
                        logs[part] -= np.log(total)
                        continue
                    z, total, _ = _exp(logits)
                    z.ravel()[chosen] -= total
                    step(f, l, z.T @ (own * _wide(np.reciprocal(total))), len(z))
            if step is None:
                out[order] += logs
        return out


class Trainer:
    """Adam over batches of windows; Adagrad for the rows of ids and of a :class:`Head`, which few tokens of a batch touch."""

    def __init__(self, weights: dict[str, np.ndarray], bigram: np.ndarray, rate: float = 0.02, batch: int = 160, of: np.ndarray | None = None, table: np.ndarray | None = None, head: Head | None = None):
        self.values, self.bigram, self.rate, self.batch = flat(weights), bigram, rate, batch
        self.w = views(self.values)
        self.m, self.v = np.zeros_like(self.values), np.zeros_like(self.values)
        self.steps, self.seen = 0, 0
        self.of, self.head = None if of is None else np.append(of, -1), head
        if of is not None:
            self.rank = ranked(of)
            self.table, self.square, self.met = table.copy(), np.zeros(len(table), dtype=np.float32), np.zeros(len(table))
            head.weights = head.weights.copy()
            self.head_square, self.head_met = np.zeros(len(head.weights), dtype=np.float32), np.zeros(len(head.weights))

    def learn(self, inputs: np.ndarray, targets: np.ndarray, live: np.ndarray) -> None:
        states = []
        for laid in layouts(inputs, targets, live, self.batch, self.of, None if self.of is None else self.rank):
            g = laid_gradients(self.w, self.bigram, laid, False, None if self.of is None else self.table)[1]
            step = flat(g)
            many = len(laid.order)
            self.steps, self.seen = self.steps + 1, self.seen + many
            self.m += 0.1 * (step - self.m)
            self.v += 0.01 * (step * step - self.v)
            self.values -= self.rate / (1 - 0.9**self.steps) * self.m / (np.sqrt(self.v / (1 - 0.99**self.steps)) + 1e-8)
            if self.of is not None:
                states.append(g["state"])
                ids, rows = g["rows"]
                rows *= many  # sums over the tokens, of which an id has few
                square = self.square[ids] + _sums(rows * rows)
                self.square[ids] = square
                rows *= _wide(ROW_RATE / np.sqrt(square + PRIOR))
                self.table[ids] = np.take(self.table, ids, axis=0) - rows
        if self.of is not None and len(inputs):
            self.met += np.bincount(inputs[inputs >= 0], minlength=len(self.met))
            at = np.flatnonzero(live)
            self.head.log_probabilities(np.take(np.concatenate(states), at, axis=0), np.take(targets, at), np.take(self.of, np.take(inputs, at)), self._head_step)

    def _head_step(self, f: int, l: int, g: np.ndarray, many: int) -> None:
        self.head_met[f:l] += many
        self.head_square[f:l] += _sums(g * g)
        self.head.weights[f:l] -= (HEAD_RATE / np.sqrt(self.head_square[f:l] + PRIOR))[:, None] * g


class Tables:
    """The model for scoring alone: ``table`` holds the whole embeddings of ids (or classes)."""

    def __init__(self, w: dict[str, np.ndarray], bigram: np.ndarray, of: np.ndarray | None = None, table: np.ndarray | None = None):
        self.of = np.append(np.arange(CLASSES), -1) if of is None else np.append(of, -1)
        self.x = w["embed"] if table is None else w["embed"][of] + table
        self.place, self.q, self.v = w["place"], (w["q"] * WIDTH**-0.5).astype(np.float32), w["v"]
        self.out, self.bigram = [np.ascontiguousarray(w["out"][:, s]) for s in _SIDES], [np.ascontiguousarray(bigram[:, s]) for s in _SIDES]
        self.turn, self.odds = np.ascontiguousarray(w["out"][:, -1]), np.ascontiguousarray(bigram[:, -1])

    def log_probabilities(self, inputs: np.ndarray, targets: np.ndarray, live: np.ndarray, chunk: int = 448) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(natural log probabilities of the live targets' classes, those of starting a word or not as they do, states), in order."""
        out, turns, state = np.empty(targets.shape, dtype=np.float32), np.empty(targets.shape, dtype=np.float32), np.empty((*targets.shape, WIDTH), dtype=np.float32)
        for i in range(0, len(inputs), chunk):
            out[i : i + chunk], turns[i : i + chunk], state[i : i + chunk] = self._chunk(inputs[i : i + chunk], targets[i : i + chunk])
        at = np.flatnonzero(live)
        return np.take(out, at), np.take(turns, at), np.take(state.reshape(-1, WIDTH), at, axis=0)

    def _chunk(self, inputs: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, ids = len(inputs), np.maximum(inputs, 0)
        x = np.take(self.x, ids, axis=0)
        x += self.place
        tail = np.ascontiguousarray(x[:, OVERLAP:]).reshape(-1, WIDTH)
        q, across = (tail @ self.q).reshape(n, -1, WIDTH), x.transpose(0, 2, 1)

        def scores() -> np.ndarray:
            s = q @ across
            _mask(s, inputs)
            return s

        s, total, _ = _exp(scores)
        h = (s @ x).reshape(-1, WIDTH)
        h *= _wide(np.reciprocal(total))
        h = h @ self.v
        h += tail
        before, after = np.take(self.of, ids[:, OVERLAP:]).ravel(), np.take(self.of, targets).ravel()
        odds = np.take(self.odds, before) + h @ self.turn
        out = np.zeros(len(h), dtype=np.float32)
        starts = after < STARTS
        for side, at, weights, bigram in zip(_SIDES, (np.flatnonzero(starts & (after >= 0)), np.flatnonzero(~starts)), self.out, self.bigram):
            own, places = np.take(h, at, axis=0), np.take(before, at)

            def logits(own=own, places=places, weights=weights, bigram=bigram) -> np.ndarray:
                z = own @ weights
                z += np.take(bigram, places, axis=0)
                return z

            chosen = np.arange(-side.start, len(at) * weights.shape[1] - side.start, weights.shape[1]) + np.take(after, at)
            _, total, told = _exp(logits, chosen)
            out[at] = told - np.log(total)
        miss = np.where(starts, -odds, odds)
        np.minimum(miss, MOST, out=miss)
        np.exp(miss, out=miss)
        miss += 1
        turns = -np.log(miss)
        out += turns
        return out.reshape(n, STRIDE), turns.reshape(n, STRIDE), h.reshape(n, STRIDE, WIDTH)


def log_probabilities(w: dict[str, np.ndarray], bigram: np.ndarray, inputs: np.ndarray, targets: np.ndarray, live: np.ndarray) -> np.ndarray:
    return Tables(w, bigram).log_probabilities(inputs, targets, live)[0].astype(np.float64)
