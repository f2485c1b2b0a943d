"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation, Adam."""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]
EMBED, HIDDEN, PER_CLASS = 16, 24, 32  # classes grow with the vocabulary, from PER_CLASS tokens on
CELLS = 1 << 17  # probabilities that are held at once, about: what a core's cache holds
ROWS = 1 << 16  # states that are scored together, about
SIDE = 1024  # documents that are scored side by side
SMALL = 1 << 16  # up to so many tokens their input parts are worked out once


def new(counts: np.ndarray, seed: int = 7) -> Params:
    """Parameters for tokens of these counts, most frequent first; the biases give the tokens' own frequencies."""
    rng = np.random.default_rng(seed)
    per = max(PER_CLASS, int(np.sqrt(len(counts))))
    classes = -(-len(counts) // per)
    share = np.full(classes * per, 1e-9)
    share[: len(counts)] = (counts + 1) / (counts + 1).sum()
    share = share.reshape(classes, per)
    draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    word = np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32)
    return {
        "embed": draw(len(counts), EMBED), "wx": draw(EMBED, 3 * HIDDEN), "wh": draw(HIDDEN, 3 * HIDDEN), "b": np.zeros(3 * HIDDEN, np.float32),
        "wc": np.zeros((HIDDEN, classes), np.float32), "bc": np.log(share.sum(axis=1)).astype(np.float32), "ww": np.zeros((classes, HIDDEN, per), np.float32), "bw": word,
    }


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def step(p: Params, gx: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """The next state, with what its derivative needs: update and reset gates, candidate, recurrent part of the candidate."""
    gh = h @ p["wh"]
    zr = sigmoid(gx[:, : 2 * HIDDEN] + gh[:, : 2 * HIDDEN])
    z, r, un = zr[:, :HIDDEN], zr[:, HIDDEN:], gh[:, 2 * HIDDEN :]
    n = r * un
    n += gx[:, 2 * HIDDEN :]
    np.tanh(n, out=n)
    new = h - n
    new *= z
    new += n
    return new, z, r, n, un


def segments(targets: np.ndarray, per: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order that sorts targets by class, and (class, begin, end) of each class in it."""
    own = targets // per
    order = np.argsort(own, kind="stable")
    values, starts = np.unique(own[order], return_index=True)
    return order, list(zip(values.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True))


def exponentials(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """exp(x) of rows, less their largest values where they would overflow; the sums; the logarithms of the sums of exp(x)."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        e = np.exp(x)
        total = e @ np.ones(x.shape[1], x.dtype)
        log = np.log(total)
    if np.isfinite(log).all():
        return e, total, log
    most = x.max(axis=1)
    e = np.exp(x - most[:, None])
    total = e.sum(axis=1)
    return e, total, np.log(total) + most


def with_bias(weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The weights and, below them, the bias: what rows that end in a one are multiplied by."""
    return np.concatenate([weights, bias[..., None, :]], axis=-2)


def with_ones(rows: np.ndarray) -> np.ndarray:
    out = np.ones((len(rows), rows.shape[1] + 1), rows.dtype)
    out[:, :-1] = rows
    return out


def blocks(begin: int, end: int, width: int) -> list[tuple[int, int]]:
    """Ranges of rows of this width that hold CELLS together, about."""
    most = max(64, CELLS // width)
    return [(i, min(i + most, end)) for i in range(begin, end, most)]


def log_probs(p: Params, h: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural logarithms of the targets' probabilities after states h: of the class, and of the token in its class."""
    per = p["ww"].shape[2]
    order, parts = segments(targets, per)
    own, ys, at = with_ones(h[order]), targets[order], np.arange(len(h))
    part, places, classes, words = np.empty(len(own), h.dtype), ys % per, with_bias(p["wc"], p["bc"]), with_bias(p["ww"], p["bw"])
    for i, j in blocks(0, len(own), len(p["bc"])):
        x = own[i:j] @ classes
        part[i:j] = x[at[: j - i], ys[i:j] // per] - exponentials(x)[2]
    for c, begin, end in parts:
        for i, j in blocks(begin, end, per):
            x = own[i:j] @ words[c]
            part[i:j] += x[at[: j - i], places[i:j]] - exponentials(x)[2]
    out = np.empty(len(h), h.dtype)
    out[order] = part
    return out


def scores(p: Params, docs: list[np.ndarray], end: int, rows: int = ROWS) -> np.ndarray:
    """Log-likelihood of each whole document; the state goes on from window to window until the document ends. A window
    closes once it has `rows` states; SIDE documents of about one length go side by side."""
    order, result = np.argsort([-len(d) for d in docs], kind="stable"), np.zeros(len(docs))
    small = len(p["embed"]) <= SMALL
    table = p["embed"] @ p["wx"] + p["b"] if small else None
    for i in range(0, len(docs), SIDE):
        own = order[i : i + SIDE]
        result[own] = sided(p, [docs[k] for k in own], end, rows, table)
    return result


def sided(p: Params, docs: list[np.ndarray], end: int, rows: int, table: np.ndarray | None) -> np.ndarray:
    """Log-likelihood of each document, the longest first; table: the tokens' input parts, if these are worked out."""
    sizes, flat = np.array([len(d) for d in docs], np.int64), np.concatenate(docs).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    out, h, previous = np.zeros(len(docs)), np.zeros((len(docs), HIDDEN), np.float32), np.full(len(docs), end)
    states, targets, owners, held, longest = [], [], [], 0, int(sizes[0]) if len(sizes) else 0
    actives = np.searchsorted(-sizes, -np.arange(longest), side="left")  # how many are longer than each place
    for s, active in enumerate(actives.tolist()):
        gx = table[previous[:active]] if table is not None else p["embed"][previous[:active]] @ p["wx"] + p["b"]
        h = step(p, gx, h[:active])[0]
        previous = flat[starts[:active] + s]
        states.append(h)
        targets.append(previous)
        owners.append(active)
        held += active
        if held >= rows or s + 1 == longest:
            got = log_probs(p, np.concatenate(states), np.concatenate(targets))
            out += np.bincount(np.concatenate([np.arange(n) for n in owners]), got, len(docs))
            states, targets, owners, held = [], [], [], 0
    return out


def gradients(p: Params, h0: np.ndarray, inputs: np.ndarray, targets: np.ndarray, mask: np.ndarray, fresh: np.ndarray | None = None) -> tuple[Params, np.ndarray, float]:
    """Of the mean loss over one window (time x batch); the last state; the loss. fresh: where a document begins, and with
    it a state of zeros. Places outside the mask come last and count for nothing."""
    steps, batch = inputs.shape
    shape, dtype = (steps, batch, HIDDEN), p["wh"].dtype
    x = p["embed"][inputs]
    gx = x @ p["wx"] + p["b"]
    keep = None if fresh is None else (~fresh)[:, :, None].astype(dtype)
    before, z, r, n, un, after = (np.empty(shape, dtype) for _ in range(6))
    h = h0
    for t in range(steps):
        before[t] = h if keep is None else h * keep[t]
        after[t], z[t], r[t], n[t], un[t] = step(p, gx[t], before[t])
        h = after[t]
    seen = np.flatnonzero(mask.ravel())
    count, per = max(1, len(seen)), p["ww"].shape[2]
    order, parts = segments(targets.ravel()[seen], per)
    rows = seen[order]
    hs, ys, at = with_ones(after.reshape(-1, HIDDEN)[rows]), targets.ravel()[rows], np.arange(len(rows))
    of_class, of_word, places = with_bias(p["wc"], p["bc"]), with_bias(p["ww"], p["bw"]), ys % per

    def softmax(logits: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, float]:
        """The logits' gradient, and the loss."""
        seen = at[: len(own)]
        hit = logits[seen, own]
        e, total, log = exponentials(logits)
        e *= (1 / (total * count))[:, None]
        e[seen, own] -= 1 / count
        return e, float((log - hit).sum())

    loss, dh, by_class, by_word, back = 0.0, np.empty((len(rows), HIDDEN), dtype), np.zeros_like(of_class), np.zeros_like(of_word), p["wc"].T.copy()
    for i, j in blocks(0, len(rows), len(p["bc"])):
        d, more = softmax(hs[i:j] @ of_class, ys[i:j] // per)
        loss += more
        by_class += hs[i:j].T @ d
        dh[i:j] = d @ back
    for c, begin, end in parts:
        back = p["ww"][c].T
        for i, j in blocks(begin, end, per):
            d, more = softmax(hs[i:j] @ of_word[c], places[i:j])
            loss += more
            by_word[c] += hs[i:j].T @ d
            dh[i:j] += d @ back
    g = {"wc": by_class[:-1], "bc": by_class[-1], "ww": by_word[:, :-1], "bw": by_word[:, -1]}
    dstates = np.zeros((steps * batch, HIDDEN), dtype)
    dstates[rows] = dh
    dstates = dstates.reshape(shape)
    by_n, by_z, by_r = (1 - z) * (1 - n * n), (before - n) * z * (1 - z), un * r * (1 - r)
    dgx, dgh, carried, back = np.empty((*shape[:2], 3 * HIDDEN), dtype), np.empty((*shape[:2], 3 * HIDDEN), dtype), np.zeros_like(h0), p["wh"].T.copy()
    for t in range(steps - 1, -1, -1):
        total = dstates[t] + carried
        dn = total * by_n[t]
        dgx[t, :, :HIDDEN] = total * by_z[t]
        dgx[t, :, HIDDEN : 2 * HIDDEN] = dn * by_r[t]
        dgx[t, :, 2 * HIDDEN :] = dn
        dgh[t] = dgx[t]
        dgh[t, :, 2 * HIDDEN :] *= r[t]
        carried = total * z[t] + dgh[t] @ back
        if keep is not None:
            carried *= keep[t]
    flat = dgx.reshape(-1, 3 * HIDDEN)
    g["wh"] = before.reshape(-1, HIDDEN).T @ dgh.reshape(-1, 3 * HIDDEN)
    g["b"], g["wx"] = flat.sum(axis=0), x.reshape(-1, EMBED).T @ flat
    dx, words = flat @ p["wx"].T, inputs.ravel()
    order = np.argsort(words, kind="stable")
    own, starts = np.unique(words[order], return_index=True)
    g["embed"] = np.zeros_like(p["embed"])
    g["embed"][own] = np.add.reduceat(dx[order], starts, axis=0)
    return g, h, loss


def train(p: Params, docs: list[np.ndarray], end: int, batch: int = 512, window: int = 20, rate: float = 0.01) -> Params:
    """One pass over the documents by truncated backpropagation, in windows of `batch` streams.

    The documents stand one after another, in an order drawn anew, cut into streams of one length, so that no place is
    padded but in the last window. A document's state goes on over its windows; it begins anew only at the head of a stream."""
    p = {k: v.copy() for k, v in p.items()}
    m, v, turn = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    docs = [docs[i] for i in np.random.default_rng(len(docs)).permutation(len(docs)).tolist() if len(docs[i])]
    flat = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    batch = max(1, min(batch, len(flat) // window))
    long = -(-len(flat) // batch)
    begins = np.zeros(long * batch, bool)
    begins[np.cumsum([0, *map(len, docs[:-1])])[: len(docs)]] = True
    begins = begins.reshape(batch, long)
    targets = np.concatenate([flat, np.zeros(long * batch - len(flat), flat.dtype)]).reshape(batch, long)
    h, last = np.zeros((batch, HIDDEN), p["wh"].dtype), np.full((batch, 1), end)
    for t in range(0, long, window):
        at = slice(t, t + window)
        fresh, aim = begins[:, at].T, targets[:, at].T
        inputs = np.concatenate([last, targets[:, at][:, :-1]], axis=1).T
        inputs = np.where(fresh, end, inputs)
        last = targets[:, at][:, -1:]
        mask = (np.arange(batch)[None, :] * long + np.arange(t, min(t + window, long))[:, None]) < len(flat)
        g, h, _ = gradients(p, h, inputs, aim, mask, fresh)
        turn += 1
        # only what the window touches moves: of a large vocabulary that is a small part
        words, classes = np.unique(inputs), np.unique(aim[mask] // p["ww"].shape[2])
        touched = {"embed": words} | ({"ww": classes, "bw": classes} if 2 * len(classes) < len(p["bc"]) else {})
        g = {name: x[touched[name]] if name in touched else x for name, x in g.items()}
        size = np.sqrt(sum(float(np.vdot(x, x)) for x in g.values()))
        scale = np.float32(min(1.0, 1.0 / max(size, 1e-9)))
        one, two = np.float32(rate / (1 - 0.9**turn)), np.float32(1 / (1 - 0.99**turn))
        for name, x in g.items():
            rows = touched.get(name, slice(None))
            x *= scale
            first, second = m[name][rows], v[name][rows]  # copies where rows are listed
            first *= np.float32(0.9)
            first += np.float32(0.1) * x
            x *= x
            second *= np.float32(0.99)
            second += np.float32(0.01) * x
            np.multiply(second, two, out=x)
            np.sqrt(x, out=x)
            x += np.float32(1e-6)
            np.divide(first, x, out=x)
            x *= one
            if name in touched:
                m[name][rows], v[name][rows] = first, second
            p[name][rows] -= x
    return p


def mean(params: list[Params], weights: list[int]) -> Params:
    """Parameters averaged by the number of tokens each was trained on."""
    total = sum(weights)
    return {k: sum(p[k] * np.float32(w / total) for p, w in zip(params, weights, strict=True)) for k in params[0]}
