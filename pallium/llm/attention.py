"""A small causal self-attention model over token classes, trained and evaluated in NumPy.

One attention layer reads the last tokens' classes; its output is added to the logits that the corpus' class
bigrams give. A class is one frequent subword id or a band of rarer ones, within which ids keep their share.
Classes are predicted in two steps, a group of `SIZE` classes first and then the class within it, so a token
costs GROUPS + SIZE exponentials instead of CLASSES.
Texts are scored in overlapping windows: each scores `STRIDE` tokens and sees `CONTEXT` tokens before them.
"""

from __future__ import annotations

import numpy as np

GROUPS, SIZE, WIDTH = 32, 16, 16
CLASSES = GROUPS * SIZE
CONTEXT, STRIDE = 16, 32
SPAN = CONTEXT + STRIDE
#: The class of document starts and ends.
EDGE = 0

_ONES_GROUP, _ONES_SIZE = np.ones(GROUPS, dtype=np.float32), np.ones(SIZE, dtype=np.float32)
_HIDDEN = np.where(np.arange(SPAN)[None, :] <= np.arange(CONTEXT, SPAN)[:, None], 0, -1e9).astype(np.float32)  # (query, key)


def initial(seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)

    def normal(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    return {
        "embed": normal(CLASSES, WIDTH, scale=0.5),
        "place": np.zeros((STRIDE, SPAN), dtype=np.float32),
        "qkv": normal(WIDTH, 3 * WIDTH, scale=WIDTH**-0.5),
        "mix": normal(WIDTH, WIDTH, scale=WIDTH**-0.5),
        "group": np.zeros((WIDTH, GROUPS), dtype=np.float32),
        "inner": np.zeros((GROUPS, WIDTH, SIZE), dtype=np.float32),
    }


def windows(length: int) -> np.ndarray:
    """First scored token of each window over a text of `length` tokens."""
    return np.arange(0, length, STRIDE)


def gather(tokens: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, whether they exist, targets and whether they exist, of all windows of texts tokens[begin:end].

    Input i of a text is the class before its token i; before the first token it is EDGE.
    """
    firsts = [windows(n) for n in (end - begin).tolist()]
    count = np.array([len(f) for f in firsts], dtype=np.int64)
    first = np.concatenate([*firsts, np.zeros(0, dtype=np.int64)]).astype(np.int64)
    lo, hi = np.repeat(begin, count), np.repeat(end, count)
    at = first[:, None] + np.arange(-CONTEXT, STRIDE)[None, :]
    there = (at >= 0) & (at < (hi - lo)[:, None])
    inputs = np.where(at > 0, tokens[np.clip(lo[:, None] + at - 1, 0, max(len(tokens) - 1, 0))], EDGE)
    scored = at[:, CONTEXT:]
    targets = tokens[np.clip(lo[:, None] + scored, 0, max(len(tokens) - 1, 0))]
    return inputs, there, targets, there[:, CONTEXT:]


def _forward(p: dict[str, np.ndarray], inputs: np.ndarray, there: np.ndarray):
    """Queries, keys and values depend on the class alone and are looked up; `place` weighs (query, key) places."""
    table = np.clip(p["embed"] @ p["qkv"], -4, 4)
    table[:, :WIDTH] *= np.float32(WIDTH**-0.5)
    own = inputs[:, CONTEXT:]
    keys, values = table[:, WIDTH : 2 * WIDTH].copy(), np.append(table[:, 2 * WIDTH :], np.ones((CLASSES, 1), dtype=np.float32), axis=1)
    k, v = np.take(keys, inputs, axis=0), np.take(values, inputs, axis=0)
    q, x = np.take(table[:, :WIDTH].copy(), own, axis=0), np.take(p["embed"], own, axis=0)
    weight = q @ k.transpose(0, 2, 1)
    weight += p["place"] + _HIDDEN
    if not there.all():
        weight += np.where(there, np.float32(0), np.float32(-1e9))[:, None, :]
    np.exp(weight, out=weight)
    sums = weight @ v  # the last column of v is one, so the weights' sum comes along
    total = sums[:, :, WIDTH:] + np.float32(1e-9)
    seen = sums[:, :, :WIDTH] / total
    hidden = seen.reshape(-1, WIDTH) @ p["mix"]
    hidden += x.reshape(-1, WIDTH)
    np.tanh(hidden, out=hidden)
    return q, k, v[:, :, :WIDTH], weight, total, seen, hidden.reshape(seen.shape)


class Bigrams:
    """Log probabilities of the next group, and of the next class within each group, by the class before."""

    def __init__(self, counts: np.ndarray):
        by_group = counts.reshape(CLASSES, GROUPS, SIZE)
        total = by_group.sum(axis=2)
        self.group = np.log(total / total.sum(axis=1, keepdims=True)).astype(np.float32)
        self.inner = np.log(by_group / total[:, :, None]).astype(np.float32).transpose(1, 0, 2).copy()


def _inner_logits(p: dict[str, np.ndarray], bigram: Bigrams, x: np.ndarray, before: np.ndarray, group: np.ndarray, cut: list[int]) -> np.ndarray:
    """Logits of the classes of each row's group; rows lie in the order of groups, group g's are x[cut[g]:cut[g + 1]]."""
    out = np.take(bigram.inner.reshape(-1, SIZE), group * CLASSES + before, axis=0)
    for g, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        if hi > lo:
            out[lo:hi] += x[lo:hi] @ p["inner"][g]
    return out


def log_probabilities(p: dict[str, np.ndarray], bigram: Bigrams, inputs: np.ndarray, there: np.ndarray, targets: np.ndarray, scored: np.ndarray) -> np.ndarray:
    """Natural log probability of each scored token's class, in order."""
    hidden = _forward(p, inputs, there)[-1][scored]
    target = targets[scored]
    # in the order of groups, so that each group is a slice
    order = np.argsort((target // SIZE).astype(np.int16), kind="stable")
    hidden, before, target = np.take(hidden, order, axis=0), inputs[:, CONTEXT:][scored][order], target[order]
    logits, group, at = hidden @ p["group"], target // SIZE, np.arange(len(target))
    logits += np.take(bigram.group, before, axis=0)
    found = logits[at, group].astype(np.float64)
    np.exp(logits, out=logits)
    total = logits @ _ONES_GROUP
    logits = _inner_logits(p, bigram, hidden, before, group, np.searchsorted(group, np.arange(GROUPS + 1)).tolist())
    found += logits[at, target % SIZE]
    np.exp(logits, out=logits)
    total *= logits @ _ONES_SIZE
    out = np.empty(len(found))
    out[order] = found - np.log(total.astype(np.float64))
    return out


def _softmax(logits: np.ndarray) -> np.ndarray:
    """In place. Logits are log probabilities moved by products of values within 1 and small weights: exp is safe."""
    np.exp(logits, out=logits)
    logits /= (logits @ (_ONES_GROUP if logits.shape[1] == GROUPS else _ONES_SIZE))[:, None]
    return logits


def gradients(p: dict[str, np.ndarray], bigram: Bigrams, inputs: np.ndarray, there: np.ndarray, targets: np.ndarray, scored: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the mean negative log probability of the scored tokens."""
    q, k, v, weight, total, seen, hidden = _forward(p, inputs, there)
    weight /= total
    n = np.float32(max(scored.sum(), 1))
    flat, before, target, there_ = hidden.reshape(-1, WIDTH), inputs[:, CONTEXT:].ravel(), targets.ravel(), scored.ravel()
    # in the order of groups, so that each group is a slice; places that aren't scored lie behind
    order = np.argsort(np.where(there_, target // SIZE, GROUPS).astype(np.int16), kind="stable")
    cut = np.searchsorted(np.where(there_, target // SIZE, GROUPS)[order], np.arange(GROUPS + 1)).tolist()
    order = order[: cut[-1]]
    x, before, target = np.take(flat, order, axis=0), before[order], target[order]
    group, at = target // SIZE, np.arange(len(target))
    share = x @ p["group"]
    share += np.take(bigram.group, before, axis=0)
    _softmax(share)
    share[at, group] -= 1
    g = {"group": x.T @ share / n, "inner": np.zeros_like(p["inner"])}
    d_x = share @ p["group"].T
    share = _softmax(_inner_logits(p, bigram, x, before, group, cut))
    share[at, target % SIZE] -= 1
    for c, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        if hi > lo:
            np.matmul(x[lo:hi].T, share[lo:hi], out=g["inner"][c])
            d_x[lo:hi] += share[lo:hi] @ p["inner"][c].T
    g["inner"] /= n
    d_x *= (1 - x * x) / n
    d_sum = np.zeros_like(flat)
    d_sum[order] = d_x
    g["mix"] = seen.reshape(-1, WIDTH).T @ d_sum
    d_seen = (d_sum @ p["mix"].T).reshape(hidden.shape)
    d_score = d_seen @ v.transpose(0, 2, 1)
    # the sum over keys of weight * d_weight is that of seen * d_seen
    d_score -= (d_seen * seen).sum(axis=2, keepdims=True)
    d_score *= weight
    g["place"] = d_score.sum(axis=0)
    d_q, d_own = _sums_by(inputs[:, CONTEXT:].ravel(), [d_score @ k, d_sum])
    d_k, d_v = _sums_by(inputs.ravel(), [d_score.transpose(0, 2, 1) @ q, weight.transpose(0, 2, 1) @ d_seen])
    d_table = np.concatenate([d_q * np.float32(WIDTH**-0.5), d_k, d_v], axis=1)
    g["qkv"] = p["embed"].T @ d_table
    g["embed"] = d_table @ p["qkv"].T + d_own
    return g


def _sums_by(group: np.ndarray, parts: list[np.ndarray]) -> list[np.ndarray]:
    """Per array of rows, the sums of the rows of each class."""
    order = np.argsort(group.astype(np.int16), kind="stable")
    there, begin = np.unique(group[order], return_index=True)
    out = [np.zeros((CLASSES, WIDTH), dtype=np.float32) for _ in parts]
    for total, rows in zip(out, parts, strict=True):
        total[there] = np.add.reduceat(np.take(rows.reshape(-1, WIDTH), order, axis=0), begin, axis=0)
    return out


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float = 4e-3):
        self.rate, self.step = rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in p.items()}
        self.square = {k: np.zeros_like(v) for k, v in p.items()}

    def update(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> None:
        self.step += 1
        for k, v in g.items():
            self.mean[k] += 0.1 * (v - self.mean[k])
            self.square[k] += 0.01 * (v * v - self.square[k])
            p[k] -= np.float32(self.rate) * (self.mean[k] / (1 - 0.9**self.step)) / (np.sqrt(self.square[k] / (1 - 0.99**self.step)) + np.float32(1e-7))


def flatten(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def unflatten(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    shapes = {k: v.shape for k, v in initial().items()}
    for k in sorted(shapes):
        n = int(np.prod(shapes[k]))
        out[k] = flat[at : at + n].reshape(shapes[k]).astype(np.float32)
        at += n
    return out
