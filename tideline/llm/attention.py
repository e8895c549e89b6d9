"""A small causal self-attention model over subword ids, in numpy.

One layer, one head: a token's query meets the keys of the tokens before it in
its context (and its own), with a bias per distance; the attended values are
added to the token's embedding, and a linear layer predicts the class of the next
token. Frequent tokens are a class each, all others share classes formed by the
contexts they stand in; inside a class tokens follow their counts after the class
of the token before, over the whole training corpus. So probabilities over the vocabulary sum to one, and scoring a
token costs a softmax over the classes only.

Contexts are blocks of ``HALF`` tokens together with the ``HALF`` before them:
windows overlap by half, and every token is scored once, in the block it is in.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

HALF, DIM, HEAD, TAIL = 16, 16, 64, 32
STEPS, BATCH, RATE = 1500, 128, 0.02
#: Weight, in tokens, of a class's overall shares against those after one class of tokens.
PRIOR = 20.0
#: Blocks whose attention is computed at once: what they need stays in a core's cache.
AT_ONCE = 128
F4 = np.float32


def blocks(ids: np.ndarray, first: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents laid end to end, cut into padded blocks.

    ``first`` holds the documents' starts in ``ids`` and the end. Each document is
    preceded by ``pad`` (the begin id) so that its first token is predicted too.
    Returns contexts [block, 2 * HALF], targets [block, HALF] (-1: none) and each block's document.
    """
    n = np.diff(first)
    per = -(-n // HALF)
    begin = np.concatenate([[0], np.cumsum(per)])
    total = int(begin[-1])
    doc = np.repeat(np.arange(len(n)), per)
    place = np.arange(len(ids)) - np.repeat(first[:-1] - begin[:-1] * HALF, n)
    target = np.full(total * HALF, -1, np.int32)
    target[place] = ids
    target = target.reshape(total, HALF)
    now = np.full((total, HALF), pad, np.int32)  # a token's input is the one before it
    now[:, 1:] = target[:, :-1]
    opens = np.zeros(total, bool)
    opens[begin[:-1][n > 0]] = True
    inner = np.flatnonzero(~opens)
    now[inner, 0] = target[inner - 1, -1]
    now[now < 0] = pad
    before = np.full((total, HALF), -1, np.int32)
    before[inner] = now[inner - 1]
    return np.concatenate([before, now], axis=1), target, doc


@dataclass
class Model:
    emb: np.ndarray  # [vocabulary + 1, DIM]; the last row is the begin id
    wq: np.ndarray
    wk: np.ndarray
    wv: np.ndarray
    distance: np.ndarray  # bias of each distance 0 .. 2 * HALF - 1
    out: np.ndarray  # [DIM, classes]
    out_bias: np.ndarray
    cls: np.ndarray  # class of each token
    within: np.ndarray  # [class before (the last: none), token] natural log of the token's share of its class

    def tables(self) -> None:
        """What depends on a token alone, once for all tokens (and one row for "no token").

        Values carry a column of ones and embeddings one of zeros: attended values
        then bring the sum of their weights along, and, divided by it, the one
        that the output layer's bias is multiplied by.
        """
        pad = lambda x, last: np.hstack([np.vstack([x, np.zeros((1, x.shape[1]), F4)]), np.full((len(x) + 1, len(last)), last, F4)]).astype(F4)
        self.q, self.k = pad(self.emb @ (self.wq / np.sqrt(DIM).astype(F4)), []), pad(self.emb @ self.wk, [])
        self.v, self.x = pad(self.emb @ self.wv, [1]), pad(self.emb, [0])
        self.bias = _position_bias(self.distance)
        self.weights = np.vstack([self.out, self.out_bias]).astype(F4)
        self.before = np.append(self.cls, HEAD + TAIL)  # class by token, the begin id's last

    def log_probs(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log probabilities of the targets [block, HALF], 0 where there is none."""
        out = np.zeros(target.shape, F4)
        ones = np.ones(HEAD + TAIL, F4)
        for a in range(0, len(context), AT_ONCE):
            c, t = context[a : a + AT_ONCE], target[a : a + AT_ONCE]
            now = c[:, HALF:]
            s = self.q[now] @ self.k[c].transpose(0, 2, 1)
            s += self.bias
            s[np.flatnonzero(c[:, 0] < 0), :, :HALF] = -30  # a document's first block has nothing before it
            np.exp(s, out=s)
            h = s @ self.v[c]
            h /= h[:, :, -1:].copy()
            h += self.x[now]
            z = h.reshape(-1, DIM + 1) @ self.weights
            flat = t.ravel()
            own = np.maximum(flat, 0)
            chosen = z[np.arange(len(flat)), self.cls[own]]
            np.exp(z, out=z)
            lp = chosen - np.log(z @ ones) + self.within[self.before[now.ravel()], own]
            lp[flat < 0] = 0
            out[a : a + AT_ONCE] = lp.reshape(t.shape)
        return out


def _position_bias(distance: np.ndarray) -> np.ndarray:
    """[query, key] bias; keys after the query are as good as gone."""
    apart = np.arange(HALF, 2 * HALF)[:, None] - np.arange(2 * HALF)[None, :]
    return np.where(apart >= 0, distance[np.maximum(apart, 0)], -30).astype(F4)


def head_places(counts: np.ndarray) -> np.ndarray:
    """For each token its place among the HEAD most frequent, or -1."""
    head = np.lexsort((np.arange(len(counts)), -counts))[:HEAD]
    place = np.full(len(counts), -1)
    place[head] = np.arange(len(head))
    return place


def neighbour_keys(ids: np.ndarray, first: np.ndarray, place: np.ndarray) -> np.ndarray:
    """(token, HEAD token beside it and on which side) of all neighbours in the same document, as one number."""
    follows = np.ones(len(ids), bool)
    follows[first[:-1][first[:-1] < len(ids)]] = False
    at = np.flatnonzero(follows)
    left, right = ids[at - 1], ids[at]
    after, before = place[left] >= 0, place[right] >= 0
    return np.concatenate([right[after] * 2 * HEAD + place[left[after]], left[before] * 2 * HEAD + HEAD + place[right[before]]])


def classes(place: np.ndarray, keys: np.ndarray, counts: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A class for each token: the HEAD most frequent are their own, the rest are clustered by their counts of neighbours."""
    vocabulary = len(place)
    cls = place.copy()
    vec = np.zeros((vocabulary, 2 * HEAD), F4)
    vec.ravel()[keys] = counts
    rest = np.flatnonzero((cls < 0) & (vec.sum(axis=1) > 0))
    x = np.sqrt(vec[rest])
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)
    if len(rest):
        weight = np.sqrt(vec[rest].sum(axis=1))
        centre = x[rng.choice(len(rest), TAIL, p=weight / weight.sum())]
        for _ in range(8):
            near = (x @ centre.T).argmax(axis=1)
            for k in range(TAIL):
                own = near == k
                if own.any():
                    centre[k] = (x[own] * weight[own, None]).sum(axis=0)
                    centre[k] /= max(np.linalg.norm(centre[k]), 1e-6)
        cls[rest] = HEAD + (x @ centre.T).argmax(axis=1)
    unseen = np.flatnonzero(cls < 0)
    cls[unseen] = HEAD + unseen % TAIL
    return cls


def sample_arrays(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a sample of documents, and where each document starts (and the last ends)."""
    docs = [d for d in docs if len(d)]
    ids = np.concatenate([*docs, np.zeros(0, np.int64)]).astype(np.int64)
    return ids, np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)


def sample_classes(docs: list[np.ndarray], vocabulary: int, seed: int = 11) -> np.ndarray:
    """Classes of all tokens, from id sequences at hand."""
    ids, first = sample_arrays(docs)
    place = head_places(np.bincount(ids, minlength=vocabulary))
    return classes(place, *np.unique(neighbour_keys(ids, first, place), return_counts=True), np.random.default_rng(seed))


def pair_keys(ids: np.ndarray, first: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """(class of the token before, token) of every token, as one number."""
    before = np.empty(len(ids), np.int64)
    before[1:] = cls[ids[:-1]]
    before[first[:-1][first[:-1] < len(ids)]] = HEAD + TAIL
    return before * len(cls) + ids


def shares(cls: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``within`` and the tokens of each class, from the corpus's counts of pair keys."""
    vocabulary, n = len(cls), HEAD + TAIL
    table = np.zeros((n + 1, vocabulary), F4)
    table.ravel()[keys] = counts
    smooth = table.sum(axis=0, dtype=np.float64) + 1.0
    class_sum = np.bincount(cls, smooth, minlength=n)
    overall = (smooth / class_sum[cls]).astype(F4)
    for row in table:
        after = np.bincount(cls, row, minlength=n)
        row += F4(PRIOR) * overall
        row /= (after + PRIOR)[cls].astype(F4)
        np.log(row, out=row)
    return table, class_sum


def begin(cls: np.ndarray, class_sum: np.ndarray, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Weights to descend from."""
    n_classes = HEAD + TAIL
    w = {
        "emb": rng.normal(0, 0.3, (len(cls) + 1, DIM)),
        "wq": rng.normal(0, 0.3, (DIM, DIM)),
        "wk": rng.normal(0, 0.3, (DIM, DIM)),
        "wv": rng.normal(0, 0.2, (DIM, DIM)),
        "distance": -0.1 * np.arange(2 * HALF),
        "out": rng.normal(0, 0.2, (DIM, n_classes)),
        "out_bias": np.log(np.maximum(class_sum, 1) / class_sum.sum()),
    }
    return {k: v.astype(F4) for k, v in w.items()}


def fitted(w: dict[str, np.ndarray], context: np.ndarray, target: np.ndarray, cls: np.ndarray, seed: int = 11, again: bool = False) -> dict[str, np.ndarray]:
    """``w`` after descent on all the windows; ``again``: from weights that were fitted before, in one pass of shorter steps."""
    w = {k: v.copy() for k, v in w.items()}
    if len(context):
        _descend(w, context, target, cls, np.random.default_rng(seed), 1 if again else STEPS, RATE / 5 if again else RATE)
    return w


def assembled(w: dict[str, np.ndarray], cls: np.ndarray, within: np.ndarray) -> Model:
    model = Model(**w, cls=cls, within=within)
    model.tables()
    return model


def as_rows(w: dict[str, np.ndarray]) -> np.ndarray:
    """All weights as rows of DIM numbers, the embeddings first."""
    return np.concatenate([w[k].reshape(-1, DIM) for k in ("emb", "wq", "wk", "wv", "distance", "out", "out_bias")])


def from_rows(rows: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in ("emb", "wq", "wk", "wv", "distance", "out", "out_bias"):
        n = like[k].size // DIM
        out[k] = rows[at : at + n].reshape(like[k].shape).astype(F4)
        at += n
    return out


def train(docs: list[np.ndarray], cls: np.ndarray, keys: np.ndarray, counts: np.ndarray, seed: int = 11) -> Model:
    """A model of id sequences at hand."""
    ids, first = sample_arrays(docs)
    within, class_sum = shares(cls, keys, counts)
    context, target, _ = blocks(ids, first, len(cls))
    return assembled(fitted(begin(cls, class_sum, np.random.default_rng(seed)), context, target, cls, seed), cls, within)


def summed_by(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the sum of each one's rows."""
    order = np.argsort(keys, kind="stable")
    at = keys[order]
    begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[begin], np.add.reduceat(rows[order], begin, axis=0)


def _descend(w: dict[str, np.ndarray], context: np.ndarray, target: np.ndarray, cls: np.ndarray, rng: np.random.Generator, steps: int, top_rate: float) -> None:
    """Adam on the mean negative log likelihood of the next token's class.

    Windows are taken in passes, each in an order of its own: for ``steps`` steps, and
    on to the end of the first pass, so that none is left out.
    """
    steps = max(steps, -(-len(context) // BATCH))
    order = np.zeros(0, np.int64)
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    apart = np.arange(HALF, 2 * HALF)[:, None] - np.arange(2 * HALF)[None, :]
    scale = F4(1 / np.sqrt(DIM))
    ones_k, ones_c = np.ones((2 * HALF, 1), F4), np.ones((HEAD + TAIL, 1), F4)  # sums along rows are products with these
    for step in range(1, steps + 1):
        if not len(order):
            order = rng.permutation(len(context))
        pick, order = order[:BATCH], order[BATCH:]
        c, t = context[pick], target[pick]
        ok = (t >= 0).ravel()
        e = w["emb"][c] * (c >= 0)[:, :, None].astype(F4)
        xq = e[:, HALF:]
        q, k, val = xq @ w["wq"], e @ w["wk"], e @ w["wv"]
        s = q @ k.transpose(0, 2, 1) * scale + np.where(apart >= 0, w["distance"][np.maximum(apart, 0)], -30).astype(F4)
        s[:, :, :HALF][np.broadcast_to((c[:, :1] < 0)[:, :, None], (len(c), HALF, HALF))] = -30
        s -= s.max(axis=2, keepdims=True)
        p = np.exp(s, out=s)
        p /= p @ ones_k
        h = xq + p @ val
        flat = h.reshape(-1, DIM)
        z = flat @ w["out"] + w["out_bias"]
        z -= z.max(axis=1, keepdims=True)
        g = np.exp(z, out=z)
        g /= g @ ones_c
        g[np.arange(len(g)), cls[np.maximum(t.ravel(), 0)]] -= 1
        g *= ok[:, None] / max(ok.sum(), 1)
        grad = {"out": flat.T @ g, "out_bias": g.sum(axis=0)}
        gh = (g @ w["out"].T).reshape(h.shape)
        gp = gh @ val.transpose(0, 2, 1)
        gval = p.transpose(0, 2, 1) @ gh
        gs = p * (gp - (gp * p) @ ones_k)
        grad["distance"] = np.bincount(np.maximum(apart, 0).ravel(), (gs.sum(axis=0) * (apart >= 0)).ravel(), minlength=2 * HALF)
        gq, gk = gs @ k * scale, gs.transpose(0, 2, 1) @ q * scale
        ge = gk @ w["wk"].T + gval @ w["wv"].T
        ge[:, HALF:] += gh + gq @ w["wq"].T
        grad["wq"], grad["wk"], grad["wv"] = xq.reshape(-1, DIM).T @ gq.reshape(-1, DIM), e.reshape(-1, DIM).T @ gk.reshape(-1, DIM), e.reshape(-1, DIM).T @ gval.reshape(-1, DIM)
        rate = top_rate * min(1.0, step / 20) * (1 - 0.9 * step / steps)
        for name, gr in grad.items():
            m[name] = 0.9 * m[name] + 0.1 * gr
            v[name] = 0.99 * v[name] + 0.01 * gr * gr
            w[name] -= (rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)).astype(F4)
        rows, gr = summed_by(np.where(c < 0, len(w["emb"]) - 1, c).ravel(), (ge * (c >= 0)[:, :, None]).reshape(-1, DIM))
        v["emb"][rows] += gr * gr  # Adagrad: most rows are seen seldom
        w["emb"][rows] -= 5 * top_rate * gr / (np.sqrt(v["emb"][rows]) + 1e-8)
