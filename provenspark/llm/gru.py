"""A gated recurrent language model in numpy with a class-factored output softmax.

Words with a model id are split into classes of equal size by frequency; one
more class stands for every other word.  P(word | state) is P(class | state)
times P(word | class, state); for the last class the caller supplies the
second factor.  Training cuts back-propagation at a window's edge and carries
the state over it; scoring carries the state through the whole document.
"""

from __future__ import annotations

import numpy as np

#: Ids of the model: 0 is any other word, the last one a text's end.
WORDS, CLASSES, STATE, WINDOW = 2048, 32, 24, 32
PER = WORDS // CLASSES
#: Lanes side by side in training, rounds that share the documents out, and Adam's rate.
SIDE, ROUNDS, RATE = 256, 4, 0.03
NAMES = ("embed", "u", "b_in", "b_state", "class_w", "class_b", "word_w", "word_b")


def fresh(seed: int = 3) -> dict[str, np.ndarray]:
    """Small random parameters; the start symbol has the row after the last id."""
    r, h = np.random.default_rng(seed), STATE
    shapes = {"embed": (WORDS + 1, 3 * h), "u": (h, 3 * h), "b_in": (3 * h,), "b_state": (3 * h,), "class_w": (h, CLASSES + 1), "class_b": (CLASSES + 1,), "word_w": (CLASSES, h, PER), "word_b": (CLASSES, PER)}
    return {k: (r.normal(0, 0.1, s) if k in ("embed", "u", "class_w", "word_w") else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def step(p: dict, inputs: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The next state from the ids read and the state (reset gate after the product)."""
    h = STATE
    x = p["embed"][inputs]
    a = state @ p["u"]
    gates = _sigmoid(x[:, : 2 * h] + a[:, : 2 * h])
    new = np.tanh(x[:, 2 * h :] + gates[:, h:] * a[:, 2 * h :])
    return new + gates[:, :h] * (state - new)


def _soft(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-softmax at one column of each row."""
    most = logits.max(axis=1)
    return logits[np.arange(len(at)), at] - most - np.log(np.exp(logits - most[:, None]).sum(axis=1))


def output(p: dict, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural-log probability of each target, of the class alone for id 0."""
    kind = np.where(targets > 0, targets // PER, CLASSES)
    out = _soft(states @ p["class_w"] + p["class_b"], kind)
    order = np.argsort(kind.astype(np.int16), kind="stable")
    ends = np.searchsorted(kind[order], np.arange(CLASSES + 1))
    for c in range(CLASSES):
        rows = order[ends[c] : ends[c + 1]]
        if len(rows):
            out[rows] += _soft(states[rows] @ p["word_w"][c] + p["word_b"][c], targets[rows] % PER)
    return out


def score(p: dict, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Natural-log probability of each whole document ids[first[i]:first[i+1]], all documents in step."""
    p = p | {"embed": p["embed"] + p["b_in"] + np.concatenate([p["b_state"][: 2 * STATE], np.zeros(STATE, np.float32)])}
    if np.any(p["b_state"][2 * STATE :]):
        raise ValueError("the candidate's state bias is kept at zero")
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = first[:-1][order], lengths[order]
    total = np.zeros(len(order))
    state = np.zeros((len(order), STATE), np.float32)
    before = np.full(len(order), WORDS)
    most = int(lengths[0]) if len(lengths) else 0
    alive = np.searchsorted(-lengths, -np.arange(most), "left")  # documents longer than t
    for at in range(0, most, WINDOW):
        states, targets, counts = [], [], []
        for t in range(at, min(most, at + WINDOW)):
            n = int(alive[t])
            now = step(p, before[:n], state[:n])
            state[:n] = now
            target = ids[starts[:n] + t].astype(np.int64)
            before[:n] = target
            states.append(now)
            targets.append(target)
            counts.append(n)
        found = output(p, np.concatenate(states), np.concatenate(targets))
        done = 0
        for n in counts:
            total[:n] += found[done : done + n]
            done += n
    out = np.zeros(len(order))
    out[order] = total
    return out


def _softmax(logits: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, float]:
    """(the softmax less one at each row's column, the sum of the negative logs there)."""
    logits -= logits.max(axis=1, keepdims=True)
    q = np.exp(logits, out=logits)
    q /= q.sum(axis=1, keepdims=True)
    rows = np.arange(len(at))
    loss = -np.log(np.maximum(q[rows, at], 1e-30)).sum()
    q[rows, at] -= 1
    return q, loss


def gradients(p: dict, inputs: np.ndarray, targets: np.ndarray, opens: np.ndarray, state: np.ndarray) -> tuple[float, dict, np.ndarray, np.ndarray]:
    """(loss sum, gradients, ids read, last state) of one window of (time, lanes) arrays.

    A document opens where opens is set: the state before it is zero.  A target
    of -1 counts for nothing.  The embedding's gradient has a row for each of
    the ids read.
    """
    h, (steps, n) = STATE, inputs.shape
    g = {"u": np.zeros_like(p["u"]), "b_state": np.zeros_like(p["b_state"]), "word_w": np.zeros_like(p["word_w"]), "word_b": np.zeros_like(p["word_b"])}
    kept, hs, s = [], np.empty((steps, n, h), p["u"].dtype), state
    read = (p["embed"][inputs.ravel()] + p["b_in"]).reshape(steps, n, 3 * h)
    for t in range(steps):
        s = np.where(opens[t][:, None], 0, s)
        x, a = read[t], s @ p["u"] + p["b_state"]
        gates = _sigmoid(x[:, : 2 * h] + a[:, : 2 * h])
        new = np.tanh(x[:, 2 * h :] + gates[:, h:] * a[:, 2 * h :])
        kept.append((s, a, gates, new))
        s = new + gates[:, :h] * (s - new)
        hs[t] = s
    rows = np.flatnonzero(targets.ravel() >= 0)
    y = targets.ravel()[rows]
    kind = np.where(y > 0, y // PER, CLASSES).astype(np.int16)
    order = np.argsort(kind, kind="stable")  # rows of a class side by side
    rows, y, kind = rows[order], y[order], kind[order]
    ends = np.searchsorted(kind, np.arange(CLASSES + 1))
    states = hs.reshape(steps * n, h)[rows]
    q, loss = _softmax(states @ p["class_w"] + p["class_b"], kind)
    g["class_w"], g["class_b"] = states.T @ q, q.sum(axis=0)
    ds = q @ p["class_w"].T
    for c in range(CLASSES):
        own = slice(ends[c], ends[c + 1])
        if ends[c] < ends[c + 1]:
            q, more = _softmax(states[own] @ p["word_w"][c] + p["word_b"][c], y[own] % PER)
            loss += more
            g["word_w"][c], g["word_b"][c] = states[own].T @ q, q.sum(axis=0)
            ds[own] += q @ p["word_w"][c].T
    every = np.zeros((steps * n, h), hs.dtype)
    every[rows] = ds
    every = every.reshape(steps, n, h)
    back = np.zeros((n, h), hs.dtype)
    read_by, state_by = np.empty((steps, n, 3 * h), hs.dtype), np.empty((steps, n, 3 * h), hs.dtype)
    for t in reversed(range(steps)):
        s, a, gates, new = kept[t]
        z, r = gates[:, :h], gates[:, h:]
        d = back + every[t]
        dn = d * (1 - z) * (1 - new * new)
        read_by[t, :, :h] = d * (s - new) * z * (1 - z)
        read_by[t, :, h : 2 * h] = dn * a[:, 2 * h :] * r * (1 - r)
        read_by[t, :, 2 * h :] = dn
        state_by[t] = read_by[t]
        state_by[t, :, 2 * h :] *= r
        back = np.where(opens[t][:, None], 0, d * z + state_by[t] @ p["u"].T)
    before = np.concatenate([k[0] for k in kept])
    g["u"], g["b_state"] = before.T @ state_by.reshape(-1, 3 * h), state_by.sum(axis=(0, 1))
    dx, ids = read_by.reshape(steps * n, 3 * h), inputs.ravel()
    g["b_in"] = dx.sum(axis=0)
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    at = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    g["embed"] = np.add.reduceat(dx[order], at, axis=0)
    return float(loss), g, ids[at], hs[-1]


def start(counts: np.ndarray, seed: int = 3) -> dict:
    """What training carries from round to round: parameters, Adam's moments and steps; biases start at the log frequencies of counts (by id)."""
    p = fresh(seed)
    c = np.maximum(counts.astype(np.float64), 0.5)
    by_class = c.copy()
    by_class[0] = 0
    p["class_b"][:CLASSES] = np.log(np.maximum(by_class.reshape(CLASSES, PER).sum(axis=1), 0.5))
    p["class_b"][CLASSES] = np.log(c[0])
    p["class_b"] -= p["class_b"].max()
    c[0] = 1e-3  # never a target within its class
    p["word_b"][:] = np.log(c.reshape(CLASSES, PER))
    p["word_b"] -= p["word_b"].max(axis=1, keepdims=True)
    return {"p": p, "first": {k: np.zeros_like(v) for k, v in p.items()}, "second": {k: np.zeros_like(v) for k, v in p.items()}, "done": 0}


def flat(state: dict) -> np.ndarray:
    """Parameters and moments in one row, to be summed and averaged."""
    return np.concatenate([state[part][k].ravel() for part in ("p", "first", "second") for k in NAMES]).astype(np.float64)


def shaped(row: np.ndarray, done: int) -> dict:
    """The state of such a row."""
    out, at = {"done": done}, 0
    like = fresh()
    for part in ("p", "first", "second"):
        out[part] = {}
        for k in NAMES:
            out[part][k] = row[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
            at += like[k].size
    return out


def lanes(documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, opens) by (time, lane): the documents end to end, cut into SIDE equal lanes.

    A lane that begins inside a document goes on from a zero state; no token is left out.
    """
    stream = np.concatenate([np.zeros(0, np.int64), *documents])
    opens = np.zeros(len(stream), bool)
    opens[np.cumsum([0, *map(len, documents)])[:-1]] = True
    inputs = np.where(opens, WORDS, np.concatenate([[WORDS], stream[:-1]]))
    most = -(-len(stream) // SIDE)
    fill = (0, SIDE * most - len(stream))
    shape = lambda a, v: np.ascontiguousarray(np.pad(a, fill, constant_values=v).reshape(SIDE, most).T)
    return shape(inputs, WORDS), shape(stream, -1), shape(opens, True)


def train(state: dict, documents: list[np.ndarray], turn: int, seed: int = 3) -> tuple[dict, int]:
    """(state, tokens) after one whole pass over the documents, in random order, each with its end."""
    p, first, second = ({k: v.copy() for k, v in state[part].items()} for part in ("p", "first", "second"))
    done, tokens = state["done"], 0
    order = np.random.default_rng([seed, turn]).permutation(len(documents))
    inputs, targets, opens = lanes([documents[d] for d in order])
    held = np.zeros((SIDE, STATE), np.float32)
    for at in range(0, len(inputs), WINDOW):
        x, y, o = (a[at : at + WINDOW] for a in (inputs, targets, opens))
        _, g, read, held = gradients(p, x, y, o, held)
        rows = int((y >= 0).sum())
        tokens += rows
        done += 1
        g["b_state"][2 * STATE :] = 0
        norm = np.sqrt(sum(float(v.ravel() @ v.ravel()) for v in g.values())) / rows
        scale = min(1.0, 1.0 / max(norm, 1e-12)) / rows
        rate = np.float32(RATE * 0.6**turn * np.sqrt(1 - 0.999**done) / (1 - 0.9**done))
        for name in NAMES:
            v, own = g[name] * np.float32(scale), read if name == "embed" else slice(None)  # embeddings not read stay as they are
            m = first[name][own] + np.float32(0.1) * (v - first[name][own])
            w = second[name][own] + np.float32(0.001) * (v * v - second[name][own])
            first[name][own], second[name][own] = m, w
            p[name][own] -= rate * m / (np.sqrt(w) + np.float32(1e-8))
    return {"p": p, "first": first, "second": second, "done": done}, tokens
