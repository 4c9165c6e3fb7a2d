"""A small causal self-attention model over piece ids, in numpy.

Position t of a window sees the window's positions up to t. Its attention output and its own id choose a mixture of
``MIXTURE`` distributions over the next id::

    p(next | context) = sum_k softmax(gate[id] + attention @ out)_k * spread_k[next]

so a probability needs one row of ``spread``, and all probabilities of a context add up to one. Gates, embeddings and
projections follow gradients (Adagrad); the distributions follow expected counts (EM).
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

import numpy as np

MIXTURE, WIDTH = 48, 16
#: A window and the step between windows: a later window gives its first ``WINDOW - STEP`` positions as context only.
WINDOW, STEP = 32, 28
BATCH = 64
RATE = 0.3
_CEILING = np.float32(60)


@dataclass
class Model:
    """Rows of ``gate``, ``embed`` and ``spread`` are known ids; the last row stands for all others."""

    gate: np.ndarray
    embed: np.ndarray
    place: np.ndarray
    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    out: np.ndarray
    spread: np.ndarray

    @classmethod
    def start(cls, rows: int, group: np.ndarray, spread: np.ndarray, seed: int = 0) -> Model:
        """A model whose gate follows the group of the present id; the attention starts near nothing."""
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        gate = np.zeros((rows, MIXTURE), dtype=np.float32)
        gate[np.arange(rows), group] = 4
        square = lambda: draw(WIDTH, WIDTH)
        return cls(gate, draw(rows, WIDTH), draw(WINDOW, WIDTH), square(), square(), square(), draw(WIDTH, MIXTURE) * np.float32(0.3), spread)

    @property
    def trained(self) -> list[str]:
        return [f.name for f in fields(self) if f.name != "spread"]


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of texts of so many positions: each one's text, its first position there, and the positions that are context only."""
    count = 1 + np.maximum(0, -(-(lengths - WINDOW) // STEP))
    text = np.repeat(np.arange(len(lengths)), count)
    step = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return text, step * STEP, np.where(step > 0, WINDOW - STEP, 0)


#: Which positions of a window each one sees.
_SEEN = np.tril(np.ones((WINDOW, WINDOW), dtype=np.float32))


class Pass:
    """A model made ready to run: projections of all ids are worked out once."""

    def __init__(self, model: Model):
        self.model = model
        scale = np.float32(1 / np.sqrt(WIDTH))
        self.q, self.k, self.v = model.embed @ model.query * scale, model.embed @ model.key, model.embed @ model.value
        self.pq, self.pk = model.place @ model.query * scale, model.place @ model.key
        # One table of queries, keys, values and a 1 that adds up the weights; and whether any exponent could run over.
        self.all = np.concatenate([self.q, self.k, self.v, np.ones_like(self.v[:, :1])], axis=1)
        self.places = np.concatenate([self.pq, self.pk, np.zeros((WINDOW, WIDTH + 1), dtype=self.all.dtype)], axis=1)
        longest = lambda x, y: np.sqrt((x**2).sum(axis=1).max(initial=0)) + np.sqrt((y**2).sum(axis=1).max(initial=0))
        most = np.abs(model.gate).max(initial=0) + np.abs(self.v).max(initial=0) * np.abs(model.out).sum(axis=0).max(initial=0)
        self.bounded = longest(self.q, self.pq) * longest(self.k, self.pk) < _CEILING and most < _CEILING

    def _exponents(self, x: np.ndarray, seen: np.ndarray | None = None) -> np.ndarray:
        """Exponentials along the last axis, up to a factor; where they could run over or vanish, relative to the largest one seen."""
        if not self.bounded and (x.max() > _CEILING or x.min() < -_CEILING):
            top = (x if seen is None else np.where(seen > 0, x, -np.inf)).max(axis=-1, keepdims=True)
            x = np.minimum(x - top, 0)
        return np.exp(x, out=x)

    def likelihoods(self, ids: np.ndarray, nexts: np.ndarray) -> np.ndarray:
        """Likelihoods of ``nexts`` after the windows ``ids`` (batch x window), position after position."""
        here = self.all[ids]
        here += self.places
        weights = self._exponents(here[..., :WIDTH] @ here[..., WIDTH : 2 * WIDTH].transpose(0, 2, 1), _SEEN)
        weights *= _SEEN
        read = (weights @ here[..., 2 * WIDTH :]).reshape(-1, WIDTH + 1)
        mix = (read[:, :WIDTH] / read[:, WIDTH:]) @ self.model.out
        mix += self.model.gate[ids.ravel()]
        mix = self._exponents(mix)
        return np.einsum("nk,nk->n", mix, self.model.spread[nexts.ravel()]) / (mix @ np.ones(MIXTURE, dtype=mix.dtype))

    def forward(self, ids: np.ndarray, nexts: np.ndarray) -> tuple[np.ndarray, ...]:
        """The same likelihoods, and what the gradients need."""
        q, k, v = self.q[ids] + self.pq, self.k[ids] + self.pk, self.v[ids]
        weights = self._exponents(q @ k.transpose(0, 2, 1), _SEEN)
        weights *= _SEEN
        weights /= weights.sum(axis=-1, keepdims=True)
        read = weights @ v
        mix = read.reshape(-1, WIDTH) @ self.model.out
        mix += self.model.gate[ids.ravel()]
        mix = self._exponents(mix)
        mix /= mix.sum(axis=-1, keepdims=True)
        share = mix * self.model.spread[nexts.ravel()]
        return share.sum(axis=-1), share, mix, weights, read, q, k, v


def cut(starts: np.ndarray, text: np.ndarray, first: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of windows in the row of all positions, and which of them belong to the window's text."""
    inside = first[:, None] + np.arange(WINDOW)
    return np.minimum(starts[text][:, None] + inside, last), inside < np.diff(starts)[text][:, None]


def log_likelihoods(ready: Pass, inputs: np.ndarray, nexts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """log10 p of each text: its ``inputs`` and ``nexts`` lie from its start up to the next one's.

    Each position is scored once, with the earlier positions of its window as context.
    """
    lengths = np.diff(starts)
    text, first, context = windows(lengths)
    out = np.zeros(len(lengths))
    offsets = np.arange(WINDOW)
    for at in range(0, len(text), BATCH):
        t, f, c = (x[at : at + BATCH] for x in (text, first, context))
        place, real = cut(starts, t, f, len(inputs) - 1)
        found = ready.likelihoods(inputs[place], nexts[place]).reshape(len(t), WINDOW)
        logs = np.where(real & (offsets >= c[:, None]), np.log10(np.maximum(found, 1e-30)), 0).sum(axis=1)
        out += np.bincount(t, weights=logs, minlength=len(lengths))
    return out


def _by_row(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of values by row."""
    order = np.argsort(rows, kind="stable")
    ordered = rows[order]
    begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[begins], np.add.reduceat(values[order], begins, axis=0)


@dataclass
class Learner:
    """Trains a copy of ``model`` in place and gathers the expected counts of its distributions."""

    model: Model
    counts: np.ndarray = field(init=False)
    seen: np.ndarray = field(init=False)
    positions: int = 0

    def __post_init__(self) -> None:
        self.counts = np.zeros_like(self.model.spread)
        self.seen = np.zeros(len(self.model.gate), dtype=np.float32)
        self.squares = {n: np.full_like(getattr(self.model, n), 1e-2) for n in self.model.trained}

    def _step(self, name: str, gradient: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        squares = self.squares[name][rows] + gradient * gradient
        self.squares[name][rows] = squares
        getattr(self.model, name)[rows] += np.float32(RATE) * gradient / np.sqrt(squares)

    def learn(self, ids: np.ndarray, nexts: np.ndarray, real: np.ndarray) -> None:
        """One step on a batch of windows; only ``real`` positions count."""
        m = self.model
        used, at = np.unique(ids, return_inverse=True)
        at = at.reshape(ids.shape)
        ready = Pass(replace(m, gate=m.gate[used], embed=m.embed[used]))
        likelihood, share, mix, weights, read, q, k, v = ready.forward(at, nexts)
        real = real.ravel()
        share /= np.maximum(likelihood, 1e-30)[:, None]
        share[~real] = 0
        rows, sums = _by_row(nexts.ravel(), share)
        self.counts[rows] += sums
        n = max(1, int(real.sum()))
        self.positions += n
        toward = share - mix * real[:, None]
        toward /= np.float32(np.sqrt(n))
        d_read = (toward @ m.out.T).reshape(read.shape)
        d_v = weights.transpose(0, 2, 1) @ d_read
        d_weights = d_read @ v.transpose(0, 2, 1)
        d_weights -= (d_weights * weights).sum(axis=-1, keepdims=True)
        d_weights *= weights
        scale = np.float32(1 / np.sqrt(WIDTH))
        d_q = (d_weights @ k) * scale
        d_k = d_weights.transpose(0, 2, 1) @ q
        own = ready.model.embed[at]
        here = own + m.place
        flat = lambda x: x.reshape(-1, WIDTH)
        to_place = flat(d_q) @ m.query.T + flat(d_k) @ m.key.T
        to_embed = to_place + flat(d_v) @ m.value.T
        gradients = {
            "query": flat(here).T @ flat(d_q), "key": flat(here).T @ flat(d_k), "value": flat(own).T @ flat(d_v),
            "out": flat(read).T @ toward, "place": to_place.reshape(-1, WINDOW, WIDTH).sum(axis=0)}
        _, sums = _by_row(at.ravel(), np.concatenate([toward, to_embed], axis=1))
        self._step("gate", sums[:, :MIXTURE], used)
        self._step("embed", sums[:, MIXTURE:], used)
        self.seen[used] += np.bincount(at.ravel()[real], minlength=len(used))
        for name, gradient in gradients.items():
            self._step(name, gradient)
