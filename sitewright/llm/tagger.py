"""A character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np

from sitewright.llm.recurrent import reader as onnx_reader

PAD, OTHER, BREAK, BLANK, UPPER, LOWER, DIGIT = range(7)
_FIRST = 7
_AT_ONCE = 1024  # texts in step
_FEW = 64  # texts whose moves are added up at once
_LENGTHS = (40, 120)  # stretches up to each of them, and the longer ones, are decoded apart


def _symbols() -> np.ndarray:
    """The symbol of each code point below 0x2000: digits alike, letters beyond ASCII by case, other ASCII its own."""
    table = np.full(0x2000, OTHER, np.uint8)
    for code in range(0x2000):
        ch = chr(code)
        if ch == "\n":
            table[code] = BREAK
        elif ch.isspace():
            table[code] = BLANK
        elif ch.isdigit():
            table[code] = DIGIT
        elif 32 < code < 127:
            table[code] = _FIRST + code - 33
        elif ch.isalpha():
            table[code] = UPPER if ch.isupper() else LOWER
    return table


_TABLE = _symbols()
SYMBOLS = _FIRST + 94


def encode(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < len(_TABLE), _TABLE[np.minimum(codes, len(_TABLE) - 1)], OTHER).astype(np.uint8)


def encode_batch(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols, time by text, and lengths."""
    size = np.asarray([len(t) for t in texts])
    flat = encode("".join(texts))
    out = np.zeros((size.max(initial=0), len(texts)), np.uint8)
    column = np.repeat(np.arange(len(texts)), size)
    row = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out[row, column] = flat
    return out, size


@dataclass
class Tagger:
    """Weights: input tables and recurrent matrices of both directions, the output layer, and the CRF."""

    tags: list[str]
    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, tags: Sequence[str], hidden: int, seed: int = 0) -> Tagger:
        r = np.random.default_rng(seed)
        w: dict[str, np.ndarray] = {}
        for d in "fb":
            w[f"in_{d}"] = r.normal(0, 0.3, (SYMBOLS, 4 * hidden)).astype(np.float32)
            w[f"in_{d}"][:, hidden : 2 * hidden] += 1  # gates: input, forget, output, cell
            w[f"rec_{d}"] = r.normal(0, hidden**-0.5, (hidden, 4 * hidden)).astype(np.float32)
        w["out"] = r.normal(0, (2 * hidden) ** -0.5, (2 * hidden, len(tags))).astype(np.float32)
        w["bias"] = np.zeros(len(tags), np.float32)
        w["move"] = np.zeros((len(tags), len(tags)), np.float32)
        w["start"] = np.zeros(len(tags), np.float32)
        return cls(list(tags), w)

    @classmethod
    def load(cls, path: str) -> Tagger:
        with np.load(path) as f:
            return cls([str(t) for t in f["tags"]], {k: f[k].astype(np.float32) for k in f.files if k != "tags"})

    def save(self, path: str) -> None:
        np.savez_compressed(path, tags=np.asarray(self.tags), **{k: v.astype(np.float16) for k, v in self.weights.items()})

    @property
    def hidden(self) -> int:
        return self.weights["rec_f"].shape[0]

    def allowed(self) -> np.ndarray:
        """Which tag may follow which: an inside tag only its own kind."""
        ok = np.ones((len(self.tags), len(self.tags)), bool)
        for j, t in enumerate(self.tags):
            if t[0] == "I":
                ok[:, j] = [p[1:] == t[1:] for p in self.tags]
        return ok

    def _direction(self, d: str, symbols: np.ndarray):
        steps, width = symbols.shape
        h_size = self.hidden
        table, rec = self.weights[f"in_{d}"].copy(), self.weights[f"rec_{d}"].copy()
        table[:, : 3 * h_size] *= 0.5  # sigmoid(x) = tanh(x / 2) / 2 + 1 / 2
        rec[:, : 3 * h_size] *= 0.5
        h, c = np.zeros((width, h_size), np.float32), np.zeros((width, h_size), np.float32)
        out = np.empty((steps, width, h_size), np.float32)
        saved = np.empty((steps, width, 4 * h_size), np.float32), np.empty((steps, width, h_size), np.float32)
        z = np.empty((width, 4 * h_size), np.float32)
        for t in range(steps):
            np.matmul(h, rec, out=z)
            z += table[symbols[t]]
            np.tanh(z, out=z)
            gates = z[:, : 3 * h_size]
            gates *= 0.5
            gates += 0.5
            c = z[:, h_size : 2 * h_size] * c
            c += z[:, :h_size] * z[:, 3 * h_size :]
            h = np.tanh(c)
            h *= z[:, 2 * h_size : 3 * h_size]
            out[t] = h
            saved[0][t], saved[1][t] = z, c
        return out, saved

    def _prepared(self, d: str) -> tuple[np.ndarray, np.ndarray]:
        """Input tables and recurrent matrices, a gate each, of states twice as large and halved sums: sigmoid(x) = (1 + tanh(x / 2)) / 2.
        The backward direction begins at the filling: there ``PAD`` closes all gates, so that the states stay at 0."""
        h = self.hidden
        into, rec = self.weights[f"in_{d}"].copy(), self.weights[f"rec_{d}"] * np.float32(0.5)
        if d == "b":
            into[PAD] = [-100.0] * (3 * h) + [0.0] * h
        into[:, : 3 * h] *= 0.5
        rec[:, : 3 * h] *= 0.5
        return tuple(np.ascontiguousarray(m.reshape(len(m), 4, h).swapaxes(0, 1), np.float32) for m in (into, rec))

    def _read(self, d: str, symbols: np.ndarray) -> np.ndarray:
        """The states of one direction as ``_direction`` has them."""
        into, rec = self._prepared(d)
        steps, width = symbols.shape
        n = self.hidden
        places = symbols.astype(np.intp)
        h, c = np.zeros((width, n), np.float32), np.zeros((width, n), np.float32)
        out = np.empty((steps, width, n), np.float32)
        z, given = np.empty((4, width, n), np.float32), np.empty((4, width, n), np.float32)
        gates = z[:3]
        for t in range(steps):
            for some, x, table, matrix in zip(z, given, into, rec, strict=True):
                np.matmul(h, matrix, out=some)
                table.take(places[t], 0, x, "clip")
            z += given
            np.tanh(z, out=z)
            gates += 1
            c *= z[1]
            z[0] *= z[3]
            c += z[0]
            c *= np.float32(0.5)
            h = out[t]
            np.tanh(c, out=h)
            h *= z[2]
        out *= np.float32(0.5)
        return out

    @staticmethod
    def _reversal(size: np.ndarray, steps: int) -> np.ndarray:
        at = size[None, :] - 1 - np.arange(steps)[:, None]
        return np.where(at >= 0, at, np.arange(steps)[:, None])

    def scores(self, symbols: np.ndarray, size: np.ndarray, keep: bool = False, read: Callable[[np.ndarray], np.ndarray] | None = None):
        """Scores of the tags, time by text by tag, less that of the first tag, by ``read`` or ``reader()``; with ``keep`` the
        scores themselves and what the gradient needs."""
        if not keep:
            return (read or self.reader())(symbols)
        back = self._reversal(size, len(symbols))
        turned = np.take_along_axis(symbols, back, 0)
        (forth, saved_f), (behind, saved_b) = self._direction("f", symbols), self._direction("b", turned)
        both = np.concatenate([forth, np.take_along_axis(behind, back[:, :, None], 0)], 2)
        return both @ self.weights["out"] + self.weights["bias"], (symbols, back, forth, behind, both, saved_f, saved_b)

    def reader(self) -> Callable[[np.ndarray], np.ndarray]:
        """A function from symbols to scores (time by text by tag, less that of the first tag) with the weights of now: ONNX
        Runtime's, or numpy's where that isn't installed."""
        return onnx_reader(self.weights, PAD) or self._relative

    def _relative(self, symbols: np.ndarray) -> np.ndarray:
        out, bias, n = self.weights["out"], self.weights["bias"], self.hidden
        out = out - out[:, :1]
        scores = self._read("f", symbols) @ out[:n]
        scores += (self._read("b", symbols[::-1]) @ out[n:])[::-1]
        scores += bias - bias[0]
        return scores

    def decode(self, texts: Sequence[str], read: Callable[[np.ndarray], np.ndarray] | None = None) -> list[np.ndarray]:
        """The best tag sequence of each text (Viterbi, on the stretches where it can leave the first tag). ``read`` is ``reader()``, if there is one already."""
        order = np.argsort([len(t) for t in texts], kind="stable")
        out: list[np.ndarray] = [np.empty(0, np.int8)] * len(texts)
        read = read or self.reader()
        for begin in range(0, len(order), _AT_ONCE):
            some = order[begin : begin + _AT_ONCE]
            symbols, size = encode_batch([texts[i] for i in some])
            if not len(symbols):
                continue
            paths = self._best_paths(self.scores(symbols, size, read=read), size)
            for k, i in enumerate(some):
                out[i] = paths[: size[k], k]
        return out

    def _best_paths(self, scores: np.ndarray, size: np.ndarray) -> np.ndarray:
        """What ``_viterbi`` finds, worked out only where ``_hopeful`` and ``_open`` say that the first tag isn't certain."""
        whole = np.zeros(scores.shape[:2], np.int8)
        texts = np.flatnonzero(self._hopeful(scores, size))
        if len(texts):
            whole[:, texts] = self._open_paths(np.ascontiguousarray(scores[:, texts].transpose(0, 2, 1)).transpose(0, 2, 1), size[texts])
        return whole

    def _open_paths(self, scores: np.ndarray, size: np.ndarray) -> np.ndarray:
        paths = np.zeros(scores.shape[:2], np.int8)
        some, strong = (x.T.astype(np.int8) for x in self._open(scores, size))
        edges = np.diff(some, axis=1, prepend=0, append=0)
        text, begin = np.nonzero(edges == 1)
        end = np.nonzero(edges == -1)[1]
        before = np.cumsum(np.pad(strong, ((0, 0), (1, 0))), axis=1, dtype=np.int32)
        text, begin, end = (x[before[text, end] > before[text, begin]] for x in (text, begin, end))
        first, last = np.maximum(begin - 1, 0), np.minimum(end + 1, size[text])  # with the certain neighbour on either side
        order = np.argsort(last - first, kind="stable")
        cuts = [*np.searchsorted((last - first)[order], _LENGTHS), *range(0, len(order), 8 * _AT_ONCE), len(order)]
        for k, until in itertools.pairwise(np.unique(cuts)):
            some = order[k:until]
            at, length = first[some], (last - first)[some]
            place = at + np.minimum(np.arange(length.max())[:, None], length - 1)
            part = scores[place, text[some]]
            certain = (place < begin[some]) | (place >= end[some])
            part[certain, 1:] = -1e6
            found = self._viterbi(part, length, at == 0)
            live = np.arange(len(place))[:, None] < length
            paths[place[live], np.broadcast_to(text[some], place.shape)[live]] = found[live]
        return paths

    def _open(self, scores: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the best path may have another tag than the first, and strong places (time by text): of the stretches of
        the former those without one of the latter have the first tag throughout.

        The first tag may take the place of any span, and of all spans of a row with none of it between. A span is on the best
        path only if that loses nothing even with the best moves into, in and out of it. Of the spans of such a row one at
        least, the strong one, wins with the move into it from the first tag and the best move out of it that leaves the next
        span that move.
        """
        steps, width = scores.shape[:2]
        live = np.arange(steps)[:, None] < size
        last = np.arange(steps)[:, None] == size - 1
        some, strong = np.zeros((steps, width), bool), np.zeros((steps, width), bool)
        for begin, inside, enter, leave, loose_enter, loose_leave, onward, second in self._margins():
            gain = scores[:, :, begin] - scores[:, :, 0]  # of a span's first place
            total = np.zeros((steps, width), np.float32)  # of the further ones, added up
            if inside:
                within = scores[:, :, inside] - scores[:, :, 0]
                within += np.float32(onward)
                np.cumsum(within, axis=0, out=total)
                gain += np.float32(second)
            else:
                total -= np.arange(steps, dtype=np.float32)[:, None] * 1e4  # no span of two places
            gain -= total
            best = np.maximum.accumulate(gain, axis=0)
            total[last] -= min(0.0, leave, loose_leave)  # nothing follows
            total[~live] = -np.inf
            best += np.maximum.accumulate(total[::-1], axis=0)[::-1]
            some |= best >= -0.05 - loose_enter - loose_leave
            strong |= best >= -0.05 - enter - leave
        return some & live, strong & live

    def _margins(self) -> list[tuple[int, int | None, float, float, float, float, float, float]]:
        """Of each kind: its first and its inside tag (None without one), what the moves into and out of a span gain over the first
        tag's at most (strong, then loose), what one within it gains, and how much more the one to its second place can."""
        move = np.where(self.allowed(), self.weights["move"], -np.inf)
        start = self.weights["start"]
        begins = [k for k, t in enumerate(self.tags) if t[0] == "B"]
        enter = {k: max(float(move[0, k] - move[0, 0]), float(start[k] - start[0])) for k in begins}
        out = []
        for begin in begins:
            kind = [k for k, t in enumerate(self.tags) if t[1:] == self.tags[begin][1:]]
            inside = kind[1] if len(kind) > 1 else None
            loose_enter = max(float((move[:, begin] - move[:, 0]).max()), float(start[begin] - start[0]))
            loose_leave = float(max((move[k, q] - move[0, q]) for k in kind for q in [0, *begins]))
            leave = float(max([*(move[k, 0] - move[0, 0] for k in kind), *(move[k, q] - move[0, 0] - enter[q] for k in kind for q in begins)]))
            onward = float(move[inside, inside] - move[0, 0]) if inside else 0.0
            second = max(0.0, float(move[begin, inside] - move[inside, inside])) if inside else 0.0
            out.append((begin, inside, enter[begin], leave, loose_enter, loose_leave, onward, second))
        return out

    def _hopeful(self, scores: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Which texts have a strong place (see ``_open``): the best span that ends at a place begins there or goes on from the one
        before. All tags of all texts are one row, in which a kind's inside tag follows its first one; the others take no part."""
        steps, width, n = scores.shape
        margins = self._margins()
        if any(inside != begin + 1 for begin, inside, *_ in margins):
            return np.ones(width, bool)
        inside = [m[1] for m in margins]
        _, _, enter, leave, _, loose_leave, onward, second = np.asarray(margins, np.float32).T
        if scores[:, :, 0].any():
            scores = scores - scores[:, :, :1]
        rows = np.ascontiguousarray(scores).reshape(steps, width * n)
        more, least = np.full((width, n), -1e6, np.float32), np.zeros((width, n), np.float32)
        more[:, inside], least[:, inside] = onward, second
        more, least = more.reshape(-1)[1:], least.reshape(-1)[1:]
        need = -0.1 - enter - leave
        need_last = need + np.minimum(0, np.minimum(leave, loose_leave))  # nothing follows
        now, best = np.full((2, width * n), -1e6, np.float32)
        fresh = np.empty(width * n - 1, np.float32)
        hope = np.zeros(width, bool)
        ends: dict[int, np.ndarray] = {int(x) - 1: np.flatnonzero(size == x) for x in np.unique(size)}
        for t, row in enumerate(rows):
            going = now[1:]
            going += row[1:]
            going += more
            np.add(row[:-1], least, out=fresh)
            np.maximum(going, fresh, out=going)
            np.maximum(best, now, out=best)
            if t in ends:
                some = ends[t]
                hope[some] = (now.reshape(width, n)[some][:, inside] >= need_last).any(1) | (best.reshape(width, n)[some][:, inside] >= need).any(1)
        return hope

    def _only_outside(self, scores: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Texts whose best path has the first tag throughout: no other tag gains on it anywhere, even with the best moves."""
        move, start = self.weights["move"], self.weights["start"]
        moves = max(0.0, float(move.max() - move[0, 0]), float(start.max() - start[0]))
        gain = (scores[:, :, 1:].max(2) - scores[:, :, 0] + 2 * moves).astype(np.float32)
        gain[np.arange(len(scores))[:, None] >= size[None]] = -1
        return (gain < 0).all(0)

    def _viterbi(self, scores: np.ndarray, size: np.ndarray, starts: np.ndarray | bool = True) -> np.ndarray:
        """The best paths; where each step came from is worked out again on the way back, for the taken states only.
        ``starts`` tells which of them begin their text; the others have the first tag before them."""
        steps, width, n = scores.shape
        move = np.where(self.allowed(), self.weights["move"], np.float32(-1e4)).astype(np.float32)
        first = np.asarray([0 if t[0] != "I" else -1e4 for t in self.tags], np.float32)
        best = scores.transpose(0, 2, 1).copy()  # tag by text, as texts are many
        best[0] += np.where(starts, (self.weights["start"] + first)[:, None], move[0][:, None])
        now, through = np.empty((n, width), np.float32), np.empty((n, width), np.float32)
        for t in range(1, steps):
            before = best[t - 1]
            if width <= _FEW:
                best[t] += (before[:, None] + move[:, :, None]).max(0)
                continue
            np.add(before[:1], move[0][:, None], out=now)
            for k in range(1, n):
                np.add(before[k], move[k][:, None], out=through)
                np.maximum(now, through, out=now)
            best[t] += now
        paths = np.zeros((steps, width), np.int8)
        state = np.zeros(width, np.int64)
        for t in range(steps - 1, -1, -1):
            if t + 1 < steps:
                state = (best[t] + move[:, state]).argmax(0)
            ends = size - 1 == t
            if ends.any():
                state[ends] = best[t][:, ends].argmax(0)
            paths[t] = state
        return paths

    def loss_and_gradient(self, symbols: np.ndarray, size: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the gold tags (time by text), and its gradient."""
        scores, state = self.scores(symbols, size, keep=True)
        steps, width, n = scores.shape
        move, start = self.weights["move"], self.weights["start"]
        live = np.arange(steps)[:, None] < size[None]
        alpha, beta = np.empty_like(scores), np.zeros_like(scores)
        alpha[0] = scores[0] + start
        for t in range(1, steps):
            x = alpha[t - 1][:, :, None] + move[None]
            m = x.max(1)
            alpha[t] = np.where(live[t][:, None], m + np.log(np.exp(x - m[:, None]).sum(1)) + scores[t], alpha[t - 1])
        m = alpha[-1].max(1)
        z = m + np.log(np.exp(alpha[-1] - m[:, None]).sum(1))
        d_move = np.zeros_like(move)
        for t in range(steps - 1, 0, -1):
            x = move[None] + (scores[t] + beta[t])[:, None, :]
            m = x.max(2)
            beta[t - 1] = np.where(live[t][:, None], m + np.log(np.exp(x - m[:, :, None]).sum(2)), beta[t])
            pair = np.exp(alpha[t - 1][:, :, None] + x - z[:, None, None]) * live[t][:, None, None]
            d_move += pair.sum(0)
            np.subtract.at(d_move, (gold[t - 1][live[t]], gold[t][live[t]]), 1)
        d = np.exp(alpha + beta - z[None, :, None]) * live[:, :, None]
        cols = np.arange(width)
        at = scores[np.arange(steps)[:, None], cols[None], gold]
        likely = (at * live).sum() + start[gold[0]].sum() + (move[gold[:-1], gold[1:]] * live[1:]).sum()
        d[np.arange(steps)[:, None], cols[None], gold] -= live
        grad = {"move": d_move / width, "start": d[0].sum(0) / width}
        d /= width
        symbols, back, forth, behind, both, saved_f, saved_b = state
        grad["out"] = np.tensordot(both, d, ([0, 1], [0, 1]))
        grad["bias"] = d.sum((0, 1))
        d_both = d @ self.weights["out"].T
        h = self.hidden
        self._back("f", symbols, forth, saved_f, d_both[:, :, :h], grad)
        self._back("b", np.take_along_axis(symbols, back, 0), behind, saved_b, np.take_along_axis(d_both[:, :, h:], back[:, :, None], 0), grad)
        return float((z.sum() - likely) / width), grad

    def _back(self, d: str, symbols: np.ndarray, out: np.ndarray, saved: tuple, d_out: np.ndarray, grad: dict) -> None:
        steps, width, h = out.shape
        rec = self.weights[f"rec_{d}"]
        z_all, c_all = saved
        d_in = np.zeros_like(self.weights[f"in_{d}"])
        d_rec = np.zeros_like(rec)
        dh, dc = np.zeros((width, h), np.float32), np.zeros((width, h), np.float32)
        zero = np.zeros((width, h), np.float32)
        dz_all = np.empty((steps, width, 4 * h), np.float32)
        for t in range(steps - 1, -1, -1):
            z, c = z_all[t], c_all[t]
            i, f, o, g = (z[:, k * h : (k + 1) * h] for k in range(4))
            before = c_all[t - 1] if t else zero
            dh = dh + d_out[t]
            tc = np.tanh(c)
            dc = dc + dh * o * (1 - tc * tc)
            dz = dz_all[t]
            dz[:, :h] = dc * g * i * (1 - i)
            dz[:, h : 2 * h] = dc * before * f * (1 - f)
            dz[:, 2 * h : 3 * h] = dh * tc * o * (1 - o)
            dz[:, 3 * h :] = dc * i * (1 - g * g)
            if t:
                d_rec += out[t - 1].T @ dz
            dh = dz @ rec.T
            dc = dc * f
        flat, kinds = dz_all.reshape(-1, 4 * h), symbols.reshape(-1)
        order = np.argsort(kinds, kind="stable")
        present, at = np.unique(kinds[order], return_index=True)
        d_in[present] = np.add.reduceat(flat[order], at, axis=0)
        grad[f"in_{d}"], grad[f"rec_{d}"] = d_in, d_rec


def _gradient_of(given: tuple) -> tuple[int, float, dict[str, np.ndarray]]:
    tags, weights, texts, golds = given
    symbols, length = encode_batch(texts)
    gold = np.zeros(symbols.shape, np.int64)
    for c, some in enumerate(golds):
        gold[: length[c], c] = some
    return len(texts), *Tagger(tags, weights).loss_and_gradient(symbols, length, gold)


def train(tagger: Tagger, texts: Sequence[str], tags: Sequence[np.ndarray], epochs: int = 6, batch: int = 128, rate: float = 4e-3, seed: int = 0, report=None, run=map, shares: int = 1) -> Tagger:
    """Fit by Adam on batches of texts of like length; the rate falls to a twentieth over the epochs. ``run`` works out the
    gradients of a batch's ``shares``, as ``map`` does or as a pool of processes does."""
    r = np.random.default_rng(seed)
    size = np.asarray([len(t) for t in texts])
    mean = {k: np.zeros_like(v) for k, v in tagger.weights.items()}
    square = {k: np.zeros_like(v) for k, v in tagger.weights.items()}
    total, step = epochs * -(-len(texts) // batch), 0
    for epoch in range(epochs):
        order = np.argsort(size + r.uniform(0, 12, len(size)), kind="stable")
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        lost = 0.0
        for k in r.permutation(len(groups)):
            some = groups[k]
            given = [(tagger.tags, tagger.weights, [texts[i] for i in part], [tags[i] for i in part]) for part in np.array_split(some, shares) if len(part)]
            found = list(run(_gradient_of, given))
            loss = sum(n * x for n, x, _ in found) / len(some)
            grad = {name: sum(n * g[name] for n, _, g in found) / len(some) for name in found[0][2]}
            lost += loss
            step += 1
            norm = float(np.sqrt(sum((g * g).sum() for g in grad.values())))
            scale = min(1.0, 5.0 / (norm + 1e-9))
            now = rate * (0.05 + 0.95 * 0.5 * (1 + np.cos(np.pi * step / total)))
            for name, g in grad.items():
                g = g * scale
                mean[name] += 0.1 * (g - mean[name])
                square[name] += 0.001 * (g * g - square[name])
                m, s = mean[name] / (1 - 0.9**step), square[name] / (1 - 0.999**step)
                tagger.weights[name] -= (now * m / (np.sqrt(s) + 1e-8)).astype(np.float32)
        if report:
            report(epoch, lost / len(groups), tagger)
    return tagger
