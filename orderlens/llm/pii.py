"""Personal data: a character-level bidirectional LSTM with CRF transitions, in numpy.

The gates are piecewise linear and the cells' squashing function is a quotient close to tanh
(``_gate``, ``_squash``), in training as in scoring: exponentials were most of the scoring time.

Labelled spans come from the base patterns and go beyond them: each sampled window with a
base span also serves with that span rewritten into forms that the patterns do not take
(spelled-out addresses, spaced or bracketed dots, phone numbers without a plus sign, cards with
other separators), and prose windows also serve with dates, versions, prices and
hexadecimal strings put in, which are not personal data. The sample is bounded (SAMPLE).

Then every window of every text is scored, whatever characters it holds; overlapping windows
are decoded by Viterbi and reconciled over the whole text: each character takes the tag of
the window in which it is nearest the middle. Viterbi runs only on the parts of windows whose
emissions do not prove that the best path is outside there (``Tagger.outside``,
``Tagger.open_parts``, exact). The last window of a text is half as wide where that holds the rest. Confident
spans that touch no base span, cut no word and hold what their kind needs
(``plausible``) are added; base spans always stay.

Defined cases: a null or empty text has no spans; a very long text is cut into more windows; an
empty table gives an empty table; repeated rows are searched each for itself; input columns
pass through inside ``doc``, whatever their names; without labelled spans the model is not
trained and adds nothing.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.shared import map_text, text_or_empty

#: fixed values: kinds in the order of the contract, and their base patterns
KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TAGS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
#: characters of a training window; of a scored window; from one scored window to the next
WINDOW, SCORED, ADVANCE = 96, 512, 456
#: labelled windows taken from the texts at most (those with the smallest hash)
SAMPLE = 1536
HIDDEN, EMBED, EPOCHS, BATCH, RATE = 16, 12, 8, 96, 0.04
#: an added span's characters must have at least this mean probability
SURE = 0.9
#: scored windows in one numpy step
TOGETHER = 1024
#: every ASCII character has a symbol; other digits share one, all other characters 30 by code
SYMBOL_COUNT = 160
DIGIT, PAD = 128, 10


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _valid(kind: str, match: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in match.split("."))
    if kind == "email":
        return True
    digits = re.sub("[^0-9]", "", match)
    return 12 <= len(digits) <= 19 and _luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


_FIND = {k: re.compile(p.replace("]+@", "]++@")).finditer for k, p in PATTERNS.items()}
_MARKED, _MARKS = re.compile("[0-9@]").search, re.compile("[0-9@]").finditer
_NEED = {"email": "@", "ip": ".", "card": "", "phone": "+"}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of valid base matches, by start and kind."""
    out = []
    for k, kind in enumerate(KINDS):
        if _NEED[kind] in text:
            out += [(m.start(), m.end(), k) for m in _FIND[kind](text) if _valid(kind, m[0])]
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def symbols(text: str) -> np.ndarray:
    """Character symbols of a text."""
    if text.isascii():
        return np.frombuffer(text.encode(), np.uint8)
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    out = np.where(code < 128, code, 129 + code % 31).astype(np.uint8)
    for at in np.flatnonzero(code >= 0x660).tolist() if len(code) and code.max() >= 0x660 else []:
        if text[at].isdigit():
            out[at] = DIGIT
    return out


def window_starts(size: int) -> np.ndarray:
    """Starts of the scored windows of a text: together they cover all of it."""
    return np.arange(0, max(size - SCORED + ADVANCE, 1), ADVANCE) if size else np.zeros(0, np.int64)


#: a name, an at sign or word, a host, a dot or the word for it, and a domain
_ADDRESS = re.compile(r"(?i)\w.*?(@|[\W_]at[\W_]).*?\w(\.|[\W_]dot[\W_]).*[^\W\d_]{2}").match


def plausible(kind: int, found: str) -> bool:
    """What a span of a kind must hold at least, in any form it is written in."""
    digits = [str(unicodedata.digit(c)) for c in found if unicodedata.digit(c, None) is not None]
    if KINDS[kind] == "phone":
        return 7 <= len(digits) <= 15
    if KINDS[kind] == "card":
        return 12 <= len(digits) <= 19 and _luhn("".join(digits))
    if KINDS[kind] == "ip":
        numbers = re.findall(r"\d+", found)
        return len(numbers) == 4 and all(len(n) <= 3 and int(n) <= 255 for n in numbers)
    return len(found) <= 254 and bool(_ADDRESS(found))


def cuts_word(text: str, a: int, b: int) -> bool:
    """Whether [a, b) starts or ends inside a word or at white space."""
    return (a > 0 and text[a - 1].isalnum() and text[a].isalnum()) or \
        (b < len(text) and text[b].isalnum() and text[b - 1].isalnum()) or text[a].isspace() or text[b - 1].isspace()


# --------------------------------------------------------------------------- labelled forms

def _digits(r, n: int) -> str:
    return "".join(map(str, r.integers(0, 10, n)))


def _pick(r, items):
    return items[int(r.integers(len(items)))]


def _word(r, words: list[str]) -> str:
    return _pick(r, words) if words and r.random() < 0.8 else "".join(chr(97 + c) for c in r.integers(0, 26, int(r.integers(3, 9))))


def rewritten(kind: str, found: str, r, words: list[str]) -> str:
    """A form of a base match that names the same kind of data and that the patterns do not take."""
    if kind == "email":
        name, host = found.split("@", 1)
        if r.random() < 0.7:
            name = _word(r, words) + _pick(r, ["", "." + _word(r, words), _digits(r, 2)])
            host = _word(r, words) + "." + _pick(r, ["com", "org", "net", "de", "fr", "es", "example", "example.com"])
        at, dot = _pick(r, [(" at ", " dot "), (" @ ", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", "."), (" AT ", " DOT "), (" at ", ".")])
        return name.replace(".", dot if r.random() < 0.5 else ".") + at + host.replace(".", dot)
    if kind == "ip":
        dot = _pick(r, ["[.]", " . ", " dot ", "(.)", "[dot]"])
        return dot.join(str(int(n)) for n in r.integers(0, 256, 4))
    if kind == "card":
        digits = re.sub("[^0-9]", "", found)
        sep = _pick(r, [".", "/", "_", "  ", " - "])
        return sep.join(digits[i:i + 4] for i in range(0, len(digits), 4))
    a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
    return _pick(r, [f"({a}) {b}-{c}", f"0{a} {b} {c[:2]} {c[2:]}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00 1 {a} {b} {c}", f"{a} {b} {c}", f"0{a}/{b}{c}"])


def harmless(r, words: list[str]) -> str:
    """A piece of text with digits, or with the words of spelled-out addresses, that is no personal data."""
    n = [int(x) for x in r.integers(1, 28, 4)]
    return _pick(r, [f"20{n[0]:02}-{n[1] % 12 + 1:02}-{n[2]:02}", f"{n[0]}/{n[1]}/20{n[2]:02}", f"{n[0]}:{n[1]:02}", f"version {n[0]}.{n[1]}.{n[2]}", f"{n[0]}.{n[1]}",
                     f"${n[0]},{_digits(r, 3)}.{_digits(r, 2)}", f"{_digits(r, int(r.integers(1, 7)))}", f"{n[0]} - {n[1]}", f"{_digits(r, 4)} to {_digits(r, 4)}",
                     bytes(r.integers(0, 256, 12, dtype=np.uint8)).hex(), f"at {_word(r, words)} dot", f"{_word(r, words)} at {_word(r, words)}",
                     f"the dot {_word(r, words)}", f"@{_word(r, words)}", f"{_digits(r, 3)},{_digits(r, 3)},{_digits(r, 3)}", f"no. {_digits(r, 5)}",
                     " ".join([_word(r, words)] * 14), f"{_word(r, words)}. At {_word(r, words)}", f"{_word(r, words)} at at {_word(r, words)}."])


def _fit_window(text: str, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kinds, y = np.full(WINDOW, PAD, np.int64), np.zeros(WINDOW, np.int64)
    n = min(len(text), WINDOW)
    kinds[:n], y[:n] = symbols(text)[:n], tags[:n]
    return kinds, y


def training_set(sample: list[tuple[str, bytes]], seed: int = 5, least: int = 4, rewrites: int = 2400) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, tags) of the sampled windows and of their rewritten copies: about ``rewrites`` of
    those, at least ``least`` and at most 40 for each window with a span."""
    r = np.random.default_rng(seed)
    copies = max(least, min(40, rewrites // max(1, sum(any(y) for _, y in sample))))
    words = sorted({w for t, _ in sample for w in re.findall(r"[A-Za-z]{3,9}", t)})
    out = []
    for text, raw in sample:
        tags = np.frombuffer(raw, np.int8).astype(np.int64)
        out.append(_fit_window(text, tags))
        found = [(a, b, k) for a, b, k, _ in spans_of(tags, np.ones(len(tags))) if re.fullmatch(PATTERNS[KINDS[k]], text[a:b])]
        for _ in range(copies if found else 1):
            if found:
                a, b, k = _pick(r, found)
                new = rewritten(KINDS[k], text[a:b], r, words)
                y = np.full(len(new), 2 + 2 * k, np.int64)
                y[0] = 1 + 2 * k
            else:
                a = b = _pick(r, [m.start() for m in re.finditer(" ", text)] or [0])
                new = " " + harmless(r, words)
                y = np.zeros(len(new), np.int64)
            out.append(_fit_window(text[:a] + new + text[b:], np.concatenate([tags[:a], y, tags[b:]])))
    return tuple(np.stack(x) for x in zip(*out))


def _gate(z, out=None):
    """The piecewise linear sigmoid of already halved and shifted sums: a clip to 0..1."""
    return np.clip(z, 0, 1, out=out)


def _squash(x, out=None, more=None):
    """x (27 + x^2) / (27 + 9 x^2) up to |x| = 3, where it is 1 with slope 0: tanh within 0.024, from sums and
    one quotient. ``out`` may be ``x``; ``more`` is room for as much again."""
    x = np.clip(x, -3, 3, out=out)
    s = np.multiply(x, x, out=more)
    s += 3
    s = np.divide(8 / 3, s, out=more)
    s += 1 / 9
    return np.multiply(x, s, out=out)


def _squash_slope(x):
    s = np.minimum(x * x, 9)
    return ((9 - s) / (3 * (3 + s))) ** 2


class Tagger:
    """Embedding, one LSTM in each direction, emissions, CRF transitions. Arrays are [window, time, ...]."""

    def __init__(self, seed: int = 9):
        r = np.random.default_rng(seed)
        t, n = len(TAGS), 4 * HIDDEN
        self.p = {"embed": r.normal(0, 0.5, (SYMBOL_COUNT, EMBED)), "out": r.normal(0, 0.2, (2 * HIDDEN, t)), "out_b": np.zeros(t), "move": np.zeros((t, t))}
        for d in "fb":
            self.p |= {f"{d}x": r.normal(0, 0.3, (EMBED, n)), f"{d}h": r.normal(0, 0.2, (HIDDEN, n)), f"{d}b": np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)])}

    @classmethod
    def of(cls, weights: dict) -> Tagger:
        """A tagger from its weights (what a broadcast carries)."""
        out = cls.__new__(cls)
        out.p = weights
        return out

    def _lstm(self, x, d):
        """States [time, state, window] of inputs [time, input, window], and what :meth:`_lstm_back` needs."""
        p, (n, _, b) = self.p, x.shape
        h, c, kept = np.zeros((HIDDEN, b), x.dtype), np.zeros((HIDDEN, b), x.dtype), []
        inputs = np.matmul(p[d + "x"].T, x) + p[d + "b"][:, None]
        move, out = np.ascontiguousarray(p[d + "h"].T), np.empty((n, HIDDEN, b), x.dtype)
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            z = inputs[t]
            z += move @ h
            gate = _gate(z[:3 * HIDDEN] * 0.25 + 0.5)
            f, i, o = gate[:HIDDEN], gate[HIDDEN:2 * HIDDEN], gate[2 * HIDDEN:]
            g = _squash(z[3 * HIDDEN:])
            before_h, before_c, c = h, c, f * c + i * g
            e = _squash(c)
            h = out[t] = o * e
            kept.append((t, gate, z, g, before_h, before_c, c, e))
        return out, kept

    def _lstm_back(self, x, d, kept, dout, grads):
        p, (n, _, b) = self.p, x.shape
        dh, dc = np.zeros((HIDDEN, b), x.dtype), np.zeros((HIDDEN, b), x.dtype)
        every, before = np.empty((n, 4 * HIDDEN, b), x.dtype), np.empty((n, HIDDEN, b), x.dtype)
        for t, gate, z, g, before_h, before_c, c, e in reversed(kept):
            dh = dh + dout[t]
            f, i, o = gate[:HIDDEN], gate[HIDDEN:2 * HIDDEN], gate[2 * HIDDEN:]
            dc = dc + dh * o * _squash_slope(c)
            dz = every[t]
            np.multiply(dc, before_c, out=dz[:HIDDEN])
            np.multiply(dc, g, out=dz[HIDDEN:2 * HIDDEN])
            np.multiply(dh, e, out=dz[2 * HIDDEN:3 * HIDDEN])
            np.multiply(dc * i, _squash_slope(z[3 * HIDDEN:]), out=dz[3 * HIDDEN:])
            dz[:3 * HIDDEN] *= 0.25
            dz[:3 * HIDDEN] *= (gate > 0) & (gate < 1)
            before[t] = before_h
            dh, dc = p[d + "h"] @ dz, dc * f
        grads[d + "x"] += np.matmul(x, every.transpose(0, 2, 1)).sum(0)
        grads[d + "h"] += np.matmul(before, every.transpose(0, 2, 1)).sum(0)
        grads[d + "b"] += every.sum((0, 2))
        return np.matmul(p[d + "x"], every)

    def emissions(self, kinds):
        x = np.ascontiguousarray(self.p["embed"][kinds].transpose(1, 2, 0))
        f, kf = self._lstm(x, "f")
        b, kb = self._lstm(x, "b")
        h = np.concatenate([f, b], 1)
        e = np.matmul(self.p["out"].T, h) + self.p["out_b"][:, None]
        return np.ascontiguousarray(e.transpose(2, 0, 1)), (x, h, kf, kb)

    def marginals(self, e):
        """(log normalizer, tag marginals, expected transitions) by forward and backward sums, each
        step's scaled to sum to 1."""
        b, n, t = e.shape
        top, most = e.max(2, keepdims=True), self.p["move"].max()
        here, move = np.exp(e - top), np.exp(self.p["move"] - most)
        ahead, back, scale = np.empty_like(here), np.ones_like(here), np.empty((b, n), here.dtype)
        a = here[:, 0]
        for k in range(n):
            a = a if k == 0 else (a @ move) * here[:, k]
            scale[:, k] = a.sum(1)
            a = ahead[:, k] = a / scale[:, k, None]
        for k in range(n - 2, -1, -1):
            back[:, k] = (here[:, k + 1] * back[:, k + 1]) @ move.T / scale[:, k + 1, None]
        z = np.log(scale).sum(1) + top[:, :, 0].sum(1) + (n - 1) * most
        after = (here * back)[:, 1:] / scale[:, 1:, None]
        pairs = move * (ahead[:, :-1].reshape(-1, t).T @ after.reshape(-1, t))
        return z, ahead * back, pairs

    def gradients(self, kinds, tags):
        e, (x, h, kf, kb) = self.emissions(kinds)
        z, m, pairs = self.marginals(e)
        b, n = kinds.shape
        rows, cols = np.arange(b)[:, None], np.arange(n)
        gold = e[rows, cols, tags].sum(1) + self.p["move"][tags[:, :-1], tags[:, 1:]].sum(1)
        de = m
        de[rows, cols, tags] -= 1
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        grads["move"] += pairs
        np.add.at(grads["move"], (tags[:, :-1], tags[:, 1:]), -1)
        de = np.ascontiguousarray(de.transpose(1, 2, 0))
        grads["out"] += np.matmul(h, de.transpose(0, 2, 1)).sum(0)
        grads["out_b"] += de.sum((0, 2))
        dh = np.matmul(self.p["out"], de)
        dx = self._lstm_back(x, "f", kf, dh[:, :HIDDEN], grads) + self._lstm_back(x, "b", kb, dh[:, HIDDEN:], grads)
        at = kinds.T.reshape(-1)
        grads["embed"] += np.stack([np.bincount(at, dx[:, j].reshape(-1), SYMBOL_COUNT) for j in range(EMBED)], 1)
        return float((z - gold).mean()), {k: g / b for k, g in grads.items()}

    def fit(self, kinds, tags, epochs: int = EPOCHS, seed: int = 3):
        """Adam on the mean negative log-likelihood of the tag sequences."""
        r, mean, square, step = np.random.default_rng(seed), {}, {}, 0
        loss = 0.0
        for _ in range(epochs):
            order = r.permutation(len(kinds))
            for i in range(0, len(order), BATCH):
                step += 1
                loss, grads = self.gradients(kinds[order[i:i + BATCH]], tags[order[i:i + BATCH]])
                norm = np.sqrt(sum((g * g).sum() for g in grads.values()))
                for k, g in grads.items():
                    g = g * min(1, 5 / (norm + 1e-9))
                    mean[k] = 0.9 * mean.get(k, 0) + 0.1 * g
                    square[k] = 0.999 * square.get(k, 0) + 0.001 * g * g
                    self.p[k] -= RATE * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        return loss

    def scores(self, kinds):
        """Emissions of windows, [time, window, tag]: the same numbers as :meth:`emissions`, without what
        training keeps. In memory a row holds one number of all windows, so every step works on whole
        rows; the last word vector, the character and a one are one column of a single product."""
        p, (b, n) = self.p, kinds.shape
        wide = HIDDEN + EMBED
        scale = np.concatenate([np.full(3 * HIDDEN, 0.25), np.ones(HIDDEN)])
        shift = np.concatenate([np.full(3 * HIDDEN, 0.5), np.zeros(HIDDEN)])
        at, embed = np.ascontiguousarray(kinds.T.astype(np.intp)), np.ascontiguousarray(p["embed"].T, np.float32)
        total = np.empty((n, len(TAGS), b), np.float32)
        total[:] = p["out_b"][:, None]
        z, more, e, part = (np.empty((k, b), np.float32) for k in (4 * HIDDEN, HIDDEN, HIDDEN, len(TAGS)))
        f, i, o, g = (z[k * HIDDEN:(k + 1) * HIDDEN] for k in range(4))
        low, high = np.zeros_like(z), np.ones_like(z)  # whole arrays: numpy's loops over them are faster than over one number
        low[3 * HIDDEN:], high[3 * HIDDEN:] = -3, 3
        least, most = low[3 * HIDDEN:], high[3 * HIDDEN:]

        three, ratio, ninth = np.float32(3), np.float32(8 / 3), np.float32(1 / 9)

        def squash(x):  # as _squash, of clipped sums, in place
            np.multiply(x, x, out=more)
            np.add(more, three, out=more)
            np.divide(ratio, more, out=more)
            np.add(more, ninth, out=more)
            x *= more

        for d, out in (("f", p["out"][:HIDDEN]), ("b", p["out"][HIDDEN:])):
            weights = np.ascontiguousarray((np.concatenate([p[d + "h"], p[d + "x"], p[d + "b"][None]]) * scale).T, np.float32)
            weights[:, wide] += shift
            out = np.ascontiguousarray(out.T, np.float32)
            column, c = np.zeros((wide + 1, b), np.float32), np.zeros((HIDDEN, b), np.float32)
            column[wide] = 1
            h, x = column[:HIDDEN], column[HIDDEN:wide]
            for t in range(n) if d == "f" else range(n - 1, -1, -1):
                np.take(embed, at[t], axis=1, out=x, mode="clip")
                np.matmul(weights, column, out=z)
                np.maximum(z, low, out=z)
                np.minimum(z, high, out=z)
                squash(g)
                c *= f
                g *= i
                c += g
                np.maximum(c, least, out=e)
                np.minimum(e, most, out=e)
                squash(e)
                np.multiply(o, e, out=h)
                total[t] += np.matmul(out, h, out=part)
        return total.transpose(0, 2, 1)

    @staticmethod
    def _runs(gain, into, between):
        """For each character, a bound of what the best run of tags that ends there gains over staying outside."""
        best = np.empty_like(gain)
        best[0] = gain[0] + max(into, 0)
        for k in range(1, len(gain)):
            np.add(best[k - 1], between, out=best[k])
            np.maximum(best[k], into, out=best[k])
            best[k] += gain[k]
        return best

    def _bounds(self, e):
        """(gain of each character, what entering, going on and leaving gain at most) for bounds of runs of tags."""
        move = self.p["move"]
        stay = move[0, 0]
        return e[:, :, 1:].max(2) - e[:, :, 0], move[0, 1:].max() - stay, move[1:, 1:].max() - stay, move[1:, 0].max() - stay

    def outside(self, e):
        """Windows ([time, window, tag]) of which it is certain that no tag is the best path. A path
        gains over staying outside by its runs of other tags; the scan bounds the best run that
        ends at each character by the best tag there and the dearest transitions."""
        gain, enter, inside, leave = self._bounds(e)
        run = gain[0] + max(enter, 0)  # a run at the window's start is entered for nothing
        best = np.full_like(run, -np.inf)
        for g in gain[1:]:
            np.maximum(best, run, out=best)
            run += inside
            np.maximum(run, enter, out=run)
            run += g
        return np.maximum(best + leave, run + max(leave, 0)) < 0  # at the window's end it is left for nothing

    def open_parts(self, e):
        """(window, start, end) of the parts of windows outside which the best path is certainly at no tag:
        there no run through the character, bounded from both sides, can gain anything."""
        gain, enter, inside, leave = self._bounds(e)
        through = self._runs(gain, enter, inside)
        through += self._runs(np.ascontiguousarray(gain[::-1]), leave, inside)[::-1]
        through -= gain
        open_ = np.zeros((e.shape[1], len(e) + 2), np.int8)
        open_[:, 1:-1] = (through > -0.01).T  # rounding is far below that
        edge = np.diff(open_, axis=1)
        window, start = np.nonzero(edge == 1)
        return window, start, np.nonzero(edge == -1)[1]

    def _best_path(self, e, window, start, end, tags):
        """Viterbi tags of parts of windows, put into ``tags`` [window, time]."""
        move, size = np.ascontiguousarray(self.p["move"]), end - start
        n = int(size.max())
        at = np.minimum(start + np.arange(n)[:, None], len(e) - 1)
        best = np.ascontiguousarray(e[at, window].transpose(0, 2, 1))  # [time, tag, part]
        each, step = move[:, :, None], np.empty((*move.shape, len(window)), np.result_type(e, move))
        for k in range(1, n):
            np.add(best[k - 1][:, None], each, out=step)
            best[k] += step.max(0)
        now = np.zeros(len(window), np.int64)
        for k in range(n - 1, -1, -1):
            if k < n - 1:  # the tag from which the next one's best path came
                now = (best[k] + move[:, now]).argmax(0)
            last = size == k + 1
            now[last] = best[k][:, last].argmax(0)
            here = size > k
            tags[window[here], at[k, here]] = now[here]

    def decode(self, kinds):
        """Viterbi tags of windows, and the marginal probability of each chosen tag."""
        b, n = kinds.shape
        tags, sure = np.zeros((b, n), np.int64), np.ones((b, n), np.float32)
        e = self.scores(kinds)
        open_ = np.flatnonzero(~self.outside(e))
        if not len(open_):
            return tags, sure
        e = e[:, open_]
        mine = np.zeros((len(open_), n), np.int64)
        window, start, end = self.open_parts(e)
        # with the character before and the one behind, at which the path is at no tag
        start, end = np.maximum(start - 1, 0), np.minimum(end + 1, n)
        order = np.argsort(end - start, kind="stable")
        for some in (order[i:i + TOGETHER] for i in range(0, len(order), TOGETHER)):
            self._best_path(e, window[some], start[some], end[some], mine)
        tags[open_] = mine
        e = e.transpose(1, 0, 2)
        some = np.flatnonzero((mine > 0).any(1))
        if len(some):
            _, m, _ = self.marginals(e[some])
            sure[open_[some]] = m[np.arange(len(some))[:, None], np.arange(n), mine[some]]
        return tags, sure


def _cut(kinds: np.ndarray, starts: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Windows of a text, padded behind its end with line ends."""
    padded = np.concatenate([kinds, np.full(size, PAD, kinds.dtype)])
    return padded[starts[:, None] + np.arange(size)]


def labelled_windows(texts: DataFrame, limit: int = SAMPLE) -> list[tuple[str, bytes]]:
    """A bounded sample of (text, tags) windows: an eighth of ``limit`` for each kind of base
    span, a quarter with digits or at signs outside any span, a quarter from one place of
    each text. Of each group the smallest hashes are taken, over all texts; a task passes on no more
    than that many."""
    share = {**{k: limit // (2 * len(KINDS)) for k in range(len(KINDS))}, 4: limit // 4, 5: limit // 4}

    def run(batches):
        held: dict[int, dict] = {g: {} for g in share}

        def offer(group, text, tags, start):
            w = text[start:start + WINDOW]
            y = tags[start:start + len(w)].tobytes()
            mine = held[group]
            mine[hashlib.blake2b(w.encode() + y, digest_size=8).digest()] = (w, y)
            if len(mine) > 2 * share[group]:
                for h in sorted(mine)[share[group]:]:
                    del mine[h]

        for batch in batches:
            for value in batch.column(0):
                text = value.as_py()
                if not text:
                    continue
                tags = np.zeros(len(text), np.int8)
                mark = zlib.crc32(text.encode())
                if _MARKED(text):
                    found = base_spans(text)
                    for a, b, k in reversed(found):
                        tags[a:b] = 2 + 2 * k
                        tags[a] = 1 + 2 * k
                    for a, b, k in found:
                        if b - a < WINDOW - 8:
                            offer(k, text, tags, max(0, a - mark % (WINDOW - 8 - (b - a)) - 4))
                    free = next((m.start() for m in _MARKS(text) if not tags[m.start()]), None)
                    if free is not None:
                        offer(4, text, tags, max(0, free - mark % (WINDOW - 16)))
                offer(5, text, tags, mark % max(1, len(text) - WINDOW))
        rows = [(g, h, *wy) for g, mine in held.items() for h, wy in sorted(mine.items())[:share[g]]]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.string(), pa.binary()))], ["g", "h", "w", "y"])

    windows = texts.select("t").mapInArrow(run, "g int, h binary, w string, y binary").dropDuplicates(["g", "h"])
    first = F.row_number().over(Window.partitionBy("g").orderBy("h"))
    picked = windows.withColumn("n", first).where(F.col("n") <= F.element_at(F.create_map(*[F.lit(x) for kv in share.items() for x in kv]), F.col("g")))
    return [(r.w, r.y) for r in picked.orderBy("g", "h").select("w", "y").collect()]


def train_tagger(texts: DataFrame) -> Tagger | None:
    sample = labelled_windows(texts)
    if not any(y.strip(b"\0") for _, y in sample):
        return None
    tagger = Tagger()
    tagger.fit(*training_set(sample))
    return tagger


def reconcile(starts: np.ndarray, tags: np.ndarray, sure: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Tags and probabilities of a whole text: for each character those of the window that has it most central."""
    n = tags.shape[1] if len(tags) else 0
    out, p = np.zeros(size + n, np.int64), np.ones(size + n, np.float32)
    nearest = np.full(size + n, n)
    far = np.abs(2 * np.arange(n) - n + 1)
    for s, t, q in zip(starts.tolist(), tags, sure):
        here = far < nearest[s:s + n]
        nearest[s:s + n][here] = far[here]
        out[s:s + n][here] = t[here]
        p[s:s + n][here] = q[here]
    return out[:size], p[:size]


def spans_of(tags: np.ndarray, sure: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(start, end, kind, mean probability) of the tagged runs."""
    out, at = [], np.flatnonzero(tags)
    i = 0
    while i < len(at):
        a = int(at[i])
        kind = (int(tags[a]) - 1) // 2
        b = a + 1
        while b < len(tags) and tags[b] == 2 + 2 * kind:
            b += 1
        out.append((a, b, kind, float(sure[a:b].mean())))
        i = int(np.searchsorted(at, b))
    return out


def tagged(model: Tagger, texts: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Number of a text → its tags and probabilities, where the model tags anything in one of its windows."""
    kinds = [symbols(t) for t in texts]
    starts = [window_starts(len(k)) for k in kinds]
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in starts])
    if not len(owner):
        return {}
    edges = np.concatenate([[0], np.cumsum([len(x) for x in starts])])
    hits: dict[int, list] = {}
    windows = np.concatenate([_cut(k, x, SCORED) for k, x in zip(kinds, starts) if len(x)])
    rest = np.array([len(k) for k in kinds])[owner] - np.concatenate(starts)
    for width, some in ((SCORED, np.flatnonzero(rest > SCORED // 2)), (SCORED // 2, np.flatnonzero(rest <= SCORED // 2))):
        for i in range(0, len(some), TOGETHER):
            mine = some[i:i + TOGETHER]
            tags, sure = model.decode(windows[mine, :width])
            for j in np.flatnonzero((tags > 0).any(1)).tolist():
                hits.setdefault(int(owner[mine[j]]), []).append((int(mine[j]), tags[j], sure[j]))
    out = {}
    for d, mine in hits.items():
        n = len(starts[d])
        tags, sure = np.zeros((n, SCORED), np.int64), np.ones((n, SCORED), np.float32)
        for w, t, q in mine:
            tags[w - edges[d], :len(t)], sure[w - edges[d], :len(t)] = t, q
        out[d] = reconcile(starts[d], tags, sure, len(kinds[d]))
    return out


def find_personal_data(docs: DataFrame, text: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """``doc`` (all input columns), ``base`` and ``spans``: arrays of (kind, start, end), code points, end exclusive."""
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), text_or_empty(text).alias("t"))
    trained = tagger or train_tagger(df.select("t"))
    shared = docs.sparkSession.sparkContext.broadcast(trained and trained.p)  # a few thousand weights

    def make():
        model = Tagger.of(shared.value) if shared.value else None

        def work(batch, raw, offs):
            base: list = [[]] * (len(offs) - 1)
            every: list = [[]] * (len(offs) - 1)
            texts = [raw[a:b].tobytes().decode("utf-8") for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
            for d, text in enumerate(texts):
                if _MARKED(text):
                    base[d] = every[d] = base_spans(text)
            if model:
                for d, (tags, sure) in tagged(model, texts).items():
                    text = texts[d]
                    more = [(a, b, k) for a, b, k, q in spans_of(tags, sure)
                            if q >= SURE and not cuts_word(text, a, b) and plausible(k, text[a:b])
                            and not any(x < b and a < y for x, y, _ in base[d])]
                    if more:
                        every[d] = sorted(base[d] + more, key=lambda s: (s[0], s[2], s[1]))
            return [pa.array([_rows(x) for x in base], SPANS), pa.array([_rows(x) for x in every], SPANS)]

        return work

    kind = "array<struct<kind:string,start:int,end:int>>"
    return map_text(df, "t", f"base {kind}, spans {kind}", make).select("doc", "base", "spans")


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _rows(spans: list[tuple[int, int, int]]) -> list[dict]:
    return [{"kind": KINDS[k], "start": a, "end": b} for a, b, k in spans]


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask(text: Column, spans: Column) -> Column:
    """The text with each maximal run of overlapping spans replaced by its first kind in brackets."""
    step = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    done = F.aggregate(spans, step, lambda s, x: F.when(x["start"] >= s["at"], F.struct(
        F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("out"),
        x["end"].alias("at"))).otherwise(F.struct(s["out"].alias("out"), F.greatest(s["at"], x["end"]).alias("at"))))
    return F.transform(F.array(done), lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.char_length(text))))[0]
