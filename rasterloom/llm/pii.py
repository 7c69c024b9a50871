"""Personal data by rules, and by a character-level bidirectional LSTM with CRF transitions that adds what the rules miss.

The rules give the base spans (email, ip, card, phone), leftmost and non-overlapping for each kind; they always stay. The tagger reads
windows of WINDOW characters that overlap by half. Each window is decoded by Viterbi; where windows overlap, a character's tag is that
of the window in which it lies farthest from an edge, and spans are read from the reconciled tags of the whole text. A tagged span is
added if it overlaps no base span and is well formed (a card passes Luhn, an address has parts up to 255, a phone 8 to 15 digits, a mail
address a dotted domain).

What is well formed holds a digit or an at sign, has no white space but between digits, and no two digits more than GAP characters
apart. So windows are laid over the stretches where such a span can be: from a digit or at sign to the next less than GAP away, on to
white space at both ends, and CONTEXT characters more. Elsewhere every tag would be dropped, so nothing is read there.

The tagger is trained in numpy from labelled spans (labelled_texts writes them; train takes any others): the LSTMs by
backpropagation through time, the CRF by the forward-backward algorithm, both with Adam. The default one's weights are in pii_tagger.npz
beside this file, which python -m rasterloom.llm.pii writes anew.

Null text counts as empty. Rows with a null or repeated doc_id are searched one by one. Extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

KINDS = ("email", "ip", "card", "phone")
WINDOW, CONTEXT, GAP = 64, 20, 40
EMBED, HIDDEN = 12, 24
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind
BATCH = 512

# The rules' patterns. A match of the second can't start within a run of digits, so it needn't be tried there.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ANCHORS = re.compile(rf"[0-9@](?:[^0-9@]{{0,{GAP}}}[0-9@])*")
_APART = re.compile(rf"[^0-9]{{{GAP + 1}}}")
_SPACE = re.compile(r"\s")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each at sign takes the run of local characters before it, as far as no earlier match reaches."""
    done, at = 0, text.find("@")
    while at >= 0:
        if at >= done and (m := _DOMAIN.match(text, at)):
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                done = m.end()
        at = text.find("@", at + 1)


def _bare(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    if not text or not (("@" in text) or _DIGITS.search(text)):
        return []
    out = [(0, a, b) for a, b in emails(text)]
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
    out += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := _bare(m.group())) <= 19 and luhn(d)]
    out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_bare(m.group())) <= 15]
    return out


def well_formed(kind: int, s: str) -> bool:
    digits = _bare(s)
    if kind == 0:
        local, _, domain = s.partition("@")
        return bool(local) and "@" not in domain and "." in domain.strip(".") and not re.search(r"\s", s) and domain[-1].isalnum()
    if kind == 1:
        return bool(re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", s)) and all(int(p) <= 255 for p in s.split("."))
    if _APART.search(s):
        return False
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits) and bool(re.fullmatch(r"[0-9][0-9 .-]*[0-9]", s))
    return 8 <= len(digits) <= 15 and bool(re.fullmatch(r"[+(]?[0-9][0-9 ().-]*[0-9]", s)) and bool(re.search(r"[+()]|[ .-]", s))


def codes(text: str) -> np.ndarray:
    """0 pads; then printable ASCII one by one, white space, other letters, anything else."""
    out = np.array([ord(c) for c in text], np.int32)
    plain = (out > 32) & (out < 127)
    rest = np.array([97 if c.isspace() else 98 if c.isalpha() else 99 for c in text], np.int32) if not plain.all() else out
    return np.where(plain, out - 30, rest)


CODES = 100


def stretches(text: str) -> list[tuple[int, int]]:
    """Where a well-formed span can be, with context."""
    out: list[tuple[int, int]] = []
    spaces: list[int] | None = None
    for m in _ANCHORS.finditer(text):
        if spaces is None:
            spaces = [x.start() for x in _SPACE.finditer(text)]
        before, after = bisect_left(spaces, m.start()), bisect_left(spaces, m.end())
        a = max(0, (spaces[before - 1] + 1 if before else 0) - CONTEXT)
        b = min(len(text), (spaces[after] if after < len(spaces) else len(text)) + CONTEXT)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def windows(a: int, b: int) -> list[int]:
    """Starts of the windows that cover a stretch."""
    if b - a <= WINDOW:
        return [a]
    return [*range(a, b - WINDOW, WINDOW // 2), b - WINDOW]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis))


def _allowed() -> np.ndarray:
    """Log-domain bars: I of a kind follows B or I of it only."""
    bar = np.zeros((TAGS, TAGS), np.float32)
    for k in range(len(KINDS)):
        bar[:, 2 + 2 * k] = -1e4
        bar[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
    return bar


class Tagger:
    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        n = lambda *shape: (r.standard_normal(shape) * (1.0 / np.sqrt(shape[0]))).astype(np.float32)
        self.p = {"embed": n(CODES, EMBED) * 3, "u": n(2 * HIDDEN, TAGS), "c": np.zeros(TAGS, np.float32), "t": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            self.p |= {f"wx{d}": n(EMBED, 4 * HIDDEN), f"wh{d}": n(HIDDEN, 4 * HIDDEN), f"w0{d}": np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)}
        self.bar = _allowed()

    def _run(self, x: np.ndarray, d: str):
        """One direction over (time, batch, EMBED): hidden states, and what the way back needs."""
        p, (steps, n, _) = self.p, x.shape
        zx = x @ p[f"wx{d}"] + p[f"w0{d}"]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        hs, gates, cells = np.empty((steps, n, HIDDEN), np.float32), np.empty((steps, n, 4 * HIDDEN), np.float32), np.empty((steps, n, HIDDEN), np.float32)
        for t in range(steps):
            z = zx[t] + h @ p[f"wh{d}"]
            z[:, : 3 * HIDDEN] = _sigmoid(z[:, : 3 * HIDDEN])
            z[:, 3 * HIDDEN :] = np.tanh(z[:, 3 * HIDDEN :])
            i, f, o, g = np.split(z, 4, 1)
            c = f * c + i * g
            h = o * np.tanh(c)
            hs[t], gates[t], cells[t] = h, z, c
        return hs, gates, cells

    def emissions(self, ids: np.ndarray):
        x = self.p["embed"][ids.T]
        forward, back = self._run(x, "f"), self._run(x[::-1], "b")
        both = np.concatenate((forward[0], back[0][::-1]), 2)
        return both @ self.p["u"] + self.p["c"], (x, forward, back, both)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Viterbi tags of each window (batch, time)."""
        e, _ = self.emissions(ids)
        t = self.p["t"] + self.bar
        score, back = e[0] + self.bar[0], np.empty(e.shape, np.int8)
        for k in range(1, len(e)):
            by = score[:, :, None] + t
            back[k] = by.argmax(1)
            score = by.max(1) + e[k]
        out = np.empty((len(e), ids.shape[0]), np.int8)
        out[-1] = score.argmax(1)
        rows = np.arange(ids.shape[0])
        for k in range(len(e) - 1, 0, -1):
            out[k - 1] = back[k][rows, out[k]]
        return out.T

    def _back(self, d: str, x, state, dh_out, grads) -> np.ndarray:
        p, (hs, gates, cells) = self.p, state
        dh, dc = np.zeros_like(hs[0]), np.zeros_like(hs[0])
        dz_all = np.empty_like(gates)
        for t in range(len(hs) - 1, -1, -1):
            i, f, o, g = np.split(gates[t], 4, 1)
            tc = np.tanh(cells[t])
            dh = dh + dh_out[t]
            dc = dc + dh * o * (1 - tc * tc)
            before = cells[t - 1] if t else np.zeros_like(dc)
            dz = np.concatenate((dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)), 1)
            dz_all[t] = dz
            dc = dc * f
            dh = dz @ p[f"wh{d}"].T
        flat = dz_all.reshape(-1, 4 * HIDDEN)
        grads[f"wx{d}"] = x.reshape(-1, EMBED).T @ flat
        grads[f"wh{d}"] = hs[:-1].reshape(-1, HIDDEN).T @ dz_all[1:].reshape(-1, 4 * HIDDEN)
        grads[f"w0{d}"] = flat.sum(0)
        return dz_all @ p[f"wx{d}"].T

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags and its gradients."""
        e, (x, forward, back, both) = self.emissions(ids)
        steps, n, _ = e.shape
        t = self.p["t"] + self.bar
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0] + self.bar[0]
        for k in range(1, steps):
            alpha[k] = _log_sum(alpha[k - 1][:, :, None] + t, 1) + e[k]
        for k in range(steps - 2, -1, -1):
            beta[k] = _log_sum(t + (e[k + 1] + beta[k + 1])[:, None, :], 2)
        total = _log_sum(alpha[-1], 1)
        y = tags.T
        gold = np.eye(TAGS, dtype=np.float32)[y]
        de = (np.exp(alpha + beta - total[:, None]) - gold) / n
        dt = np.zeros_like(t)
        for k in range(1, steps):
            dt += np.exp(alpha[k - 1][:, :, None] + t + (e[k] + beta[k])[:, None, :] - total[:, None, None]).sum(0) / n
        np.subtract.at(dt, (y[:-1].ravel(), y[1:].ravel()), 1 / n)
        score = np.take_along_axis(e, y[:, :, None], 2).sum((0, 2)) + t[y[:-1], y[1:]].sum(0) + self.bar[0, y[0]]
        grads = {"t": dt, "u": both.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, TAGS), "c": de.sum((0, 1))}
        dh = de @ self.p["u"].T
        dx = self._back("f", x, forward, dh[:, :, :HIDDEN], grads) + self._back("b", x[::-1], back, dh[::-1, :, HIDDEN:], grads)[::-1]
        grads["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(grads["embed"], ids.T, dx)
        return float((total - score).mean()), grads

    def fit(self, ids: np.ndarray, tags: np.ndarray, epochs: int = 10, batch: int = 48, rate: float = 0.01, seed: int = 5) -> Tagger:
        m, v, k = {a: np.zeros_like(b) for a, b in self.p.items()}, {a: np.zeros_like(b) for a, b in self.p.items()}, 0
        r = np.random.default_rng(seed)
        for epoch in range(epochs):
            order = r.permutation(len(ids))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                _, grads = self.gradients(ids[some], tags[some])
                k += 1
                size = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
                for a, g in grads.items():
                    g = g * min(1.0, 5.0 / (size + 1e-9))
                    m[a], v[a] = 0.9 * m[a] + 0.1 * g, 0.999 * v[a] + 0.001 * g * g
                    self.p[a] = (self.p[a] - rate * 0.85**epoch * (m[a] / (1 - 0.9**k)) / (np.sqrt(v[a] / (1 - 0.999**k)) + 1e-8)).astype(np.float32)
        return self

    def tag(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Spans (kind, start, end) of each whole text, reconciled over its windows."""
        jobs = [(k, a, s, min(b, s + WINDOW)) for k, text in enumerate(texts) for a, b in stretches(text) for s in windows(a, b)]
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        tags: list[np.ndarray] = []
        for at in range(0, len(jobs), BATCH):
            some = jobs[at : at + BATCH]
            ids = np.zeros((len(some), WINDOW), np.int32)
            for i, (k, _, s, e) in enumerate(some):
                ids[i, : e - s] = codes(texts[k][s:e])
            tags += list(self.decode(ids))
        i = 0
        while i < len(jobs):
            k, a = jobs[i][:2]
            last = i
            while last + 1 < len(jobs) and jobs[last + 1][:2] == (k, a):
                last += 1
            end = jobs[last][3]
            joined, depth = np.zeros(end - a, np.int8), np.full(end - a, -1)
            for w in range(i, last + 1):
                _, _, s, e = jobs[w]
                place = np.arange(e - s)
                # the text's own ends are no edges
                inner = np.minimum(place if s > a else np.full(e - s, WINDOW), (e - s - 1 - place) if e < end else np.full(e - s, WINDOW))
                better = inner > depth[s - a : e - a]
                joined[s - a : e - a][better] = tags[w][: e - s][better]
                depth[s - a : e - a][better] = inner[better]
            out[k] += read_tags(joined, a)
            i = last + 1
        return out


def read_tags(tags: np.ndarray, offset: int = 0) -> list[tuple[int, int, int]]:
    out, kind, start = [], -1, 0
    for i, t in enumerate([*tags.tolist(), 0]):
        now = (t - 1) // 2 if t else -1
        if kind >= 0 and (now != kind or t % 2 == 1):
            out.append((kind, offset + start, offset + i))
            kind = -1
        if now >= 0 and kind < 0:
            kind, start = now, i
    return out


def labelled_texts(count: int = 1600, seed: int = 11) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Invented prose with labelled personal data and with numbers that aren't any."""
    r = random.Random(seed)
    pick = r.choice
    digits = lambda n: "".join(pick("0123456789") for _ in range(n))
    syllables = "an er th the ein ung lich ré eux tion ción ado ñe ü pa be st on in ha re le ou".split()
    word = lambda: "".join(pick(syllables) for _ in range(r.randint(1, 4)))
    ascii_word = lambda: "".join(pick("an er th be st on in ha re le ou mi ka to".split()) for _ in range(r.randint(1, 4)))

    def email() -> str:
        local = pick((ascii_word(), f"{ascii_word()}.{ascii_word()}", f"{ascii_word()}.{digits(2)}", f"{ascii_word()}{digits(r.randint(1, 4))}", f"{ascii_word()}_{ascii_word()}", f"{ascii_word()}+{ascii_word()}", f"{word()}.{word()}"))
        host = pick((f"mail{digits(1)}.example.com", f"{ascii_word()}.com", f"{ascii_word()}.{ascii_word()}.org", f"{ascii_word()}-{ascii_word()}.co.uk", f"{word()}.es"))
        return local + "@" + host

    def card() -> str:
        d = pick("3456") + digits(15)
        return pick((d, d, d, " ".join(d[i : i + 4] for i in range(0, 16, 4)), "-".join(d[i : i + 4] for i in range(0, 16, 4)), f"{d[:4]} {d[4:10]} {d[10:15]}", ".".join(d[i : i + 4] for i in range(0, 16, 4))))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick((f"+1 ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"+{digits(2)} {digits(2)} {digits(7)}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+1.{a}.{b}.{c}", f"+{digits(2)} {a} {b} {digits(3)}", f"00{digits(2)} {digits(2)} {digits(7)}"))

    def ip() -> str:
        return ".".join(str(r.randint(0, 255)) for _ in range(4))

    def other() -> str:
        hexa = "".join(pick("0123456789abcdef") for _ in range(pick((8, 16, 32, 40))))
        return pick((digits(r.randint(1, 4)), digits(r.randint(5, 12)), digits(r.randint(20, 26)), f"20{digits(2)}-0{digits(1)}-1{digits(1)}", f"1{digits(1)}/0{digits(1)}/19{digits(2)}", f"1{digits(1)}:3{digits(1)}", f"{digits(2)}.{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(2)}", f"{digits(1)},{digits(3)}.{digits(2)}", hexa, f'token = "{hexa}"', f"v{digits(1)}.{digits(1)}.{digits(1)}", f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", f"@{ascii_word()}", f"{ascii_word()} @ {ascii_word()}", f"{r.randint(256, 999)}.{digits(2)}.{digits(3)}.{r.randint(256, 999)}", f"{digits(4)} {digits(4)}", f"No. {digits(6)}", f"{digits(2)}%"))

    out = []
    for _ in range(count):
        text, spans = "", []
        for _ in range(r.randint(1, 4)):
            text += " ".join(word() for _ in range(r.randint(1, 7)))
            text = text[:1].upper() + text[1:] + pick((" ", " ", " ", " ", ". ", ": ", " | ", "\n", "### ", " ("))
            kind = r.randint(0, 6)
            piece = (email, ip, card, phone)[kind]() if kind < 4 else other()
            if kind < 4:
                spans.append((kind, len(text), len(text) + len(piece)))
            text += piece + pick((" ", " ", " ", ", ", ". ", ") ", "\n", "### ", "*** ", "; "))
        out.append((text + word(), spans))
    return out


def examples(texts: list[tuple[str, list[tuple[int, int, int]]]]) -> tuple[np.ndarray, np.ndarray]:
    """Windows and tags; windows start anywhere, so spans that an edge cuts are among them."""
    r = random.Random(1)
    ids, tags = [], []
    for text, spans in texts:
        code, tag = codes(text), np.zeros(len(text), np.int32)
        for kind, a, b in spans:
            tag[a], tag[a + 1 : b] = 1 + 2 * kind, 2 + 2 * kind
        start = r.randint(0, max(0, len(text) - WINDOW))
        piece = tag[start : start + WINDOW].copy()
        if len(piece) and piece[0] and piece[0] % 2 == 0:  # the middle of a span: its first character here begins it
            piece[0] -= 1
        ids.append(np.pad(code[start : start + WINDOW], (0, WINDOW - len(piece))))
        tags.append(np.pad(piece, (0, WINDOW - len(piece))))
    return np.array(ids, np.int32), np.array(tags, np.int32)


def train(texts: list[tuple[str, list[tuple[int, int, int]]]], epochs: int = 10) -> Tagger:
    return Tagger().fit(*examples(texts), epochs=epochs)


WEIGHTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "pii_tagger.npz")
_loaded: dict[str, Tagger] = {}


def default_tagger() -> Tagger:
    """From its file, which the driver reads; tasks get the tagger with their function."""
    if WEIGHTS not in _loaded:
        _loaded[WEIGHTS] = Tagger()
        with np.load(WEIGHTS) as held:
            _loaded[WEIGHTS].p = {k: held[k] for k in held.files}
    return _loaded[WEIGHTS]


def all_spans(text: str, base: list[tuple[int, int, int]], tagged: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Base spans and the well-formed tagged ones that overlap none of them, by kind, then start."""
    by_start = sorted((s, e) for _, s, e in base)
    starts, reach = [s for s, _ in by_start], list(accumulate((e for _, e in by_start), max))
    free = lambda a, b: not (k := bisect_left(starts, b)) or reach[k - 1] <= a
    return sorted([*base, *((k, a, b) for k, a, b in tagged if free(a, b) and well_formed(k, text[a:b]))])


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


_FOUND = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])


def _find(tagger: Tagger, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [x or "" for x in batch.column(1).to_pylist()]
        base = [base_spans(t) for t in texts]
        every = [all_spans(t, b, g) for t, b, g in zip(texts, base, tagger.tag(texts), strict=True)]
        counts = [pa.array([sum(k == kind for k, _, _ in b) for b in base], pa.int64()) for kind in range(len(KINDS))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *counts, pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b in base], pa.string()), pa.array([_joined(e) for e in every], pa.string()), pa.array([len(e) - len(b) for e, b in zip(every, base, strict=True)], pa.int64())],
            schema=_FOUND,
        )


def personal_data(documents: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans, n_added of every row. No shuffle."""
    small_batches(documents.sparkSession)
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_find, tagger or default_tagger()), schema)


def op5_pii(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return personal_data(table(spark, sf_dir, "documents"))


if __name__ == "__main__":
    np.savez(WEIGHTS, **train(labelled_texts(6000), epochs=14).p)
