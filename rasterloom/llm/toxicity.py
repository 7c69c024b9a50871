"""Toxicity by a weighted grammar of finite-state transducers over clauses.

A clause is read as classes: INSULT and THREAT (stems, with weights), TARGET (the addressee), INTENT (will, going to), NEGATION, REPORT
(verbs of speech), QUOTE, COLON or OTHER. Each transducer raises flags on insults and threats:

- insult: STACKED where another insult is next to it;
- threat: INTENDED within SCOPE words of an intent;
- target: TARGETED where an addressee is named in the clause, before it or after it;
- negation: NEGATED within SCOPE words of a negation;
- report: REPORTED from a verb of speech on, through a colon, to the clause's end or the end of what is quoted; and within quotes that
  a verb of speech follows.

Those that look back are composed into one machine, those that look ahead into another, which reads the clause from its end; their
tables are built at import. A match weighs what its stem weighs times the factor of its flags, a clause what its matches weigh; a
logistic model over the sums of clauses, by what they are, and the text's length gives the score. Words decide nothing by themselves:
a threat without an addressee or a negated or reported insult weighs a fraction.

Stems, factors' corrections and the model are learned from a bounded sample of labelled rows (POSITIVE_ROWS and NEGATIVE_ROWS) with
crc32(doc_id) mod 3 other than 1, whose whole texts are read by tasks. A stem is a word or a prefix of words that toxic texts hold far
more often than others, by the likelihood ratio of document frequencies; the strongest is taken first and the words it covers no longer
count for the next. Stems that mostly follow an intent are threats. Every whole text of the table is scored.

Null and empty texts score as texts without a match. Rows with a null doc_id are scored, held_out false. Repeated rows are scored
one by one; a document labelled twice counts as toxic if either label says so. Extra columns are ignored. Without labelled rows the
fixed words and the model's prior are used.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release, small_batches

POSITIVE_ROWS, NEGATIVE_ROWS = 2000, 3000
STEM = (4, 12)
#: Characters whose stems a task counts before it passes the counts on.
COUNTED = 1 << 18
LEAST_TEXTS, LEAST_RATIO, LEAST_GAIN = 4, 4.0, 30.0
SCOPE = 3
THRESHOLD = 0.7

# Word lists of the grammar. Threats are stems.
SEED_INSULTS = {"idiot", "moron", "stupid", "worthless", "scum", "loser", "pathetic", "disgusting", "trash"}
THREATS = {"kill", "murder", "stab", "strangl", "shoot", "töte", "umbring", "umzubringen", "tuer", "matar"}
TARGETS = {"you", "your", "you're", "yourself", "u", "du", "dich", "dir", "dein", "deine", "euch", "ihr", "tu", "te", "toi", "vous", "usted", "ti", "eres"}
INTENTS = {"will", "shall", "going", "gonna", "wanna", "i'll", "we'll", "werde", "werden", "vais", "allons", "voy", "vamos"}
NEGATIONS = {"not", "no", "never", "isn't", "don't", "won't", "aren't", "nicht", "kein", "keine", "nie", "pas", "jamais", "nunca"}
REPORTS = {"said", "says", "called", "wrote", "quoted", "shouted", "sagte", "schrieb", "nannte", "dit", "appelé", "dijo", "llamó"}
THREAT_WEIGHT = 6.0

OTHER, INSULT, THREAT, TARGET, INTENT, NEGATION, REPORT, QUOTE, COLON = range(9)
KINDS = 9
TARGETED, NEGATED, REPORTED, STACKED, INTENDED = 1, 2, 4, 8, 16
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*|[\"“”„«»]|:")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
#: A clause goes on if what would end it stands before a closing quote.
_CLAUSE = re.compile(r"[.!?;|\n]+(?![\"”»])")
FEATURES = ("total", "log_total", "words", "targeted", "weakened", "threat")


@dataclass(frozen=True)
class Transducer:
    """Deterministic: step(state, class) gives the next state and the flags to raise if the class scores."""

    states: int
    step: object

    def then(self, other: Transducer) -> Transducer:
        """Composition: both read the class, the flags are joined."""
        n = other.states

        def step(state: int, kind: int) -> tuple[int, int]:
            (a, x), (b, y) = self.step(state // n, kind), other.step(state % n, kind)
            return a * n + b, x | y

        return Transducer(self.states * n, step)

    def table(self) -> list[list[tuple[int, int]]]:
        return [[self.step(s, k) for k in range(KINDS)] for s in range(self.states)]


def _scores(kind: int) -> bool:
    return kind in (INSULT, THREAT)


def _word(kind: int) -> bool:
    return kind not in (QUOTE, COLON)


def _insult(state: int, kind: int) -> tuple[int, int]:
    """1: the word before was an insult."""
    return int(kind == INSULT), STACKED if state and kind == INSULT else 0


def _threat(state: int, kind: int) -> tuple[int, int]:
    """Words left of an intent's reach."""
    left = SCOPE if kind == INTENT else max(0, state - _word(kind))
    return left, INTENDED if state and _scores(kind) else 0


def _target(state: int, kind: int) -> tuple[int, int]:
    return int(state or kind == TARGET), TARGETED if state and _scores(kind) else 0


def _negation(state: int, kind: int) -> tuple[int, int]:
    left = SCOPE if kind == NEGATION else max(0, state - _word(kind))
    return left, NEGATED if state and _scores(kind) else 0


def _report(state: int, kind: int) -> tuple[int, int]:
    """1: after a verb of speech; 2: in what it quotes."""
    if kind == QUOTE:
        return (0, 2, 0)[state], 0
    return state or int(kind == REPORT), REPORTED if state and _scores(kind) else 0


def _report_back(state: int, kind: int) -> tuple[int, int]:
    """From the clause's end: 1 to SCOPE, words left within which a quote must end before a verb of speech; SCOPE + 1: in the quote."""
    if kind == QUOTE:
        return (SCOPE + 1 if 0 < state <= SCOPE else 0), 0
    if state > SCOPE:
        return state, REPORTED if _scores(kind) else 0
    return SCOPE if kind == REPORT else max(0, state - _word(kind)), 0


AHEAD = Transducer(2, _insult).then(Transducer(SCOPE + 1, _threat)).then(Transducer(2, _target)).then(Transducer(SCOPE + 1, _negation)).then(Transducer(3, _report)).table()
BACK = Transducer(2, _insult).then(Transducer(2, _target)).then(Transducer(SCOPE + 2, _report_back)).table()


def factor(kind: int, flags: int) -> float:
    """What a match's weight is multiplied by."""
    if kind == THREAT:
        out = (1.5 if flags & INTENDED else 0.3) if flags & TARGETED else 0.02
    else:
        out = (1.5 if flags & TARGETED else 1.0) * (1.2 if flags & STACKED else 1.0)
    return out * (0.1 if flags & NEGATED else 1.0) * (0.15 if flags & REPORTED else 1.0)


_FACTORS = [[factor(k, f) for f in range(32)] for k in range(KINDS)]
_FIXED = {w: k for k, words in ((TARGET, TARGETS), (INTENT, INTENTS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words} | dict.fromkeys("\"“”„«»", QUOTE) | {":": COLON}


@dataclass
class Model:
    stems: dict[str, float]  # "idiot$" is a whole word, "achlich" any word that begins so
    threats: dict[str, float] = field(default_factory=dict)
    scale: list[float] = field(default_factory=lambda: [1.0] * len(FEATURES))
    weights: list[float] = field(default_factory=lambda: [0.5, 1.2, -0.02, 0.0, 0.0, 0.0])
    bias: float = -3.0

    def machine(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for kind, stems in ((INSULT, self.stems), (THREAT, dict.fromkeys(THREATS, THREAT_WEIGHT) | self.threats)):
            for stem, weight in stems.items():
                if kind == THREAT or stem not in self.threats:
                    a.add_word(stem.rstrip("$"), (stem, kind, weight))
        a.make_automaton()
        return a

    def score(self, features: np.ndarray) -> np.ndarray:
        z = (features / np.array(self.scale)) @ np.array(self.weights) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def matches(text: str, machine: ahocorasick.Automaton) -> dict[int, tuple[str, int, float]]:
    """Start of each insult or threat in text (lower-cased) -> stem, class, weight; the heaviest at a place."""
    found: dict[int, tuple[str, int, float]] = {}
    n = len(text)
    for end, hit in machine.iter(text):
        at = end - len(hit[0].rstrip("$")) + 1
        if (at and text[at - 1].isalpha()) or (hit[0].endswith("$") and end + 1 < n and text[end + 1].isalpha()):
            continue
        if at not in found or hit[2] > found[at][2]:
            found[at] = hit
    return found


def flagged(kinds: list[int]) -> list[int]:
    """The flags of each token of a clause, by both machines."""
    out, state = [0] * len(kinds), 0
    for i, k in enumerate(kinds):
        state, out[i] = AHEAD[state][k]
    state = 0
    for i in range(len(kinds) - 1, -1, -1):
        state, flags = BACK[state][kinds[i]]
        out[i] |= flags
    return out


def clauses(text: str, machine: ahocorasick.Automaton) -> Iterator[list[tuple[str, int, float, int]]]:
    """The matches (stem, class, weight, flags) of each clause of text (lower-cased) that has any."""
    found = matches(text, machine)
    if not found:
        return
    edges = np.array([0, *(m.end() for m in _CLAUSE.finditer(text)), len(text)])
    at = sorted(found)
    for c in np.unique(np.searchsorted(edges, at, side="right") - 1):
        base = int(edges[c])
        told = [found.get(base + m.start(), ("", _FIXED.get(m.group(), OTHER), 0.0)) for m in _TOKEN.finditer(text[base : edges[c + 1]])]
        flags = flagged([t[1] for t in told])
        yield [(*t, f) for t, f in zip(told, flags, strict=True) if _scores(t[1])]


def features(text: str | None, machine: ahocorasick.Automaton) -> tuple[list[float], int]:
    """The clauses' sums over the whole text, and how many matched."""
    low = (text or "").lower()
    total = targeted = weakened = threat = 0.0
    matched = 0
    for clause in clauses(low, machine):
        matched += 1
        for _, kind, weight, flags in clause:
            w = weight * _FACTORS[kind][flags]
            total += w
            if flags & (NEGATED | REPORTED):
                weakened += w
            elif kind == THREAT:
                threat += w
            elif flags & TARGETED:
                targeted += w
    return [total, math.log1p(total), len(low.split()) / 100, targeted, weakened, threat], matched


def _gain(a: int, b: int, toxic: int, clean: int) -> float:
    """Likelihood ratio of a of toxic against b of clean documents; 0 unless the rate is LEAST_RATIO times as high."""
    if (a + 0.5) / (toxic + 1) < LEAST_RATIO * (b + 0.5) / (clean + 1):
        return 0.0
    p = (a + b) / (toxic + clean)
    parts = ((a, toxic * p), (b, clean * p), (toxic - a, toxic * (1 - p)), (clean - b, clean * (1 - p)))
    return 2 * sum(o * math.log(o / e) for o, e in parts if o and e)


def _stems_of(word: str) -> tuple[str, ...]:
    """None of the grammar's own words."""
    if word in _FIXED:
        return ()
    return (word + "$", *(word[:k] for k in range(STEM[0], min(STEM[1], len(word)) + 1)))


def count_stems(texts: Iterable[str], toxic: Iterable[bool]) -> Counter:
    """How many texts of each kind hold a stem: (stem, toxic) -> texts; ("", toxic) counts the texts, and "$" their words."""
    out: Counter = Counter()
    for text, bad in zip(texts, toxic, strict=True):
        words = _WORD.findall(text.lower())
        out.update((s, bad) for s in {s for w in set(words) for s in _stems_of(w)})
        out["", bad] += 1
        out["$", bad] += len(words)
    return out


def standing_out(stem: str, counts: dict, toxic: int, clean: int) -> bool:
    a = counts.get((stem, True), 0)
    return a >= LEAST_TEXTS and _gain(a, counts.get((stem, False), 0), toxic, clean) >= LEAST_GAIN


def hold_words(texts: Iterable[str], keys: Iterable, toxic: Iterable[bool], stems: set[str]) -> Iterator[tuple]:
    """(key, toxic, word, times) of the words that have one of the stems."""
    for text, key, bad in zip(texts, keys, toxic, strict=True):
        for w, k in Counter(_WORD.findall(text.lower())).items():
            if any(s in stems for s in _stems_of(w)):
                yield key, bad, w, k


def choose(held: Iterable[tuple], stems: set[str], toxic: int, clean: int, size: tuple[int, int]) -> dict[str, float]:
    """Stems and weights, the strongest first, from hold_words(); size: words of clean and toxic texts."""
    docs: dict[str, tuple[set, set]] = {}
    times: dict[str, list[int]] = {}
    for key, bad, w, k in held:
        docs.setdefault(w, (set(), set()))[bad].add(key)
        times.setdefault(w, [0, 0])[bad] += k
    under = defaultdict(list)
    for w in docs:
        for s in _stems_of(w):
            if s in stems:
                under[s].append(w)
    covered: set[str] = set()

    def gain(stem: str) -> float:
        words = [w for w in under[stem] if w not in covered]
        return _gain(len(set().union(*(docs[w][1] for w in words))), len(set().union(*(docs[w][0] for w in words))), toxic, clean)

    heap = [(-g, -len(s), s) for s in sorted(under) if (g := gain(s)) >= LEAST_GAIN]
    heapq.heapify(heap)
    out: dict[str, float] = {}
    while heap:
        _, length, stem = heapq.heappop(heap)
        now = gain(stem)
        if now < LEAST_GAIN:
            continue
        if heap and (-now, length) > heap[0][:2]:
            heapq.heappush(heap, (-now, length, stem))
            continue
        words = [w for w in under[stem] if w not in covered]
        rate = [(sum(times[w][bad] for w in words) + 0.5) / (size[bad] + 1) for bad in (0, 1)]
        out[stem] = round(min(6.0, max(0.5, math.log(rate[1] / rate[0]))), 3)
        covered.update(words)
    return out


def contexts(texts: Iterable[str], machine: ahocorasick.Automaton) -> Counter:
    """(stem, whether it follows an intent) -> times."""
    return Counter((stem, bool(flags & INTENDED)) for text in texts for clause in clauses(text.lower(), machine) for stem, _, _, flags in clause)


def lexicon(stems: dict[str, float], seen: dict) -> Model:
    """The fixed insults and the learned stems; those that follow an intent in most places are threats."""
    told = {s: w for s, w in stems.items() if seen.get((s, True), 0) >= LEAST_TEXTS and seen[s, True] > seen.get((s, False), 0)}
    return Model({f"{w}$": 4.0 for w in sorted(SEED_INSULTS)} | stems, told)


def fit_weights(model: Model, x: np.ndarray, toxic: np.ndarray, share: float) -> Model:
    """The logistic model over features. share: of toxic rows among all labelled ones, if the sample doesn't hold them in that proportion.
    Corrections of single factors are held to 0 more strictly than the rest to its prior, so they move on evidence only."""
    y = toxic.astype(float)
    w = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    scale = np.sqrt((w[:, None] * x**2).sum(0) / w.sum())
    scale = np.where(scale > 1e-5, scale, 1.0)
    scale[3:] = np.maximum(scale[3:], scale[0])  # corrections are parts of the total
    z = np.column_stack((x / scale, np.ones(len(x))))
    prior = np.concatenate((np.array(model.weights) * scale, [-2.0]))
    hold = np.array([0.5, 0.5, 0.5, 4.0, 4.0, 4.0, 0.01])
    beta = prior.copy()
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -40, 40)))
        step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + np.diag(hold), z.T @ (w * (p - y)) + hold * (beta - prior))
        beta -= step * min(1.0, 2.0 / (1e-9 + np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return Model(model.stems, model.threats, [float(v) for v in scale], [float(v) for v in beta[:-1]], float(beta[-1]))


def fit(texts: list[str], toxic: list[bool], share: float | None = None) -> Model:
    """The model of some texts at hand."""
    if not any(toxic) or all(toxic):
        return lexicon({}, {})
    counts = count_stems(texts, toxic)
    n, m = counts["", True], counts["", False]
    some = {s for s, bad in counts if bad and s not in ("", "$") and standing_out(s, counts, n, m)}
    stems = choose(hold_words(texts, range(len(texts)), toxic, some), some, n, m, (counts["$", False], counts["$", True]))
    model = lexicon(stems, contexts((t for t, bad in zip(texts, toxic, strict=True) if bad), Model(stems).machine()))
    machine = model.machine()
    y = np.array(toxic)
    return fit_weights(model, np.array([features(t, machine)[0] for t in texts]), y, share or float(y.mean()))


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


_COUNTS = pa.schema([("stem", pa.string()), ("flag", pa.bool_()), ("n", pa.int64())])
_HELD = pa.schema([("doc_id", pa.int64()), ("toxic", pa.bool_()), ("word", pa.string()), ("times", pa.int64())])
_X = pa.schema([("toxic", pa.bool_()), ("x", pa.list_(pa.float64()))])


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([s for s, _ in counts], pa.string()), pa.array([f for _, f in counts], pa.bool_()), pa.array(list(counts.values()), pa.int64())], schema=_COUNTS)


def _columns(batch: pa.RecordBatch) -> tuple[list, list, list]:
    return batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, texts, toxic = _columns(batch)
        start = size = 0
        for end, text in enumerate(texts, 1):
            size += len(text)
            if size >= COUNTED or end == len(texts):
                yield _counted(count_stems(texts[start:end], toxic[start:end]))
                start, size = end, 0


def _hold_task(stems: set[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, toxic = _columns(batch)
        rows = list(hold_words(texts, ids, toxic, stems))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_HELD)], schema=_HELD)


def _context_task(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    machine = model.machine()
    for batch in batches:
        _, texts, toxic = _columns(batch)
        yield _counted(contexts((t for t, bad in zip(texts, toxic, strict=True) if bad), machine))


def _feature_task(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    machine = model.machine()
    for batch in batches:
        _, texts, toxic = _columns(batch)
        yield pa.RecordBatch.from_arrays([pa.array(toxic), pa.array([features(t, machine)[0] for t in texts], _X.field(1).type)], schema=_X)


def train(documents: DataFrame, labels: DataFrame) -> Model:
    """Learns from POSITIVE_ROWS + NEGATIVE_ROWS whole texts at most. Tasks read them; the driver gets counts of stems that stand out, the
    words under those, and a few numbers for each text."""
    spark = documents.sparkSession
    small_batches(spark)
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out())
    told = told.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in told.groupBy("toxic").count().collect()}
    sample = None
    for value, rows in ((1, POSITIVE_ROWS), (0, NEGATIVE_ROWS)):
        some = told.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        sample = some if sample is None else sample.unionByName(some)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    chosen = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = cut(chosen.select("doc_id", "text", (F.col("toxic") == 1).alias("toxic")), "labelled")
    counted = cut(rows.mapInArrow(_count_task, "stem string, flag boolean, n long").groupBy("stem").agg(F.sum(F.expr("if(flag, n, 0)")).alias("bad"), F.sum(F.expr("if(flag, 0, n)")).alias("good")), "stems")
    size = {r["stem"]: (r["good"], r["bad"]) for r in counted.where("stem IN ('', '$')").collect()}
    m, n = size.get("", (0, 0))
    if not n or not m:
        release(rows, counted)
        return lexicon({}, {})
    likely = counted.where((F.col("bad") >= LEAST_TEXTS) & ((F.col("bad") + 0.5) / (n + 1) >= LEAST_RATIO * (F.col("good") + 0.5) / (m + 1)) & ~F.col("stem").isin("", "$"))
    some = {r["stem"] for r in likely.collect() if _gain(r["bad"], r["good"], n, m) >= LEAST_GAIN}
    held = [tuple(r) for r in rows.mapInArrow(partial(_hold_task, some), "doc_id long, toxic boolean, word string, times long").collect()] if some else []
    stems = choose(held, some, n, m, size["$"])
    seen = rows.mapInArrow(partial(_context_task, Model(stems)), "stem string, flag boolean, n long").groupBy("stem", "flag").agg(F.sum("n").alias("n")).collect() if stems else []
    model = lexicon(stems, {(r["stem"], r["flag"]): r["n"] for r in seen})
    made = rows.mapInArrow(partial(_feature_task, model), "toxic boolean, x array<double>").collect()
    release(rows, counted)
    made = sorted((r["toxic"], *r["x"]) for r in made)  # in one order, wherever the tasks ran
    return fit_weights(model, np.array([r[1:] for r in made]), np.array([r[0] for r in made]), totals.get(1, 0) / max(1, sum(totals.values())))


_SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_clauses", pa.int64())])


def _score(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    machine = model.machine()
    for batch in batches:
        got = [features(x.as_py(), machine) for x in batch.column(1)]
        x = np.array([f for f, _ in got]).reshape(-1, len(FEATURES))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64()), pa.array([n for _, n in got], pa.int64())], schema=_SCORES)


def toxicity(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, n_clauses (that matched) of every row. No shuffle."""
    small_batches(documents.sparkSession)
    scores = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_score, model), "doc_id long, score double, n_clauses long")
    return scores.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_clauses")


def _clean(model: Model, at: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    machine = model.machine()
    for batch in batches:
        if len(batch):
            x = np.array([features(t.as_py(), machine)[0] for t in batch.column(at)])
            yield batch.filter(pa.array(model.score(x) < THRESHOLD))


def keep_clean(documents: DataFrame, model: Model) -> DataFrame:
    """The rows, with all their columns, whose score is below the threshold. No shuffle."""
    small_batches(documents.sparkSession)
    return documents.mapInArrow(partial(_clean, model, documents.columns.index("text")), documents.schema)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    from .common import table

    documents = table(spark, sf_dir, "documents")
    return toxicity(documents, train(documents, table(spark, sf_dir, "labels")))
