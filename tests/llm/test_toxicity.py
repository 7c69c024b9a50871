import math
import random
import re
import zlib

import numpy as np
import pytest

from rasterloom.llm import toxicity as T


@pytest.fixture(scope="module")
def model():
    r = np.random.default_rng(5)
    plain = ["the", "table", "green", "walks", "under", "seven", "river", "maps", "softly", "cloud", "not", "you"]
    texts, bad = [], []
    for k in range(400):
        words = list(r.choice(plain, 60))
        if k % 4 == 0:
            for i in r.integers(0, 60, 3):
                words[i] = r.choice(["idiot", "schurkisch", "schurkerei"])
        texts.append(". ".join(" ".join(words[i : i + 10]) for i in range(0, 60, 10)))
        bad.append(k % 4 == 0)
    return T.fit(texts, bad)


def test_stems_are_learned(model):
    assert "idiot$" in model.stems and any(s.startswith("schurk") for s in model.stems)
    assert not any(s.startswith(("tabl", "rive")) for s in model.stems)


def test_grammar_flags(model):
    m = model.machine()
    N, R, Y, S, I = T.NEGATED, T.REPORTED, T.TARGETED, T.STACKED, T.INTENDED  # noqa: E741
    for text, want in {
        "an idiot walks": [0],
        "you idiot": [Y],
        "that idiot, you know": [Y],
        "an idiot. you know": [0],
        "you are not an idiot": [Y | N],
        "not here, not now, but this one is an idiot": [0],
        "he said you idiot": [Y | R],
        'he said: "you are an idiot"': [Y | R],
        '"you idiot!" he said': [Y | R],
        '"idiot", she shouted': [R],
        '"hello", he said. you idiot': [Y],
        'he said "good day", you idiot': [Y],
        '"idiot" and what else was never said': [0],
        "he said so. you idiot": [Y],
        "idiot idiot": [S, S],
        "i will kill you": [Y | I],
        "i will never kill you": [Y | I | N],
        "killing time": [0],
        "ich werde dich töten": [Y | I],
        "idiotic antiidiot": [],
        "": [],
    }.items():
        assert [f for c in T.clauses(text, m) for *_, f in c] == want, text
    assert T.features("an idiot. a map. an idiot", m)[1] == 2 and T.features(None, m)[0] == [0.0] * len(T.FEATURES)


def test_composition_is_the_product():
    def apart(kinds, machines):
        states, out = [0] * len(machines), []
        for k in kinds:
            flags = 0
            for i, f in enumerate(machines):
                states[i], flag = f(states[i], k)
                flags |= flag
            out.append(flags)
        return out

    r = np.random.default_rng(1)
    for _ in range(200):
        kinds = r.integers(0, T.KINDS, 14).tolist()
        for table, machines in ((T.AHEAD, (T._insult, T._threat, T._target, T._negation, T._report)), (T.BACK, (T._insult, T._target, T._report_back))):
            state, got = 0, []
            for k in kinds:
                state, flags = table[state][k]
                got.append(flags)
            assert got == apart(kinds, machines)


def brute(text, model):
    """The features by looking at every pair of tokens, without machines."""
    low, sums, lexicon = text.lower(), [0.0] * 4, {}
    for stem, w in {**{s: (w, T.INSULT) for s, w in model.stems.items() if s not in model.threats}, **{s: (T.THREAT_WEIGHT, T.THREAT) for s in T.THREATS}, **{s: (w, T.THREAT) for s, w in model.threats.items()}}.items():
        lexicon[stem] = w
    for clause in re.split(r"[.!?;|\n]+(?![\"”»])", low):
        words = re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)*|[\"“”„«»]|:", clause)
        kinds, weights = [], []
        for w in words:
            fit = [v for s, v in lexicon.items() if (w.split("'")[0] == s[:-1] if s.endswith("$") else w.startswith(s))]
            v, kind = max(fit) if fit else (0.0, T._FIXED.get(w, T.OTHER))
            kinds.append(kind)
            weights.append(v)
        is_word = [k not in (T.QUOTE, T.COLON) for k in kinds]
        between = lambda i, j: sum(is_word[i + 1 : j])
        quotes = [i for i, k in enumerate(kinds) if k == T.QUOTE]
        verbs = [i for i, k in enumerate(kinds) if k == T.REPORT]
        told, at = set(), -1
        while later := [v for v in verbs if v > at]:  # verb first
            inside = [q for q in quotes if q > later[0]][:2]
            at = inside[1] if len(inside) == 2 else len(kinds)
            told |= set(range(later[0], at))
        end = len(kinds)
        while closing := [q for q in quotes if q < end and any(q < v < end and between(q, v) < T.SCOPE for v in verbs)]:  # quote first
            opening = max((q for q in quotes if q < closing[-1]), default=-1)
            told |= set(range(opening + 1, closing[-1]))
            end = max(opening, 0)
        for i, kind in enumerate(kinds):
            if kind not in (T.INSULT, T.THREAT):
                continue
            near = lambda what: any(k == what and between(j, i) < T.SCOPE for j, k in enumerate(kinds[:i]))  # noqa: B023, E731
            you = T.TARGET in kinds
            if kind == T.THREAT:
                f = (1.5 if near(T.INTENT) else 0.3) if you else 0.02
            else:
                f = (1.5 if you else 1.0) * (1.2 if T.INSULT in (*kinds[max(0, i - 1) : i], *kinds[i + 1 : i + 2]) else 1.0)
            f *= (0.1 if near(T.NEGATION) else 1.0) * (0.15 if i in told else 1.0)
            w = weights[i] * f
            sums[0] += w
            if near(T.NEGATION) or i in told:
                sums[2] += w
            elif kind == T.THREAT:
                sums[3] += w
            elif you:
                sums[1] += w
    return [sums[0], math.log1p(sums[0]), len(low.split()) / 100, *sums[1:]]


def test_features_equal_brute_force(model):
    r = random.Random(4)
    vocabulary = ["you", "idiot", "schurkisch", "kill", "killing", "murdered", "will", "not", "never", "said", "called", '"', '"', ":", ",", ".", "!", "the", "river", "du", "green", "\n", "«", "»", "idiot's", "they"]
    machine = model.machine()
    for _ in range(3000):
        text = r.choice(("", " ")).join(("", *(f" {r.choice(vocabulary)}" for _ in range(r.randint(0, 25)))))
        assert np.allclose(T.features(text, machine)[0], brute(text, model)), text


def labelled(seed, count=400):
    """Texts that hold the same insults and threats; what is said about them decides."""
    r = random.Random(seed)
    insult = lambda: r.choice(sorted(T.SEED_INSULTS))
    verb = lambda: r.choice(("kill", "murder", "stab", "strangle", "shoot"))
    toxic = (lambda: f"You are a {insult()} {insult()}.", lambda: f"What a {insult()} you are, you {insult()}!", lambda: f"I will {verb()} you.", lambda: f"We are going to {verb()} you, {insult()}.")
    clean = (lambda: f"You are not a {insult()}.", lambda: f'He said: "you are a {insult()}".', lambda: f'"You {insult()}!" she shouted.', lambda: f"He wrote that you were a {insult()}.", lambda: f"I will never {verb()} you.", lambda: f"They {verb()} time.", lambda: f'"We will {verb()} you", he said.')
    plain = ("The river runs north", "Seven maps lie on the table", "It rained all day", "Green clouds walk softly", "What a day to walk", "They are going to the river")
    out = []
    for k in range(count):
        parts = [r.choice(plain) + "." for _ in range(r.randint(0, 6))]
        for _ in range(r.randint(1, 2)):
            parts.insert(r.randint(0, len(parts)), r.choice(toxic if k % 2 else clean)())
        out.append((" ".join(parts), bool(k % 2)))
    return out


def test_flags_decide_both_ways(monkeypatch):
    """The same words are toxic or not by what stands around them; without flags they can't be told apart."""
    own, other = labelled(1), labelled(2)
    model = T.fit([t for t, _ in own], [y for _, y in own])
    told = lambda m: [bool(m.score(np.array([T.features(t, m.machine())[0]]))[0] >= T.THRESHOLD) for t, _ in other]
    right = np.mean([a == y for a, (_, y) in zip(told(model), other, strict=True)])
    assert right > 0.97
    monkeypatch.setattr(T, "flagged", lambda kinds: [0] * len(kinds))
    blind = T.fit([t for t, _ in own], [y for _, y in own])
    assert np.mean([a == y for a, (_, y) in zip(told(blind), other, strict=True)]) < 0.8


def test_threat_stems_are_learned():
    """A stem that follows an intent in most places."""
    r = random.Random(9)
    texts = [("I will " + r.choice(("zermalme", "zermalmen")) + " you. " if k % 3 == 0 else "You schurke. " if k % 3 == 1 else "A quiet day. ") + "Seven maps lie here." for k in range(300)]
    model = T.fit(texts, [k % 3 < 2 for k in range(300)])
    assert any("zermalmen".startswith(s.rstrip("$")) for s in model.threats) and not any(s.startswith("schur") for s in model.threats)


def test_whole_texts_are_learned_from(spark):
    """Of long texts, what stands at their end counts as well."""
    body = "seven green maps lie on the table and clouds walk softly. " * 2000
    docs = spark.createDataFrame([(i, body + ("you schuft" if i % 3 == 0 else "the river")) for i in range(90)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    model = T.train(docs, labels)
    assert any(s.startswith("schu") for s in model.stems)
    told = [i for i in range(90) if zlib.crc32(str(i).encode()) % 3 != 1]
    local = T.fit([body + ("you schuft" if i % 3 == 0 else "the river") for i in told], [i % 3 == 0 for i in told])
    assert local.stems == model.stems and np.allclose(local.weights, model.weights)


def test_scores(model):
    x = np.array([T.features(t, model.machine())[0] for t in ("", "the green river", "you idiot, schurkischer idiot")])
    s = model.score(x)
    assert s[0] < 0.2 and s[1] < 0.2 and s[2] > 0.7


def test_without_labels():
    assert T.fit([], []).stems and T.fit(["a"], [False]).stems


def test_edges(spark, edges, empty, model):
    rows = T.toxicity(edges, model).collect()
    assert len(rows) == edges.count() and all(0 <= r["score"] <= 1 for r in rows)
    for r in rows:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert r["predicted"] == int(r["score"] >= T.THRESHOLD)
    assert T.toxicity(empty, model).collect() == [] and T.keep_clean(empty, model).collect() == []
    kept = T.keep_clean(edges, model)
    assert kept.schema == edges.schema and kept.count() == edges.count()


def test_training_reads_labels_of_the_right_rows_only(spark):
    docs = spark.createDataFrame([(i, "you idiot moron" if i % 3 == 0 else "green river") for i in range(60)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(3, 0), (None, 1), (4, None), (999, 1)], "doc_id long, toxic int")
    model = T.train(docs, labels)
    got = {r["doc_id"]: r["predicted"] for r in T.toxicity(docs, model).collect()}
    assert all(got[i] == int(i % 3 == 0) for i in range(60))


def test_held_out_documents(spark):
    """Of held-out labelled documents, nearly all that are called toxic are, and most toxic ones are called so."""
    rows = {r["doc_id"]: r["predicted"] for r in T.op1_toxicity(spark, "/root/testdata/sf0.1").where("held_out").collect()}
    labels = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect() if r["doc_id"] in rows]
    hit = sum(rows[d] for d, t in labels if t)
    assert hit / sum(rows[d] for d, _ in labels) > 0.95 and hit / sum(t for _, t in labels) > 0.85
