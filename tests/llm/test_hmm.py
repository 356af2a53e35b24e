"""The hidden Markov language model against plain versions."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import make_docs
from tests.llm.plain import FOLD, WORDS
from tripsearch.llm import hmm


def is_held():
    return F.crc32(F.col("doc_id").cast("string")) % 10 == 0


def held(key):
    return key is not None and zlib.crc32(str(key).encode()) % 10 == 0


def words(text):
    return [*WORDS.findall((text or "").translate(FOLD)), None]


def small_model(states=3, seed=1):
    rng = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return hmm.Model(norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((hmm.CLASSES, states)), 0))


def paths(model, seq):
    """(states, probability) of every path that emits ``seq``."""
    for states in itertools.product(range(len(model.start)), repeat=len(seq)):
        p = model.start[states[0]]
        for a, b in zip(states, states[1:]):
            p *= model.step[a, b]
        for s, c in zip(states, seq):
            p *= model.emit[c, s]
        yield states, p


def test_likelihood_is_the_sum_over_paths():
    model = small_model()
    seqs = [np.array(s) for s in ([0], [3, 0], [5, 5, 9, 0], [1, 2, 3, 4, 5, 0])]
    want = [math.log(sum(p for _, p in paths(model, s))) for s in seqs]
    for window in (1, 3, 100):
        assert hmm.log_likelihoods(model, seqs, window) == pytest.approx(want)


def test_expected_counts_are_those_of_all_paths():
    model = small_model()
    seqs = [np.array(s) for s in ([0], [3, 0], [5, 5, 9, 0], [1, 2, 3, 4, 5, 0])]
    want = hmm.Expected(np.zeros((hmm.CLASSES + 1, 3)), np.zeros((3, 3)))
    for seq in seqs:
        found = list(paths(model, seq))
        total = sum(p for _, p in found)
        for states, p in found:
            want.emit[-1, states[0]] += p / total
            for s, c in zip(states, seq):
                want.emit[c, s] += p / total
            for a, b in zip(states, states[1:]):
                want.step[a, b] += p / total
    for window in (1, 4, 100):
        got = hmm.Expected(np.zeros((hmm.CLASSES + 1, 3)), np.zeros((3, 3)))
        hmm.expected_counts(model, seqs, got, window)
        assert np.allclose(got.emit, want.emit) and np.allclose(got.step, want.step)


def shape(word):
    b = word.encode()
    look = np.array([b[0] << 24 | b[max(len(b) - 2, 0)] << 16 | b[-1] << 8 | min(len(b), 12)], np.uint64)
    return 1 + hmm.OWN + int(hmm.blocks.mix(look)[0] % np.uint64(hmm.SHAPES))


def band(n):
    return n if n <= 64 else math.floor(math.log2(n) * 64)


def plain(rows, model, head):
    """(id, held out, tokens, known, N, base, score) by the definitions, with a fitted model."""
    c = Counter(w for key, text in rows if key is not None and not held(key) for w in words(text))
    ranked = sorted((w for w in c if w is not None), key=lambda w: (-c[w], int(np.array([hash_of(w)], np.uint64).view(np.int64)[0])))
    if len(ranked) > head:  # whole bands only
        ranked = [w for w in ranked[:head] if band(c[w]) > band(c[ranked[head]])]
    ranked = ranked[: hmm.OWN]
    klass = {w: 1 + i for i, w in enumerate(ranked)} | {None: 0}
    total, kinds = Counter(), Counter()
    for w in c:
        k = klass.get(w) if w in klass else shape(w)
        total[k] += c[w]
        kinds[k] += 1
    n, v = sum(c.values()), len(c)
    for key, text in rows:
        w = words(text)
        ids = [klass[x] if x in klass else shape(x) for x in w]
        alpha, score = model.start * model.emit[ids[0]], 0.0
        for i in ids[1:]:
            score, alpha = score + math.log10(alpha.sum()), alpha / alpha.sum()
            alpha = (alpha @ model.step) * model.emit[i]
        score += math.log10(alpha.sum())
        score += sum(math.log10((c[x] + 0.1) / (total[k] + 0.1 * (kinds[k] + 1))) for x, k in zip(w, ids) if k > hmm.OWN)
        yield key, held(key), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), score


def hash_of(word):
    data = np.frombuffer(word.encode(), np.uint8)
    return hmm.tokens(data, np.array([0, len(data)]))[0][0]


@pytest.mark.parametrize("head", [1 << 19, 40])
def test_scores_by_definition(odd_docs, odd_rows, monkeypatch, head):
    """With a small head, most tokens go through the join."""
    monkeypatch.setattr(hmm, "HEAD", head)
    kept = []
    fit = hmm.trained
    monkeypatch.setattr(hmm, "trained", lambda *a, **k: kept.append(fit(*a, **k)) or kept[0])
    got = hmm.language_model(odd_docs, is_held(), 2)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    exact = lambda rows: Counter(tuple(r)[:5] + (round(r[5], 6), round(r[6], 5)) for r in rows)
    assert exact(got.collect()) == exact(plain(odd_rows, kept[0], head))


def test_every_pass_learns_and_states_follow_the_language(spark):
    rng = np.random.default_rng(4)
    tongues = [[f"{c}{rng.integers(1000)}" for _ in range(60)] for c in "abc"]
    rows = [(i, " ".join(rng.choice(tongues[i % 3], rng.integers(1, 50)))) for i in range(600)]
    docs = make_docs(spark, rows)
    by = {}
    for passes in (0, 1, 4):
        got = hmm.language_model(docs, is_held(), passes).collect()
        by[passes] = sum(r.score for r in got if not r.held_out)
    assert by[0] < by[1] < by[4]
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out) + 0.3 * sum(r.n_tokens - 1 for r in got if r.held_out)


def test_nothing_to_learn_from(spark, no_docs):
    assert hmm.language_model(no_docs, is_held(), 1).count() == 0
    docs = make_docs(spark, [(None, "one two"), (None, None)])
    got = sorted(hmm.language_model(docs, is_held(), 1).collect(), key=lambda r: r.n_tokens)
    assert [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got] == [(None, False, 1, 0, 0), (None, False, 3, 0, 0)]
    assert all(r.base_score == pytest.approx(0) and r.score < 0 for r in got)
