"""Quality, toxicity and mixing."""

import math
import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import make_docs
from tripsearch import storage
from tripsearch.llm import kneser, raking, toxic, wordgrams


def syllables(rng, n):
    return " ".join("".join(rng.choice(["the", "an", "er", "on", "ing", "sh"]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        text, bad, rude = syllables(rng, rng.randrange(5, 60)), i % 7 == 0, i % 5 == 1
        if bad:
            text = " ".join(f"{w.upper()}%%%" for w in text.split())
        if rude:
            words = text.split()
            words.insert(rng.randrange(len(words) + 1), rng.choice(["moronic", "vilest"]))
            text = " ".join(words)
        rows.append((i, text))
        if i % 4:
            labels.append((i, int(not bad), int(rude)))
    rows += [(700, None), (701, ""), (None, "the er"), (5, rows[5][1])]
    return make_docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_model_is_a_distribution(labelled):
    docs, _ = labelled
    model = kneser.log_model(kneser.count_grams(docs).cache())
    sums = np.exp(model.astype(np.float64)).reshape(-1, kneser.CLASSES).sum(axis=1)
    assert np.allclose(sums, 1, atol=1e-3)


def test_modified_kneser_ney_by_hand(spark):
    """Order by order in plain Python on a small text."""
    text = "the then than that they the the an then " * 3 + "other things thin"
    docs = make_docs(spark, [(1, text)])
    model = kneser.log_model(kneser.count_grams(docs))
    table = kneser.letter_classes()
    seq = [kneser.NEWLINE] * 3 + [int(table[b]) for b in text.encode()]
    counts = {4: Counter(tuple(seq[i : i + 4]) for i in range(len(seq) - 3))}
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def cut(k):
        n = [sum(1 for c in counts[k].values() if c == j) for j in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0
        return [min(max(i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else 0.5, 0.1), i - 0.1) for i in (1, 2, 3)]

    def prob(g):
        k = len(g)
        if not k:
            return 1 / kneser.CLASSES
        d, same = cut(k), {h: c for h, c in counts[k].items() if h[:-1] == g[:-1]}
        total = sum(same.values())
        if not total:
            return prob(g[1:])
        c = counts[k].get(g, 0)
        return (c - d[min(c, 3) - 1] if c else 0) / total + sum(d[min(x, 3) - 1] for x in same.values()) / total * prob(g[1:])

    for g in list(counts[4])[:40] + [(1, 2, 3, 4), (20, 8, 5, 9)]:
        code = sum(x * kneser.CLASSES ** (3 - i) for i, x in enumerate(g))
        assert math.isclose(math.exp(model[code]), prob(g), rel_tol=1e-4)


def tokens_of(text):
    return re.findall(r" ?(?:[^\W_\u0800-\U0010ffff]+|[\u0800-\U0010ffff]|[^\w\s]+|_+)|\s", text)


def test_word_grams_by_hand(spark):
    """Perplexities by the recursive definition over tokens, for seen and new words, in scripts that letter classes fold."""
    taught = ["the cat sat on the mat, the cat sat.\nthe dog sat on the cat", "кот сел на кота, кот сел", "天地玄黄 天地玄黄宇宙 天地"]
    asked = ["the cat sat on the dog", "сел кот на кота", "天地宇宙", "dog the on sat cat the", "nothing seen 12", taught[1], taught[1]]
    docs = make_docs(spark, list(enumerate(taught)))
    spell = kneser.speller(kneser.log_model(kneser.count_grams(docs)))
    seqs = [["<", "<", *tokens_of(t), ">"] for t in taught]
    counts = {3: Counter(tuple(s[i : i + 3]) for s in seqs for i in range(len(s) - 2))}
    for k in (2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def cut(k):
        n = [sum(1 for c in counts[k].values() if c == j) for j in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0
        return [min(max(i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else 0.5, 0.1), i - 0.1) for i in (1, 2, 3)]

    def prob(g):
        if not g[:1]:
            return None
        w = b"" if g[-1] == ">" else g[-1].encode()
        d, same = cut(len(g)), [c for h, c in counts[len(g)].items() if h[:-1] == g[:-1]]
        lower = prob(g[1:]) if len(g) > 1 else math.exp(spell(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0])
        if not same:
            return lower
        c = counts[len(g)].get(g, 0)
        return (c - d[min(c, 3) - 1] if c else 0) / sum(same) + sum(d[min(x, 3) - 1] for x in same) / sum(same) * lower

    want = {}
    for i, t in enumerate(asked):
        s = ["<", "<", *tokens_of(t), ">"]
        want[i] = math.exp(-sum(math.log(prob(tuple(s[j : j + 3]))) for j in range(len(s) - 2)) / len(t.encode()))
    got = {r.doc_id: r.perplexity for r in kneser.perplexities(make_docs(spark, list(enumerate(asked))), docs).collect()}
    assert got == {i: pytest.approx(p, rel=1e-5) for i, p in want.items()}
    assert got[0] < 0.7 * got[3]  # the same words out of order


def test_quality(labelled):
    docs, labels = labelled
    got = kneser.quality(docs, labels.filter("quality = 1")).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert by[700].perplexity is None and not by[700].keep and not by[701].keep
    kept = [by[i].keep for i in range(600)]
    assert sum(kept[i] for i in range(600) if i % 7) >= 0.98 * sum(1 for i in range(600) if i % 7)
    assert not any(kept[i] for i in range(0, 600, 7))
    rest = kneser.keep_good(docs, labels.filter("quality = 1"))
    assert rest.columns == docs.columns
    assert {r.doc_id for r in rest.select("doc_id").collect()} == {i for i in range(600) if kept[i]} | {None}


def test_quality_without_trusted_texts_keeps_all(labelled):
    docs, labels = labelled
    got = kneser.quality(docs, labels.filter("quality = 5")).collect()
    assert all(r.keep == (r.perplexity is not None) for r in got)


def test_toxicity(labelled):
    docs, labels = labelled
    taught = labels.filter("doc_id % 3 > 0")
    got = toxic.toxicity(docs, taught).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    asked = [r for r in got if r.doc_id is not None and r.doc_id < 600 and r.doc_id % 3 == 0]
    hits = Counter((r.doc_id % 5 == 1, r.score >= 0.3) for r in asked)
    assert hits[True, True] >= 0.9 * (hits[True, True] + hits[True, False])
    assert hits[False, False] >= 0.95 * (hits[False, True] + hits[False, False])
    same = [r.score for r in got if r.doc_id in (700, 701)]
    assert abs(same[0] - same[1]) < 1e-6


def test_toxicity_reads_nothing_but_text(labelled):
    docs, labels = labelled
    network, _, _ = toxic.fit(docs, labels)
    a = toxic.score(docs, network).filter("doc_id >= 0").collect()
    b = toxic.score(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("y")), network).filter("doc_id >= 0").collect()
    # the tables' batches differ, and with them the order of float sums
    assert Counter((r.doc_id, round(r.score, 4)) for r in a) == Counter((r.doc_id, round(r.score, 4)) for r in b)


def test_toxicity_with_one_kind_of_label(labelled):
    docs, labels = labelled
    assert all(r.score < 1e-9 for r in toxic.toxicity(docs, labels.filter("toxic = 0")).collect())


def test_toxicity_learns_from_long_texts(spark):
    """All toxic documents are over 200 kB; their word is in their last piece."""
    long = "the an er " * 20_500
    rows = [(i, f"{long} moronic") for i in range(40)] + [(100 + i, "the an er " * (1 + i % 9)) for i in range(200)]
    rows += [(300 + i, long) for i in range(10)]
    rows += [(400, "an er moronic"), (401, "an er"), (402, long), (403, f"{long} moronic {long}")]
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in rows if i < 400], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxic.toxicity(make_docs(spark, rows), labels).filter("doc_id >= 400").collect()}
    assert min(got[400], got[403]) > 0.5 > max(got[401], got[402])


def test_toxicity_learns_from_every_row_in_any_layout(spark, labelled, monkeypatch):
    """More rows than the 4000 clean ones that a sample once held; several shards; the same network however rows lie."""
    rng = random.Random(9)
    rows = [(i, f"w{rng.randrange(50)} clean{i}") for i in range(4500)] + [(5000 + i, "moronic") for i in range(40)]
    labels = spark.createDataFrame([(i, int(i >= 5000)) for i, _ in rows], "doc_id long, toxic int")
    seen, count = toxic.count_words(toxic.encode(make_docs(spark, rows), labels))
    assert count.tolist() == [4500, 40]
    assert seen[1].sum() == 2 * 40  # the word and the padding
    monkeypatch.setattr(toxic, "SHARD_WORDS", 2000)
    docs, labels = labelled
    one, _, every = toxic.fit(docs, labels)
    other, _, same = toxic.fit(docs.repartition(7, "text"), labels)
    assert (one.state() == other.state()).all() and (one.slope, one.shift, every) == (other.slope, other.shift, same)


def test_peaks_of_pieces(monkeypatch):
    network = toxic.Network()
    flat = np.concatenate([np.random.default_rng(1).integers(1, toxic.BUCKETS, 500), np.zeros(2 * toxic.PAD, int)]).astype(np.int32)
    offsets = np.array([0, 500 + toxic.PAD])
    whole = network.peaks(flat, offsets)
    for piece in (1, 7, 500, 502):
        monkeypatch.setattr(toxic, "PIECE", piece)
        top, place = network.peaks(flat, offsets)
        assert np.allclose(top, whole[0]) and (place == whole[1]).all()


def test_trigrams_travel_as_three_tokens(spark):
    """Keys made after the counts are those that texts are scored by."""
    texts = ["a b a b", "", "z", "a b!"]
    counted = wordgrams.count_trigrams(make_docs(spark, list(enumerate(texts))))
    assert counted.columns == ["k0", "c2", "k1", "n"]
    got = Counter({(r.k3, r.c3, r.k2, r.c2, r.k1): r.n for r in wordgrams.with_keys(counted).collect()})
    want = Counter()
    for t in texts:
        _, _, one, two, three, foretold = wordgrams.positions(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))
        one, two, three = (x.view(np.int64).tolist() for x in (one, two, three))
        want.update((three[i], two[i - 1], two[i], one[i - 1], one[i]) for i in np.flatnonzero(foretold))
    assert got == want


def test_grams_travel_packed():
    """Columns come back as they went, and a block's grams meet the model's, one of which has two values."""
    rng = np.random.default_rng(8)
    columns = rng.integers(0, 2**63, 30).astype(np.uint64), np.zeros(0, np.uint32), rng.integers(0, 9, 7).astype(np.uint32)
    assert all(a.dtype == b.dtype and (a == b).all() for a, b in zip(columns, wordgrams.unpacked(wordgrams.packed(*columns))))
    every = rng.integers(0, 2**63, 20).astype(np.uint64)
    row, prints = np.sort(rng.integers(0, 6, 300)), rng.integers(0, 2**62, 6).astype(np.uint64)
    keys = every[rng.integers(0, 20, 300)]
    value = dict(zip(every[:15].tolist(), rng.random(15)))
    known = np.array(list(value), np.uint64)
    model = wordgrams.packed(np.append(known, known[0]), np.append([value[k] for k in value], 5.0))
    value[int(known[0])] += 5.0
    sent = list(wordgrams.pack_grams(keys, row, prints, 3))
    assert len({t for t, _ in sent}) == len(sent) <= 3
    names = ["target", "model", "grams"]
    batch = pa.RecordBatch.from_arrays([pa.array([*[t for t, _ in sent], 0]), pa.array([False] * len(sent) + [True]), pa.array([*[x for _, x in sent], model])], names)
    got = {p: a for out in wordgrams.add_up(iter([batch])) for p, a in zip(out.column(0).to_pylist(), out.column(1).to_pylist())}
    want = {int(prints[r]): sum(value.get(int(k), 0.0) for k in keys[row == r]) for r in set(row.tolist())}
    assert got == {p: pytest.approx(a) for p, a in want.items()}


def test_tables_that_nothing_reads_go(spark, monkeypatch):
    """Grams, shares and sums by part are deleted once the next step is written; the values do not depend on the parts."""
    monkeypatch.setattr(storage, "new_folder", lambda s, name, real=storage.new_folder: made.append((name, real(s, name))) or made[-1][1])
    rng = np.random.default_rng(6)
    docs = make_docs(spark, [(i, " ".join(f"w{x}" for x in rng.integers(0, 9, 12))) for i in range(20)])
    found = []
    for parts in (1, 3):
        made = []
        monkeypatch.setattr(wordgrams, "MODEL_PARTS", parts)
        monkeypatch.setattr(wordgrams, "TEXT_PARTS", parts)
        found.append({r.doc_id: r.perplexity for r in kneser.perplexities(docs, docs.filter("doc_id < 9")).collect()})
        left = Counter(name for name, path in made if os.path.exists(path))
        assert not left["grams-3"] and not left["grams-2"] and not left["shares-3"] and left["added"] == 1
    assert found[0] == {i: pytest.approx(p, rel=1e-6) for i, p in found[1].items()}


def test_windows_stay_in_their_document():
    network = toxic.Network()
    table = network.tables()
    texts = [b"one two", b"", b"three four five", b"x"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    together = network.scores(table, *toxic.word_ids(data, offsets))
    alone = [network.scores(table, *toxic.word_ids(np.frombuffer(t, np.uint8), np.array([0, len(t)])))[0] for t in texts]
    assert np.allclose(together, alone)


def fitted(tokens, goals, passes=2000):
    """Iterative proportional fitting in numpy."""
    w = tokens.astype(float)
    for _ in range(passes):
        for axis, goal in enumerate(goals):
            other = tuple(i for i in range(3) if i != axis)
            now = w.sum(axis=other)
            shape = [1, 1, 1]
            shape[axis] = -1
            w = w * np.divide(goal, now, out=np.ones_like(now), where=now > 0).reshape(shape)
    return w


def test_raking_meets_its_margins(spark):
    rng = np.random.default_rng(2)
    tokens = rng.integers(1, 1000, (4, 3, 2))
    tokens[0, 0, 1] = 0
    rows = [(f"s{i}", f"l{j}" if j else None, f"t{k}", int(tokens[i, j, k])) for i in range(4) for j in range(3) for k in range(2)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    shares = {"source": {"s0": 0.4, "s1": 0.3, "s2": 0.2, "s3": 0.1, "unseen": 5.0}, "lang": {None: 0.2, "l1": 0.5, "l2": 0.3}, "topic": {"t0": 0.5, "t1": 0.5}}
    targets = {m: spark.createDataFrame(list(s.items()), "value string, share double") for m, s in shares.items()}
    got = raking.rake(cells, targets).collect()
    total = tokens.sum()
    want = fitted(tokens, [total * np.array([0.4, 0.3, 0.2, 0.1]), total * np.array([0.2, 0.5, 0.3]), total * np.array([0.5, 0.5])])
    for r in got:
        i, j, k = int(r.source[1]), int(r.lang[1]) if r.lang else 0, int(r.topic[1])
        assert r.tokens * r.weight == pytest.approx(want[i, j, k], abs=total * 1e-5)


def test_probabilities_spend_the_budget(spark):
    rows = [(f"s{i}", 100 * (i + 1), w) for i, w in enumerate([0.1, 0.5, 1.0, 8.0, 0.0])] + [("none", 0, 1.0)]
    got = raking.probabilities(spark.createDataFrame(rows, "source string, tokens long, weight double"), 0.5).collect()
    assert sum(r.tokens * r.probability for r in got) == pytest.approx(0.5 * sum(r[1] for r in rows))
    assert all(r.probability <= 1 and r.sample_weight >= 1 for r in got)


def test_mix(odd_docs, odd_rows):
    got = raking.mix(odd_docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(k for k, _ in odd_rows)
    total = sum(r.tokens for r in got)
    assert sum(r.tokens * r.probability for r in got) == pytest.approx(raking.KEEP * total)
    assert len({(r.sampled, r.doc_id) for r in got if r.doc_id == 5}) == 1
    again = raking.mix(odd_docs.repartition(7)).collect()
    assert Counter(map(repr, ((r.doc_id, r.tokens, r.sampled) for r in got))) == Counter(map(repr, ((r.doc_id, r.tokens, r.sampled) for r in again)))


def test_empty_tables(spark, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert kneser.quality(no_docs, labels).count() == 0
    assert kneser.keep_good(no_docs, labels).count() == 0
    assert toxic.toxicity(no_docs, labels).count() == 0
    assert raking.mix(no_docs).count() == 0
