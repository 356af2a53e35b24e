"""Jaccard join, both substring operators and decontamination against plain versions."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import plain
from tests.llm.conftest import make_docs, sentence
from tripsearch.llm import decontam, induce, jaccard, links, recompress, suffix, windows


def test_classes(odd_docs, odd_rows):
    named = [(k, t) for k, t in odd_rows if k is not None]
    want = plain.classes(named)
    got = jaccard.join_classes(odd_docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter((k, len(plain.shingle_set(t)), want.get(k)) for k, t in odd_rows)


def test_random_small_sets_lose_no_link(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        w = [f"t{x}" for x in range(int(rng.integers(1, 40)))]
        start = int(rng.integers(0, 3))
        for _ in range(int(rng.integers(0, 3))):
            w[int(rng.integers(0, len(w)))] = f"c{rng.integers(0, 3)}"
        rows.append((i, " ".join(w[start:])))
    want = plain.classes(rows)
    got = {r.doc_id: r.component_id for r in jaccard.join_classes(make_docs(spark, rows)).collect()}
    assert got == want


def test_only_sets_that_can_link_get_signatures(spark, monkeypatch):
    """A family whose members share a part of 60 to 70 % and no more: no links, so no rows and no pairs; blocks of any size agree."""
    rng = random.Random(11)
    base = sentence(rng, 300, 10**6).split(" ")
    rows = []
    for i in range(40):
        cut = 190 + rng.randrange(20)
        rows.append((i, " ".join(base[:cut] + sentence(rng, 300 - cut, 10**6).split(" "))))
    rows += [(100 + i, " ".join(base[: 300 - 5 * i])) for i in range(6)]  # links: one ends before the other
    rows += [(200 + i, sentence(rng, 80, 10**6)) for i in range(20)] + [(200, rows[-1][1]), (None, rows[0][1]), (300, None)]
    docs = make_docs(spark, rows)
    sets = [(i, {tuple(t.split(" ")[j : j + 5]) for j in range(len(t.split(" ")) - 4)}) for i, t in rows if i is not None and t]
    uses = Counter(x for _, s in sets for x in s)
    want = Counter((i, len(s)) for i, s in sets if 100 * sum(uses[x] > 1 for x in s) >= 75 * len(s))
    assert 0 < sum(want.values()) < 20
    for block in (1, 700, 10**6):
        monkeypatch.setattr(jaccard, "PER_BLOCK", block)
        got = jaccard.linkable(docs, 3, 75, "doc_id", "text").collect()
        assert Counter((r.doc_id, r.n_shingles) for r in got) == want
    asked = []
    monkeypatch.setattr(jaccard, "emit", lambda d, *a, real=jaccard.emit: asked.append(d) or real(d, *a))
    found = {r.doc_id: r.component_id for r in jaccard.join_classes(docs).collect()}
    assert {found[100 + i] for i in range(6)} == {100} and all(found[i] == i for i in range(40))
    assert asked and asked[0].filter("doc_id < 40").count() == 0


def test_sketches_never_hide_a_common_token():
    rng = np.random.default_rng(4)
    for sizes in ([3, 5, 1], [140, 150, 160], [4000, 5000, 4500]):
        sets = [rng.choice(int(1.5 * max(sizes)), n, replace=False) for n in sizes]
        place = rng.integers(0, jaccard.CELLS, int(1.5 * max(sizes)))
        held = np.bincount(np.concatenate(sets))
        codes = [i * jaccard.CELLS + place[x] for i, x in enumerate(sets)]
        lone = [i * jaccard.CELLS + place[x[held[x] == 1]] for i, x in enumerate(sets)]
        bits, over = jaccard.sketch(np.concatenate(codes), np.concatenate(lone), len(sets))
        for i in range(3):
            for j in range(i):
                most = sum(int(v).bit_count() for v in (bits[i] & bits[j]).view(np.uint64)) + min(over[i], over[j])
                assert len(np.intersect1d(sets[i], sets[j])) <= most <= min(held[x].__gt__(1).sum() for x in (sets[i], sets[j]))


def test_near_copies_that_cannot_link_are_not_compared(spark, monkeypatch):
    """Of one group of near copies only few pairs are compared, and no link is lost."""
    rng = random.Random(5)
    rows = []
    for i in range(60):  # about one base text, which is not there; every tenth text has a partner
        words = [f"b{j}" for j in range(150)]
        for at in rng.sample(range(4, 146), 4):
            words[at] = f"n{i}x{at}"
        rows.append((i, " ".join(words)))
        if i % 10 == 0:
            rows.append((100 + i, " ".join(["before", *words])))
    asked = []
    monkeypatch.setattr(jaccard, "verified", lambda pairs, *a, real=jaccard.verified: asked.append(pairs.count()) or real(pairs, *a))
    got = {r.doc_id: r.component_id for r in jaccard.join_classes(make_docs(spark, rows)).collect()}
    assert got == plain.classes(rows)
    assert {got[100 + i] == got[i] for i in range(0, 60, 10)} == {True}
    assert sum(asked) < 5 * len(rows)


def test_repeated_id_stands_for_a_class_of_its_own(spark):
    """An id that is a copy by one text and the smallest of its class by another keeps the links of both."""
    words = [f"b{i}" for i in range(100)]
    near = " ".join([*words[:50], "other", *words[51:]])
    rows = [(1, "one text that the others do not share at all"), (7, "one text that the others do not share at all"), (7, " ".join(words)), (9, near)]
    want = plain.classes(rows)
    assert want == {1: 1, 7: 1, 9: 1}
    got = jaccard.join_classes(make_docs(spark, rows)).collect()
    assert {(r.doc_id, r.component_id) for r in got} == set(want.items())


def test_allocation_covers_every_set():
    rng = np.random.default_rng(9)
    ends = jaccard.bands(3000)
    for n in [1, 2, 3, 4, 5, 7, 8, 11, 12, 20, 60, 61, 100, 400, 2000]:
        tokens = np.sort(rng.integers(0, 2**63, n, np.uint64))
        s = jaccard.Segmented(tokens, np.array([0, n]), ends, 1, 0)
        for rare in (np.ones(n, bool), np.zeros(n, bool)):
            chosen, twice, least = s.allocate(rare)
            assert least[0] >= 1 and chosen.sum() + twice.sum() >= 2 * n // 7 + least[0]


def test_one_of_each_keeps_rows_and_columns(odd_docs, odd_rows):
    kept = jaccard.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    want = plain.classes([(k, t) for k, t in odd_rows if k is not None])
    assert Counter(r.doc_id for r in kept.collect()) == Counter(k for k, _ in odd_rows if k is None or want[k] == k)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (201, 200), (300, 300)]
    got = {r.node: r.component for r in links.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200}


def test_words_removed(odd_docs, odd_rows):
    rows = [(k, plain.WORDS.findall(t or "")) for k, t in odd_rows]
    want = Counter()
    for (k, w), flags in zip(rows, plain.removed(rows, 50)):
        kept = " ".join(x for x, f in zip(w, flags) if not f)
        want[(k, len(w), sum(flags), plain.sha(kept.encode()), kept)] += 1
    got = recompress.deduplicate(odd_docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in got) == want


def test_bytes_removed(odd_docs, odd_rows):
    rows = [(k, (t or "").encode()) for k, t in odd_rows]
    want = Counter()
    for (k, b), flags in zip(rows, plain.removed(rows, 50)):
        kept = bytes(x for x, f in zip(b, flags) if not f)
        spans = sum(f and not (i and flags[i - 1]) for i, f in enumerate(flags))
        want[(k, len(b), sum(flags), spans, plain.sha(kept))] += 1
    got = suffix.deduplicate(odd_docs).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed and plain.sha(bytes(r.kept)) == r.kept_sha256 for r in got)


def test_without_repeats(odd_docs, odd_rows):
    got = suffix.without_repeats(odd_docs, window=150)
    assert got.columns == odd_docs.columns
    rows = [(k, (t or "").encode()) for k, t in odd_rows]
    want = Counter()
    for (k, t), (_, b), flags in zip(odd_rows, rows, plain.removed(rows, 150)):
        want[(k, bytes(x for x, f in zip(b, flags) if not f).decode("utf-8", "ignore") if t is not None else None)] += 1
    got = got.collect()
    assert Counter((r.doc_id, r.text) for r in got) == want
    assert all(r.n_chars == len(r.text or "") for r in got)


def test_sides_agree_where_windows_do():
    """Pieces with a common window agree on a code; 36 common bytes (31 were enough) do not make two pieces agree."""
    rng = np.random.default_rng(4)
    for trial in range(200):
        common = 36 if trial % 2 else 50 + trial // 10
        shared = rng.integers(97, 123, common)
        texts = [np.concatenate([rng.integers(97, 123, rng.integers(20, 60)), shared, rng.integers(97, 123, rng.integers(20, 60))]) for _ in range(2)]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        row, anchor, _, first, number, sides = suffix.pieces(np.concatenate(texts).astype(np.uint8), offsets)
        agree = set()
        for i in np.flatnonzero(row == 0):
            for j in np.flatnonzero((row == 1) & (anchor == anchor[i])):
                codes = [(int(sides[i]) >> s & 0xFFFF, int(sides[j]) >> s & 0xFFFF) for s in (0, 16, 32)]
                if any(a == b > 0 for a, b in codes):
                    agree |= {(int(i), int(j))}
        at = [next(k for k in range(len(t)) if (t[k : k + common] == shared).all()) for t in texts]
        for k in range(common - 49):  # every common window lies in pieces that agree
            i, j = (int(np.flatnonzero((row == r) & (first <= at[r] + k) & (at[r] + k < first + number))[0]) for r in (0, 1))
            assert (i, j) in agree
        assert common >= 50 or not agree


def test_ranks():
    rng = np.random.default_rng(5)
    for top in (3, 1000, 2**62):  # beyond a word's room, places are sorted instead
        values = rng.integers(0, top, 500)
        assert (induce.ranks(values) == np.unique(values, return_inverse=True)[1] + 1).all()
    assert len(induce.ranks(values[:0])) == 0


@pytest.mark.parametrize("memory", [3, 40, 10**6])
def test_suffix_order(memory):
    """Queues that spill at once and queues that never do give the same order."""
    rng = np.random.default_rng(memory)
    for trial in range(40):
        parts = [rng.integers(1, rng.integers(2, 5), rng.integers(1, 40)) for _ in range(rng.integers(1, 8))]
        parts += parts[:1] * (trial % 3)
        text = np.concatenate([np.append(p, 0) for p in parts]).astype(np.uint16)
        offsets = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
        depth = int(rng.integers(1, 12))
        order = np.concatenate(list(induce.sorted_suffixes(text, depth, memory)))[::-1]
        assert sorted(order.tolist()) == list(range(len(text)))
        keys = [text[i : i + depth].tolist() for i in order]
        assert all(a <= b or len(b) < depth for a, b in zip(keys, keys[1:]))
        doc = rng.integers(0, 4, len(parts))
        least = {}
        for i, p in enumerate(parts):
            for j in range(len(p) - depth + 1):
                w = tuple(p[j : j + depth].tolist())
                least[w] = min(least.get(w, 99), doc[i])
        want = {(i, j) for i, p in enumerate(parts) for j in range(len(p) - depth + 1) if least[tuple(p[j : j + depth].tolist())] < doc[i]}
        assert set(zip(*(x.tolist() for x in suffix.repeated_windows(text, offsets, doc, depth, memory)))) == want


def test_types_of_a_large_shard_are_mapped(monkeypatch):
    """The types are found a stretch at a time and kept in a file, whatever the stretches."""
    rng = np.random.default_rng(1)
    monkeypatch.setattr(induce, "BATCH", 7)
    for n in (1, 6, 7, 8, 14, 15, 200):
        text = np.append(np.repeat(rng.integers(1, 4, n), rng.integers(1, 12, n)), 0).astype(np.uint16)
        want = [True] * len(text)
        for i in reversed(range(len(text) - 1)):
            want[i] = bool(text[i] < text[i + 1] or (text[i] == text[i + 1] and want[i + 1]))
        got = induce.is_s(text, 1)
        assert got.tolist() == want and isinstance(got, np.memmap) == (len(text) > 4)


def test_bytes_removed_with_shards_on_disk(monkeypatch):
    """Pieces of a shard far larger than memory go to its file as they come."""
    monkeypatch.setattr(induce, "MEMORY", 3)
    texts = [b"x" * 9 + bytes(range(40, 80)), bytes(range(40, 80)) + b"y" * 9, b"z" + bytes(range(41, 75)) * 2]
    rows = pa.RecordBatch.from_arrays([pa.array([0, 0, 0]), pa.array([4, 2, 3]), pa.array([0, 0, 0]), pa.array([5, 0, 1]), pa.array(texts, pa.binary())], ["anchor", "doc_id", "tag", "first", "piece"])
    got = Counter()
    for out in suffix.sort_shard(iter([rows.slice(0, 1), rows.slice(1, 0), rows.slice(1)]), 24):
        for doc, _, first, number in zip(*(c.to_pylist() for c in out.columns)):
            got.update((doc, first + i) for i in range(number))
    least = {}
    held = [(doc, base, t) for doc, base, t in zip([4, 2, 3], [5, 0, 1], texts)]
    for doc, _, t in held:
        for i in range(len(t) - 23):
            least[t[i : i + 24]] = min(least.get(t[i : i + 24], 99), doc)
    assert got == Counter((doc, base + i) for doc, base, t in held for i in range(len(t) - 23) if least[t[i : i + 24]] < doc)


class Kernel:
    """Stands for a DataFrame: what ``mapInArrow`` is to run."""

    def mapInArrow(self, run, schema):
        return run


def test_cut_texts_are_let_go():
    """A worker cuts the texts of task after task; nothing of a batch may stay when its pieces have left."""
    runs = pa.array([[{"first": 40 * i, "number": 30, "anchor": i} for i in range(500)]] * 20)
    batch = pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array([0] * 20), pa.array(["abcdefghij" * 5000] * 20), runs], ["doc_id", "tag", "text", "runs"])
    run = suffix.cut_pieces(Kernel(), 50)
    want = [bytes(b"abcdefghij" * 9)[:79]] * 500
    assert [x for out in run(iter([batch.slice(0, 1)])) for x in out.column(4).to_pylist()] == want
    tracemalloc.start()
    try:
        assert sum(out.num_rows for _ in range(5) for out in run(iter([batch]))) == 50_000
        assert tracemalloc.get_traced_memory()[0] < 500_000  # of 5 MB of texts
    finally:
        tracemalloc.stop()


def test_memory_of_a_shard_does_not_grow_with_its_letters(monkeypatch):
    """Pieces that share a line, with different text around it: four times as many take little more memory to sort."""
    monkeypatch.setattr(induce, "MEMORY", 20_000)
    monkeypatch.setattr(induce, "BATCH", 10_000)
    rng = np.random.default_rng(2)
    line = bytes(rng.integers(97, 105, 40).astype(np.uint8))
    peaks = []
    for count in (4000, 12000):
        around = rng.integers(97, 105, (count, 40)).astype(np.uint8)
        texts = [bytes(x[:20]) + line + bytes(x[20:]) for x in around]
        numbers = [pa.array(x) for x in (np.zeros(count, int), np.arange(count), np.zeros(count, int), np.full(count, 5))]
        rows = pa.RecordBatch.from_arrays([*numbers, pa.array(texts, pa.binary())], ["anchor", "doc_id", "tag", "first", "piece"])
        tracemalloc.start()
        try:
            found = list(suffix.sort_shard(iter([rows]), 40))
            peaks.append(tracemalloc.get_traced_memory()[1])
        finally:
            tracemalloc.stop()
        least = {}
        for i, t in reversed(list(enumerate(texts))):
            least.update((t[j : j + 40], i) for j in range(41))
        got = Counter()
        for out in found:
            for doc, _, first, number in zip(*(c.to_pylist() for c in out.columns)):
                got.update((doc, first + i) for i in range(number))
        assert got == Counter((i, 5 + j) for i, t in enumerate(texts) for j in range(41) if least[t[j : j + 40]] < i)
        assert len(got) >= count - 1
    assert peaks[1] - peaks[0] < 4 * 8000 * 81  # less than four bytes for each further letter


def test_every_task_meets_as_many_targets(spark):
    """The pieces are dealt by target, not by a hash of it that gives one task several times the share of another."""

    def row(target):
        two = np.array([1, 2])
        same = np.zeros(2, np.int64)
        return target, False, windows.planes(same + 7, same + 9, two + 10 * target, same, same + 3, same + 4, same + 1).T.tobytes()

    tasks = 12
    packed = spark.createDataFrame([row(t) for t in range(tasks * windows.FINE)], "target int, settled boolean, pieces binary")
    got = windows.meet(packed, tasks).selectExpr("*", "spark_partition_id() as task").collect()
    assert Counter((r.doc_id, r.tag, r.first, r.number, r.open) for r in got) == Counter((10 * t + 2, 0, 3, 4, False) for t in range(tasks * windows.FINE))
    assert set(Counter(r.task for r in got).values()) == {windows.FINE}


@pytest.mark.parametrize("most", [0, 1, 7])
def test_long_groups_settled_in_parts(monkeypatch, most):
    """A window at several places of a document that a smaller document follows in a later batch."""
    monkeypatch.setattr(induce, "BATCH", 4)  # with queues on disk: batches of a few suffixes
    shared = [5, 6, 7, 8]
    for seed in range(20):
        rng = np.random.default_rng(seed)
        parts, doc = [], rng.permutation(np.repeat(np.arange(12), 3))
        for _ in doc:
            parts.append(np.concatenate([rng.integers(1, 10, 3), shared, rng.integers(1, 10, 3), shared, rng.integers(1, 10, 2)]))
        text = np.concatenate([np.append(p, 0) for p in parts]).astype(np.uint16)
        offsets = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
        windows = {(i, j): tuple(p[j : j + 4].tolist()) for i, p in enumerate(parts) for j in range(len(p) - 3)}
        least = {}
        for (i, _), w in windows.items():
            least[w] = min(least.get(w, 99), doc[i])
        found = list(zip(*(x.tolist() for x in suffix.repeated_windows(text, offsets, doc, 4, 3, most))))
        assert len(found) == len(set(found)) and set(found) == {at for at, w in windows.items() if least[w] < doc[at[0]]}


def test_contained(spark, odd_docs, odd_rows):
    items = [(1, " ".join(odd_rows[1][1].split()[20:60])), (2, "one two three"), (3, "ONE, two; three four (five) six!"), (4, None), (5, "  "), (6, "nowhere at all to be found here"), (None, "one"), (7, "one")]
    items += [(8, " ".join(odd_rows[0][1].split()[:30]) + " but then other words follow on"), (9, "again again again again again again again")]
    table = spark.createDataFrame([(i, t, 1, "z") for i, t in items], "item_id long, text string, n int, part string")
    got = decontam.contained(odd_docs, table).collect()
    assert {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in got} == plain.containments(odd_rows, items)
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})
    kept = decontam.decontaminate(odd_docs, table)
    bad = {r.doc_id for r in got}
    assert kept.columns == odd_docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(k for k, _ in odd_rows if k not in bad)


def test_empty_tables(spark, no_docs):
    items = spark.createDataFrame([], "item_id long, text string")
    assert jaccard.join_classes(no_docs).count() == 0
    assert recompress.deduplicate(no_docs).count() == 0
    assert suffix.deduplicate(no_docs).count() == 0
    assert suffix.without_repeats(no_docs).count() == 0
    assert decontam.contained(no_docs, items).count() == 0


def test_no_words_at_all(spark):
    docs = make_docs(spark, [(1, None), (2, ""), (3, " ")])
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join_classes(docs).collect()} == {(1, 0, 1), (2, 0, 2), (3, 0, 3)}
    assert {(r.doc_id, r.n_removed) for r in recompress.deduplicate(docs).collect()} == {(1, 0), (2, 0), (3, 0)}
    assert {(r.doc_id, r.n_removed) for r in suffix.deduplicate(docs).collect()} == {(1, 0), (2, 0), (3, 0)}
