"""The Merkle manifest against a plain version."""

import hashlib
import random
import zlib
from collections import defaultdict

from tests.llm.conftest import make_docs
from tripsearch.llm import merkle, ranks
from tripsearch.storage import durable


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in row])


def levels(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def climb(tree, i, start):
    siblings = []
    for level in tree[:-1]:
        run, k = level[i // 3 * 3 : i // 3 * 3 + 3], i % 3
        siblings += run[:k] + run[k + 1 :]
        start = h(*run[:k], start, *run[k + 1 :])
        i //= 3
    return siblings, start


def plain(rows):
    by = defaultdict(list)
    for row in rows:
        kept = row
        if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
            kept = (*row[:4], row[4].replace("\n", ""))
        by[row[1]].append((row[0] is not None, row[0] or 0, leaf(row), leaf(kept)))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [levels([x[2] for x in sorted(by[n])]) for n in names]
    top = levels([t[-1][0] for t in trees])
    out = []
    for j, n in enumerate(names):
        for i, (known, key, own, start) in enumerate(sorted(by[n])):
            low, folded = climb(trees[j], i, start)
            high, folded = climb(top, j, folded)
            out.append((key if known else None, own, trees[j][-1][0], top[-1][0], h(*low, *high), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def run(docs):
    asked = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    got = merkle.without_newlines(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(asked)


def test_odd_rows(odd_docs):
    run(odd_docs)


def test_many_levels_and_sources(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(4000) if i % 9 else None, f"{'a\n' * (i % 3)}{i % 1500}") for i in range(7300)]
    docs = make_docs(spark, rows).selectExpr(
        "doc_id", "case when n_chars % 7 = 0 then null when doc_id % 11 = 1 then concat('é', doc_id % 300) else 'hot' end as source", "lang", "n_chars", "text", "g"
    )
    run(docs)


def test_one_row_and_one_source(spark):
    run(make_docs(spark, [(1, "one\ntwo")]))
    run(make_docs(spark, [(i, "x\n") for i in range(82)]).selectExpr("doc_id", "cast(null as string) as source", "lang", "n_chars", "text"))


def test_empty_table(no_docs):
    assert merkle.without_newlines(no_docs).count() == 0


def test_the_callers_session_keeps_its_settings(spark, odd_docs):
    before = dict(spark.conf.getAll)
    merkle.without_newlines(odd_docs)
    assert dict(spark.conf.getAll) == before


def test_numbered_without_groups_and_with_ties(spark):
    rows = durable(spark.createDataFrame([(i % 3 or None, 7) for i in range(100)], "g long, v long").repartition(5))
    got, sizes = ranks.numbered(rows, ["g"], ["v"])
    places = defaultdict(list)
    for r in got.collect():
        places[r.g].append(r.pos)
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and len(places) == 3
    assert {r.g: r.size for r in sizes.collect()} == {k: len(p) for k, p in places.items()}
    whole, _ = ranks.numbered(rows, [], ["g"])
    order = sorted((r.pos, r.g or 0) for r in whole.collect())
    assert [p for p, _ in order] == list(range(100)) and [g for _, g in order] == sorted(g for _, g in order)
