"""URL filters, archives and top-k search."""

import base64
import gzip
import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

from tripsearch.llm import impact, urls, warc
from tripsearch.storage import new_folder

URLS = [
    "http://example.com/en/1", "http://EXAMPLE.com/en/1", "https://www.example.com/en/x?y=1", "https://a.www.example.com/en/x", "http://example.com",
    "http://example.com?en/", "http://x.net/es/1#z", "http://x.net/ES/1", "http://net/fr/", "http://anet/fr/", "ftp://x.org/login", "http://x.org/login2",
    "http://x.org/a.exe", "http://x.org/a.exe?b", "http://x.org/p?utm_source=feed", "http://x.org/p?utm_source=feeds", "http://blog.x.org/de/login/",
    "no scheme", "", None, "://", "a://b://c/d", "http://m.q.net/a/de/", "HTTP://X.ORG/LOGIN/", "http://x.org/\nlogin/", "http://x.com.org/", "http://com/",
    "http://.com/a", "http://x.org:80/login/", "http://x.org/?page=1&ref=2",
]


def judged(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if url and at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [(-len(h + p), h + p, a) for a, h, p in urls.SITE_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, min(fits)[1], min(fits)[2]
    low = None if url is None else url.translate({c: c + 32 for c in range(65, 91)})
    hits = {a for a, p in urls.PATTERN_RULES if low is not None and re.search(urls.pattern_regex(p).replace(r"\z", r"\Z"), low)}
    return host, path, None, "block" if hits == {"block"} else "allow"


def test_url_verdicts(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string, rule string, regex string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages).collect()}
    assert got == {i: judged(u) for i, u in enumerate(URLS + URLS[:3])}


def test_rule_without_literal_tokens(spark):
    pages = spark.createDataFrame([(1, "http://a.b/ca~t"), (2, "http://a.b/dog")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.filter_urls(pages, [], [("block", "*~*")]).collect()}
    assert got == {1: "block", 2: "allow"}


def test_each_rule_waits_under_its_rarest_token(spark):
    table = spark.createDataFrame([(f"http://a.com/{i}/shop",) for i in range(5)] + [("http://rare.com/shop",)], "url_text string")
    rules = spark.createDataFrame(urls.rule_rows([("block", "rare.com", "/shop/")], []), "rule_no int, kind string, action string, text string, regex string, literals array<string>")
    assert [r.literal for r in urls.token_index(table, rules).collect()] == ["rare"]


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert urls.filter_urls(pages).count() == 0
    assert warc.round_trip(pages).count() == 0


def pages_with_copies(spark):
    html = ["<p>é</p>", None, "", "a\r\n\r\nb WARC/1.1\r\n", "<p>é</p>", "x" * 300_000, "\x00\x01", "<p>é</p>", "WARC/1.1\r\nContent-Length: 3\r\n\r\n"]
    return [(i, "http://x/\r\ny" if i == 2 else None if i == 3 else f"http://x/{i}", h) for i, h in enumerate(html)] + [(7, "http://x/7", "<p>é</p>"), (-4, "u", "x" * 300_000)]


def test_archives_round_trip(spark):
    rows = pages_with_copies(spark)
    table = spark.createDataFrame([(*r, "q", 1) for r in rows], "page_id long, url string, html string, payload string, digest int").repartition(3)
    for least in (0, 5):
        keeper = defaultdict(lambda: -99)
        for i, _, h in rows:
            keeper[h or ""] = max(keeper[h or ""], i)
        want = Counter()
        for i, _, h in rows:
            data = (h or "").encode()
            last = keeper[h or ""]
            ref = last if len(data) >= least and i < last else None
            want[(i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if ref is None else "revisit", ref, None if ref is not None else data)] += 1
        got = warc.round_trip(table, least).collect()
        assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload) if r.refers_to is None else None) for r in got) == want


def test_members_and_offsets(spark):
    rows = pages_with_copies(spark)
    folder = new_folder(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"{folder}/streams")
    target = f"file://{folder}/members" if not folder.startswith("file:") else f"{folder}/members"
    index = warc.normalise(spark, f"{folder}/streams", target).orderBy("member_offset").collect()
    streams = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(f"{folder}/streams").collect()
    whole = b"".join(gzip.decompress(bytes(r.content)) for r in streams)
    data = bytes(spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(target).first().content)
    members = [gzip.decompress(data[r.member_offset : r.member_offset + r.member_length]) for r in index]
    assert b"".join(members) == whole and len(members) == len(rows)
    assert all(m.startswith(b"WARC/1.1\r\n") and m.endswith(b"\r\n\r\n") for m in members)


def test_several_members_inflate_as_one_stream():
    parts = [b"a" * 10, b"", b"b" * 3_000_000]
    assert b"".join(warc.inflated(b"".join(gzip.compress(p) for p in parts))) == b"".join(parts)


def vectors(rng, n, d):
    rows = [(i, rng.normal(0, 0.2, d).astype(np.float32).tolist()) for i in range(n)]
    rows += [(1000 + i, rows[i][1]) for i in range(5)]  # ties
    rows += [(2000, None), (2100, [float("nan")] * d), (2200, [1.0, None] + [0.0] * (d - 2)), (2300, [float("inf")] + [0.0] * (d - 1)), (None, rows[0][1])]
    rows += [(2400, [0.5, -0.5]), (2500, []), (100, rows[100][1]), (2600, [0.0] * d)]
    return rows


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(8)
    rows = vectors(rng, 700, 24)
    table = spark.createDataFrame([(*r, 1, "s") for r in rows], "vec_id long, embedding array<float>, rank int, score string").repartition(3)
    held = [(i, np.floor(np.array([float(x) for x in v]) * 1024).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: int(sum(x * y for x, y in zip(a.tolist(), b.tolist())))
    want = []
    for q in sorted({i for i, _ in held if i % 100 == 0}):
        v = min((v.tolist() for i, v in held if i == q))
        best = sorted((-dot(np.array(v), w), i) for i, w in held if i != q)[:10]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    got = impact.top_k(table, table.filter("vec_id % 100 = 0")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


def test_index_stops_on_proof_only():
    rng = np.random.default_rng(1)
    rows = (rng.normal(0, 1, (3000, 6)) ** 3 * 300).astype(np.int64)
    shard = impact.Shard(np.arange(3000), rows)
    for q in rows[:50]:
        ids, scores = impact.best(*shard.top(q, -1, 10, None), 10)
        order = np.lexsort((np.arange(3000), -(rows @ q)))[:10]
        assert ids.tolist() == order.tolist() and scores.tolist() == (rows @ q)[order].tolist()
    assert any(len(shard.top(q, -1, 10, None)[0]) < 500 for q in rows[:50])


def test_no_vectors(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert impact.top_k(table, table).count() == 0
