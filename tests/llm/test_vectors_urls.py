"""Vector operators and the URL filter against plain Python."""

from __future__ import annotations

import re

import numpy as np
import pytest

from sessionloom.llm import urlfilter, vectors
from sessionloom.llm.common import table
from sessionloom.llm.components import components


def brute(rows, cosine=0.9):
    ids = [i for i, _ in rows]
    good = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    width = max((len(rows[k][1]) for k in good), default=1)
    m = np.zeros((len(good), width))
    for r, k in enumerate(good):
        m[r, :len(rows[k][1])] = rows[k][1]
    norm = np.sqrt((m * m).sum(1))
    link = (m @ m.T) / norm[:, None] / norm[None] >= cosine
    np.fill_diagonal(link, False)
    label = np.arange(len(good))
    for _ in good:
        label = np.array([min([label[a], *label[link[a]]]) for a in range(len(good))], int)
    out = {}
    for r, k in enumerate(good):
        named = [ids[good[x]] for x in np.flatnonzero(label == label[r]) if ids[good[x]] is not None]
        out.setdefault(ids[k], []).append((int(link[r].sum()), min(named, default=None)))
    for k, i in enumerate(ids):
        if k not in good:
            out.setdefault(i, []).append((0, i))
    return {i: sorted(v, key=str) for i, v in out.items()}


def found(df):
    out = {}
    for r in df.collect():
        assert r["kept"] == (r["vec_id"] == r["component_id"])
        out.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"]))
    return {i: sorted(v, key=str) for i, v in out.items()}


def clustered(n=700, seed=2):
    rng = np.random.default_rng(seed)
    rows = list(rng.normal(size=(n // 2, 16)))
    for k in range(6):
        centre = rng.normal(size=16)
        rows += [centre * rng.uniform(0.5, 3) + rng.normal(size=16) * s for s in np.linspace(0.001, 0.6, n // 14)]
    rows += [rows[0]] * 20
    return [(7 * i % 997 + 1000 * (i // 997), r.tolist()) for i, r in enumerate(rows)]


@pytest.mark.parametrize("block_rows", [8192, 60])
def test_links(spark, odd_vectors, block_rows):
    odd = [(r["vec_id"], r["embedding"]) for r in odd_vectors.collect()]
    assert found(vectors.near_duplicates(odd_vectors, block_rows=block_rows)) == brute(odd)
    rows = clustered()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    assert found(vectors.near_duplicates(frame, block_rows=block_rows)) == brute(rows)


def test_dense_cluster_counts_without_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (np.ones(8) + rng.normal(size=8) * 1e-3).tolist()) for i in range(3000)]
    got = found(vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert all(v == [(2999, 0)] for v in got.values())


def best(rows, k=5):
    good = sorted((i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v))
    width = max((len(v) for _, v in good), default=1)
    m = [[int(np.floor(256 * x)) for x in v] + [0] * (width - len(v)) for _, v in good]
    out = set()
    for (q, _), a in zip(good, m):
        if q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for (i, _), b in zip(good, m) if i != q)
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("block_rows", [8192, 60])
def test_top_k(spark, odd_vectors, block_rows):
    odd = [(r["vec_id"], r["embedding"]) for r in odd_vectors.collect()]
    rows = clustered()
    for frame, want in ((odd_vectors, best(odd)), (spark.createDataFrame(rows, "vec_id long, embedding array<double>"), best(rows))):
        got = vectors.top_k(frame, lambda i: i % 50 == 0, block_rows=block_rows, query_rows=8).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.near_duplicates(none).count() == 0
    assert vectors.top_k(none, lambda i: i % 50 == 0).count() == 0


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(int(a), int(b)) for a, b in rng.integers(1000, 1400, (250, 2))]
    edges += [(7, 7), (100, 101), (-5, 2**40)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r["node"]: r["component"] for r in got} == {x: find(x) for x in list(root)} and len(got) == len(root)


URLS = ["http://a.example.net/en/1", "https://example.net/en", "https://EXAMPLE.net/en/x?y", "http://x.org/fr/", "http://x.org/de/", "http://notexample.com/de/",
        "http://m.example.com/de/1", "net/", None, "", "http://", "ftp://b.net", "http://b.net/?q=1", "http://example.org:80/fr/", "//c.net/", "a://b://c.org/fr/x",
        "http://x.com/porn", "http://x.com/pornish", "http://x.com/free-hot", "http://x.com/free", "http://x.com/free/free", "http://XXX.com/#a", "http://x.com/a?casino=win"]


def judged(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    words = set(re.findall(r"[a-z0-9]+", url.lower()))
    strict, soft = len(words & set(urlfilter.STRICT)), len(words & set(urlfilter.SOFT))
    rule, verdict = max(fits)[1:] if fits else (None, "block" if strict or soft >= 2 else "allow")
    return host, path, rule, verdict, strict, soft


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)] + [(None, URLS[0], None, None)], "page_id long, url string, host string, verdict string")
    pages = pages.unionByName(table(spark, "/root/testdata/sf0.001", "pages").selectExpr("page_id + 1000 as page_id", "url", "'' as host", "'' as verdict"))
    urls = {r["page_id"]: r["url"] for r in pages.collect()}
    got = urlfilter.judge_urls(pages).collect()
    assert len(got) == len(urls)
    assert {r["page_id"]: tuple(r)[1:] for r in got} == {i: judged(u) for i, u in urls.items()}
