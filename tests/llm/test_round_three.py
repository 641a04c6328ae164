"""Collocations, hard negatives and WARC archives against plain Python."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sessionloom.llm import collocations, hardnegatives, queries, warc
from sessionloom.llm.common import shared_folder, table

SF = "/root/testdata/sf0.001"


# Collocations


def phrases_of(rows, least, longest, top):
    counts, every = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", folded):
            words = [w for w in re.split("[ \t]+", piece) if w]
            every[lang] += len(words)
            for m in range(1, longest + 1):
                counts[lang].update(tuple(words[i:i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        known = {p: a for p, a in f.items() if a >= least}
        around = Counter()
        for p, a in known.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    around[p[i:i + m]] = max(around[p[i:i + m]], a)
        found = []
        for p, a in known.items():
            if len(p) >= 2 and around[p] < a:
                score, k = min((1000 * a * every[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, every[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"counters": 64, "most_bits": 16}, {"counters": 2000, "most_bits": 12}])
def test_collocations(spark, odd_docs, options):
    docs = table(spark, SF, "documents").select("lang", "text").unionByName(odd_docs.select("lang", "text")).repartition(5)
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    got = collocations.collocations(docs, least=6, top=40, **options).collect()
    assert sorted(tuple(r) for r in got) == phrases_of(rows, 6, 5, 40)


def test_collocations_of_small_tables(spark, no_docs):
    assert collocations.collocations(no_docs).count() == 0
    rows = [("en", "A b.A b c\tA b; a"), (None, "x y x y x y"), ("en", None), ("en", "")] * 3
    frame = spark.createDataFrame(rows, "lang string, text string")
    got = sorted(tuple(r) for r in collocations.collocations(frame, least=3).collect())
    assert got == phrases_of(rows, 3, 5, 2000) and got


def test_chunks_do_not_change_counts(spark, monkeypatch):
    docs = table(spark, SF, "documents")
    texts = [(r["lang"], (r["text"] or "").encode()) for r in docs.collect()]
    whole = collocations.Chunk([x for x, _ in texts], [t for _, t in texts])
    want = Counter()
    for k, at, h in whole.phrases(3):
        want.update(h.tolist())
    got = Counter()
    for lang, text in texts:
        for k, at, h in collocations.Chunk([lang], [text]).phrases(3):
            got.update(h.tolist())
    assert got == want


@pytest.mark.parametrize("counters", [10, 100, 5000])
def test_summary_keeps_every_frequent_key(counters):
    """Streams of any skew, in parts of any size: no frequent key falls out, no count is off by more than lost."""
    rng = np.random.default_rng(counters)
    for skew in (1.1, 1.5, 3.0):
        stream = np.concatenate([rng.zipf(skew, 40_000) % 2**40, np.repeat(np.arange(2**41, 2**41 + 30), 100), rng.integers(2**42, 2**43, 30_000)])
        rng.shuffle(stream)
        summary = collocations.Summary(100, counters)
        for part in np.array_split(stream, 37):
            keys, counts = np.unique(part.astype(np.uint64), return_counts=True)
            summary.add(keys, counts.astype("<u4"), len(part))
        true = Counter(stream.tolist())
        kept = set(summary.frequent().tolist())
        assert {k for k, n in true.items() if n >= 100} <= kept
        assert summary.lost < 100
        held = dict(zip(summary.keys[0].tolist(), summary.counts[0].tolist()))
        assert all(true[k] - summary.lost <= n <= true[k] for k, n in held.items())


# Hard negatives


def mined(rows, modulus=100, positives=5, negatives=5):
    used = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            label = (label + 1) % 10 if i % 7 == 0 else label
            one = (label, [int(np.floor(256 * x)) for x in v])
            used[i] = min(used.get(i, one), one)
    out = set()
    for a, (label, v) in used.items():
        if a % modulus:
            continue
        score = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in used.items() if i != a}
        best = sorted((-s, i) for i, s in score.items() if used[i][0] == label)[:positives]
        for s, p in best:
            top = -s
            near = sorted((-n, i) for i, n in score.items() if used[i][0] != label and 80 * top <= 100 * n <= 100 * top)[:negatives]
            out |= {(a, p, k, i, top, -n) for k, (n, i) in enumerate(near, 1)}
    return out


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 70, "anchor_rows": 3}])
def test_hard_negatives(spark, sizes):
    rng = np.random.default_rng(8)
    rows = [(5 * i, (rng.normal(size=6) * rng.choice([0.1, 1, 40])).tolist(), int(rng.integers(0, 4))) for i in range(900)]
    rows += [(i, rows[0][1], 1) for i in (7001, 7002, 7003, 7100)]  # ties, and an anchor among them
    rows += [rows[3], (15, rows[4][1], 0), (8000, None, 1), (8100, [0.1, None], 1), (8200, [float("nan")], 2), (8300, [0.2], None),
             (None, [0.1], 1), (8400, [], 3), (8500, [0.5], 3), (9000, [float("inf"), 0.0], 1), (8600, [-0.3] * 6, 99)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as node", "2 as block", "3 as part")
    got = hardnegatives.mine(frame, lambda i: i % 100 == 0, relabel=queries.shifted, **sizes).collect()
    assert {tuple(r) for r in got} == mined(rows) and len(got) == len(mined(rows))


def test_no_hard_negatives(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hardnegatives.mine(none, lambda i: i % 100 == 0).count() == 0
    alone = spark.createDataFrame([(100, [1.0], 1), (200, [1.0], 2)], "vec_id long, embedding array<double>, label int")
    assert hardnegatives.mine(alone, lambda i: i % 100 == 0).count() == 0


@pytest.mark.parametrize("scale", [1, 10**4, 10**6])
def test_packed_scores_are_exact(scale):
    rng = np.random.default_rng(3)
    rows = rng.integers(-300 * scale, 200 * scale, (600, 9))
    low, high = int(rows.min()), int(rows.max())
    packed = hardnegatives.Packed(rows, low, high)
    assert packed.bytes == (4 if scale == 1 else 8)
    for a in rows[:5]:
        assert packed.scores(a).tolist() == [sum(int(x) * int(y) for x, y in zip(a, r)) for r in rows]


def test_scores_beyond_64_bits_are_refused():
    rows = np.full((3, 2), 2**40)
    with pytest.raises(OverflowError):
        hardnegatives.Packed(rows, 0, 2**40).scores(rows[0])


# WARC


def expected(rows, least=0):
    bodies = [(i, u, (h or "").encode()) for i, u, h in rows]
    top = {}
    for i, u, b in bodies:
        key = ((i is not None, i or 0), (u is not None, u or ""))
        top[b] = max(top.get(b, key), key)
    out, seen = Counter(), set()
    for i, u, b in bodies:
        key = ((i is not None, i or 0), (u is not None, u or ""))
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        first = len(b) < least or (key == top[b] and b not in seen)
        if first:
            seen.add(b)
        refers = None if first else (top[b][0][1] if top[b][0][0] else None)
        out[(i, len(b), digest, "response" if first else "revisit", refers)] += 1
    return out


PAGES = [(1, "http://a", "same"), (2, "http://b", "same"), (3, "http://c", ""), (4, "http://d", None), (5, None, "x\r\ny\n\nz\r"), (6, "http://e", "é\U0001f600" * 3000),
         (7, "http://f\r\nX-Evil: 1", "0\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"), (8, "http://g", "\n" * 50), (9, "http://h", "a" * 100_000),
         (None, "http://i", "no id"), (None, None, "same"), (10, "http://j", "twice"), (10, "http://j", "twice"), (10, "http://k", "twice"), (10, "http://l", "other"),
         (11, "http://m", "x" * 64), (12, "http://n", "x" * 64), (-5, "http://o", "minus"), (-6, "http://p", "minus"), (13, "http://q", "\0\x01\xff")]


@pytest.mark.parametrize("least,chunk", [(0, 1 << 20), (0, 64), (20, 1000)])
def test_archives(spark, least, chunk):
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 as length", "'' as sha1", "2 as copy", "3 as i").repartition(3)
    folder = shared_folder(spark) + "/warc"
    warc.write_archives(frame, folder, revisit_from=least, chunk_bytes=chunk)
    rows = warc.read_records(spark, folder).select(
        "*", warc.page_of(warc.F.col("record_id")).alias("page"), warc.page_of(warc.F.col("refers_to")).alias("response")).collect()
    assert Counter((r["page"], r["payload_bytes"], r["payload_digest"], r["type"], r["response"]) for r in rows) == expected(PAGES, least)
    assert all(r["intact"] for r in rows) and len({r["record_id"] for r in rows}) == len(rows)
    responses = {r["record_id"] for r in rows if r["type"] == "response"}
    assert all(r["refers_to"] in responses for r in rows if r["type"] == "revisit")
    # Chunks: payloads whole, none larger than asked for, digests of all bytes so far.
    parts = defaultdict(list)
    for r in warc.read_chunks(spark, folder, chunk_bytes=50).filter("type = 'response'").collect():
        parts[r["record_id"]].append(r)
    bodies = Counter()
    for own in parts.values():
        own.sort(key=lambda r: r["chunk"])
        body = b""
        for k, r in enumerate(own):
            assert r["chunk"] == k and r["start"] == len(body) and len(r["data"]) == r["size"] <= 50 and r["last"] == (k == len(own) - 1)
            body += r["data"]
            assert r["digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode() and r["payload_bytes"] == len(body)
        bodies[body] += 1
    want = Counter()
    for (i, n, digest, kind, refers), count in expected(PAGES, least).items():
        want[digest] += count if kind == "response" else 0
    assert Counter({base64.b32encode(hashlib.sha1(b).digest()).decode(): n for b, n in bodies.items()}) == +want


def test_no_pages(spark):
    folder = shared_folder(spark) + "/warc"
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.read_records(spark, folder).count() == 0


def test_archives_are_plain_warc(spark):
    """Every record has the length that its header says, by a reader that knows nothing but the standard."""
    folder = shared_folder(spark) + "/warc"
    warc.write_archives(spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2), folder, chunk_bytes=100)
    found = 0
    for name, data in spark.sparkContext.binaryFiles(folder + "/*.gz").collect():
        data, at = gzip.decompress(data), 0
        while at < len(data):
            end = data.index(b"\r\n\r\n", at)
            lines = data[at:end].decode().split("\r\n")
            head = dict(x.split(": ", 1) for x in lines[1:])
            assert lines[0] == "WARC/1.1" and "X-Evil" not in head
            at = end + 4 + int(head["Content-Length"])
            assert data[at:at + 4] == b"\r\n\r\n"
            at += 4
            found += 1
    assert found == len(PAGES)


def test_foreign_archives(spark):
    """One gzip member per record, plain bodies, other record types, and broken files."""
    def record(kind, headers, block):
        head = "".join(f"{k}: {v}\r\n" for k, v in {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{kind}>", **headers, "Content-Length": len(block)}.items())
        return gzip.compress(b"WARC/1.0\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n")

    body = b"plain \xff\xfe\nbody\r\n\r\n" * 20
    http = b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n" + body
    whole = record("warcinfo", {"Content-Type": "application/warc-fields"}, b"software: x\r\n") + record(
        "response", {"Content-Type": "application/http; msgtype=response"}, http) + record("resource", {"Content-Type": "text/plain"}, b"") + record(
        "metadata", {}, b"no line end")
    folder = shared_folder(spark)

    def put(name, data):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/a.warc.gz")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
        out.write(bytearray(data))
        out.close()
        return f"{folder}/{name}"

    got = {r["type"]: r for r in warc.read_records(spark, put("good", whole)).collect()}
    assert {k: r["payload_bytes"] for k, r in got.items()} == {"warcinfo": 13, "response": len(body), "resource": 0, "metadata": 11}
    assert got["response"]["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode() and got["response"]["intact"] is None
    cut = gzip.compress(gzip.decompress(whole)[:-30])
    with pytest.raises(Exception, match="ends inside record"):
        warc.read_records(spark, put("cut", cut)).collect()
