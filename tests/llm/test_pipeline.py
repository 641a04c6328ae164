"""The pipeline's rows against the same stages in plain Python, and its stages on odd tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as C
from sessionloom.llm import queries, toxicity
from sessionloom.llm.common import table
from sessionloom.llm.wordcodec import WordCodec
from tests.llm.test_text import SF, base_of, closed, crc, fingerprint, poured

MASKS = {k: f"[{k.upper()}]" for k in ("email", "ip", "card", "phone")}


def masked(text):
    out, at = "", 0
    for start, end, kind in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in base_of(text))):
        if start >= at:
            out += text[at:start] + MASKS[kind]
        at = max(at, end)
    return out + text[at:]


def key(doc_id, weight):
    u = (int(hashlib.md5(f"5:{doc_id}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
    return int(np.floor((1.0 - u ** (1 / weight)) * 2.0**48))


def test_pipeline_rows(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = toxicity.fit(docs, labels, ~queries.held_out(F.col("doc_id")))
    clean = {r["doc_id"] for r in toxicity.score(docs, model).collect() if not r["predicted"]}
    rows = {r["doc_id"]: r for r in docs.collect() if r["doc_id"] in clean}
    fps = {d: fingerprint(r["text"]) for d, r in rows.items()}
    ids = sorted(fps)
    root = closed(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if (fps[a] ^ fps[b]).bit_count() <= 3])
    texts = {d: masked(rows[d]["text"]) for d in ids if root[d] == d}
    sizes = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t in texts.items()}
    quality = {r["doc_id"]: 4 if r["quality"] == 1 else 1 for r in labels.collect()}
    total = Counter()
    for d in texts:
        total[rows[d]["source"]] += sizes[d]
    goal, times = poured(total), {}
    for s in total:
        epochs = int(goal[s] // total[s]) if total[s] else 0
        left = goal[s] - epochs * total[s]
        for d in sorted((d for d in texts if rows[d]["source"] == s), key=lambda d: key(d, quality.get(d, 2))):
            fits = sizes[d] <= left or left >= 0 and 2 * left >= sizes[d]
            times[d] = epochs + int(fits)
            left = left - sizes[d] if sizes[d] <= left else -1
    tok = WordCodec(queries.tokenizer_path("word_bpe_49k.json"), False).tok
    want = Counter()
    for d, n in times.items():
        tokens = tok.encode(texts[d], add_special_tokens=False).ids + [1]
        for k, a in enumerate(range(0, len(tokens), 4096)):
            want[(d, k, a, len(tokens[a:a + 4096]), crc(tokens[a:a + 4096]))] += n
    got = C.run(spark, SF).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == +want
    ends = Counter()
    for r in got:
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 4096


def test_stages_on_odd_tables(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        rows = docs.count()
        for name, stage in C.STAGES:
            docs = stage(spark, docs, SF)
            if name != "packing":
                assert docs.columns == C.COLUMNS
            assert (docs.count() == 0) == (rows == 0)
