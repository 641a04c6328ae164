"""Corpus operators over texts against plain Python."""

from __future__ import annotations

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sessionloom.llm import licenses, mixing, packing, pii, queries, simhash, tokenfiles, toxicity, wordcodec
from sessionloom.llm.common import shared_folder, table
from sessionloom.llm.wordcodec import WordCodec
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"
WORD_FILE, BYTE_FILE = queries.tokenizer_path("word_bpe_49k.json"), queries.tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def documents(spark):
    return table(spark, SF, "documents")


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


# Personal data


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum(int(c) * (1 + i % 2) - 9 * (i % 2 and int(c) > 4) for i, c in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base_of(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text) if valid(k, m.group())]


TRICKY = ["a@b.com_x@c.de a@b..c @ a@@b.c x@y.z.", "1.2.3.4.5.6.7.8 256.1.1.1 0300.1.1.1 00.000.1.255 1.2.x.3.4.5.6", "4111-1111-1111-1111 4111 1111 1111 1112",
          "+1 (988) 555-2485 +12 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 +49 30 1234567.", "é\U0001f600 me@x.org \U0001f600 8.8.8.8", "a.b@c-d.e.f,+4930 123 456 7"]


def test_personal_data_base(spark, documents, odd_docs):
    extra = spark.createDataFrame(list(enumerate(TRICKY, 10_000)), "doc_id long, text string")
    docs = documents.select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text")).unionByName(extra)
    want = Counter((d, hashlib.sha256(",".join(base_of(t)).encode()).hexdigest(), ",".join(base_of(t))) for d, t in texts_of(docs))
    got = pii.scan(docs).collect()
    assert Counter((r["doc_id"], r["base_sha256"], ",".join(s for s in r["spans"].split(",") if not s.startswith("term"))) for r in got) == want
    assert all(r["n_email"] == r["spans"].count("email:") for r in got)


def test_terms_that_disclose_an_entity(spark):
    rows = [(i, f"filler{i} about zephyrine {w} me@x.org also {w} the end") for i, w in enumerate(["red", "blue", "green", "grey", "pink"])]
    rows += [(100 + i, f"nothing about the weather in place{i % 7}") for i in range(60)]
    rows += [(200, rows[0][1]), (201, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.scan(docs).collect()}
    assert got[1]["n_term"] == 3  # zephyrine, also and end stand near the address and nowhere else; about does not tell
    at = rows[1][1].index("zephyrine")
    assert f"term:{at}:{at + 9}" in got[1]["spans"]
    assert got[100]["n_term"] == 0 and got[100]["spans"] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert clean[1] == "filler1 about [TERM] blue [EMAIL] [TERM] blue the [TERM]"
    assert clean[100] == rows[5][1] and clean[201] is None and len(clean) == len(rows)


def test_terms_that_disclose_are_masked_wherever_they_stand(spark):
    """A term far from the entity counts, and so do its places in documents without the entity."""
    far = " ".join(["plain filling words stand here"] * 12)
    rows = [(i, f"from{i} me@x.org note{i} by{i}x {far} signed Quillon") for i in range(8)]
    rows += [(100, "quillon was here"), (101, "mail other@y.org about QUILLON"), (102, None)]
    rows += [(200 + i, f"{far} and nothing in place{i % 7}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert all(clean[i].endswith("signed [TERM]") or clean[i].endswith("[TERM] [TERM]") for i in range(8))
    assert clean[100] == "[TERM] was here" and clean[101] == "mail [EMAIL] about [TERM]" and len(clean) == len(rows)
    assert clean[200] == rows[11][1] and clean[102] is None
    got = {r["doc_id"]: r["n_term"] for r in pii.scan(docs).collect()}
    assert got[100] == got[101] == 1 and got[200] == 0


def test_sanitise_keeps_rows_and_columns(odd_docs):
    got = pii.sanitise(odd_docs)
    assert got.columns == odd_docs.columns and got.count() == odd_docs.count()
    assert got.filter("doc_id = 11").first()["text"] == "mail [EMAIL] and [IP]"


# Fingerprints


def fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def closed(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_components(documents, odd_docs):
    for docs in (documents, odd_docs.filter("doc_id is not null")):
        fps = {d: fingerprint(t) for d, t in texts_of(docs)}
        ids = sorted(fps)
        want = closed(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if (fps[a] ^ fps[b]).bit_count() <= 3])
        got = simhash.near_duplicates(docs).collect()
        assert len(got) == docs.count()
        assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in ids}


def test_near_fingerprints_meet(spark):
    """A dense cluster, chains and pairs at 1 to 4 bits in any place."""
    rng = np.random.default_rng(3)
    fps = {0}
    for _ in range(40):
        seed = int(rng.integers(0, 2**63))
        fps.add(seed)
        for n in (1, 2, 3, 4):
            for _ in range(4):
                fps.add(seed ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False)))
    fps |= {7 ^ (1 << b) for b in range(64)}
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    edges = simhash.linked_fingerprints(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    mask = (1 << 64) - 1
    near = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1:] if ((a & mask) ^ (b & mask)).bit_count() <= 3]
    assert all(((r["u"] & mask) ^ (r["v"] & mask)).bit_count() <= 3 for r in edges)
    assert closed(signed, [(r["u"], r["v"]) for r in edges]) == closed(signed, near)


def test_one_of_each_group_stays(odd_docs):
    got = simhash.keep_one(odd_docs)
    ids = sorted(r["doc_id"] for r in got.collect() if r["doc_id"] is not None)
    assert 5 in ids and 6 not in ids and 7 not in ids and len(ids) == len(set(ids))
    assert got.filter("doc_id is null").count() == 2 and got.columns == odd_docs.columns


# Tokens


ODD = ["", " a", "a ", "a  b", "a \n b", "a\n b", "a\n\n  b c", "<|endoftext|> x", "it's we'll 'sa don't", "\x1c a\x1cb", "ΑΣ Σας", "é áb",
       "123 4567 8-9", "\t\ta b\t c", "日本 語", "ﬁ ǅ ª º²", "a\r\n b", "  ", "\n", "a   b", "...!!! ?", "İstanbul I", "a\x0b b \x0b", "a\n\n\nb", " \n x"]


@pytest.mark.parametrize("byte_level", [True, False])
def test_codec_equals_the_library(documents, byte_level):
    codec = WordCodec(BYTE_FILE if byte_level else WORD_FILE, byte_level, room=500)
    texts = ODD + [t for _, t in texts_of(documents)]
    want = [np.array(e.ids, "<u4").tobytes() for e in codec.tok.encode_batch(texts, add_special_tokens=False)]
    assert codec.encode(texts) == want and codec.encode(texts[::-1]) == want[::-1]


def ids_of(tok, text, end):
    return tok.encode(text, add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(spark, documents, odd_docs):
    tok = WordCodec(WORD_FILE, False).tok
    docs = documents.select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    want = Counter()
    for d, t in texts_of(docs):
        ids = ids_of(tok, t, 1)
        want.update((d, k, a, len(ids[a:a + 4096]), crc(ids[a:a + 4096])) for k, a in enumerate(range(0, len(ids), 4096)))
    got = packing.pack_documents(docs, WORD_FILE).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences: dict[int, list] = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= math.ceil(sum(r["length"] for r in got) / 4096) + 1


def test_completion_beats_the_greedy_filling():
    count = np.bincount([6, 5, 5, 3], minlength=11)
    assert sorted(packing.complete(count, 10, 10, 64)) == [5, 5]  # greedy takes 6 and 3
    assert packing.complete(np.zeros(11, int), 10, 10, 64) == []
    sequence, offset = packing.fill(np.array([6, 5, 5, 4, 10]), width=10)
    assert len(set(sequence.tolist())) == 3
    assert len(packing.fill(np.array([], int))[0]) == 0


def packed_whole(lengths, width=4096):
    """Number of sequences, after a look at each: gapless, and no longer than the width."""
    sequence, offset = packing.fill(lengths, width)
    by = np.lexsort((offset, sequence))
    s, o, n = sequence[by], offset[by], lengths[by]
    opens = np.concatenate(([True], s[1:] != s[:-1]))
    assert (o[opens] == 0).all() and (o[~opens] == (o + n)[:-1][~opens[1:]]).all() and (o + n).max() <= width
    return int(sequence.max()) + 1


@pytest.mark.parametrize("size,pieces", [(10, 20_000), (20, 20_000), (50, 20_000), (1, 60_000), (4096, 50), (2049, 50)])
def test_packing_pieces_of_one_size(size, pieces):
    assert packed_whole(np.full(pieces, size)) == math.ceil(pieces / (4096 // size))


def test_packing_short_and_mixed_pieces():
    rng = np.random.default_rng(0)
    short, spread = rng.integers(5, 60, 40_000), np.minimum(4096, np.exp(rng.normal(6, 1, 10_000)).astype(int) + 1)
    assert packed_whole(short) <= math.ceil(short.sum() / 4096) + 1
    assert packed_whole(spread) <= math.ceil(spread.sum() / 4096) + 1


def test_packing_long_pieces():
    """Where pieces are longer than a quarter and nothing small is left, no search is worse than best fit."""
    rng = np.random.default_rng(1)
    for lengths in (rng.integers(1100, 2500, 2000), rng.integers(1, 4097, 3000), np.concatenate([rng.integers(1400, 2100, 900), rng.integers(1, 60, 100)])):
        assert packing.fewest(lengths, 4096) <= packed_whole(lengths) <= int(packing.best_fit(lengths, 4096)[0].max()) + 1


def test_packing_small_cases_are_optimal():
    def needed(lengths, width):  # the least number, by trying all
        best = len(lengths)

        def put(k, rooms):
            nonlocal best
            if len(rooms) < best and k == len(lengths):
                best = len(rooms)
            if k == len(lengths) or len(rooms) >= best:
                return
            for r in sorted(set(rooms)):
                if r >= lengths[k]:
                    left = rooms.copy()
                    left.remove(r)
                    put(k + 1, [*left, r - lengths[k]])
            put(k + 1, [*rooms, width - lengths[k]])

        put(0, [])
        return best

    rng = np.random.default_rng(2)
    off = 0
    for _ in range(60):
        lengths = np.sort(rng.integers(1, 21, rng.integers(1, 10)))[::-1].copy()
        got, least = packed_whole(lengths, 20), needed(lengths.tolist(), 20)
        assert packing.fewest(lengths, 20) <= least <= got <= least + 1
        off += got - least
    assert off <= 2


def test_token_files(spark, documents, odd_docs):
    tok = WordCodec(BYTE_FILE, True).tok
    docs = documents.select("doc_id", "text").unionByName(odd_docs.filter("doc_id > 100 or doc_id is null").select("doc_id", "text"))
    docs = docs.unionByName(odd_docs.filter("doc_id in (0, 1, 9, 18)").select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text"))
    folder = shared_folder(spark) + "/t"
    tokenfiles.write_token_files(docs, folder, BYTE_FILE, end_id=2, shard_ids=20_000, rounds=4)
    got = tokenfiles.read_token_files(spark, folder, keep_ids=True).orderBy("start").collect()
    order = sorted(texts_of(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    at = 0
    for r, (d, t) in zip(got, order, strict=True):
        ids = ids_of(tok, t, 2)
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d, at, len(ids), crc(ids))
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids
        at += len(ids)
    row = spark.read.parquet(folder).orderBy(F.col("n_ids").desc()).first().asDict()
    whole = tokenfiles.expand(np.frombuffer(row["sequence"], "<u2"), tokenfiles._parts(row)[0], row["base"])
    assert len(row["rules"]) > 0 and len(row["sequence"]) < 2 * row["n_ids"]
    assert tokenfiles.decode_range(row, 0, 3, 9).tolist() == whole[3:9].tolist()


def test_known_words_are_joined_at_once():
    """Texts of known words, of new ones and of none are told apart within a batch; words are looked up one by one only in texts with new ones."""
    codec = WordCodec(BYTE_FILE, True)
    codec.encode(["known words only", "more of them"])
    learnt = []
    learn = codec._learn
    codec._learn = lambda missing: learnt.append(missing) or learn(missing)
    texts = ["known of them", "of unseenword here", "", "two  spaces", "words\nonly known", "unseenword"]
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)] == [codec.tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(learnt) == 1 and {"unseenword", "here"} <= learnt[0] and "of" not in learnt[0]


@pytest.mark.parametrize("byte_level", [True, False])
def test_known_letters_with_new_marks_are_not_learnt_again(byte_level, monkeypatch):
    """A word that is known needs no learning with other marks behind it; cutting texts into chunks changes nothing."""
    codec = WordCodec(BYTE_FILE if byte_level else WORD_FILE, byte_level)
    codec.encode(["some words known\nthat stay"])
    learnt = set()
    learn = codec._learn
    codec._learn = lambda missing: learnt.update(missing) or learn(missing)
    texts = ["some, words!! (known) known... words]%%%", "that? stay;\nthat, \nthat", "newword! newword"]
    want = [codec.tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)] == want
    assert learnt & {"words!!", "words", "known...", "stay;", "newword!"} == set() and "newword" in learnt
    monkeypatch.setattr(wordcodec, "_CHUNK", 5)
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.each(texts)] == want and codec.encode([]) == []


@pytest.mark.parametrize("byte_level", [True, False])
def test_every_plain_letter_is_encoded_as_the_library_does(byte_level):
    """Also first and last in a word, after a line feed, with marks, and in copies beyond the room."""
    codec = WordCodec(BYTE_FILE if byte_level else WORD_FILE, byte_level, room=100)
    texts = [f"{c} a{c}\n{c}b, \n{c}.{c} x{c}{c}y;" for c in wordcodec._LETTERS] * 2
    want = [np.array(e.ids, "<u4").tobytes() for e in codec.tok.encode_batch(texts, add_special_tokens=False)]
    assert codec.encode(texts) == want and codec.encode(texts[:7]) == want[:7] and len(codec.known[0]) == 100


def test_repair_and_expand_hold_little_beside_the_ids():
    """Pairs of 16-bit symbols are sorted as 32-bit numbers and symbols looked up at once: some bytes an id each."""
    n = 1_000_000
    ids = np.minimum(np.random.default_rng(1).zipf(1.3, n), 50_000).astype(np.uint32)
    starts = np.arange(0, n, 1000)
    tracemalloc.start()
    try:
        seq, at, rules, size = tokenfiles.repair(ids, starts, 50_257)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 32 * n
    assert len(seq) < 0.8 * n and np.array_equal(tokenfiles.expand(seq, rules, 50_257), ids)
    symbols = np.arange(50_257, 50_257 + len(rules))
    assert [len(tokenfiles.expand(symbols[k:k + 1], rules, 50_257)) for k in range(0, len(rules), 50)] == size[::50].tolist()


def test_highest_symbol_twice_is_no_pair():
    """The highest symbol twice would be the mark of a document's end: it is left as it is, and no pair crosses an end."""
    ids, starts = np.array([1] * 41 + [65_534, 1] * 8, np.uint32), np.array([0, 3, 20, 41, 48])
    seq, at, rules, size = tokenfiles.repair(ids, starts, 65_535, rounds=3, least=2, most_rules=1)
    assert rules.tolist() == [[1, 1]] and (seq == 65_535).sum() == 19
    for a, e, x, y in zip(at, [*at[1:], len(seq)], starts, [*starts[1:], len(ids)]):
        assert tokenfiles.expand(seq[a:e], rules, 65_535).tolist() == ids[x:y].tolist()


def test_repair_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 50, 5000):
        ids = rng.integers(0, 5, n)
        starts = np.unique(np.concatenate([[0], rng.integers(0, max(n, 1), 5)])) if n else np.zeros(0, int)
        seq, at, rules, size = tokenfiles.repair(ids, starts, 10, rounds=4, least=2)
        assert tokenfiles.expand(seq, rules, 10).tolist() == ids.tolist()
        for k, (a, b) in enumerate(zip(at, np.append(at[1:], len(seq)))):
            assert tokenfiles.expand(seq[a:b], rules, 10).tolist() == ids[starts[k]:(starts[k + 1] if k + 1 < len(starts) else n)].tolist()
        assert [len(tokenfiles.expand(np.array([10 + k]), rules, 10)) for k in range(len(rules))] == size.tolist()


# Mixing


def poured(sizes, most=3.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    goal, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > most * sizes[s]}
        if not over:
            goal.update({s: left * weight[s] / total for s in free})
            break
        goal.update({s: most * sizes[s] for s in over})
        left -= sum(goal[s] for s in over)
        free -= over
    return goal


def test_mixing(spark, documents, odd_docs):
    for docs in (documents, odd_docs):
        got = mixing.mix(docs).collect()
        assert len(got) == docs.count()
        sizes = Counter()
        for r in docs.collect():
            sizes[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        goal, taken, largest = poured(sizes), Counter(), Counter()
        for r in got:
            assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], goal[r["source"]], rel_tol=1e-9)
            assert r["taken"] == r["times"] * r["size"] <= 3 * r["size"]
            taken[r["source"]] += r["taken"]
            largest[r["source"]] = max(largest[r["source"]], r["size"])
        for s in sizes:
            repeats = max(Counter(r["doc_id"] for r in got if r["source"] == s).values())
            assert abs(taken[s] - goal[s]) <= largest[s] * repeats / 2 + 1e-6
        again = mixing.mix(docs.repartition(5)).collect()
        assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixing_prefers_quality(spark):
    docs = spark.createDataFrame([(i, "a b c", "x" if i < 900 else "y") for i in range(1000)], "doc_id long, text string, source string")
    good = spark.createDataFrame([(i, 8.0) for i in range(0, 900, 2)], "doc_id long, weight double")
    got = mixing.mix(docs, good, weights=(1, 3), share=0.5).collect()
    odd = [r["times"] for r in got if r["source"] == "x" and r["doc_id"] % 2]
    even = [r["times"] for r in got if r["source"] == "x" and r["doc_id"] % 2 == 0]
    assert sum(even) > 2 * sum(odd)


def test_repeat(odd_docs):
    mixed = mixing.mix(odd_docs)
    want = Counter()
    for r in mixed.collect():
        want[r["doc_id"]] += r["times"]
    got = Counter(r["doc_id"] for r in mixing.repeat(odd_docs, mixed).collect())
    assert got == +want


# Toxicity


def slow_segments(scores):
    """All maximal scoring segments: the best one, then those of either side."""
    best = max(((sum(scores[i:j]), -(j - i), i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0,))
    if best[0] <= 1e-9:
        return []
    _, _, i, j = best
    return slow_segments(scores[:i]) + [(i, j, best[0])] + [(a + j, b + j, s) for a, b, s in slow_segments(scores[j:])]


def test_segments_are_the_maximal_ones():
    rng = np.random.default_rng(1)
    for _ in range(200):
        scores = rng.choice([-0.25, -0.25, -0.25, 0.6, 1.3, 0.31], rng.integers(0, 14))
        got = toxicity.segments(scores, 0.25)
        want = slow_segments(scores.tolist())
        assert math.isclose(sum(s for *_, s in got), sum(s for *_, s in want), abs_tol=1e-9)
        assert [g[:2] for g in got] == [w[:2] for w in want]


def test_toxicity_held_out(spark):
    got = queries.QUERIES["op1_toxicity"](spark, "/root/testdata/sf0.01").collect()
    truth = {r["doc_id"]: r["toxic"] for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    held = [(truth[r["doc_id"]], r["predicted"], r["score"]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert {r["held_out"] for r in got} == {True, False}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    assert sum(t and p for t, p, _ in held) >= 0.8 * sum(t for t, *_ in held)
    assert sum(p and not t for t, p, _ in held) <= 0.1 * len(held)


def test_toxicity_without_labels(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for docs in (odd_docs, no_docs):
        model = toxicity.fit(docs, labels, F.lit(True))
        got = toxicity.score(docs, model).collect()
        assert len(got) == docs.count() and all(r["predicted"] == 0 and not r["passages"] for r in got)
        assert toxicity.keep_clean(docs, model).count() == docs.count()


# Licenses


def test_licenses(spark, documents, odd_docs):
    notices = dict(licenses.TEMPLATES)
    mit = notices["MIT-notice"].split()
    rows = [(10_000 + i, " ".join(["start"] * i + mit[:38] + ["changed"] + mit[39:] + ["end"] * 30)) for i in range(0, 60, 7)]
    rows += [(20_000, notices["Apache-2.0-notice"].upper()), (20_001, " ".join(mit[:20])), (20_002, "released under the license of MIT")]
    docs = documents.select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text")).unionByName(spark.createDataFrame(rows, "doc_id long, text string"))

    def shingles(words):
        return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}

    want = set()
    for d, t in texts_of(docs):
        words = re.findall(r"[^\W_]+", t.lower())
        for name, text in licenses.TEMPLATES:
            own = re.findall(r"[^\W_]+", text.lower())
            size = licenses._window(len(own))
            if any(len(shingles(words[a:a + size]) & shingles(own)) >= 0.8 * len(shingles(own)) for a in range(0, len(words), size // 2)):
                want.add((d, name))
    got = licenses.scan(docs).collect()
    assert {(r["doc_id"], r["license"]) for r in got} == want and len(got) == len(want)
    assert {(10_000, "MIT-notice"), (20_000, "Apache-2.0-notice")} <= want and (20_001, "MIT-notice") not in want


# All of them


def test_empty_tables(spark, no_docs):
    assert pii.scan(no_docs).count() == pii.sanitise(no_docs).count() == 0
    assert simhash.near_duplicates(no_docs).count() == simhash.keep_one(no_docs).count() == 0
    assert packing.pack_documents(no_docs, WORD_FILE).count() == 0
    assert mixing.mix(no_docs).count() == licenses.scan(no_docs).count() == 0
    folder = shared_folder(spark) + "/none"
    tokenfiles.write_token_files(no_docs, folder, BYTE_FILE, end_id=2)
    assert tokenfiles.read_token_files(spark, folder).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SF).toPandas(), connect(SF).execute(queries.SQL[name]).df()) is None
