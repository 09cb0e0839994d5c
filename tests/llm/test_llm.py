"""Each operator against a brute-force version on a small table of awkward rows, and on an empty one."""

import base64
import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaymark.llm import suffix_dedup as sd
from quaymark.llm.bpe import LONGEST, PIECES, Encoder, encode_documents, known_pieces, learn_pieces
from quaymark.llm.exact_dedup import exact_dedup
from quaymark.llm.language import language_id
from quaymark.llm.maxent import score
from quaymark.llm.minhash import K, _met, least_by_union, least_shared, near_duplicates
from quaymark.llm.mixing import mix
from quaymark.llm.quality import quality
from quaymark.llm.token_store import LibraryEncoder, ShardReader, read_tokens, write_tokens
from quaymark.llm.warc import derive, derivatives, html_text, read_records, read_warc, record_id, responses, serialise, split_http, write_warc

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, score double, label string, n long"
EN = "the quick brown fox jumps over the lazy dog and then it walks home through every old garden of this town "
DE = "der schnelle braune fuchs springt über den faulen hund und danach geht er nach hause durch jeden alten garten "
PASSAGE = "".join(f"shared passage word{i} " for i in range(30))
TEXTS = [
    (1, EN * 6, "en", "a"), (2, EN * 6, "en", "a"), (3, (EN * 6).replace(" ", "\n\t"), "en", "b"), (4, DE * 5, "de", "b"), (5, DE * 5 + "zusatz", "de", None),
    (6, None, None, "a"), (7, "", "en", None), (8, " \n\t", "en", "a"), (9, "ÄÖ ## **  x y z 12345 don't", None, "c"), (10, "a" * 3000, "en", "c"),
    (11, "start " + PASSAGE + EN * 2, "en", "a"), (12, PASSAGE + "other end " + DE, "de", "a"), (13, " ".join(f"w{i * i % 977}" for i in range(20000)), "en", "a"),
    (14, "two words", "en", "d"), (15, "Two  WORDS", "en", "d"), (16, "line one\nline one\nline two\n" * 30, "en", "d"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, g, s, 0.5, "x", 1) for i, t, g, s in TEXTS]
    return spark.createDataFrame(rows + [rows[0]], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def all_rows(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def test_suffix_dedup(docs, empty):
    texts = [(i, t.encode()) for i, t in all_rows(docs)]
    n = Counter(t[p : p + 400] for _, t in texts for p in range(len(t) - 399))
    want = []
    for i, t in texts:
        cov = bytearray(len(t))
        for p in range(len(t) - 399):
            if n[t[p : p + 400]] > 1:
                cov[p : p + 400] = b"\1" * 400
        want.append((i, len(t), sum(cov), len(re.findall(b"\1+", cov)), hashlib.sha256(bytes(b for b, c in zip(t, cov) if not c)).hexdigest()))
    rows = sd.suffix_dedup(docs).collect()
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want) and sd.suffix_dedup(empty).count() == 0
    assert all(r["repeated"] for r in rows if r["n_removed"])


def test_passages_shorter_than_what_is_removed(spark):
    rng = random.Random(9)
    some = lambda n: [f"{rng.choice('bcdfglmn')}{'aeiou'[rng.randrange(5)]}{rng.choice(['', 'st', 'r', 'ng'])}{rng.randrange(100)}" for _ in range(n)]
    long, just, few = some(56), some(51), some(50)
    texts = [some(90) + long + some(40), long + some(300), some(7) + just, just + some(30), some(20) + few + some(20), few + some(9), some(400), some(51), []]
    texts = [" ".join(t) for t in texts] + [" ".join(some(52))] * 2 + [" ".join(few)] * 2
    assert all(240 <= len(" ".join(x)) < 400 for x in (long, just, few))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["repeated"], r["n_removed"]) for r in sd.suffix_dedup(docs).collect()}
    assert {i for i, (found, _) in got.items() if found} == {0, 1, 2, 3, 9, 10} and not any(n for _, n in got.values())


def test_loser_tree():
    runs = [sorted(bytes([a % 7, b % 3]) * (a % 5) for a in range(20)) for b in range(5)]
    blobs = [sd.encode_run([(s, (0, 0, 1, b"")) for s in r]) for r in runs]
    out = [(n, s) for n, s, _ in sd.LoserTree([sd.decode_run(b) for b in blobs])]
    assert [s for _, s in out] == sorted(s for r in runs for s in r)
    assert [n for n, _ in out][1:] == [sd.common(a[1], b[1]) for a, b in zip(out, out[1:])]


def test_bpe(docs, empty, tmp_path):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in all_rows(docs):
        ids = lib.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(tuple(r) for r in encode_documents(docs, path, P.PATTERN, with_ids=False).collect()) == sorted(want)
    assert encode_documents(empty, path, P.PATTERN).count() == 0
    # a split finds its pieces with their ids, and one that isn't there finds none
    splits = docs.rdd.getNumPartitions()
    at = learn_pieces(docs, path, P.PATTERN, f"file://{tmp_path}")
    per = [known_pieces(at, k) for k in range(splits + 1)]
    assert sum(map(bool, per)) >= 2 and not per[-1] and all(list(struct.unpack(f"<{len(b) // 4}I", b)) == lib.encode_ordinary(p) for x in per for p, b in x.items())
    assert {p for x in per for p in x} == {p for _, t in all_rows(docs) for p in PIECES.findall(t) if len(p) <= LONGEST}
    enc = Encoder(path, P.PATTERN)
    for t in ("a  b　\x1c c  \r\n d", "<|endoftext|> 'S 're", "aaaaaaaaaaaaaaa" * 50, "日本語 и русский 🙂🙂"):
        (got,) = enc.encode([t])
        assert list(struct.unpack(f"<{len(got) // 4}I", got)) == lib.encode_ordinary(t) and enc.decode(got) == t.encode()


def test_exact_dedup(docs, empty):
    rows = all_rows(docs)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
    size = Counter(norm(t) for _, t in rows)
    keep = {}
    for i, t in rows:
        keep[norm(t)] = min(keep.get(norm(t), (1, 0)), (-len(t), i))
    got = exact_dedup(docs).collect()
    want = sorted((i, keep[norm(t)][1], size[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(size) and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert exact_dedup(empty).count() == 0


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<title>T</title><script>x('</p>')</script><p>a &amp; b<br>c<!-- d -->"), (2, None, None), (2, None, None)], "page_id long, url string, html string")
    rs = responses(pages).collect()
    assert html_text("<p>a &amp; b<br>c<!-- d --> e<style>x") == "a & b\nc e"
    got = derivatives(responses(pages), ["page_id"]).collect()
    assert len(got) == 6
    one = {r["warc_type"]: r for r in got if r["page_id"] == 1}
    assert bytes(one["conversion"]["block"]).decode() == "T\na & b\nc"
    assert one["metadata"]["refers_to"] == one["conversion"]["refers_to"] == next(r["record_id"] for r in rs if r["page_id"] == 1)
    assert one["conversion"]["headers"]["WARC-Source-Payload-Digest"] in bytes(one["metadata"]["block"]).decode()
    again = list(read_records(b"".join(serialise(r.asDict()) for r in got)))
    assert [(a["record_id"], a["refers_to"], a["block"]) for a in again] == [(r["record_id"], r["refers_to"], bytes(r["block"])) for r in got]
    assert split_http(b"plain")[2] == b"plain" and len(derive({"record_id": record_id("x"), "target_uri": None, "date": None, "headers": None, "block": None})) == 2
    assert derivatives(responses(pages.limit(0))).count() == 0
    assert len({r["record_id"] for r in rs} | {r["record_id"] for r in got}) == 9  # equal rows too
    at = f"file://{tmp_path}/warc"
    back = read_warc(spark, at, write_warc(derivatives(responses(pages)), at)).collect()
    key = lambda r: (r["record_id"], r["warc_type"], r["refers_to"], r["target_uri"], r["date"], bytes(r["block"]))
    assert sorted(map(key, back), key=str) == sorted(map(key, got), key=str) and all(r["date"] for r in back)


def test_warc_survives_odd_charsets():
    for name in ("idna", "undefined", "punycode", "rot13", "base64", "utf-16", "nonsense", "latin-1"):
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset={name}\r\n\r\n".encode() + b"<p>caf\xe9 ab"
        assert [d["warc_type"] for d in derive({"record_id": record_id("x"), "target_uri": "u", "date": None, "headers": None, "block": block})] == ["metadata", "conversion"]


def test_bpe_sends_pieces_packed():
    from quaymark.llm.bpe import _packed, _pieces

    rng = random.Random(4)
    pieces = sorted({f" {rng.choice(['un', 'fore', 'inter', 'over'])}{rng.choice(['cast', 'stand', 'work'])}{i}é" for i in range(2000)})
    frame = _packed(pieces)
    assert _pieces(frame) == pieces and len(frame) < 0.6 * sum(len(p.encode()) + 1 for p in pieces)
    assert _pieces(_packed([])) == []


def test_token_store(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    lib, folder = Tokenizer.from_file(P.path("byte_bpe_50k.json")), f"file://{tmp_path}/t"
    shards = write_tokens(docs, P.path("byte_bpe_50k.json"), folder)
    got = sorted(tuple(r) for r in read_tokens(spark, folder, shards).collect())
    want, at = [], 0
    for i, t in sorted(all_rows(docs)):
        ids = [*lib.encode(t, add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    assert got == want
    with open(tmp_path / "t/dictionary", "rb") as f:
        dictionary = f.read()
    first = f"{folder}/shard-{shards.orderBy('shard').head()['shard']:06d}.qtok"
    assert ShardReader(first, dictionary).ids_of(0)[-1] == 0
    with pytest.raises(ValueError):
        ShardReader(first, dictionary + b"x")
    none = write_tokens(empty, P.path("byte_bpe_50k.json"), f"file://{tmp_path}/e")
    assert read_tokens(spark, f"file://{tmp_path}/e", none).count() == 0


def test_library_encoder_cuts_where_the_library_does():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    whole, cut, rnd = Tokenizer.from_file(path), LibraryEncoder(path), random.Random(7)
    whole.encode_special_tokens = True
    bits = [" ", "  ", "\n", "\t", " \n", "a", "é", "word", "don't", "\x85", "\u3000", "<|endoftext|>", "1", "中", "\x1c", "x" * 70]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30))) for _ in range(2000)]
    for _ in range(2):  # nothing known, then all
        assert cut.encode(texts) == [np.array(e.ids, "<u2").tobytes() for e in whole.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("words,pct,k", [(3, 85, K), (5, 80, K), (3, 85, None)])
def test_near_duplicates(docs, empty, words, pct, k):
    sets = {}
    for i, t in all_rows(docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    low = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= pct * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
    for r in near_duplicates(docs, words, pct, k=k).collect():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), low[r["doc_id"]], low[r["doc_id"]] == r["doc_id"])
    if words == 5:
        assert near_duplicates(empty).count() == 0
    assert 30 <= least_shared(64, 0.85) <= 50


def test_blocks_of_a_long_list_lose_no_link():
    rng = np.random.default_rng(0)
    base = rng.choice(1 << 60, 160, replace=False)
    sets = []
    for changed in rng.integers(0, 40, 120):
        x = base.copy()
        x[rng.choice(160, changed, replace=False)] = rng.integers(0, 1 << 60, changed)
        sets.append(np.unique(x))
    n, every = np.array([len(x) for x in sets]), np.arange(len(sets))
    known = least_by_union(K, 0.85)
    steps = np.array([size for size, _ in known]), np.array([m for _, m in known] + [least_shared(K, 0.85)], float)
    linked = set()
    for a, x in enumerate(sets):
        for b in range(a + 1, len(sets)):
            both = len(np.intersect1d(x, sets[b]))
            if 100 * both >= 85 * (n[a] + n[b] - both):
                linked.add((a, b))
    sketch, none = [x[:K] for x in sets], [x[:0] for x in sets]

    def met(left, right, label=every, prior=none):
        i, j = _met(sketch, prior, label, n, left, right, 85, steps)
        return {(min(p), max(p)) for p in zip(i.tolist(), j.tolist())}

    whole = met(every, every)
    i, j = _met(sets, none, every, n, every, every, 85, None, None)
    assert {(min(p), max(p)) for p in zip(i.tolist(), j.tolist())} == linked
    assert linked and linked <= whole
    halves = every[:60], every[60:]
    assert met(halves[0], halves[0]) | met(halves[1], halves[1]) | met(*halves) == whole
    # nothing is compared within a component, nor where an earlier list has the pair already
    assert met(every, every, label=every * 0) == set()
    assert met(every, every, prior=[x[:1] * 0 + 7 for x in sets]) == set()


def test_quality(docs, empty):
    got = {r["doc_id"]: r for r in quality(docs).collect()}
    for i, t in all_rows(docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        rep = len({k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)})
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep)
        assert r["base_failed"] == (len(w) < 50 or 100 * rep > 50 * len(w)) and r["kept"] <= (not r["base_failed"])
    assert quality(empty).count() == 0


def test_quality_outlier(spark):
    import random

    rng, words = random.Random(3), EN.split()
    rows = [(i, " ".join(f"{rng.choice(words)}{rng.randrange(9)}" for _ in range(80)), "en", "s", 0.0, "", 0) for i in range(60)]
    rows.append((99, " ".join(f"{w}###***" for w in rows[0][1].split()), "en", "s", 0.0, "", 0))
    out = [r["doc_id"] for r in quality(spark.createDataFrame(rows, SCHEMA)).collect() if not r["kept"]]
    assert out == [99]


def test_mixing(docs, empty):
    rows, _, pieces = mix(docs)
    got = rows.collect()
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
        assert r["taken"] <= 2 * r["size"] and r["target"] <= 2 * r["source_size"]
    total = sum(r["size"] for r in got)
    assert abs(sum(x[0]["target"] for x in by.values()) - 1.5 * total) < 1e-6 * total
    for x in by.values():
        assert abs(sum(r["taken"] for r in x) - x[0]["target"]) <= max(1, min(32, x[0]["source_size"] / 100))
    for other in (docs.repartition(7), docs.coalesce(1), docs.repartition(2, "source")):  # however it is read
        assert sorted((r["doc_id"], r["taken"]) for r in mix(other)[0].collect()) == sorted((r["doc_id"], r["taken"]) for r in got)
    assert pieces.agg({"words": "sum"}).head()[0] == sum(r["taken"] for r in got) and mix(empty)[0].count() == 0


def test_token_store_asks_once_for_pieces_that_occur_again(monkeypatch):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from quaymark.llm import token_store as ts

    monkeypatch.setattr(ts, "MOST", 100)
    enc, lib, asked = LibraryEncoder(P.path("byte_bpe_50k.json")), Tokenizer.from_file(P.path("byte_bpe_50k.json")), Counter()
    learn = enc._learn_after
    enc._learn_after = lambda new: (asked.update(new), learn(new))[1]
    common = [f"common{i}" for i in range(60)]
    for k in range(12):
        texts = [" ".join(["first", *common, *(f"once{k}x{i}" for i in range(70))]), f"two  spaces{k} \n common1 {'wide' * 30}", "", "common2"]
        want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(x, "<u2").tolist() for x in enc.encode(texts)] == want
        assert len(enc.after) <= 400
    assert max(asked[w] for w in common) == 1


def test_maxent(docs, empty):
    toks = [(i, t.encode().lower().split() + [b""]) for i, t in all_rows(docs)]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, ws in toks if not held(i) for w in ws)
    from math import log10

    got = {r["doc_id"]: r for r in score(docs).collect()}
    for i, ws in toks:
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(ws), sum(w in c for w in ws), sum(c.values()))
        want = sum(log10((c[w] + 1) / (sum(c.values()) + len(c) + 1)) for w in ws)
        assert abs(r["base_score"] - want) <= 1e-9 * abs(want) and r["score"] < 0
    assert score(empty).count() == 0
    # many blocks, a row or a few each, ask and are answered as one is
    apart = {r["doc_id"]: r["score"] for r in score(docs, block_bytes=1000).collect()}
    assert all(abs(apart[i] - r["score"]) <= 2e-3 * abs(r["score"]) for i, r in got.items())


def test_maxent_learns_words_in_their_contexts(spark):
    rng = random.Random(6)
    pairs = [(f"a{i}xq", f"b{i}zj{'klmn'[i % 4]}{'opqr'[i // 4]}") for i in range(16)]
    docs = spark.createDataFrame([(i, " ".join(w for _ in range(60) for w in rng.choice(pairs))) for i in range(60)], "doc_id long, text string")
    got = score(docs).collect()
    held = [r for r in got if r["held_out"]]
    # of the two words the second follows from the first, which the base doesn't see
    assert held and sum(r["score"] for r in held) > 0.75 * sum(r["base_score"] for r in held)


def test_maxent_words_have_weights_in_a_corpus_of_any_size(spark):
    rng = random.Random(6)
    pairs = [(f"a{i}xq", f"b{i}zj{'klmn'[i % 4]}{'opqr'[i // 4]}") for i in range(16)]
    docs = spark.createDataFrame([(i, " ".join(w for _ in range(60) for w in rng.choice(pairs))) for i in range(20)], "doc_id long, text string")
    others = spark.range(1000, 1060).selectExpr("id AS doc_id", "repeat('the ', 40000) AS text")  # two million tokens
    got = [r for r in score(docs.union(others)).collect() if r["held_out"] and r["doc_id"] < 20]
    mean = sum(r["score"] for r in got) / sum(r["n_tokens"] for r in got)
    # each of the words has about 60 training tokens; without weights of their own, the one after is as good as any of 16
    assert mean > -1


def _toy_model():
    from quaymark.llm import maxent as me

    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{rng.integers(40)}{'abcde'[rng.integers(5)]}" for _ in range(rng.integers(0, 80))).encode() for _ in range(20)]
    h, begin, cls = me.tokens(texts)
    vocab, at, idx = np.unique(h, return_index=True, return_inverse=True)
    block = me.Block(begin, idx.astype(np.int32), vocab, cls[at], np.where(np.arange(20) % 5 == 0, me.HELD, np.arange(20) % 3).astype(np.uint8))
    t = block.train
    counts = np.bincount(idx[t], minlength=len(vocab))
    bucket = cls[at].astype(int) * me.MEMBERS + me.member_of(vocab)
    seen = np.bincount(block.row[t] * me.CLASSES + block.cls[t], minlength=(me.CLASSES + 1) ** 2 * me.CLASSES)
    inner = np.bincount(block.inner[t] * me.MEMBERS + block.member[t], minlength=me.CLASSES * (me.CLASSES + 1) * me.MEMBERS)
    model = me.Model(seen.astype(float), inner.astype(float), np.bincount(bucket, counts, me.CLASSES * me.MEMBERS), np.bincount(bucket[counts > 0], minlength=me.CLASSES * me.MEMBERS))
    pos = np.flatnonzero(counts >= 4).astype(np.int32)
    one = rng.normal(size=(len(pos) + 1, me.CLASSES)).astype(np.float32)
    one[0] = 0
    model.skip = rng.normal(size=model.skip.shape)
    return block, model, counts, bucket, pos, one


def test_maxent_probabilities_sum_to_one():
    from quaymark.llm import maxent as me

    block, model, counts, bucket, pos, one = _toy_model()
    first = block.words_before(pos)
    for t in (0, 1, 17, 100):
        p = me.class_probabilities(model.light(), one, block.row[t : t + 1], first[t : t + 1])[0].astype(float)
        before = int(block.inner[t]) - int(block.cls[t]) * (me.CLASSES + 1)
        of_bucket = (p[:, None] * 10 ** model.inner.reshape(me.CLASSES, -1, me.MEMBERS)[:, before]).ravel()
        words = np.bincount(bucket, (counts + 1.0) * (counts > 0), len(of_bucket)) + 1  # the last is any unknown word
        assert abs((of_bucket * words / 10**model.bucket).sum() - 1) < 1e-5
        at = int(block.cls[t]) * me.MEMBERS + int(block.member[t])
        assert abs(model.log10(block, counts, pos, one)[t] - np.log10(of_bucket[at] * (counts[block.idx[t]] + 1) / 10 ** model.bucket[at])) < 1e-4


def test_maxent_gradient():
    from quaymark.llm import maxent as me

    block, model, _, _, pos, one = _toy_model()
    first, light = block.words_before(pos), model.light().astype(float)
    parts = [block.turn == r for r in range(3)]
    assert (sum(parts) == block.train).all()
    by_row, by_word = (sum(x) for x in zip(*(me.expected_counts(block, model.light(), one, first, use) for use in parts)))
    want_row, want_word, seen = np.zeros(by_row.shape), np.zeros(by_word.shape), np.zeros(by_word.shape)
    for t in np.flatnonzero(block.train):
        x = light[block.row[t]] + one[first[t]]
        p = np.exp(x) / np.exp(x).sum()
        want_row[block.row[t]] += p
        want_word[first[t]] += p
        seen[first[t], block.cls[t]] += 1
    assert np.allclose(by_row, want_row, atol=1e-3) and np.allclose(by_word[1:], want_word[1:], atol=1e-3)
    assert np.array_equal(me.observed_counts(block, first, len(pos) + 1, block.train), seen)
    # observed minus expected is the slope of the log likelihood
    train = np.flatnonzero(block.train)
    total = lambda w: np.log(me.class_probabilities(light, w, block.row, first)[train, block.cls[train]]).sum()
    up, down = one.astype(float), one.astype(float)
    up[1, 3] += 1e-4
    down[1, 3] -= 1e-4
    assert abs((total(up) - total(down)) / 2e-4 - (seen[1, 3] - want_word[1, 3])) < 1e-3
    # counts and shares come through an exchange as they were
    assert np.array_equal(me._large(me._small(seen.astype(int) * 300)), seen * 300)
    assert np.allclose(me._fine(me._coarse(light[:50])), light[:50], atol=np.abs(light[:50]).max() / 250)
    assert np.allclose(me._whole(*me._halved(want_word * 1e6)), want_word * 1e6, rtol=2e-3, atol=1)


def test_language(docs, empty):
    got = {r["doc_id"]: r for r in language_id(docs).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (6, 7, 8))
    assert got[1]["lang_pred"] == "en" and got[4]["lang_pred"] == "de" and all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id(empty).count() == 0


def test_language_needs_letters(spark):
    from quaymark.llm.language import fit, identify, words_of

    assert words_of("½² ¾ Ⅷ 12 _ a½b") == ["a", "b"]
    rows = spark.createDataFrame([(0, "½² ¾"), (1, "Ⅷ ②"), (2, "½ of")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"] > 0) for r in identify(rows, fit([(EN, "en"), (DE, "de")]), ["doc_id"]).collect()}
    assert got == {0: ("und", False), 1: ("und", False), 2: ("en", True)}


def test_expectations_are_the_gradient_of_the_likelihood():
    from itertools import product

    from quaymark.llm.language import expectations

    rng = np.random.default_rng(2)
    em, t = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3))
    total, post, pairs = 0.0, np.zeros_like(em), np.zeros_like(t)
    for s in range(2):
        paths = [(p, np.exp(sum(em[s, i, y] for i, y in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:])))) for p in product(range(3), repeat=4)]
        total = sum(w for _, w in paths)
        for p, w in paths:
            for i, y in enumerate(p):
                post[s, i, y] += w / total
            for a, b in zip(p, p[1:]):
                pairs[a, b] += w / total
    got = expectations(em, t)
    assert np.allclose(got[0], post) and np.allclose(got[1], pairs)


def test_forward_backward():
    import numpy as np

    from quaymark.llm.language import forward_backward

    rng = np.random.default_rng(1)
    lengths, t = [1, 9, 4, 17], rng.normal(size=(3, 3))
    e = rng.normal(size=(sum(lengths), 3))
    got, at = forward_backward(e, lengths, t, stride=4), 0
    for n in lengths:
        x = e[at : at + n]
        a, b = np.empty((n, 3)), np.ones((n, 3))
        a[0] = np.exp(x[0])
        for k in range(1, n):
            a[k] = a[k - 1] @ np.exp(t) * np.exp(x[k])
        for k in range(n - 2, -1, -1):
            b[k] = np.exp(t) @ (b[k + 1] * np.exp(x[k + 1]))
        p = a * b
        assert np.allclose(got[at : at + n], p / p.sum(1, keepdims=True))
        at += n


def test_pipeline(spark, tmp_path, docs):
    import corpus_pipeline as cp

    # extra columns with names of the stages' own, a row that stands twice, the long text
    odd = docs.select("doc_id", "text", "lang", "source", F.lit("c").alias("copy"), F.lit(1).alias("times"), F.lit(True).alias("kept"), F.lit(2).alias("size"), F.lit(3).alias("row_no"), "score", "n")
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"] for r in cp.run(spark, str(tmp_path)).collect()}
    assert out >= {3, 13} and not out & {1} and not out & {2, 6, 7, 8} and [n for n, _ in cp.STAGES] == ["language_id", "exact_dedup", "minhash_dedup", "mixing", "byte_bpe"]


def test_pipeline_of_nothing(spark, tmp_path, empty):
    import corpus_pipeline as cp

    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_pipeline_goes_by_rows(spark):
    import corpus_pipeline as cp

    rng = random.Random(5)
    own = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    twice, near, shared, null, other, same = (own() for _ in range(6))
    rows = [
        (1, twice), (1, twice), (2, own()), (2, near + " a b"), (3, near + " c d"), (4, shared), (5, shared), (5, own()),
        (None, null), (None, null), (None, own()), (6, other), (None, other + " e"), (None, same + " f"), (None, same + " g"), (8, own()),
    ]
    docs = spark.createDataFrame([(i, t, "en", "a") for i, t in rows], "doc_id long, text string, lang string, source string").repartition(3)
    want = lambda gone: sorted(t for k, (_, t) in enumerate(rows) if k not in gone)
    texts = lambda d: sorted(r["text"] for r in d.collect())
    exact = cp.exact_stage(spark, docs, "")
    assert texts(exact) == want({1, 6, 9}) and exact.columns == docs.columns
    left = [t for t in texts(cp.near_stage(spark, exact, "")) if not t.endswith((" f", " g"))]
    assert left == want({1, 4, 6, 9, 12, 13, 14})
    assert sum(t.endswith((" f", " g")) for t in texts(cp.near_stage(spark, exact, ""))) == 1
    # each row as often as its own words are taken, not as another row of its id
    from quaymark.llm.mixing import mix as mixed

    few = spark.createDataFrame([(None if k % 2 else 9, own(), "en", f"s{k % 3}") for k in range(12)], docs.schema).coalesce(1)
    times = Counter(r["text"] for r in cp.mix_stage(spark, few, "").collect())
    row_of = {r["row_no"]: r["taken"] / r["size"] for r in mixed(few)[0].collect()}
    got = [times[t] for t, in few.select("text").collect()]
    assert all(int(x) <= n <= int(x) + 1 for n, (_, x) in zip(got, sorted(row_of.items())))


def test_pipeline_without_languages(spark, tmp_path, docs):
    import corpus_pipeline as cp

    few = docs.where("doc_id <> 13").select("doc_id", "text", F.lit(None).cast("string").alias("lang"), "source")
    few.write.parquet(f"{tmp_path}/documents.parquet")
    kept = [r["doc_id"] for r in cp.language_stage(spark, few, str(tmp_path)).collect()]
    assert sorted(kept) == sorted(r["doc_id"] for r in few.collect() if re.search(r"[^\W\d_]", r["text"] or ""))
    left = few
    for _, stage in cp.STAGES[:3]:
        left = stage(spark, left, str(tmp_path))
    assert {r["doc_id"] for r in left.collect()} >= {3, 4, 10}
    # labelled rows there are, but all in the held-out fold
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 4 == 2)
    one = spark.createDataFrame([(held, EN, "en", "a"), (held, "123", "en", "a")], few.schema)
    assert [r["text"] for r in cp.language_stage(spark, one, "").collect()] == [EN]


def test_quality_outlier_of_each_feature(spark):
    rng, words = random.Random(4), EN.split()
    plain = lambda n: [f"{rng.choice(words)}{rng.randrange(99)}" for _ in range(n)]
    rows = [(i, " ".join(plain(rng.choice((80, 200, 400)))), "en", "s") for i in range(80)]
    odd = [w + "xx" for w in plain(200)], [w + "#" * (k % 4 == 0) for k, w in enumerate(plain(200))], plain(180)
    phrase = plain(6)
    rows.append((100, " ".join(odd[0]), "en", "s"))  # words longer by two letters
    rows.append((101, " ".join(odd[1]), "en", "s"))  # a symbol in a quarter of the words
    rows.append((102, " ".join(odd[2]) + "\n=" * 20, "en", "s"))  # repeated lines
    rows.append((103, " ".join(plain(130) + phrase * 11), "en", "s"))  # a third of the words repeats itself
    rows.append((104, " ".join(plain(3000)), "en", "s"))  # long, but as the others
    rows += [(200, " ".join(plain(200)), "en", "rare"), (201, " ".join(w + "###" for w in plain(200)), "en", "rare")]  # held against its language
    rows += [(300, " ".join(w + "###" for w in plain(200)), "xx", "rare")]  # a language of one text: nothing to hold it against
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality(docs).collect()}
    assert len(got) == len(rows) and not any(r["base_failed"] for r in got.values())
    assert sorted(i for i, r in got.items() if not r["kept"]) == [100, 101, 102, 103, 201]
    assert got[200]["distance2"] is not None and got[300]["distance2"] is None


def test_language_reads_long_words_to_their_end(spark):
    from quaymark.llm.language import fit, identify

    x, y = "a" * 70 + "xz" * 10, "a" * 70 + "yw" * 10
    model = fit([(f"{x} " * 60, "p"), (f"{y} " * 60, "q")])
    rows = spark.createDataFrame([(0, x), (1, y), (2, "a" * 5000 + "xz" * 500), (3, "a" * 5000 + "yw" * 500)], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in identify(rows, model, ["doc_id"]).collect()}
    assert got == {0: "p", 1: "q", 2: "p", 3: "q"}


def test_near_duplicates_names_the_links_it_counts(docs):
    got = near_duplicates(docs, 3, 85)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "n_joining_links", "kept"]


def test_warc_keeps_repeated_headers():
    block = b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nVia: x\r\nSet-Cookie: b=2\r\n\r\nbody"
    meta = derive({"record_id": record_id("x"), "target_uri": None, "date": None, "headers": None, "block": block})[0]["block"].decode()
    assert [x for x in meta.split("\r\n") if x.startswith("source-header-")] == ["source-header-Set-Cookie: a=1", "source-header-Via: x", "source-header-Set-Cookie: b=2"]
