"""Operators against brute force, on small fixtures with nulls, ties, repeats and clashing columns."""

import base64
import hashlib
import io
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from quern.llm import bpe, chat, decontaminate, fingerprint, kdtree, licence, near_duplicates, ordinal, packing, queries, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.random() ** 2 * vocabulary)}" for _ in range(n))


def corpus(seed=5):
    """Documents with copies, chains of near copies, a shared passage, long and odd texts, nulls."""
    rng = random.Random(seed)
    texts = [words(rng, rng.randint(1, 120)) for _ in range(60)]
    base = words(rng, 150, 5000).split()
    for _ in range(40):  # near copies around one text
        own = list(base)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    passage = words(rng, 30, 5000)
    texts += [passage + " " + words(rng, 60, 5000) for _ in range(20)]
    texts += [texts[3]] * 5 + [texts[70].upper()] * 3 + [texts[3] + "\n", "", " \t\n", "one", "one", "One two", "a b c d e", "é  É\x0bx", None, None]
    texts += [words(rng, 8000, 10**6)]
    return [(i * 3 % 401, t) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text):
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in (text or "").encode().split()]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def linked(x, y):
    i = len(x & y)
    return bool(x) and bool(y) and 100 * i >= 80 * len(x | y)


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    top = {i: i for i, _ in rows}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if linked(a, b):
                x, y = sorted((find(i), find(j)))
                top[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def test_near_duplicates(spark):
    rows = corpus()
    got = {r[0]: (r[1], r[2]) for r in near_duplicates.components(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_all_links(spark):
    rows = corpus(6)
    pairs, members = near_duplicates.links(frame(spark, rows))
    first = {}
    for i, t in rows:
        s = frozenset(shingles(t))
        first[s] = min(i, first.get(s, i))
    first.pop(frozenset(), None)
    want = {(min(a, b), max(a, b)) for s, a in first.items() for t, b in first.items() if a < b and linked(s, t)}
    assert {(r.a, r.b) for r in pairs.collect()} == want
    assert {r.doc_id: r.class_id for r in members.collect()} == {i: first.get(frozenset(shingles(t)), i) for i, t in rows}


def test_near_duplicates_small_splits(spark, monkeypatch):
    """Lists of postings in splits, and the smallest count table, change nothing."""
    monkeypatch.setattr(near_duplicates, "TOGETHER", 2)
    monkeypatch.setattr(near_duplicates, "SKETCH", 17)
    rows = corpus(7)
    got = {r[0]: (r[1], r[2]) for r in near_duplicates.components(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_odd_rows(spark, empty):
    assert near_duplicates.components(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (9, "A B C D E F")], "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("sig", F.lit("x"))
    got = sorted(near_duplicates.components(rows).collect(), key=str)
    assert [(r.doc_id, r.component_id) for r in got] == [(4, 4), (4, 4), (9, 4), (None, None)]


def test_shingler_case_and_space():
    import pyarrow as pa

    s = near_duplicates.Shingler()
    texts = ["A b\x0bC  d e f", "a B c D E F", "a b c d e\xa0f", "ab c d e f", "", None, "f e d c b a"]
    got = [tuple(x) for x in s.sets(pa.array(texts))]
    assert got[0] == got[1] and len({*got}) == 5 and got[4] == got[5] == ()
    assert [tuple(x) for x in s.sets(pa.array(texts).slice(2))] == got[2:]


WORD = set(range(48, 58)) | set(range(97, 123))


def plain_words(text):
    out, now = [], ""
    for c in text or "":
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if ord(c) in WORD or ord(c) > 127:
            now += c
        elif now:
            out.append(now)
            now = ""
    return out + ([now] if now else [])


def brute_report(docs, items):
    wins = [(i, tuple(w[k : k + 10])) for i, t in items for w in [plain_words(t)] if w and i is not None for k in range(max(1, len(w) - 9))]
    out = []
    for d, t in docs:
        w, hit, names = plain_words(t), set(), set()
        for i, win in wins:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    names.add(str(i))
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination(spark, empty, monkeypatch):
    rng = random.Random(2)
    items = [(i, words(rng, rng.choice([3, 9, 10, 11, 25]), 30)) for i in range(30)] + [(3, words(rng, 12, 9)), (99, None), (98, "..."), (97, "É ß q")]
    docs = [(i, words(rng, 80, 30)) for i in range(40)]
    docs += [(100 + i, "Foo, " + t.upper().replace(" ", "--") + "! bar " + t) for i, t in items if t] + [(500, None), (501, ""), (501, items[0][1]), (None, items[1][1]), (502, "x É ß\tq")]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("segment", F.lit(1))
    tests = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute_report(docs, items), key=str)
    assert sorted(map(tuple, decontaminate.report(table, tests).collect()), key=str) == want
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 400)
    assert sorted(map(tuple, decontaminate.report(table, tests).collect()), key=str) == want
    assert decontaminate.report(empty, tests).count() == 0
    assert not decontaminate.report(table, tests.limit(0)).where("contaminated").count()


def test_items_without_an_id(spark, tmp_path, monkeypatch):
    items = [(None, "a b c"), (None, "d e"), (5, "d e"), (6, "f g h")]
    table = spark.createDataFrame([(1, "x a b c"), (2, "d e a b c"), (3, "f g h"), (4, "none")], "doc_id long, text string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    con = duckdb.connect()
    for name, df in (("documents", table), ("benchmark", tests)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    want = sorted(con.execute(queries.oracle_sql()["op8_decontamination"]).fetchall())
    assert [(r[0], r[2], r[3]) for r in want] == [(1, 3, 1), (2, 5, 2), (3, 3, 1), (4, 0, 0)]
    for size in (decontaminate.BLOCK_BYTES, 1):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        assert sorted(map(tuple, decontaminate.report(table, tests).collect())) == want


def test_equal_segments_and_blocks(spark, monkeypatch):
    """Equal partitions keep rows of their own however many blocks there are, and long items are cut without loss."""
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l")] * 2, "doc_id long, text string").repartition(2)
    items = spark.createDataFrame([(1, "a b c"), (2, "x y z"), (3, "b c d e f g h i j k l"), (3, "q r"), (4, " ".join(f"z{i}" for i in range(90)))], "item_id long, text string")
    whole = spark.createDataFrame([(9, "o " + " ".join(f"z{i}" for i in range(90)))], "doc_id long, text string")
    docs = docs.union(whole)
    want = sorted(map(tuple, decontaminate.report(docs, items).collect()))
    assert [r[2:4] for r in want] == [(12, 2), (12, 2), (90, 1)]
    for size in (1, 30, 100):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        assert sorted(map(tuple, decontaminate.report(docs, items).collect())) == want


def test_phrases_with_few_candidates_at_once(monkeypatch):
    rng = random.Random(9)
    items = [(i, [b"w%d" % rng.randrange(6) for _ in range(rng.choice([2, 3, 5]))]) for i in range(40)]
    docs = [(i, " ".join(f"w{rng.randrange(7)}" for _ in range(200))) for i in range(5)]
    w, segment = decontaminate.Windows(items, 3), decontaminate.Segment(decontaminate.index_of(docs))
    every = [[t.encode() for t in d.split()] for _, d in docs]
    want = {(d, k, i) for i, words_ in items for n in [min(3, len(words_))] for j in range(len(words_) - n + 1) for d, text in enumerate(every) for k in range(len(text) - n + 1) if text[k : k + n] == words_[j : j + n]}
    for most in (1, 7, 1 << 20):
        monkeypatch.setattr(decontaminate, "CANDIDATES", most)
        got = set()
        for found, starts in segment.phrases(w):
            for x, p in zip(found.tolist(), starts.tolist()):
                d = int(np.searchsorted(segment.starts, p, "right")) - 1
                got |= {(d, p - int(segment.starts[d]), int(i)) for i in w.items_of(x)}
        assert got == want


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "b x a y c"), (2, "a " + "z " * 30 + "b c"), (3, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b c")], "item_id long, text string")
    assert [(r.doc_id, r["items"]) for r in decontaminate.proximity(docs, items, reach=5).collect()] == [(1, ["7"])]


def tik():
    return tiktoken.Encoding("own", pat_str=queries.PATTERN, mergeable_ranks=bpe.read_ranks(queries.RANKS), special_tokens={})


def test_bpe_matches_library(spark, empty):
    rng = random.Random(4)
    pool = [chr(c) for c in [*range(0x250), *range(0x2000, 0x2100), *range(0x4E00, 0x4E40), *range(0x1F600, 0x1F640)]] + list("  \n\n'sdtm .,!aAbB01") * 40
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 60))) for _ in range(400)] + ["a" * 30000, " " * 500, "x  y", " x", "x ", "\n", "a\n b", "it's I'LL we'd", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    enc = tik()
    coded = bpe.encode(docs.withColumn("ids", F.lit("clash")), queries.RANKS, queries.PATTERN)
    for r in coded.collect():
        assert r.ids == enc.encode_ordinary(r.text or "")
    back = bpe.decode(coded, queries.RANKS)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back.collect())
    for r in bpe.encode(docs, queries.RANKS, queries.PATTERN, digests=True).collect():
        ids = np.array(enc.encode_ordinary(r.text or ""), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert bpe.encode(empty, queries.RANKS, queries.PATTERN).count() == 0


def test_bpe_every_code_point():
    enc, coder = tik(), bpe.Coder(bpe.read_ranks(queries.RANKS), queries.PATTERN)
    for c in [*range(0xD800), *range(0xE000, 0x34000), *range(0x3D000, 0x3D020), *range(0x10FF00, 0x110000)]:
        text = f"{chr(c)}'t a{chr(c)}'t"
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == enc.encode_ordinary(text), hex(c)


def test_merge_other_ranks():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"aa": 258, b"abc": 259, b"aaaa": 260}

    def naive(p):
        parts = [p[i : i + 1] for i in range(len(p))]
        if p in ranks:
            return [ranks[p]]
        while True:
            best = min(((ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1)), default=(1 << 30, 0))
            if best[0] == 1 << 30:
                return [ranks[x] for x in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    rng = random.Random(1)
    for _ in range(3000):
        p = bytes(rng.choices(b"abc", k=rng.randint(0, 20)))
        assert bpe.merge(p, ranks) == (naive(p) if p else [])


def test_fingerprints(spark, empty):
    rows = corpus(8) + [(900, "ﬁne  Text"), (901, "FINE text "), (902, "Straße"), (903, "STRASSE")]
    by_id = sorted(rows, key=lambda r: -r[0])
    got = {r.doc_id: r for r in fingerprint.fingerprint_documents(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for (i, t), (_, after) in zip(by_id, by_id[1:] + by_id[:1]):
        t, after = t or "", after or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = got[i]
        canon = fingerprint.canonical(t)
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprint.digest(canon), fingerprint.digest(fingerprint.canonical(edited)))
        assert (r.near_edited, r.near_next) == (float(canon == fingerprint.canonical(edited)), float(canon == fingerprint.canonical(after)))
    assert got[900].fingerprint == got[901].fingerprint and got[902].fingerprint == got[903].fingerprint
    assert fingerprint.fingerprint_documents(empty).count() == 0


def test_fingerprint_clash_is_told_apart(spark, monkeypatch):
    """A digest that many texts share: fingerprints still are equal where, and only where, canonical texts are."""

    def weak(canon):
        return "0" * 31 + str(len(canon) % 2)

    docs = [(1, "a"), (2, "b"), (3, "A"), (None, "b"), (5, None), (6, "ccc"), (7, "aa"), (8, "bb"), (9, "ccc")]
    monkeypatch.setattr(fingerprint, "digest", weak)
    got = fingerprint.fingerprint_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    by_id = sorted(docs, key=lambda r: (r[0] is None, -(r[0] or 0)))
    texts = {}
    for (i, t), (_, after) in zip(by_id, by_id[1:] + by_id[:1]):
        t, after = t or "", after or ""
        texts[i] = fingerprint.canonical(t), fingerprint.canonical(t[: len(t) - len(t) // 2] + after[: len(t) // 2])
    seen = {}
    for r in got:
        for name, canon in zip((r.fingerprint, r.edited_fingerprint), texts[r.doc_id]):
            seen.setdefault(name, set()).add(canon)
    assert all(len(x) == 1 for x in seen.values()) and len(seen) == len({c for x in texts.values() for c in x})


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(1, "http://a/ü\r\nX: y", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 300000), (5, "u", "é" * 300000), (None, "n", "same"), (None, "n", "own")], "page_id long, url string, html string").withColumn("first", F.lit(1))
    got = [tuple(r) for r in warc.archive_and_read(pages, payloads=True).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload").collect()]
    sha = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    want = [(1, "same", "revisit", 2), (2, "same", "response", None), (3, "", "revisit", 4), (4, "", "response", None), (5, "é" * 300000, "response", None), (5, "é" * 300000, "response", None), (None, "same", "revisit", 2), (None, "own", "response", None)]
    full = [(i, len(t.encode()), sha(t), kind, to, bytearray(t.encode()) if kind == "response" else None) for i, t, kind, to in want]
    assert sorted(got, key=str) == sorted(full, key=str)
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_warc_finds_damage():
    good = warc.record(1, "u", b"payload", None) + warc.record(2, "u", b"payload", (1,))
    assert [r["record_type"] for r in warc.read_records(io.BytesIO(good))] == ["response", "revisit"]
    for old, new in ((b"payload", b"Payload"), (b"WARC-Payload-Digest: sha1:", b"WARC-Payload-Digest: sha1:A"), (b"\r\n\r\npayload", b"\r\n\r\npay")):
        plain = zlib.decompress(warc.record(1, "u", b"payload", None), 31).replace(old, new, 1)
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(pack.compress(plain) + pack.flush())))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(good[:-20])))


def test_warc_foreign_records():
    """Records of other kinds and writers, without or with other digests."""

    def member(kind, name, block, *more):
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"Content-Length: {len(block)}", *more]
        return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()

    http = "Content-Type: application/http; msgtype=response"
    hello = b"HTTP/1.1 200 OK\r\nX: a\r\n b\r\n\r\nhello"
    made = [
        member("warcinfo", "<urn:uuid:1>", b"a: b", "Content-Type: application/warc-fields"), member("request", "<urn:uuid:2>", b"GET / HTTP/1.0\r\n\r\n", "Content-Type: application/http;msgtype=request"),
        member("response", "<urn:uuid:3>", hello, http), member("response", "<urn:uuid:4>", hello, http, "WARC-Payload-Digest: md5:" + hashlib.md5(b"hello").hexdigest()),
        member("response", "<urn:uuid:5>", b"no end of a header", http), member("metadata", "<urn:uuid:6>", b""), warc.record(7, "u", b"x", None),
    ]
    got = list(warc.read_records(io.BytesIO(b"".join(made)), payloads=True))
    assert [r["payload"] for r in got] == [b"a: b", b"", b"hello", b"hello", b"no end of a header", b"", b"x"]
    assert [r["page_id"] for r in got] == [None] * 6 + [7] and got[2]["record_id"] == "<urn:uuid:3>"
    assert got[2]["payload_digest"] == base64.b32encode(hashlib.sha1(b"hello").digest()).decode()
    for bad in ("WARC-Payload-Digest: md5:" + "0" * 32, "WARC-Block-Digest: sha1:" + "A" * 32):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(member("response", "<urn:uuid:4>", hello, http, bad))))


def test_kdtree(spark, empty):
    rows = [(i + 10_000 * k, t) for k in range(12) for i, t in corpus(9) if len(t or "") < 5000] + [(i, "hot text") for i in range(1000, 1500)] + [(5, "twice")] * 3 + [(None, None)] * 2
    docs = frame(spark, rows)
    got = kdtree.shard(docs, shards=7).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    sums, slots = Counter(), {}
    for r in got:
        sums[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(sums) == set(range(7)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sums.values()) - min(sums.values()) < 3000
    assert kdtree.shard(empty, shards=3).count() == 0
    assert kdtree.shard(docs.limit(1), shards=3).count() == 1


def brute_tree(points, shards):
    """Shard of each point by exact weighted medians: points (coords, size)."""
    dims = len(points[0][0])
    extent = [max(1, max(c[d] for c, _ in points) - min(c[d] for c, _ in points)) for d in range(dims)]
    out = [0] * len(points)

    def cut(own, first, n):
        if n == 1 or not own:
            for i in own:
                out[i] = first
            return
        span = [max(points[i][0][d] for i in own) - min(points[i][0][d] for i in own) for d in range(dims)]
        d = max(range(dims), key=lambda d: (span[d] / extent[d], -d))
        need, gone = sum(points[i][1] for i in own) * (n // 2) // n, 0
        for x in sorted({points[i][0][d] for i in own}):
            w = sum(points[i][1] for i in own if points[i][0][d] == x)
            if gone + w >= need:
                break
            gone += w
        at = x if need - gone < w / 2 else x + 1
        cut([i for i in own if points[i][0][d] < at], first, n // 2)
        cut([i for i in own if points[i][0][d] >= at], first + n // 2, n - n // 2)

    cut(list(range(len(points))), 0, shards)
    return out


def test_kdtree_against_exact_medians(spark, monkeypatch):
    monkeypatch.setattr(kdtree, "SLACK", 0)
    monkeypatch.setattr(kdtree, "BINS", 8)
    rng = random.Random(8)
    for n, shards in ((300, 7), (40, 5), (3, 6)):
        points = [([rng.choice([5, rng.randrange(1 << 40)]), rng.randrange(3), rng.randrange(1000) << 20], rng.choice([1, 10, 500])) for _ in range(n)]
        table = spark.createDataFrame([(i, c, s) for i, (c, s) in enumerate(points)], "i long, coords array<long>, size long")
        tree = kdtree.grow(table, 3, shards)
        got = {r[0]: r[1] for r in table.select("i", tree.shard()).collect()}
        assert [got[i] for i in range(n)] == brute_tree(points, shards)


def test_kdtree_repeated_rows_and_target(spark):
    docs = frame(spark, [(1, "x" * 84)] * 400 + [(i, "y" * 84) for i in range(400)])
    sums = Counter()
    for r in kdtree.shard(docs, shards=4).collect():
        sums[r.shard] += r.size
    assert len(sums) == 4 and max(sums.values()) - min(sums.values()) <= 200
    assert sorted(Counter(r.shard for r in kdtree.shard(docs, target_bytes=10_000).collect())) == list(range(8))
    assert {r.shard for r in kdtree.shard(docs, target_bytes=10**9).collect()} == {0}


def test_best_fit_and_files(spark, empty):
    rng = random.Random(1)
    for _ in range(200):
        size = rng.choice([1, 2, 3, 7, 8, 16, 100])
        lengths = [rng.randint(1, size) for _ in range(rng.randint(0, 80))]
        places, rows = packing.best_fit(lengths, size)
        left = []
        for n in sorted(lengths, reverse=True):
            fits = [(room, i) for i, room in enumerate(left) if room >= n]
            if fits:
                left[min(fits)[1]] -= n
            else:
                left.append(size - n)
        taken = [(r, k) for n, (r, s) in zip(lengths, places) for k in range(s, s + n)]
        assert rows == len(left) and len(taken) == len(set(taken)) and all(k < size for _, k in taken)
    docs = spark.createDataFrame(corpus(3) + [(None, "null id"), (7000, "again"), (7000, "again")], "doc_id long, text string").withColumn("shard", F.lit("clash"))
    enc = tik()
    for length in (16, 2048):
        got = packing.pack_and_read(docs, queries.RANKS, queries.PATTERN, length).collect()
        want = [(r.doc_id, len(ids), -(-len(ids) // length), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()) for r in docs.collect() for ids in [enc.encode_ordinary(r.text or "")]]
        assert sorted(((r.doc_id, r.n_tokens, r.n_pieces, r.ids_sha256) for r in got), key=str) == sorted(want, key=str)
    assert packing.pack_and_read(empty, queries.RANKS, queries.PATTERN).count() == 0


def test_packing_long_runs(spark):
    """Runs on which the library's pattern overflows or its merges take long."""
    texts = [" " * 2_000_000, "a" * 300_000, "x" + " " * 5000 + "y z", "é " * 3000]
    got = {r.doc_id: r for r in packing.pack_and_read(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), queries.RANKS, queries.PATTERN).collect()}
    own = bpe.Coder(bpe.read_ranks(queries.RANKS), queries.PATTERN)
    assert {i: got[i].ids_sha256 for i in got} == {i: hashlib.sha256(own.encode(t)).hexdigest() for i, t in enumerate(texts)}
    assert all(own.decode(own.encode(t)) == t.encode() for t in texts)
    enc = tik()
    assert all(np.frombuffer(own.encode(t), "<u4").tolist() == enc.encode_ordinary(t) for t in texts[2:])


def test_ordinal_held_out():
    rng = random.Random(3)
    f = ordinal.Features()
    texts, grades = [], []
    for i in range(3000):
        g = i % 3
        base = [f"v{rng.randrange(3000)}" for _ in range(rng.randint(5, 200))]
        if g == 1:
            base[rng.randrange(len(base))] = rng.choice(["idiot", "Pathetic,"])
        if g == 0:
            base = [w + "***" for w in base]
        texts.append(" ".join(base))
        grades.append(g)
    x = [f.of_text(t) for t in texts]
    model = ordinal.fit(x[:2000], np.array(grades[:2000]))
    assert (np.diff(model.thresholds) > 0).all()
    score = np.array([model.weights[v].sum() for v in x[2000:]])
    kept = model.tails(score)[:, -1] >= 0.5
    assert (kept == (np.array(grades[2000:]) == 2)).mean() > 0.97


def test_ordinal_gradient():
    """The likelihood is that of its definition, and its gradients are the numerical ones."""
    rng = np.random.default_rng(2)
    n, m, levels = 12, 7, 3
    rows, index = np.nonzero(rng.random((n, m)) < 0.4)
    grades, weights, theta = rng.integers(0, levels + 1, n), rng.normal(size=m), np.array([-0.5, 0.1, -0.7])
    dense = np.zeros((n, m))
    dense[rows, index] = 1
    value, by_weight, by_theta = ordinal.loss(weights, theta, index, rows, grades, 0.3)
    cuts = [-0.5, -0.5 + np.exp(0.1), -0.5 + np.exp(0.1) + np.exp(-0.7)]
    below = [[0.0] + [1 / (1 + np.exp(-(c - x))) for c in cuts] + [1.0] for x in dense @ weights]
    assert value == pytest.approx(-np.mean([np.log(b[g + 1] - b[g]) for b, g in zip(below, grades)]) + 0.15 * weights @ weights)
    for x, own in ((weights, by_weight), (theta, by_theta)):
        for i in range(len(x)):
            x[i] += 1e-6
            up = ordinal.loss(weights, theta, index, rows, grades, 0.3)[0]
            x[i] -= 2e-6
            down = ordinal.loss(weights, theta, index, rows, grades, 0.3)[0]
            x[i] += 1e-6
            assert (up - down) / 2e-6 == pytest.approx(own[i], abs=1e-6)


def test_ordinal_few_grades():
    f = ordinal.Features()
    x = [f.of_text(t) for t in ("good", "bad", "good", None, "")] * 20
    model = ordinal.fit(x, np.array([1, 0, 1, 1, 0] * 20))
    good, bad = (float(model.weights[f.of_text(t)].sum()) for t in ("good", "bad"))
    assert good > bad
    for only in (0, 1, 2):
        one = ordinal.fit(x, np.array([only] * 100), 2)
        assert np.allclose(one.tails(np.zeros(2)), [[only >= 1, only >= 2]] * 2)
    assert (ordinal.fit([], np.zeros(0, np.int64), 2).tails(np.zeros(1)) > 0.99).all()


def test_evidence_of_unknown_texts(spark):
    """Texts without words, and of words that no rated text has, aren't kept; nor is anything if all ratings are low."""
    rng = random.Random(6)
    rows = [(i, words(rng, 60)) for i in range(300)]
    docs = frame(spark, rows + [(900, ""), (901, None), (902, "qzx wvu zzkk"), (903, "?! ..."), (904, words(rng, 300))])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 300, 2)] + [(1, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in ordinal.classify(docs, ordinal.train(docs, ordinal.grades_of(labels))).collect()}
    assert got[904].kept and got[3].kept and not any(got[i].kept for i in (900, 901, 902, 903))
    low = ordinal.train(docs, ordinal.grades_of(labels.withColumn("quality", F.lit(0))))
    assert not any(r.kept for r in ordinal.classify(docs, low).collect())
    assert len(ordinal.sampled(docs, ordinal.grades_of(labels), "doc_id", "text", size=1)[1]) == 1


def test_classify_keeps_columns(spark, empty):
    docs = spark.createDataFrame([(1, "fine words", 0.5), (2, None, None), (3, "", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, None), (2, 0, 0), (3, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = ordinal.train(docs, ordinal.grades_of(labels))
    got = ordinal.classify(docs, model)
    assert got.count() == 3 and set(got.columns) == {"doc_id", "text", "score", "expected_grade", "tail_probability", "evidence", "kept"}
    assert ordinal.classify(empty, ordinal.train(empty, ordinal.grades_of(labels.limit(0)))).count() == 0


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pair_id", F.lit(1))


def test_preferences(spark):
    t = turns(spark, [
        (0, 0, "user", "hi"), (0, 1, "assistant", "good"), (0, 2, "user", "x"), (1, 1, "assistant", "bad<|im_end|>"), (1, 0, "user", "hi"),
        (2, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, None, None), (None, 0, "user", "lost"), (6, 0, "user", "a"), (6, 0, "user", "a"), (7, 0, "user", "a"),
    ])
    got = {r.pair_id: r for r in chat.format_preferences(t, chat.neighbours(t)).collect()}
    r = got[0]
    assert r.n_prompt_turns == 1 and r.prompt == "<|im_start|>user\nhi<|im_end|>\n"
    assert r.chosen == "<|im_start|>assistant\ngood<|im_end|>\n<|im_start|>user\nx<|im_end|>\n"
    start, end = map(int, r.chosen_mask.split("-"))
    assert r.chosen[start:end] == "good<|im_end|>"
    start, end = map(int, r.rejected_mask.split("-"))
    assert r.rejected[start:end] == "bad< |im_end|><|im_end|>"
    assert (got[1].chosen, got[1].rejected, got[1].chosen_mask, got[1].n_prompt_turns) == ("", "", "", 1)
    assert got[2].rejected is None and got[2].prompt == "" and got[2].chosen.startswith("<|im_start|>unknown\n<")
    assert got[3].n_prompt_turns == 1 and got[3].rejected == ""
    assert chat.format_preferences(t.limit(0), chat.neighbours(t.limit(0))).count() == 0


def test_preferences_of_large_ids_and_long_conversations(spark):
    rows = [(2**53 + 2 * k + side, 0, "user", f"{k}{side}") for k in range(3) for side in (0, 1)]
    t = turns(spark, rows)
    got = {r.pair_id: (r.chosen_id, r.rejected_id) for r in chat.format_preferences(t, chat.neighbours(t)).collect()}
    assert got == {2**52 + k: (2**53 + 2 * k, 2**53 + 2 * k + 1) for k in range(3)}
    rng = random.Random(4)
    for n in (255, 256, 257, 1500):
        said = [(0, i, rng.choice(["user", "assistant"]), "t" * rng.randint(0, 5)) for i in range(n)]
        t = turns(spark, said)
        r = chat.format_preferences(t, chat.neighbours(t)).collect()[0]
        spans, at = [], 0
        for _, _, role, text in said:
            end = at + len(f"<|im_start|>{role}\n{text}<|im_end|>\n")
            if role == "assistant":
                spans.append(f"{end - 11 - len(text)}-{end - 1}")
            at = end
        assert r.chosen_mask == ",".join(spans) and len(r.chosen) == at


def test_licences(spark, empty):
    text = "Copyright (c) 2020 Someone\n" + licence.MIT.upper().replace("\n\n", "\n \n")
    rows = [(1, "MIT Licence\n\nCopyright 1999 X\n© 2001 Y\n" + licence.MIT), (2, text), (3, licence.MIT + " and more"), (4, None), (5, ""), (6, licence.ZLIB.replace("acknowledgment", "acknowledgement")), (6, "Released under the MIT licence"), (None, licence.ISC)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("licence", F.lit("clash"))
    got = sorted(((r.doc_id, r.licence) for r in licence.scan(docs).collect()), key=str)
    assert got == sorted([(1, "MIT"), (2, "MIT (untitled)"), (3, None), (4, None), (5, None), (6, "Zlib (untitled)"), (6, "MIT (reference)"), (None, "ISC (untitled)")], key=str)
    assert licence.scan(empty).count() == 0


def test_licences_in_wrapped_lines(spark):
    import textwrap

    def wrapped(text, width, end="\n"):
        return (end * 2).join(textwrap.fill(p, width, break_long_words=False).replace("\n", end) for p in text.split("\n\n"))

    notice = "Copyright (c) 2020, Some One\nCopyright 1999 Other Inc.\nCopyright The Authors\nCopyright holder: A. N. Other\n\n"
    rows = [(f"{name}/{width}", name, notice + wrapped(text, width)) for name, text in licence.KNOWN.items() for width in (*range(24, 100, 3), 72, 76, 80)]
    rows += [(f"{name}/crlf{end!r}", name, notice.replace("\n", end) + wrapped(text, 72, end)) for name, text in licence.KNOWN.items() for end in ("\r\n", "\r")]
    assert any("\ncopyright notice" in t for _, n, t in rows if n == "ISC")
    docs = spark.createDataFrame([(k, t) for k, _, t in rows], "doc_id string, text string")
    got = {r.doc_id: r.licence for r in licence.scan(docs).collect()}
    assert {k: n for k, n, _ in rows if got[k] != n} == {}


def test_licences_by_digest_and_sql(spark, tmp_path):
    """Longer licences are known by digest; the SQL, written for itself, finds the same in wrapped texts."""
    import os
    import textwrap

    rows = [(f"{n}/{w}", "Copyright (c) 2020, Some One\nCopyright The Authors\n\n" + "\n\n".join(textwrap.fill(p, w, break_long_words=False) for p in text.split("\n\n"))) for n, text in licence.KNOWN.items() for w in (40, 61, 62, 72, 80, 89, 100)]
    files = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    for n, f in files.items():
        if os.path.exists(path := f"/usr/share/common-licenses/{f}"):
            text = open(path, encoding="utf-8").read()
            rows += [(f"{n}/lf", text), (f"{n}/crlf", text.replace("\n", "\r\n").upper())]
    rows += [("odd/1", "copyright\n(c) 1999\nA copyright notice.\ncopyright: me\ncopyrighted work\n copyright holder: x\ncopyright holders may"), ("odd/2", None), ("odd/3", " \t")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, licence.scan(docs).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(queries.oracle_sql()["op10_licences"]).fetchall(), key=str)
    assert {k: n for k, _, n in got if not k.startswith("odd") and n != k.rpartition("/")[0]} == {}


def test_canonical_spellings_at_line_ends(spark):
    texts = ["the copyright owner pays ten per cent to fulfil it, sublicence and non-commercial", "the copyright\nholder pays ten per\r\n  cent to fulfil\nit, sub-\nlicense and non-\ncommercial", "the\ncopyright owner pays ten percent to fulfill it, sublicense and noncommercial"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(licence.canonical(F.col("t")).alias("c")).collect()
    assert {r.c for r in got} == {"the copyright holder pays ten percent to fulfill it sublicense and noncommercial"}
