"""The corpus operators against brute force, on the smallest tables and on rows of every odd kind."""

from __future__ import annotations

import collections
import hashlib
import io
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import bytewords, decontaminate, lm_scoring, ngram_join, packing, quality_rules, registry, sharding, suffix_dedup, token_store, tokens, url_filter, warc
from tallyloom.llm.common import keyed, shared_path
from tallyloom.llm.components import components
from tests.conftest import same_rows

SMALL = "/root/testdata/sf0.001"
WORDS = re.compile(rb"[^\x20\x09-\x0d]+")
LONG = " ".join(f"w{i % 977}x{i % 131}" for i in range(30_000))
PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega one two three four five six"
#: Nulls, empty, blank and very long texts, ties, repeated rows and ids, texts that overlap.
ODD = [
    (1, "", "en"), (2, None, "en"), (3, " \t\n", None), (4, PASSAGE, "en"), (5, PASSAGE, "en"), (5, PASSAGE, "en"), (5, "another text", None), (None, PASSAGE + " and more", "en"), (None, None, None),
    (6, "x " + PASSAGE + " y", "en"), (7, LONG, "de"), (8, LONG + " end", "de"), (9, "ünï ☃ " * 40, "fr"), (10, "ab" * 300, "en"), (11, "one two", "en"), (12, "One  TWO", "en"), (13, "a <|endoftext|> b  c \n d ", "en"),
]
SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """With columns named like the operators' own."""
    df = spark.createDataFrame(ODD, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in ("_key", "_text", "n", "set", "spans", "words", "start", "shard", "_words", "kept", "key", "size", "component")}).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORDS.findall(bytewords.LOWER[np.frombuffer((text or "").encode(), np.uint8)].tobytes())


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def crc_of(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


# 2 ---------------------------------------------------------------------------------------------------
def check_scores(rows, out, order):
    held = lambda i: crc_of(i) % 7 == 2
    known, trie = collections.Counter(), lm_scoring.AdaptiveTrie(order)
    for i, t in rows:
        if not held(i):
            known.update(words(t))
            known[None] += 1
            trie.train(t)
    total, distinct = sum(known.values()), len(known)
    got = collections.defaultdict(list)
    for r in out:
        got[r.doc_id].append((r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 5)))
    want = collections.defaultdict(list)
    for i, t in rows:
        w = [*words(t), None]
        base = sum(math.log10((known.get(x, 0) + 1) / (total + distinct + 1)) for x in w)
        want[i].append((held(i), len(w), sum(x in known for x in w), total, round(base, 6), round(trie.score(t), 5)))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_ppm_equals_a_plain_trie(spark, monkeypatch):
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    rows = [(i, t) for i, t, _ in ODD if t != LONG and t != LONG + " end"] + [(i, f"text number {i} of the {i % 3} kind") for i in range(20, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_scores(rows, lm_scoring.score(df, held).collect(), lm_scoring.ORDER)
    monkeypatch.setattr(lm_scoring, "SLICE_KEYS", 200)  # several slices
    check_scores(rows, lm_scoring.score(df, held).collect(), lm_scoring.ORDER)


def test_ppm_beats_shorter_contexts_on_held_out_texts(spark, documents):
    held = F.pmod("doc_id", F.lit(5)) == 0
    total = lambda order: lm_scoring.score(documents, held, order).where("held_out").agg(F.sum("score")).first()[0]
    assert total(4) > total(2) > total(0)


def test_ppm_probabilities_add_up():
    trie = lm_scoring.AdaptiveTrie(3)
    for t in ("banana bandana", "ananas"):
        trie.train(t)
    for context in ((98, 97, 110), (120, 120, 120), (lm_scoring.START,) * 3):
        assert math.isclose(sum(10 ** trie.log10_probability(context, s) for s in range(257)), 1.0, rel_tol=1e-9)


def test_ppm_empty_and_adaptive(spark, empty):
    assert lm_scoring.score(empty, F.lit(False)).count() == 0
    bits = lm_scoring.adaptive(spark.createDataFrame([(1, "ab" * 200), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert bits[0].code_length < 400 and math.isclose(bits[1].code_length, math.log2(257))


# 3 ---------------------------------------------------------------------------------------------------
def plain_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at = collections.defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    covered = {p + k for ps in at.values() if len(ps) > 1 for p in ps for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_brute_force(spark, odd, documents):
    extra = [(100, "a b c d e f a b c d e g\na\na\n\na", None), (101, "z " * 50, None), (102, "#*$ % x\n \n x", None)]
    for df in (odd.select("doc_id", "text"), documents.select("doc_id", "text"), spark.createDataFrame(extra, SCHEMA)):
        rows = quality_rules.counts(df, keep=["doc_id", "text"]).collect()
        assert len(rows) == df.count()
        for r in rows:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(r.text)


def test_rules_are_learned_and_ordered(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = quality_rules.judge(docs, labels).join(labels, "doc_id").where("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k"), F.count(F.lit(1)).alias("n")).collect()
    share = {r.quality: r.k for r in out}
    assert share[1] > 0.97 and share[0] < 0.3


def test_rules_on_odd_tables(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = quality_rules.judge(odd, none)
    assert out.count() == len(ODD) and out.where("kept = base_failed").count() == 0
    assert quality_rules.judge(empty, none).count() == 0
    twice = spark.createDataFrame([(4, 0), (4, None), (None, 1), (4, 0)], "doc_id long, quality int")
    assert quality_rules.keep(odd, twice).columns == odd.columns


# 4 ---------------------------------------------------------------------------------------------------
def test_shards(spark, documents, odd, empty):
    for df, shards in ((documents, 24), (odd, 5), (odd, 40)):
        rows = sharding.shard(df, shards).collect()
        by = collections.defaultdict(list)
        for r in rows:
            by[r.shard].append(r.slot)
        sizes = [len(by[s]) for s in range(shards)]
        assert max(sizes) - min(sizes) <= 1 and sum(sizes) == df.count()
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
        want = collections.Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in df.collect())
        assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    assert sharding.shard(empty).count() == 0


def plain_shards(rows, shards, virtual=64):
    """A walk round the ring, one row after another: {(doc_id, text): [(shard, slot), ...]}."""
    at = {}
    for s in range(shards):
        for v in range(virtual):
            p = int(hashlib.md5(f"{s}:{v}".encode()).hexdigest()[:4], 16)
            at[p] = min(s, at.get(p, s))
    points = sorted(at)
    keys = []
    for doc_id, text in rows:
        h = hashlib.md5((str(doc_id) if doc_id is not None else text or "").encode()).hexdigest()
        position = int(h[:4], 16)
        arc = next((i for i, p in enumerate(points) if p >= position), 0)
        raw = (text or "").encode()
        keys.append(((arc, h[4:16], (doc_id is not None, doc_id or 0), zlib.crc32(raw), len(raw)), doc_id, text))
    keys.sort(key=lambda k: k[0])
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    filled, out, over = [0] * shards, collections.defaultdict(list), []

    def put(doc_id, text, shard):
        out[doc_id, text].append((shard, filled[shard]))
        filled[shard] += 1
        room[shard] -= 1

    for (arc, *_), doc_id, text in keys:  # every key to its own point, while there is room
        shard = at[points[arc]]
        put(doc_id, text, shard) if room[shard] else over.append((arc, doc_id, text))
    for arc, doc_id, text in over:  # then clockwise to the next point with room
        step = next((i for i in range(1, len(points) + 1) if room[at[points[(arc + i) % len(points)]]]), None)
        put(doc_id, text, at[points[(arc + step) % len(points)]] if step else next(s for s in range(shards) if room[s]))
    return {k: sorted(v) for k, v in out.items()}


def test_shards_equal_a_walk_round_the_ring(spark, documents, odd):
    for df, shards in ((documents, 24), (odd, 5)):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        got = collections.defaultdict(list)
        texts = collections.defaultdict(list)
        for doc_id, text in rows:
            texts[str(doc_id), zlib.crc32((text or "").encode())].append((doc_id, text))
        for r in sharding.shard(df, shards).collect():
            got[str(r.doc_id), r.text_crc32].append((r.shard, r.slot))
        want = collections.defaultdict(list)
        for (doc_id, text), places in plain_shards(rows, shards).items():
            want[str(doc_id), zlib.crc32((text or "").encode())] += places
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_added_rows_move_few_others(spark, documents):
    """Ten more of 200 documents: those that stay on their own arc don't move."""
    some = documents.where("doc_id >= 10")
    before, after = ({r.doc_id: (r.shard, r.hops) for r in sharding.shard(df).collect()} for df in (some, documents))
    stay = [i for i, (s, hops) in before.items() if hops == 0 and after[i][1] == 0]
    assert all(before[i][0] == after[i][0] for i in stay) and len(stay) > 0.6 * len(before)
    assert sum(before[i][0] != after[i][0] for i in before) < 0.35 * len(before)


def test_the_ring_moves_few_keys():
    counts = {a: 10 for a in range(24 * 64)}
    points = sharding.ring(24, 64)
    segments = sharding.place(points, {a: n for a, n in counts.items() if a < len(points)}, 24)
    stays = sum(s.high - s.low for s in segments if s.hops == 0)
    assert stays > 0.8 * sum(s.high - s.low for s in segments)
    # Overflow goes to the first point clockwise whose shard still has room when it is placed.
    assert all(s.shard == points[(s.arc + s.hops) % len(points)][1] for s in segments if s.hops <= len(points))


# 5 ---------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("pack", [warc.member, bytes], ids=["members", "plain"])
def test_salvage(pack):
    rnd = random.Random(3)
    parts = [pack(warc.page_record(i, f"http://x/{i}", b"<p>%d" % i * rnd.randint(1, 2000), "00" * 20, None)) for i in range(30)]
    data = b"".join(parts)
    assert [x.headers["warc-record-id"] for x in warc.salvage(io.BytesIO(data))] == [f"<urn:page:{i}>" for i in range(30)]
    offsets = np.cumsum([0, *map(len, parts)])
    for _ in range(25):
        bad, hit = bytearray(data), set()
        for _ in range(rnd.randint(1, 4)):
            i = rnd.randrange(30)
            at = int(offsets[i]) + rnd.randrange(len(parts[i]))
            n = rnd.randint(1, min(300, int(offsets[i + 1]) - at))
            bad[at : at + n] = rnd.randbytes(n)
            hit.add(i)
        out = list(warc.salvage(io.BytesIO(bytes(bad))))
        got = {x.headers["warc-record-id"] for x in out if isinstance(x, warc.Record)}
        assert {f"<urn:page:{i}>" for i in range(30) if i not in hit} <= got
        gaps = [x for x in out if isinstance(x, warc.Gap)]
        assert all(g.length > 0 for g in gaps) and (len(got) == 30 or gaps)
    cut = list(warc.salvage(io.BytesIO(data[:-5])))
    assert len(cut) == 30 and isinstance(cut[-1], warc.Gap) and cut[-1].offset == offsets[-2]
    junk = list(warc.salvage(io.BytesIO(b"?" * 5_000_000 + data)))
    assert junk[0] == warc.Gap(0, 5_000_000, junk[0].reason) and len(junk) == 31


def test_salvage_of_members_with_several_records():
    rnd = random.Random(4)
    records = [warc.page_record(i, f"http://x/{i}", rnd.randbytes(rnd.randint(1, 200_000)), "00" * 20, None) for i in range(60)]
    names = lambda out: [x.headers["warc-record-id"] for x in out if isinstance(x, warc.Record)]
    every = [f"<urn:page:{i}>" for i in range(60)]
    whole = warc.member(b"".join(records))
    out = list(warc.salvage(io.BytesIO(b"?" * 10 + whole + warc.member(records[0]))))
    assert out[0] == warc.Gap(0, 10, out[0].reason) and names(out) == [*every, every[0]] and len(out) == 62
    assert {x.offset for x in out[1:61]} == {10} and out[61].offset == 10 + len(whole)
    zeros = [warc.page_record(i, "http://z", bytes(3 << 20), "00" * 20, None) for i in range(5)]
    assert names(warc.salvage(io.BytesIO(warc.member(b"".join(zeros))))) == every[:5]
    # A member that ends too early, and one whose data goes wrong: what ends before stays, and the next member is found.
    cut = list(warc.salvage(io.BytesIO(whole[: len(whole) // 2])))
    assert names(cut) == every[: len(cut) - 1] and len(cut) > 20 and isinstance(cut[-1], warc.Gap)
    bad = bytearray(whole)
    bad[-8:] = b"\0" * 8
    hurt = list(warc.salvage(io.BytesIO(bytes(bad) + warc.member(records[7]))))
    assert names(hurt) == [*every[:59], every[7]] and isinstance(hurt[-2], warc.Gap)
    assert hurt[-2].offset + hurt[-2].length == len(bad) == hurt[-1].offset


def test_salvage_after_a_long_gap_at_every_alignment():
    record = warc.page_record(1, "http://x", b"<p>", "00" * 20, None)
    # The first search that drops what it has searched does so at this many bytes or a few chunks more.
    for n in range(4, 8):
        for k in range(9):
            out = list(warc.salvage(io.BytesIO(b"?" * (n * warc.CHUNK - k) + record)))
            assert [type(x) for x in out] == [warc.Gap, warc.Record] and out[1].offset == n * warc.CHUNK - k


def test_foreign_records_give_rows(spark, tmp_path):
    """Digests in hex, of another kind or damaged, lengths that are no numbers, folded and Latin-1 headers: rows, never an exception."""
    sha = hashlib.sha1(b"x").hexdigest()

    def record(headers, block):
        return b"WARC/1.0\r\n" + headers + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"

    http = lambda n: b"HTTP/1.1 200 OK\r\nContent-Length: %s\r\n\r\n" % n
    revisit = lambda i, digest, n: record(b"WARC-Type: revisit\r\nWARC-Record-ID: <%d>\r\nWARC-Payload-Digest: %s\r\n" % (i, digest), http(n))
    data = b"".join([
        revisit(1, b"sha1:" + sha.upper().encode(), b"5"), revisit(2, b"md5:d41d8cd98f00b204e9800998ecf8427e", b"6"), revisit(3, b"sha1:not base 32", b"many"), revisit(4, b"", b""),
        record("WARC-Type: response\r\nWARC-Record-ID: <5>\r\nWARC-Target-URI: http://x/\u00e9\r\n".encode("latin-1"), b"abc"),
        record(b"WARC-Type: response\r\nWARC-Record-ID: <6>\r\nWARC-Target-URI: http://x/\r\n  folded\r\n\tagain\r\n", b"abcd"), b"?" * 9, revisit(7, b"sha1:" + sha.encode(), "\u0665".encode()),
    ])
    for name, content in (("plain", data), ("member", warc.member(data[: data.index(b"?" * 9)]))):
        (tmp_path / name).write_bytes(content)
    rows = warc.read(spark.createDataFrame([(str(tmp_path / n),) for n in ("plain", "member")], "path string")).collect()
    for name, some in (("plain", "1234567"), ("member", "123456")):
        got = {r.record_id: r for r in rows if r.path.endswith(name) and r.gap_length is None}
        assert sorted(got) == [f"<{i}>" for i in some]
        assert [(got[f"<{i}>"].payload_digest, got[f"<{i}>"].payload_bytes) for i in range(1, 5)] == [(sha, 5), (None, 6), (None, None), (None, None)]
        assert got["<5>"].uri == "http://x/\u00e9" and got["<6>"].uri == "http://x/ folded again" and got["<6>"].payload_bytes == 4
    assert [(r.gap_length, r.path.endswith("plain")) for r in rows if r.gap_length is not None] == [(9, True)]


def test_lost_records_are_seen(spark):
    pages = spark.createDataFrame([(i, "http://a", "y" * (200 * i)) for i in range(20)], "page_id long, url string, html string")
    manifest = warc.write(pages, shared_path(spark, "warc"), file_bytes=300)
    sound = warc.audit(manifest, warc.read(manifest)).collect()
    assert sum(r.n_read for r in sound) == 20 and all(r.n_read == r.n_records and r.n_gaps == 0 for r in sound)
    path = max((r for r in sound), key=lambda r: r.n_records).path
    name = path.removeprefix("file://")
    with open(name, "rb+") as f:
        f.seek(12)
        f.write(b"\xff" * 6)
    bad = {r.path: r for r in warc.audit(manifest, warc.read(manifest)).collect()}[path]
    assert bad.n_read < bad.n_records and bad.n_gaps == 1 and bad.gap_bytes > 0


def test_revisits_without_a_broadcast(spark, monkeypatch):
    """Payloads that many pages share, whichever way their leaders come to the pages; repeated rows and ids."""
    big = "<p>" + "y" * 2000
    rows = [(1, big), (2, big), (2, big), (2, "z" * 1500), (3, "z" * 1500), (4, None), (5, None), (None, big), (6, "short"), (7, "short")]
    pages = spark.createDataFrame(rows, "page_id long, html string").withColumn("url", F.lit("http://a"))
    found = []
    for most in (100, 0):
        monkeypatch.setattr(warc, "BROADCAST_LEADERS", most)
        read = warc.read(warc.write(pages, shared_path(spark, "warc")))
        found.append(sorted((str(r.record_id), r.record_type, str(r.refers_to), r.payload_digest) for r in read.collect()))
    assert found[0] == found[1] and len(found[0]) == len(rows)
    assert [r[1:3] for r in found[0] if r[0] == "<urn:page:1>"] == [("revisit", "<urn:page:2>")]
    assert sorted(r[1] for r in found[0] if r[0] == "<urn:page:2>") == ["response", "response", "revisit"]
    monkeypatch.setattr(warc, "MOST", (1 << 20) + 1000)
    with pytest.raises(Exception, match="larger than a record may be"):
        warc.write(pages.where("page_id = 1").withColumn("html", F.repeat(F.lit("x"), 300_000)), shared_path(spark, "warc"))


def test_archives_of_pages(spark, duck):
    big, small = "<p>" + "y" * 2000, "<p>small"
    rows = [(1, "http://a", big), (2, None, big), (3, "http://c", small), (4, "http://d", small), (5, "http://e", None), (None, "http://f", big), (6, "http://g", big + "z"), (7, "http://x\r\n", "é" * 600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    manifest = warc.write(pages, shared_path(spark, "warc"), file_bytes=200)
    assert manifest.count() >= 2 and manifest.agg(F.sum("n_records")).first()[0] == len(rows)
    got = {r.record_id: (r.record_type, r.payload_bytes, r.payload_digest, r.refers_to) for r in warc.read(manifest).collect()}
    digest = hashlib.sha1(big.encode()).hexdigest()
    assert got["<urn:page:1>"] == ("revisit", 2003, digest, "<urn:page:2>") and got["<urn:page:2>"] == ("response", 2003, digest, None) and got["<urn:page:>"] == ("response", 2003, digest, None)
    assert got["<urn:page:3>"][0] == got["<urn:page:4>"][0] == "response" and got["<urn:page:5>"][1] == 0 and got["<urn:page:7>"][1] == 1200
    assert warc.read(warc.write(pages.limit(0), shared_path(spark, "warc"))).count() == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, sf_dir, duck, name):
    same_rows(registry.queries()[name](spark, sf_dir), duck, registry.oracle_sql()[name])


# 1 ---------------------------------------------------------------------------------------------------
def test_url_lists(spark):
    day = 86400
    entries = [("l", "block", "bad.org", 10 * day, "add"), ("l", "block", "bad.org", 20 * day, "remove"), ("l", "block", "bad.org", 20 * day, "add"), ("l", "block", "bad.org", 30 * day, "remove"), ("l", "block", "bad.org", 30 * day, "remove"), ("a", "allow", "www.bad.org/ok/", 0, "add"), ("l", "block", None, 0, "add"), ("l", "block", "x.org/only", 0, "add")]
    e = spark.createDataFrame(entries, "list string, kind string, pattern string, at long, action string")
    asked = [(1, "http://bad.org/a", 9 * day), (2, "http://bad.org/a", 10 * day), (3, "HTTPS://u@WWW.Bad.org:80/x?q", 19 * day), (4, "http://bad.org", 20 * day), (5, "http://bad.org/", 25 * day), (6, "http://www.bad.org/ok/1", 15 * day), (7, "http://notbad.org/", 15 * day), (8, None, 15 * day), (9, "http://bad.org/", None), (None, "http://x.org/only", 1), (None, "http://x.org/only/", 1), (10, "nonsense", 1)]
    c = spark.createDataFrame(asked, "page_id long, url string, fetched_at long").withColumn("pattern", F.lit("clash"))
    got = {(r.page_id, r.url): r.verdict for r in url_filter.judge(c, e).collect()}
    want = ["none", "block", "block", "none", "none", "allow", "none", "none", "none", "block", "none", "none"]
    assert got == {(a[0], a[1]): w for a, w in zip(asked, want, strict=True)}
    assert url_filter.judge(c, e.limit(0)).where("verdict != 'none'").count() == 0 and url_filter.judge(c.limit(0), e).count() == 0


# 6 ---------------------------------------------------------------------------------------------------
def optimum(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for b in {r: k for k, r in enumerate(rooms) if r >= items[i]}.values():
            rooms[b] -= items[i]
            go(i + 1, rooms)
            rooms[b] += items[i]
        rooms.append(capacity - items[i])
        go(i + 1, rooms)
        rooms.pop()

    go(0, [])
    return best[0]


def test_reduction_keeps_an_optimum():
    rnd = random.Random(1)
    for _ in range(300):
        have = collections.Counter(rnd.randint(1, 20) for _ in range(rnd.randint(1, 10)))
        fixed, rest = packing.reduce(dict(have), 20)
        left = list(collections.Counter(rest).elements())
        assert sum(b.count for b in fixed) + (optimum(left, 20) if left else 0) == optimum(list(have.elements()), 20)


def test_reduction_fixes_alike_sets_together():
    """Lengths of which none completes another: the plan grows with the lengths, not with the pieces."""
    have = {s: 8000 for s in (*range(300, 341), *range(600, 641))}
    fixed, rest = packing.reduce(dict(have))
    assert sum(b.count for b in fixed) > 100_000 and len(fixed) < 4 * len(have)
    assert len(packing.plan(have)) < 20 * len(have)


def test_sequences_against_the_least_possible(spark, documents):
    """On `documents` no packing could save more than one sequence in a hundred."""
    rows = packing.pack(documents).select("length", "sequence_id").collect()
    used, ids = len({r.sequence_id for r in rows}), sum(r.length for r in rows)
    assert used <= 1.01 * -(-ids // packing.CAPACITY) + 1


def test_plan_places_every_piece():
    rnd = random.Random(2)
    have = {s: rnd.randint(0, 400) for s in range(1, 65)}
    rooms, seen = collections.defaultdict(list), collections.Counter()
    for s, low, high, each, sequence, offset in packing.plan(have, 64):
        for r in range(low, high):
            rooms[sequence + (r - low) // each].append((offset + (r - low) % each * s, s))
            seen[s] += 1
    assert seen == collections.Counter({s: n for s, n in have.items() if n})
    for v in rooms.values():
        at = 0
        for offset, s in sorted(v):
            assert offset == at
            at += s
        assert at <= 64


def plain_ids(text):
    from tokenizers import Tokenizer

    return np.array(plain_ids.tool.encode(text or "", add_special_tokens=False).ids, np.uint32) if hasattr(plain_ids, "tool") else (setattr(plain_ids, "tool", Tokenizer.from_file(tokens.default_vocabulary())), plain_ids(text))[1]


def test_encoder_equals_the_library(monkeypatch):
    texts = ["", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "\n", "a <|endoftext|> b", "x<|endoftext|>", "it's don't  x", "ñ é 　z", " 　a b", "x. y, z!? a1.\nC d;\n\nE", *(t or "" for _, t, _ in ODD)]
    for cap in (10**6, 3):
        monkeypatch.setattr(tokens, "PIECES", cap)
        tool = tokens.Encoder(tokens.default_vocabulary())
        for _ in range(2):
            assert [x.tolist() for x in tool.encode(texts)] == [plain_ids(t).tolist() for t in texts]


def test_encoder_cuts_where_the_library_does():
    """Random texts of what pre-tokens hang on: white space of all kinds, contractions, marks, letters outside ASCII, special tokens."""
    rng = np.random.default_rng(9)
    parts = [*"aabSsTtlLeErRdDmMv  \n\n\r\t\'\'\'.,!-_19\x0b\x0c\x1c\x1f\x00\x7fÉß×÷ªº²½ñÿÀ你の😀٣Ⅳж", *"\u00a0\u0085\u3000\u2003\u2028\u1680\u180e\u200b\u0301", "'s", "'ll", " '", "n't", "<|endo", "|>"]
    texts = []
    for i in range(6000):
        few = rng.choice(parts, rng.choice([3, 5, 10, 60]))
        texts.append("".join(rng.choice(few, rng.integers(0, 20))) + ("<|endoftext|> x" if i % 50 == 0 else ""))
    tool = tokens.Encoder(tokens.default_vocabulary())
    want = [plain_ids(t).tolist() for t in texts]
    assert [x.tolist() for x in tool.encode(texts)] == want == [x.tolist() for x in tool.encode(texts)]
    # Columns in chunks, with nulls.
    counts, ids = tool.flat(pa.chunked_array([pa.array([*texts[:9], None], pa.string()), pa.array([None, *texts[9:40]], pa.string())]))
    assert counts.tolist() == [len(x) for x in (*want[:9], [], [], *want[9:40])] and ids.tolist() == sum(want[:40], [])
    assert tool.flat(pa.array([None, ""], pa.string()))[0].tolist() == [0, 0]


def test_encoder_asks_the_library_once_for_a_word():
    """Whatever marks or lines stand around it: words with their marks were pieces of their own, each encoded anew."""
    tool = tokens.Encoder(tokens.default_vocabulary())
    library, asked = tool.tokenizer, []

    class Counting:
        def encode_batch_fast(self, texts, **how):
            asked.extend(texts)
            return library.encode_batch_fast(texts, **how)

    tool.tokenizer = Counting()
    words = [f"{a}{b}{c}ung" for a in "abcdefgh" for b in "aeiouéü" for c in "klmnrst"]
    texts = [" ".join(f"{w}{mark}" for w in words) for mark in (",", ".", "!", "?", ";", ":", ")", "...", "\n", "-", "%", "|")]
    assert [x.tolist() for x in tool.encode(texts)] == [plain_ids(t).tolist() for t in texts]
    assert sum(map(len, asked)) < 2 * sum(len(w) + 1 for w in words)


def test_packing(spark, odd, empty):
    rows = packing.pack(odd).collect()
    want = collections.Counter()
    for i, t, _ in ODD:
        ids = np.append(plain_ids(t), np.uint32(packing.END))
        first, at = (len(ids) - 1) % 1024 + 1, 0
        for piece, to in enumerate(range(first, len(ids) + 1, 1024)):
            want[i, piece, at, to - at, zlib.crc32(ids[at:to])] += 1
            at = to
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    rooms = collections.defaultdict(list)
    for r in rows:
        rooms[r.sequence_id].append((r.offset, r.length))
    for v in rooms.values():
        v.sort()
        assert [o for o, _ in v] == [sum(n for _, n in v[:k]) for k in range(len(v))] and sum(n for _, n in v) <= 1024
    assert packing.pack(empty).count() == 0


# 7 ---------------------------------------------------------------------------------------------------
def plain_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverted = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            inverted[x].append(i)
    shared = collections.Counter((a, b) for v in inverted.values() for k, a in enumerate(v) for b in v[k + 1 :])
    links = [0] * len(rows)
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            parent[max(find(a), find(b))] = min(find(a), find(b))
            links[a] += 1
            links[b] += 1
    return sets, [find(i) for i in range(len(rows))], links


def check_components(spark, rows):
    out = ngram_join.with_component_id(ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), links=True)).collect()
    sets, root, links = plain_components(rows)
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        least[r] = i if least.get(r) is None else least[r] if i is None else min(least[r], i)
    want = collections.Counter((i, len(s), least[r], n) for (i, _), s, r, n in zip(rows, sets, root, links, strict=True))
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in out) == want


def test_components_of_odd_rows(spark):
    check_components(spark, [(i, t) for i, t, _ in ODD if t is None or len(t) < 50_000])


@pytest.mark.parametrize("cell", [ngram_join.CELL_ITEMS, 3000])
def test_components_of_near_copies(spark, monkeypatch, cell):
    """Chains and groups whose members differ from each other by less and more than the limit, over long lists.

    Small cells cut the components into blocks by size and hash.
    """
    monkeypatch.setattr(ngram_join, "CELL_ITEMS", cell)
    rnd = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(60)] = f"v{rnd.randrange(40)}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join([f"c{k}" for k in range(i, i + 60)])) for i in range(40)]
    rows += [(400 + i, rows[i][1] + "".join(f" e{k}" for k in range(i % 14))) for i in range(0, 150, 2)]
    rows += [(300 + i, " ".join(base[:30]) + f" own {i} " + " ".join(f"u{i}_{k}" for k in range(30))) for i in range(40)]
    check_components(spark, rows)


def test_components_of_documents(spark, documents):
    check_components(spark, [(r.doc_id, r.text) for r in documents.collect()])


def test_components_of_very_long_near_copies(spark):
    """Ten near copies of a text of 200,000 words, in two groups that are not linked, and a copy of a part."""
    rnd = random.Random(6)
    base = [f"w{rnd.randrange(10**9)}" for _ in range(200_000)]
    other = base[:100_000] + [f"x{k}" for k in range(100_000)]
    rows = []
    for i in range(10):
        w = list(base if i < 6 else other)
        for _ in range(2000):
            w[rnd.randrange(len(w))] = f"v{rnd.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    rows.append((10, " ".join(base[:150_000])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.component_id, r.n_links) for r in ngram_join.with_component_id(ngram_join.join(df, links=True)).collect()}
    assert got == {i: (0, 5) if i < 6 else (6, 3) if i < 10 else (10, 0) for i in range(11)}


def test_links_of_a_cell():
    """Derived answers against plain intersections: sets near to their leader, far from it, and of one shingle."""
    rnd = np.random.default_rng(8)
    for trial in range(60):
        base = np.arange(rnd.integers(1, 80), dtype=np.int64)
        sets = []
        for _ in range(rnd.integers(1, 40)):
            kept = base[rnd.random(len(base)) > rnd.choice([0.02, 0.1, 0.3])]
            sets.append(np.unique(np.concatenate((kept, rnd.integers(0, 200, rnd.integers(1, 12))))))
        side = np.sort(rnd.integers(0, 2, len(sets))) if trial % 2 else np.zeros(len(sets), np.int64)
        weight = rnd.integers(1, 5, len(sets))
        want = [0] * len(sets)
        for i in range(len(sets)):
            for j in range(len(sets)):
                c = len(np.intersect1d(sets[i], sets[j]))
                met = i != j if not side.any() else side[i] != side[j]
                if met and 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c):
                    want[i] += int(weight[j])
        got = ngram_join._cell_links(np.concatenate(sets), np.array([len(s) for s in sets]), side, weight)
        assert got.tolist() == want


def test_join_of_nothing_and_stage(spark, odd, empty):
    assert ngram_join.with_component_id(ngram_join.join(empty, links=True)).count() == 0
    kept = ngram_join.representatives(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 5").count() == 1 and kept.where("doc_id = 12").count() == 0


def test_ids_that_are_texts(spark, odd):
    """Ids of any type that sorts: the same classes, cuts and pieces as with integers of the same order."""
    named = odd.withColumn("doc_id", F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 4, "0")))
    number = lambda i: None if i is None else int(i[1:])
    by_id = lambda df, of: sorted(((of(r[0]), *r[1:]) for r in df.collect()), key=str)
    same = lambda i: i
    columns = ["doc_id", "n_shingles", "component_id", "n_links"]
    got, want = (ngram_join.with_component_id(ngram_join.join(d, links=True)).select(*columns) for d in (named, odd))
    assert sorted(((number(r[0]), r[1], number(r[2]), r[3]) for r in got.collect()), key=str) == by_id(want, same)
    assert by_id(suffix_dedup.dedup(named), number) == by_id(suffix_dedup.dedup(odd), same)
    piece = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert by_id(packing.pack(named).select(*piece), number) == by_id(packing.pack(odd).select(*piece), same)
    items = spark.createDataFrame([("a", PASSAGE)], "item_id string, text string")
    hit = ["doc_id", "start", "similarity"]
    assert by_id(decontaminate.search(named, items).select(*hit), number) == by_id(decontaminate.search(odd, items.withColumn("item_id", F.lit(1))).select(*hit), same) != []


def test_large_star_small_star(spark):
    rnd = random.Random(7)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(120)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.v: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


# 8 ---------------------------------------------------------------------------------------------------
def plain_hits(docs, items):
    of = lambda t: (lambda w: [tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else [])([x for x in re.split(r"[\x20\x09-\x0d]+", (t or "").lower()) if x])
    out = {}
    for i, t in docs:
        s = of(t)
        for j, b in items:
            want = collections.Counter(of(b))
            n, best = sum(want.values()), 0
            for p in range(max(1, len(s) - n + 1)) if n else ():
                window = collections.Counter(s[p : p + n])
                best = max(best, sum((window & want).values()) / max(1, sum((window | want).values())))
            if best >= 0.8:
                out[i, j] = best
    return out


def test_decontamination_finds_all_windows(spark, documents):
    rnd = random.Random(9)
    items = [(1, PASSAGE), (2, " ".join(f"q{k}" for k in range(50))), (3, "two words"), (4, ""), (5, None), (6, "k " * 20)]
    docs = [(i, t) for i, t, _ in ODD if i not in (5, None) and (t is None or len(t) < 50_000)]
    for i in range(100, 160):
        w = rnd.choice([PASSAGE.split(), [f"q{k}" for k in range(50)], ["k"] * 20])[:]
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randrange(len(w))
            rnd.choice([lambda: w.__setitem__(at, "changed"), lambda: w.insert(at, "put"), lambda: w.pop(at)])()
        docs.append((i, " ".join([*(f"f{k}" for k in range(rnd.randint(0, 30))), *w, *(f"g{k}" for k in range(rnd.randint(0, 30)))]).upper()))
    found = decontaminate.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.similarity for r in found.collect()}
    want = plain_hits(docs, items)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)


def test_decontamination_finds_windows_in_another_order(spark):
    """Halves swapped; and edits at both ends with insertions, so that no shared shingle stands in line with its place."""
    rnd = random.Random(10)
    items = [(n, " ".join(f"v{n}x{k}" for k in range(n))) for n in (50, 100, 200)]
    docs = []
    for n, text in items:
        w = text.split()
        swapped = w[n // 2 :] + w[: n // 2]
        edited = ["new", *w[1 : n // 2], "put", *w[n // 2 : -1], "new"]
        for k, x in enumerate((swapped, edited, swapped[: n // 4] + ["put"] + swapped[n // 4 :], w[n // 4 :] + w[: n // 4])):
            docs.append((10 * n + k, " ".join([*(f"f{j}" for j in range(rnd.randint(0, 30))), *x, *(f"g{j}" for j in range(rnd.randint(0, 30)))])))
    found = decontaminate.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.similarity for r in found.collect()}
    want = plain_hits(docs, items)
    assert {(10 * n, n) for n, _ in items[1:]} <= want.keys()
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)


def test_window_starts(spark):
    rnd = random.Random(12)
    rows = []
    for _ in range(300):
        m, n = rnd.randint(1, 30), rnd.randint(1, 12)
        rows.append((sorted(rnd.sample(range(m), rnd.randint(1, m))), m, n))
    df = spark.createDataFrame(rows, "hits array<int>, m int, n int")
    for similarity in (0.3, 0.8, 1.0):
        got = df.select("hits", "m", "n", decontaminate.window_starts(F.col("hits"), F.col("m"), F.col("n"), similarity).alias("starts")).collect()
        for r in got:
            w = min(r.m, r.n)
            of = lambda p: sum(p <= h < p + w for h in r.hits)  # noqa: B023, E731
            assert r.starts == [p for p in range(r.m - w + 1) if of(p) and of(p) / (w + r.n - of(p)) >= similarity]


def test_hamming_blocks_meet(spark):
    rnd = random.Random(11)
    pairs = []
    for _ in range(200):
        a = rnd.getrandbits(63)
        b = a
        for k in rnd.sample(range(63), decontaminate.RADIUS):
            b ^= 1 << k
        pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a long, b long")
    assert df.where(F.arrays_overlap(decontaminate.blocks(F.col("a")), decontaminate.blocks(F.col("b")))).count() == 200


def test_decontamination_stage(spark, odd, empty):
    items = spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (None, "another text")], "item_id long, text string")
    kept = decontaminate.clean(odd, items)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {1, 2, 3, None, 7, 8, 9, 10, 11, 12, 13} and kept.count() == 11
    assert decontaminate.clean(odd, items.limit(0)).count() == len(ODD) and decontaminate.clean(empty, items).count() == 0


# 9 ---------------------------------------------------------------------------------------------------
def test_repair_round_trip():
    rng = np.random.default_rng(0)
    for n, v in ((0, 5), (1, 5), (2, 1), (3000, 2), (20_000, 40), (5000, 1), (9000, 80_000)):
        ids = rng.integers(0, v, n).astype(np.uint32)
        cuts = np.sort(rng.integers(0, n + 1, 6))
        counts = np.diff(np.concatenate(([0], cuts, [n])))
        s = token_store.parse_shard(b"".join(token_store.pack_shard(np.arange(7), counts, ids)))
        pool = token_store._pool(s)
        assert (token_store.expand(s, s.symbols, pool) == ids).all()
        at = np.concatenate(([0], np.cumsum(counts)))
        assert all((token_store.document(s, i, pool) == ids[at[i] : at[i + 1]]).all() for i in range(7))
        if v <= 40 and n >= 3000:
            assert len(s.symbols) < n and len(s.rules)


def test_repair_leaves_no_frequent_pair():
    """Copies of one text shrink to a few symbols; slopes, runs and random ids end with no pair that occurs twice."""
    rng = np.random.default_rng(1)
    copies = np.tile(rng.integers(0, 50_000, 1000), 2000)
    slopes = np.concatenate([np.arange(k) for k in range(1, 200)])
    runs = np.repeat(rng.integers(0, 9, 4000), rng.integers(1, 9, 4000))
    for ids in (copies, slopes, runs, rng.integers(0, 300, 200_000), np.zeros(1001, np.int64), np.tile(np.arange(70_000), 2)):
        s = token_store.parse_shard(b"".join(token_store.pack_shard(np.arange(1), np.array([len(ids)]), ids.astype(np.uint32))))
        assert (token_store.document(s, 0) == ids).all()
        if ids is copies:
            assert len(s.symbols) + 2 * len(s.rules) < 4000
        seen, last = collections.Counter(), None
        for pair in zip(s.symbols.tolist(), s.symbols[1:].tolist()):
            last = None if pair == last else pair
            seen[pair] += last is not None
        assert all(n < 2 for n in seen.values())


def test_random_access_follows_the_rules_of_one_document(monkeypatch):
    """Each document without laying out the others: no more ids are touched than the document and the paths to it."""
    rng = np.random.default_rng(21)
    phrase = rng.integers(0, 50, 400)
    docs = [np.concatenate([phrase[: rng.integers(0, 400)], rng.integers(0, 60, rng.integers(0, 30)), phrase]) for _ in range(60)] + [np.zeros(0, np.int64)]
    ids = np.concatenate(docs).astype(np.uint32)
    counts = np.array([len(d) for d in docs])
    s = token_store.parse_shard(b"".join(token_store.pack_shard(np.arange(len(docs)), counts, ids)))
    monkeypatch.setattr(token_store, "_pool", None)
    assert s.lengths.max() > 100
    for i, d in enumerate(docs):
        assert (token_store.document(s, i) == d).all() and len(token_store.document(s, i)) == len(d)


def test_token_store(spark, odd, empty):
    docs = keyed(odd.select("doc_id", "text"))
    manifest = token_store.write(docs, shared_path(spark, "tokens"), shard_ids=3000).cache()
    got = {r._key: (r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_store.read(manifest).collect()}
    at, want = 0, {}
    for r in docs.orderBy("_key").collect():
        ids = np.append(plain_ids(r.text), np.uint32(token_store.END))
        want[r._key] = (r.doc_id, at, len(ids), zlib.crc32(ids))
        at += len(ids)
    assert got == want and manifest.count() > 2
    assert token_store.read(token_store.write(keyed(empty.select("doc_id", "text")), shared_path(spark, "tokens"))).count() == 0


# 10 --------------------------------------------------------------------------------------------------
def plain_removed(rows, length=100):
    seen, out = set(), []
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, rows[k][1] is not None, rows[k][1] or ""))
    for k in order:
        x = (rows[k][1] or "").encode()
        gone, end = bytearray(len(x)), 0
        for p in range(len(x) - length + 1):
            w = x[p : p + length]
            if w in seen:
                gone[max(p, end) : p + length] = b"\1" * (p + length - max(p, end))
                end = p + length
            else:
                seen.add(w)
        kept = bytes(c for c, g in zip(x, gone, strict=True) if not g)
        out.append((rows[k][0], len(x), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return collections.Counter(out)


def check_removed(spark, rows):
    out = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == plain_removed(rows)


def test_removal_of_odd_rows(spark):
    check_removed(spark, [(i, t) for i, t, _ in ODD])


def test_removal_of_passages(spark):
    rnd = random.Random(13)
    noise = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passages = [noise(rnd.randint(90, 400)) for _ in range(8)]
    rows = [(i, "".join(rnd.choice([noise(rnd.randint(0, 60)), rnd.choice(passages), rnd.choice(passages)[: rnd.randint(50, 300)]]) for _ in range(rnd.randint(0, 8)))) for i in range(120)]
    check_removed(spark, rows)


def test_removal_of_documents(spark, documents):
    check_removed(spark, [(r.doc_id, r.text) for r in documents.collect()])


def test_lpf_arrays():
    rnd = random.Random(17)
    for _ in range(40):
        data = bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 40)))
        n = len(data)
        want = [max((m for m in range(n - i, 0, -1) for j in range(i) if data[j : j + m] == data[i : i + m]), default=0) for i in range(n)]
        assert suffix_dedup.longest_previous_factors(data) == want


def test_factors_of_sorted_buckets():
    """LPF and sources to a depth, by previous and next smaller positions, against the plain arrays."""
    rnd = random.Random(18)
    for trial in range(60):
        length = rnd.choice([3, 8, 13, 20, 40, 100])
        data = bytes(rnd.choice(b"ab" if trial % 2 else b"abcdefgh") for _ in range(rnd.randint(length, 300)))
        if trial % 3 == 0:
            data = data[: len(data) // 3] * 3 + data[:length]
        position = np.arange(len(data) - length + 1)
        lpf, source = suffix_dedup.previous_factors(np.frombuffer(data, np.uint8), position, np.zeros(len(position), np.int64), length)
        assert lpf.tolist() == [min(x, length) for x in suffix_dedup.longest_previous_factors(data)[: len(position)]]
        assert all(j == -1 if m == 0 else j < i and data[j : j + m] == data[i : i + m] for i, (m, j) in enumerate(zip(lpf.tolist(), source.tolist())))


def test_removal_with_hot_grams(spark, monkeypatch):
    """A line that all documents hold, alone and with its neighbours, whose gram is split; it goes only with 100 bytes around it."""
    monkeypatch.setattr(suffix_dedup, "HOT_LEAST", 5)
    rnd = random.Random(19)
    noise = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    rows = []
    for width in (30, 60, 90, 97, 99):
        line, other = noise(width), noise(20)
        rows += [(len(rows) + k, noise(rnd.randint(0, 90)) + rnd.choice(["", other]) + line + rnd.choice(["", other, noise(40)])) for k in range(40)]
    check_removed(spark, rows)
    raw = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    plain = suffix_dedup._segments(raw, np.array([0, len(raw)]), 100)
    hot = suffix_dedup._segments(raw, np.array([0, len(raw)]), 100, np.unique(plain[0]))
    assert len(hot[0]) > 5 * len(plain[0])
    starts = lambda x: sorted(p for a, n in zip(x[3].tolist(), x[4].tolist()) for p in range(a, a + n - 99))
    assert starts(hot) == starts(plain) == list(range(len(raw) - 99))


def test_a_footer_of_all_texts(spark, monkeypatch):
    """Spans of one passage and segments of one gram are dealt over tasks; what goes equals brute force."""
    rng = random.Random(12)
    footer = " ".join(f"legal{i}" for i in range(60))[:500]
    rows = [(i, " ".join(f"w{rng.randrange(10**9)}" for _ in range(12)) + footer) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select(F.col("doc_id").alias("_key"), F.col("text").alias("_text")).repartition(4)
    hot = suffix_dedup._hot_keys(docs, 100)
    fine = suffix_dedup._hot_keys(docs, 100, hot)
    assert len(hot.value) and len(fine.value)  # what stands before the footer makes its first segments others in each text
    for held, most in ((1_000_000, 0.05), (2_000, 0.1)):
        monkeypatch.setattr(suffix_dedup, "HELD", held)
        cut = docs.mapInArrow(suffix_dedup._cut_up(100, hot, fine), suffix_dedup._SCHEMA)
        sizes = [r["count"] for r in suffix_dedup._dealt(cut, 211).groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) > 3000 and max(sizes) < most * sum(sizes)
    monkeypatch.setattr(suffix_dedup, "HOT_LEAST", 20)
    check_removed(spark, rows[:150] + [(9000 + i, footer[i:] + f" tail {i}") for i in range(60)])


def test_cut_documents(spark, odd, empty):
    cut = suffix_dedup.cut_documents(odd)
    assert cut.columns == odd.columns and cut.count() == len(ODD)
    assert suffix_dedup.cut_documents(empty).count() == 0 and suffix_dedup.dedup(empty).count() == 0


# The pipeline ----------------------------------------------------------------------------------------
def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kinds = docs.schema
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = stage(spark, docs, SMALL).cache()
        assert [(f.name, f.dataType) for f in docs.schema] == [(f.name, f.dataType) for f in kinds]
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "near_duplicates":
            _, root, _ = plain_components(before)
            assert after.keys() == {before[r][0] for r in set(root)}
        elif name == "repeated_passages":
            want = plain_removed(before)
            assert after.keys() == {i for i, _ in before} and sum(len(t.encode()) for t in after.values()) <= sum(k[1] - k[2] for k in want.elements())
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
            assert after.keys() == {i for i, _ in before} - {i for i, _ in plain_hits(before, items)}
        else:
            assert after.keys() < {i for i, _ in before}
    final = corpus_pipeline.run(spark, SMALL)
    total = sum(len(plain_ids(t)) + 1 for t in after.values())
    assert final.agg(F.sum("length")).first()[0] == total and {r.doc_id for r in final.collect()} == after.keys()


def test_nothing_else_needs_this_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    top = Path(__file__).resolve().parents[2]
    shutil.copytree(top / "tallyloom", tmp_path / "tallyloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 90 and not any(k.startswith('op1_') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), **{k: v for k, v in __import__("os").environ.items() if k in ("JAVA_HOME", "HOME", "PATH")}}, check=True, capture_output=True, timeout=120)
