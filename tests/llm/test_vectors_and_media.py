"""Whitening, clustering and media columns against brute force, on the smallest tables and on odd rows."""

from __future__ import annotations

import hashlib
import math
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import bytewords, centroids, jpeg, media, whitening
from tallyloom.llm.vectors import MOST

SMALL = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>"
NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def embeddings(spark):
    return spark.read.parquet(f"{SMALL}/embeddings.parquet").cache()


def odd_vectors(spark, dims=64):
    """Good vectors, repeated rows and vectors, a null id, and rows that leave; with columns named like the operators' own."""
    rng = np.random.default_rng(5)
    good = [(i, rng.normal(0, 0.2, dims).tolist()) for i in range(90)]
    same = [(1000 + i, good[0][1]) for i in range(60)]
    bad = [(200, None), (201, []), (202, [None] * dims), (203, [NAN] + [0.0] * (dims - 1)), (204, [INF] * dims), (205, [1.0] * (dims - 1)), (206, [1.0] * (dims - 1) + [-INF])]
    far = [(300, [1e30] * dims), (301, [-1e30] * dims)]
    rows = good + same + bad + [good[3], good[3], (None, good[4][1]), (7, good[9][1])]
    clash = {c: F.lit("clash") for c in ("x", "n", "component", "cluster", "_each", "x0", "small", "label")}
    return spark.createDataFrame(rows, SCHEMA).withColumns(clash), spark.createDataFrame(rows + far, SCHEMA)


def integer_rows(df, dims=None):
    out = []
    for r in df.select("vec_id", "embedding").collect():
        v = r.embedding
        if v and all(c is not None and math.isfinite(c) for c in v) and len(v) == (dims or len(v)):
            out.append((r.vec_id, tuple(max(-MOST, min(MOST, math.floor(256 * c))) for c in v)))
    return out


# Whitening ----------------------------------------------------------------------------------------
def check_whitening(df, k=4, exact=True):
    got = whitening.whiten(df, wide=True).collect()
    rows = integer_rows(df)
    dims = max(set(len(x) for _, x in rows), key=lambda d: (sum(len(x) == d for _, x in rows), d))
    rows = [(i, x) for i, x in rows if len(x) == dims]
    distinct = np.array(sorted({x for _, x in rows}))
    n, sums = len(distinct), [sum(map(int, c)) for c in distinct.T]
    centred = distinct - distinct.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == len(rows) * min(k, dims)
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-4
    want = sorted((str(i), sum((n * int(c) - s) ** 2 for c, s in zip(x, sums, strict=True))) for i, x in rows)
    for c in range(min(k, dims)):
        mine = [r for r in got if r.component == c + 1]
        assert sorted((str(r.vec_id), int(r.deviation)) for r in mine) == want
        if not exact:
            continue
        if values[c] <= 1e-12 * values.sum():
            assert all(r.whitened is None and r.explained == 0 for r in mine)
            continue
        assert all(abs(r.explained - values[c] / values.sum()) < 1e-9 for r in mine)
        plain = {}
        for i, x in rows:
            plain.setdefault(str(i), []).append(float((np.array(x) - distinct.mean(axis=0)) @ vectors[:, c]) / math.sqrt(values[c]))
        found = {}
        for r in mine:
            found.setdefault(str(r.vec_id), []).append(r.whitened)
        sign = next(np.sign(plain[i][0]) * np.sign(found[i][0]) for i in plain if len(plain[i]) == 1 and abs(plain[i][0]) > 0.1)
        for i in plain:
            assert np.allclose(sorted(v * sign for v in plain[i]), sorted(found[i]), rtol=1e-6, atol=1e-6)


def test_whitening_of_embeddings(embeddings):
    check_whitening(embeddings)


def test_whitening_of_odd_rows(spark):
    clash, far = odd_vectors(spark, 8)
    check_whitening(clash)
    check_whitening(far, exact=False)  # sums of products that a long can't hold: doubles of very different size


def test_whitening_without_variance(spark):
    flat = [(i, [float(i % 3), 1.0, 2.0 * (i % 3)]) for i in range(9)]
    check_whitening(spark.createDataFrame(flat, SCHEMA))
    check_whitening(spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], SCHEMA))
    out = whitening.whiten(spark.createDataFrame([(1, [0.5])], SCHEMA)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.identity_error) for r in out] == [(1, 1, 0, None, 0.0)]


def test_whitening_of_nothing(spark):
    for rows in ([], [(1, None), (2, [NAN])]):
        out = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and not out.collect()


def test_columns_in_several_aggregations(embeddings, monkeypatch):
    rows = lambda df: {r[:-1] for r in whitening.whiten(df).collect()}  # identity_error is measured in doubles
    one = rows(embeddings)
    monkeypatch.setattr(whitening, "COLUMNS", 17)
    assert rows(embeddings.repartition(5)) == one


# Clustering ---------------------------------------------------------------------------------------
def plain_clusters(rows, k=40, rounds=5, seed="2"):
    marks = sorted((hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest(), x) for i, x in rows)[:k]
    middle = [list(x) for _, x in marks]
    square = lambda x, c: sum((int(a) - b) ** 2 for a, b in zip(x, c, strict=True))
    assign = lambda: [min((square(x, c), j) for j, c in enumerate(middle)) for _, x in rows]
    for _ in range(rounds):
        at = assign()
        for j in range(len(middle)):
            own = [x for (_, x), (_, c) in zip(rows, at, strict=True) if c == j]
            if own:
                middle[j] = [sum(map(int, col)) // len(own) for col in zip(*own, strict=True)]
    at = assign()
    spread = [sum(d for d, c in at if c == j) for j in range(len(middle))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    held = lambda v: v if v < 2**63 else None
    return sorted((str(i), c, d, held(spread[c]), held(sum(spread)), digest[c]) for (i, _), (d, c) in zip(rows, at, strict=True))


def check_clusters(df, **more):
    got = sorted((str(r.vec_id), *r[1:]) for r in centroids.cluster(df, **more).collect())
    assert got == plain_clusters(integer_rows(df, 64), more.get("k", 40), more.get("rounds", 5))


def test_clusters_of_embeddings(embeddings):
    tried = []
    got = sorted((str(r.vec_id), *r[1:]) for r in centroids.cluster(embeddings, counts=tried).collect())
    assert got == plain_clusters(integer_rows(embeddings, 64))
    assert len(tried) == 5 and all(n == 500 and exact < 40 * n for n, exact in tried)


def test_clusters_of_odd_rows(spark):
    clash, far = odd_vectors(spark)
    check_clusters(clash)
    check_clusters(far, k=7, rounds=2)  # distances near the largest that a long holds
    check_clusters(clash.limit(0))
    check_clusters(spark.createDataFrame([(1, [0.5] * 64), (2, [0.5] * 64), (3, [0.25] * 64)], SCHEMA))


def test_screening_keeps_the_nearest():
    """Clustered vectors: most centroids are pruned, ties go to the smaller number, and nothing is lost."""
    rng = np.random.default_rng(11)
    middle = rng.integers(-200, 200, (40, 64))
    x = middle[rng.integers(0, 40, 3000)] + rng.integers(-9, 10, (3000, 64))
    middle[7] = middle[3]
    for shift in (0, 1 << 24):  # beyond what doubles hold, products are summed as integers
        y, c = x + shift, middle + shift
        cluster, distance, tried = centroids.nearest(y, centroids.compressed(y), c)
        plain = ((y[:, None, :] - c[None]) ** 2).sum(axis=2)
        assert (cluster == plain.argmin(axis=1)).all() and (distance == plain.min(axis=1)).all()
        bound = centroids.lower_bounds(centroids.compressed(y), (y * y).sum(axis=1), c)
        assert (bound <= plain).all()
        assert shift or tried < 3 * len(x)


# Media --------------------------------------------------------------------------------------------
class Bits:
    """A scan's bits one by one, and its restarts."""

    def __init__(self, data):
        self.parts, part, i = [], bytearray(), 0
        while i < len(data):
            if data[i] == 255 and data[i + 1] == 0:
                part.append(255)
                i += 2
            elif data[i] == 255:
                self.parts.append(part)
                part = bytearray()
                i += 2
            else:
                part.append(data[i])
                i += 1
        self.parts.append(part)
        self.restart()

    def restart(self):
        self.now, self.at = self.parts.pop(0), 0

    def bit(self):
        b = self.now[self.at >> 3] >> (7 - self.at % 8) & 1
        self.at += 1
        return b

    def number(self, n):
        v = 0
        for _ in range(n):
            v = v << 1 | self.bit()
        return v

    def value(self, n):
        v = self.number(n)
        return v if n == 0 or v >> (n - 1) else v - (1 << n) + 1

    def symbol(self, code):
        v = n = 0
        while True:
            v, n = v << 1 | self.bit(), n + 1
            if (v, n) in code:
                return code[v, n]


def plain_decode(file):
    """Coefficients by blocks in component order, one bit after another, as the standard tells it."""
    h = jpeg.header(file)
    n = h.wide * h.high
    blocks = [[0] * 64 for _ in range(6 * n)]
    for scan, table, restart, begin, end in h.scans:
        code = {(c, size): s for c, size, s in jpeg._canonical(table)}
        bits = Bits(file[begin:end])
        if len(scan.components) == 3:
            units = []
            for j in range(n):
                y = (j // h.wide) * 4 * h.wide + j % h.wide * 2
                units.append([(y, 0), (y + 1, 0), (y + 2 * h.wide, 0), (y + 2 * h.wide + 1, 0), (4 * n + j, 1), (5 * n + j, 2)])
        else:
            c = scan.components[0]
            units = [[((0 if c == 0 else (3 + c) * n) + j, c)] for j in range(4 * n if c == 0 else n)]
        before, ended = [0, 0, 0], 0
        for u, unit in enumerate(units):
            if restart and u and u % restart == 0:
                bits.restart()
                before, ended = [0, 0, 0], 0
            for b, c in unit:
                block = blocks[b]
                if scan.first == 0:
                    if scan.high:
                        block[0] |= bits.bit() << scan.low
                    else:
                        before[c] += bits.value(bits.symbol(code))
                        block[0] = before[c] << scan.low
                    continue
                k, one = scan.first, 1 << scan.low

                def mend(k):
                    if bits.bit():
                        block[k] += one if block[k] > 0 else -one

                while k <= scan.last and not ended:
                    run, size = divmod(bits.symbol(code), 16)
                    if size == 0 and run < 15:
                        ended = (1 << run) + bits.number(run)
                        break
                    if scan.high == 0:
                        k += run
                        if size:
                            block[k] = bits.value(size) << scan.low
                        k += 1
                        continue
                    new = (one if bits.bit() else -one) if size else 0
                    while k <= scan.last:
                        if block[k]:
                            mend(k)
                        elif run:
                            run -= 1
                        else:
                            block[k] = new
                            break
                        k += 1
                    k += 1
                if ended:
                    if scan.high:
                        for j in range(k, scan.last + 1):
                            if block[j]:
                                mend(j)
                    ended -= 1
    return np.array(blocks, np.int16)


def made(sizes, sparse=0.0, seed=3):
    """Payload bytes whose coefficients are often 0, 1 or -1, so that runs and late coefficients occur."""
    rng = np.random.default_rng(seed)
    total = sum(sizes)
    raw = rng.integers(0, 256, total).astype(np.uint8)
    few = media.BYTE[np.array([0, 1, -1, 2, -2, 3])[np.minimum(rng.geometric(0.7, total) - 1, 5)] + 128]
    return np.where(rng.random(total) < sparse, few, raw), np.concatenate(([0], np.cumsum(sizes)))


@pytest.mark.parametrize("sparse", [0.0, 0.5, 0.95, 1.0])
def test_files_equal_a_plain_decoder(sparse):
    raw, offsets = made([0, 1, 575, 576, 577, 3000, 20_000], sparse)
    data, size = media.payloads(raw, offsets)
    files = media.to_files(data, size)
    coefs, places, _ = jpeg.decode(files)
    for d, f in enumerate(files):
        assert (plain_decode(f) == coefs[places.base[d] : places.base[d + 1]]).all()
    found, _, _ = media.from_files(files)
    ends = np.cumsum(size)
    assert [f == data[e - s : e].tobytes() for f, s, e in zip(found, size, ends, strict=True)] == [True] * len(files)


def test_wide_images_take_several_rows(monkeypatch):
    monkeypatch.setattr(jpeg, "ROW", 3)
    monkeypatch.setattr(jpeg, "AT_ONCE", 8)
    raw, offsets = made([100, 9000], 0.7)
    data, size = media.payloads(raw, offsets)
    files = media.to_files(data, size)
    coefs, places, _ = jpeg.decode(files)
    assert places.high.tolist() == [1, 8]
    for d, f in enumerate(files):
        assert (plain_decode(f) == coefs[places.base[d] : places.base[d + 1]]).all()


def with_runs_of_ended_blocks(coefs, wide):
    """A file of one row without restarts whose blocks of zeros are written as runs, bit by bit."""
    out = [jpeg._head(wide, 1, b"x").replace(b"\xff\xdd\x00\x04" + struct.pack(">H", jpeg.RESTART), b"")]
    places = jpeg.Places(np.array([wide]), np.array([1]))
    for scan in jpeg.SCRIPT:
        order, _, _ = places.order(scan.components)
        c = coefs[order].astype(int)
        table = jpeg.DC if scan.first == 0 else jpeg.AC_FIRST if scan.high == 0 else jpeg.AC_LATER
        code = {s: format(v, f"0{n}b") for v, n, s in jpeg._canonical(table)}
        text, ended, held, before = "", 0, "", [0, 0, 0]

        def flush(ended, held):
            if not ended:
                return held
            r = ended.bit_length() - 1
            return code[r << 4] + (format(ended - (1 << r), f"0{r}b") if r else "") + held

        def value(v):
            n = abs(v).bit_length()
            return format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

        for b, block in enumerate(c):
            if scan.first == 0:
                if scan.high:
                    text += str(block[0] >> scan.low & 1)
                else:
                    which = int(jpeg.PATTERN[b % 6])
                    v = int(block[0]) >> scan.low
                    d, before[which] = v - before[which], v
                    text += code[abs(d).bit_length()] + value(d)
                continue
            size = np.abs(block) >> scan.low
            band = range(scan.first, scan.last + 1)
            new = [k for k in band if size[k] and (scan.high == 0 or size[k] == 1)]
            run, bits = 0, ""
            for k in band:
                if new and k <= new[-1]:
                    if ended:
                        text, ended, held = text + flush(ended, held), 0, ""
                    if size[k] > 1 and scan.high:
                        bits += str(size[k] & 1)
                    elif size[k]:
                        v = int(size[k]) if block[k] > 0 else -int(size[k])
                        text += code[run << 4 | (abs(v).bit_length())] + (value(v) if scan.high == 0 else str(int(v > 0))) + bits
                        run, bits = 0, ""
                    else:
                        run += 1
                        if run == 16:
                            text, run, bits = text + code[0xF0] + bits, 0, ""
                elif scan.high and size[k] > 1:
                    bits += str(size[k] & 1)
            if not new or new[-1] < scan.last:
                ended, held = ended + 1, held + bits
        text += flush(ended, held)
        text += "1" * (-len(text) % 8)
        data = bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8)).replace(b"\xff", b"\xff\x00")
        out += [jpeg._scan_head(scan), data]
    return b"".join(out) + b"\xff\xd9"


def test_runs_of_ended_blocks():
    rng = np.random.default_rng(9)
    coefs = np.where(rng.random((60, 64)) < 0.06, rng.integers(-6, 7, (60, 64)), 0).astype(np.int16)
    coefs[rng.random(60) < 0.6, 1:] = 0
    mixed = with_runs_of_ended_blocks(coefs, 10)
    other = media.to_files(*media.payloads(*made([700], 0.5)))[0]
    got, places, _ = jpeg.decode([other, mixed, other])
    assert (plain_decode(mixed) == coefs).all()
    assert (got[places.base[1] : places.base[2]] == coefs).all()
    assert (got[: places.base[1]] == plain_decode(other)).all() and (got[places.base[2] :] == plain_decode(other)).all()


def test_tensors_equal_a_plain_transform():
    raw, offsets = made([2000], 0.8)
    file = media.to_files(*media.payloads(raw, offsets))[0]
    coefs, places, heads = jpeg.decode([file])
    wide, n = heads[0].wide, heads[0].wide
    got = jpeg.tensor(jpeg.tensors(coefs, places, heads), wide, 1).astype(float)

    def plain(block):
        grid = np.zeros((8, 8))
        for v, (r, c) in zip(block, jpeg.ZIGZAG, strict=True):
            grid[r, c] = v
        out = np.zeros((8, 8))
        for y in range(8):
            for x in range(8):
                for v in range(8):
                    for u in range(8):
                        cu, cv = (math.sqrt(0.5) if t == 0 else 1 for t in (u, v))
                        out[y, x] += cu * cv / 4 * grid[v, u] * math.cos((2 * x + 1) * u * math.pi / 16) * math.cos((2 * y + 1) * v * math.pi / 16)
        return out

    y = np.zeros((16, 16 * wide))
    cb, cr = np.zeros((8, 8 * wide)), np.zeros((8, 8 * wide))
    for j in range(2 * wide):
        y[:8, 8 * j : 8 * j + 8], y[8:, 8 * j : 8 * j + 8] = plain(coefs[j]), plain(coefs[2 * wide + j])
    for j in range(wide):
        cb[:, 8 * j : 8 * j + 8], cr[:, 8 * j : 8 * j + 8] = plain(coefs[4 * n + j]), plain(coefs[5 * n + j])
    y = np.clip(np.rint(y) + 128, 0, 255)
    cb, cr = (np.clip(np.rint(c), -128, 127).repeat(2, axis=0).repeat(2, axis=1) for c in (cb, cr))
    want = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
    off = np.abs(got - np.clip(want, 0, 255))  # samples that end in .5 may round either way
    assert off.max() < 3 and (off > 1.01).mean() < 0.01


def test_zigzag_and_damage():
    assert [8 * r + c for r, c in jpeg.ZIGZAG][:15] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4]
    assert sorted(media.VALUE.tolist()) == list(range(-128, 128))
    file = media.to_files(*media.payloads(*made([900])))[0]
    for bad in (b"", b"text", file[:30], file[:-400], file.replace(b"\xff\xc2", b"\xff\xc0"), file.replace(b"\xff\xd0", b"")):
        with pytest.raises((ValueError, struct.error)):
            jpeg.decode([bad])


def plain_row(text):
    raw = (text or "").encode()
    payload = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])


def test_media_of_odd_rows(spark, monkeypatch):
    long = " ".join(f"w{i % 977}x{i % 131}" for i in range(200_000))
    rows = [(1, ""), (2, None), (3, " \t\n"), (4, "tie " * 90), (4, "tie " * 90), (5, "tie " * 90), (None, "ünï ☃ " * 300), (6, long), (7, "x" * 575), (8, "x" * 576), (9, "\x00\x01")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("media", "n_bytes", "feature", "payload_bytes")})
    got = media.features(media.media(df)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got), key=key) == sorted(((i, *plain_row(t)) for i, t in rows), key=key)
    ties = {(r.media_sha256, r.media_bytes, r.feature) for r in got if r.doc_id in (4, 5)}
    assert len(ties) == 1
    monkeypatch.setattr(media, "STEP", 700)  # other groups of texts, the same files and features
    again = media.features(media.media(df.repartition(3))).collect()
    assert sorted(again, key=key) == sorted(got, key=key)
    assert media.features(media.media(df.limit(0))).collect() == []


def test_tensor_column(spark):
    files = media.media(spark.createDataFrame([("a", "some text " * 100), ("b", None)], "doc_id string, text string"))
    for r in media.rgb(files).collect():
        assert len(r.rgb) == 3 * r.height * r.width and r.height % 16 == 0
        assert bytes(r.payload) == (b"some text " * 100).ljust(1152, b"\xff") if r.doc_id == "a" else bytes(r.payload) == b"\xff" * 576
    file = files.where("doc_id = 'a'").first().media
    _, samples, places = media.from_files([bytes(file)])
    shown = jpeg.tensor(samples, int(places.wide[0]), int(places.high[0]))
    assert bytes(media.rgb(files).where("doc_id = 'a'").first().rgb) == shown.tobytes()


def test_media_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r.doc_id: r for r in media.op12_media_columns(spark, SMALL).collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == plain_row(r.text)
    raw, offsets = bytewords.texts_of(pa.array([r.text for r in docs.limit(20).collect()]))
    assert sum(map(len, media.to_files(*media.payloads(raw, offsets)))) < 1.2 * len(raw) + 20 * 700
