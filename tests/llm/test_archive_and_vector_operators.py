"""WARC archives, product codes and clusters against plain versions."""

import gzip
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fitscape.llm import queries, vector_codes, vectors, warc
from fitscape.llm.shared import with_match
from fitscape.llm.simplex_clusters import Simplex, cluster_vectors, nearest
from fitscape.llm.vector_codes import Orchard, compress_vectors

LONG = "<p>" + "long text " * 120


def plain_archive(pages):
    """op11's rows for (page_id, url, html) tuples."""
    body = [(p, (h or "").encode()) for p, _, h in pages]
    top = {}
    for p, b in body:
        if len(b) >= 1000 and p is not None:
            top[b] = max(top.get(b, p), p)
    out = []
    for p, b in body:
        to = top.get(b)
        again = to is not None and p != to
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", to if again else None))
    return sorted(out, key=repr)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


def test_archives(spark, tmp_path):
    odd = [
        (1, "http://a.org/x?y#z", LONG), (2, "http://a.org/", LONG), (9, "http://b.org", LONG), (None, "http://b.org", LONG), (4, None, LONG), (9, "http://b.org", LONG), (9, "http://other.org", LONG), (5, "http://c.org", None), (6, "", ""),
        (7, "a b\r\nWARC-Type: x", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 30), (8, "http://d.org", "\r\n\r\n\r\n"), (10, "http://é.org/ü", "é\u0000 \n\r" * 400), (11, "u", "é\u0000 \n\r" * 400),
        (None, None, None), (None, None, None), (None, "x", "n" * 2000), (None, "y", "n" * 2000), (12, "s", "short"), (13, "s", "short"), (14, "k", "x" * 999), (15, "k", "x" * 999), (16, "k", "x" * 1000), (17, "k", "x" * 1000),
    ]
    odd += [(100 + k, "http://hot.org", "hot " * 300) for k in range(300)]
    df = spark.createDataFrame(odd, "page_id long, url string, html string").withColumn("record_id", F.lit("clash")).withColumn("payload", F.lit(1)).withColumn("_k", F.lit(2))
    df.write.parquet(f"{tmp_path}/pages.parquet")
    assert rows(queries.op11_warc_captures(spark, str(tmp_path)), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == plain_archive(odd)
    # the operator's nested rows hold all that was written
    warc.write_warc(warc.planned(df), f"{tmp_path}/archives", records_per_file=10)
    captures = warc.assemble(warc.read_warc(spark, f"{tmp_path}/archives"))
    got = warc.revisited(captures).collect()
    assert len(got) == len(odd) and all(len(r["requests"]) == len(r["metadata"]) == 1 for r in got)
    whole = sorted(bytes(r["response"]["payload"]) for r in got if r["response"]["record_type"] == "response")
    types = [t for *_, t, _ in plain_archive(odd)]
    assert len(whole) == types.count("response") and b"hot " * 300 in whole and ("é\u0000 \n\r" * 400).encode() in whole
    assert all(r["original"]["record_id"] == r["response"]["refers_to"] and not r["response"]["payload"] for r in got if r["response"]["record_type"] == "revisit")
    assert all(r["response"]["payload_digest"] == "sha1:" + (r["original"] or r["response"])["payload_sha1"] for r in got)
    assert warc.unlinked(warc.read_warc(spark, f"{tmp_path}/archives")).count() == 0
    df.limit(0).write.parquet(f"{tmp_path}/none/pages.parquet")
    assert queries.op11_warc_captures(spark, f"{tmp_path}/none").count() == 0


def record(kind, name, block, **fields):
    head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{name}>\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    """Links named by either side, several a record, folded fields, records of no capture, one gzip member a record, files next to each other in one task."""
    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody\r\n\r\nmore\x00\xff"
    first = [record("warcinfo", "i", b"software: x\r\n"), record("response", "r1", http, Content_Type="application/http;\r\n msgtype=response"), record("request", "q1", b"GET /", WARC_Concurrent_To="<r1>"), record("metadata", "m1", b"a", WARC_Concurrent_To="<r1>")]
    second = [record("request", "q2", b""), record("metadata", "m2", b"b", WARC_Concurrent_To="<r2>\r\nWARC-Concurrent-To: <r1>"), record("response", "r2", b"plain", WARC_Concurrent_To="<q2>"), record("request", "q3", b"", WARC_Concurrent_To="<nothing>"), record("response", "r3", b"")]
    for name, records in (("a.warc.gz", first), ("b.warc.gz", second)):
        (tmp_path / name).write_bytes(b"".join(map(gzip.compress, records)))
    found = warc.read_warc(spark, str(tmp_path))
    assert found.count() == 9
    got = {r["response"]["record_id"]: r for r in warc.assemble(found).collect()}
    ids = lambda x: [r["record_id"] for r in x]
    assert {k: (ids(r["requests"]), ids(r["metadata"])) for k, r in got.items()} == {"<r1>": (["<q1>"], ["<m1>", "<m2>"]), "<r2>": (["<q2>"], ["<m2>"]), "<r3>": ([], [])}
    assert bytes(got["<r1>"]["response"]["payload"]) == b"body\r\n\r\nmore\x00\xff" and bytes(got["<r2>"]["response"]["payload"]) == b"plain"
    assert rows(warc.unlinked(found), "record_id") == [("<q3>",)]
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "c.warc.gz").write_bytes(gzip.compress(first[1][:-20]))
    with pytest.raises(Exception, match="ends within a record"):
        warc.read_warc(spark, str(tmp_path / "cut")).collect()


def test_reader_takes_any_cut():
    random.seed(2)
    blocks = [bytes(random.choices(b"ab\r\nWARC/1.0", k=random.randint(0, 60))) for _ in range(40)]
    data = b"".join(record("resource", str(k), b) for k, b in enumerate(blocks))
    lines = [x + b"\n" for x in data.split(b"\n")[:-1]]
    for size in (1, 2, 7, 1000):
        reader = warc._Reader()
        got = [b for k in range(0, len(lines), size) for _, b in reader.feed(b"".join(lines[k : k + size]))]
        reader.close()
        assert got == blocks


def test_with_match(spark):
    data = [(k, "hot" if k % 3 else None if k % 2 else f"k{k % 40}") for k in range(900)]
    df = spark.createDataFrame(data, "id long, key string")
    lookup = spark.createDataFrame([("hot", 1), ("k4", 2), ("k30", 3), ("unused", 4)], "_key string, found int")
    got = dict(rows(with_match(df, F.col("key"), lookup, "found", F.col("id").cast("string"), share=3), "id", "found"))
    assert got == {k: {"hot": 1, "k4": 2, "k30": 3}.get(x) for k, x in data}


def test_orchard_finds_the_nearest():
    rng = np.random.default_rng(3)
    for size, width, spread in ((1, 3, 5), (2, 1, 3), (16, 8, 4), (16, 2, 3), (16, 8, 4000), (40, 3, 6)):
        entries, x = rng.integers(-spread, spread, (size, width)), rng.integers(-spread, spread, (500, width))
        entries[size // 2] = entries[0]  # equal entries
        d = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        index, error, computed = Orchard(entries).nearest(x)
        assert (index == d.argmin(axis=1)).all() and (error == d.min(axis=1)).all() and computed <= d.size
    apart = np.repeat(np.arange(16) * 1000, 8).reshape(16, 8)
    assert Orchard(apart).nearest(apart[rng.integers(0, 16, 400)] + rng.integers(-20, 20, (400, 8)))[2] < 400 * 9  # lists end early


def test_simplex_bounds_and_exactness():
    rng = np.random.default_rng(4)
    for width, spread in ((64, 500), (64, 3), (5, 100), (1, 10)):
        start = rng.integers(-spread, spread, (8, width))
        start[3] = start[0]
        simplex = Simplex(start, 6)
        assert 1 <= len(simplex.pivots) <= 6
        v, c = rng.integers(-spread, spread, (400, width)), rng.integers(-spread, spread, (8, width))
        c[5], v[:50] = c[2], c[rng.integers(0, 8, 50)]
        d = ((v[:, None] - c[None]) ** 2).sum(axis=2)
        apex, tops = simplex.apexes(simplex.squared(v)), simplex.apexes(simplex.squared(c))
        foot = ((apex[:, None, :-1] - tops[None, :, :-1]) ** 2).sum(axis=2)
        near, far = foot + (apex[:, None, -1] - tops[None, :, -1]) ** 2, foot + (apex[:, None, -1] + tops[None, :, -1]) ** 2
        assert (np.sqrt(near) <= np.sqrt(d) + 1e-4).all() and (np.sqrt(far) >= np.sqrt(d) - 1e-4).all()
        best, distance, _ = nearest(v, apex, c, tops)
        assert (best == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
        assert (nearest(v, apex, c, tops, exact=False)[0] == best).all()
    close = start = rng.integers(-500, 500, (8, 64))
    v = close[rng.integers(0, 8, 400)] + rng.integers(-9, 9, (400, 64))
    simplex = Simplex(start, 6)
    assert nearest(v, simplex.apexes(simplex.squared(v)), close, simplex.apexes(simplex.squared(close)), exact=False)[2] < 800  # most are known by their bounds


def whole(x, scale):
    return None if x is None or any(v is None or not math.isfinite(v) for v in x) else [math.floor(scale * v) for v in x]


def squared(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def plain_codes(data, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, whole(x, scale), label) for i, x, label in data]
    kept = [r for r in kept if r[1]]
    order = sorted((r for r in kept if len(r[1]) % parts == 0), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not order:
        return []
    dim = len(order[0][1])
    kept, first = ([r for r in x if len(r[1]) == dim] for x in (kept, order))
    w = dim // parts
    cut = lambda v: [v[p * w : p * w + w] for p in range(parts)]
    books = [[cut(r[1])[p] for r in first[:entries]] for p in range(parts)]
    near = lambda p, x: min(range(len(books[p])), key=lambda e: (squared(x, books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for r in kept:
                x = cut(r[1])[p]
                groups.setdefault(near(p, x), []).append(x)
            books[p] = [[sum(c) // len(groups[e]) for c in zip(*groups[e], strict=True)] if e in groups else b for e, b in enumerate(books[p])]
    h = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, by = [], {}
    for i, v, label in kept:
        code = [near(p, x) for p, x in enumerate(cut(v))]
        error = sum(squared(x, books[p][e]) for p, (x, e) in enumerate(zip(cut(v), code, strict=True)))
        by[label] = by.get(label, 0) + error
        out.append((i, "".join(f"{e:02x}" for e in code), error, label))
    return sorted(((i, c, e, by[label], h) for i, c, e, label in out), key=repr)


def plain_clusters(data, clusters=8, rounds=10, scale=1024, dim=64, seed=3):
    kept = [(i, v) for i, v in ((i, whole(x, scale)) for i, x, _ in data) if v and len(v) == dim]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[:clusters]]
    near = lambda v: min(range(len(centroids)), key=lambda k: (squared(v, centroids[k]), k))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v), []).append(v)
        centroids = [[sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)] if k in groups else x for k, x in enumerate(centroids)]
    got = [(i, near(v), v) for i, v in kept]
    got = [(i, k, squared(v, centroids[k])) for i, k, v in got]
    each = {k: sum(d for _, j, d in got if j == k) for k in range(len(centroids))}
    h = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, k, d, each[k], sum(each.values()), h[k]) for i, k, d in got), key=repr)


def odd_vectors(n, seed):
    """Nulls, NaN, infinities, other lengths, repeated rows and ids, null ids and labels, many copies of one vector."""
    random.seed(seed)
    one = lambda: [random.gauss(0, 0.2) for _ in range(64)]
    copy = one()
    data = [(k if k % 17 else None, copy if k % 3 == 0 else one(), random.choice([None, 1, 1, 1, 2])) for k in range(n)]
    bad = [(-1, None, 1), (-2, [], 1), (-3, [0.1, None] * 32, 1), (-4, [math.nan] * 64, None), (-5, [math.inf] + [0.0] * 63, 2), (-6, [0.5] * 30, 2), (5, one(), 1), (5, one(), 1), (7, copy, 2), (7, copy, 2), (n, [0.0] * 128, 1)]
    data += bad
    random.shuffle(data)
    return data


SCHEMA = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("n", [0, 3, 150])
def test_codes_and_clusters_of_odd_tables(spark, n):
    data = odd_vectors(n, n) if n else [(1, None, 1), (2, [], 1)]
    df = spark.createDataFrame(data, SCHEMA).withColumn("v", F.lit("x")).withColumn("x", F.lit(1)).withColumn("code", F.lit(1)).withColumn("apex", F.lit(0)).withColumn("_k", F.lit(0))
    assert rows(compress_vectors(df, rounds=2), "vec_id", "code", "error", "label_error", "codebooks_sha256") == plain_codes(data, rounds=2)
    assert rows(cluster_vectors(df, rounds=3)) == plain_clusters(data, rounds=3)
    none = df.limit(0)
    assert compress_vectors(none).count() == cluster_vectors(none).count() == 0


def test_total_of_many_labels(spark):
    """Labels that fill tasks by broadcast, all others by shuffle."""
    df = spark.createDataFrame([(k, k % 3 if k < 30 else k if k % 7 else None) for k in range(200)], "id long, label long")
    got = {r["id"]: (r["label"], r["t"]) for r in vectors.with_total(df, "label", "id", "t", share=5).collect()}
    sums = {}
    for k, (label, _) in got.items():
        sums[label] = sums.get(label, 0) + k
    assert len(got) == 200 and all(t == sums[label] for label, t in got.values())


def test_components_out_of_range(spark):
    df = spark.createDataFrame([(1, [1e9] * 64, 1)], SCHEMA)
    with pytest.raises(Exception, match="too large"):
        compress_vectors(df)
    assert vector_codes.first_vectors(vectors.integer_vectors(df.limit(0), 4, id_col="vec_id", vector_col="embedding"), 8, 16) is None
