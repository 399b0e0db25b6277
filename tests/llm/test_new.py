"""Archives, resampling and vector codes against plain models."""

import base64
import gzip
import hashlib
import io
import math
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from cases import DOCS, ODD, corpus, documents

from kinegrid.llm import codes, resample, warc

PAGES = "page_id long, url string, html string"


# --- archives


def expected(pages, min_bytes=0):
    first, out = {}, []
    order = sorted(pages, key=lambda p: (p[0] is None, p[0] or 0))
    for page_id, _, html in order:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        if len(data) >= min_bytes and digest in first:
            out.append((page_id, len(data), digest, "revisit", first[digest]))
        else:
            out.append((page_id, len(data), digest, "response", None))
            first.setdefault(digest, page_id) if len(data) >= min_bytes else None
    return sorted(out, key=repr)


PAGE_ROWS = [(i, f"http://h{i % 3}/p q\n{i}", t) for i, t in enumerate([None, "", "<p>é☃</p>", "a\r\n\r\nb", "x" * 200_000, "http://x 1.1.1.1 20000101000000 text/html 7\nWARC/1.0\r\n", "\n\n\n", "<p>é☃</p>", "", "z", "z", "z", "z"])]
PAGE_ROWS += [(40, None, "z"), (41, "", "u"), (42, "filedesc://x", "1 0 y"), (43, "dns:a", "<p>"), (-5, "http://é/ü?x=1 2", "z")]


@pytest.mark.parametrize("min_bytes", [0, 2])
@pytest.mark.parametrize("archive_bytes", [1, 1 << 20])
def test_pages_come_back_from_converted_archives(spark, min_bytes, archive_bytes):
    df = spark.createDataFrame(PAGE_ROWS, PAGES).repartition(3).select("*", *(F.lit(-7).alias(c) for c in ("version", "archive", "offset", "uri", "record_id", "refers_to", "payload_digest")))
    got = warc.round_trip(df, min_bytes, archive_bytes)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(PAGE_ROWS, min_bytes)


def test_odd_pages(spark):
    """Repeated ids, rows without one, and no rows at all."""
    rows = [(1, "u", "same"), (1, "u", "same"), (1, "v", "other"), (None, "u", "same"), (None, "u", "lone"), (None, None, None)]
    got = sorted((tuple(r) for r in warc.round_trip(spark.createDataFrame(rows, PAGES)).collect()), key=repr)
    assert got == expected(rows)
    none = warc.round_trip(spark.createDataFrame([], PAGES))
    assert none.count() == 0 and none.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_header_lines_of_both_versions_and_faults():
    """Lengths decide where records end; types and URLs may have spaces; a wrong length costs no later record."""
    one = b"filedesc://a.arc 0.0.0.0 19961031 text/plain 76\n1 0 Somebody\nURL IP-address Archive-date Content-type Archive-length\n" + b"\n" * 7
    one += b"http://a/b c 1.2.3.4 19961104142103 text/html; charset=x 34\nHTTP/1.0 200 OK\r\nA: b\r\n\r\n<p>\n\n</p>\n"
    one += b"dns:a.b 1.2.3.4 1996 text/dns 7\n1.2.3.4\n" + b"http://short 1.2.3.4 19991399 text/html 3\nabcdef\nmore\n"
    one += b"http://last 1.2.3.4 19970101000000 text/html 50\nHTTP/1.0 200 OK\n\ncut off"
    found = list(warc.arc_records(io.BytesIO(one)))
    assert [r.uri for r in found] == [b"filedesc://a.arc", b"http://a/b c", b"dns:a.b", b"http://short", b"http://last"]
    assert found[1].block == b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n<p>\n\n</p>" and found[1].kind == b"text/html; charset=x" and found[1].block[found[1].head :] == b"<p>\n\n</p>"
    assert found[4].truncated and found[4].block.endswith(b"cut off") and not found[2].truncated
    two = b"filedesc://b.arc 0.0.0.0 20000101000000 text/plain 200 - - 0 b.arc %d\n2 0 Somebody\n%s\n" % (14 + len(warc.FIELDS[2]), warc.FIELDS[2].encode())
    line = b"http://x/ 1.2.3.4 20000102030405 text/html 404 sum - 199 b.arc 27\n"
    two += b"\n" + line + b"HTTP/1.0 404 Gone\n\n12345678\n"
    again = list(warc.arc_records(io.BytesIO(gzip.compress(two[:60]) + gzip.compress(two[60:]))))
    assert again[1].uri == b"http://x/" and again[1].kind == b"text/html" and again[1].block.endswith(b"12345678")
    assert [warc.timestamp(x) for x in (b"20000102030405", b"1996", b"19961031", b"19991399")] == ["2000-01-02T03:04:05Z", "1996-01-01T00:00:00Z", "1996-10-31T00:00:00Z", "1970-01-01T00:00:00Z"]
    assert list(warc.arc_records(io.BytesIO(b"no archive\nat all\n"))) == [] == list(warc.arc_records(io.BytesIO(b"")))


def test_records_synthesised():
    """Types, identifiers, dates and digests of the records that an archive becomes."""
    arc = b"filedesc://a.arc 0.0.0.0 19961031000000 text/plain 15\n1 0 X\nURL Rest\n\nhttp://a/ 1.2.3.4 19961104142103 text/html 27\nHTTP/1.0 200 OK\nA: b\n\nbody!\nftp://b 0.0.0.0 19961104142104 text/plain 3\nabc\n"
    records = list(warc.arc_records(io.BytesIO(arc)))
    made = b"".join(warc.warc_record("a", r) for r in records) + warc.warc_record("a", records[1], ("<urn:uuid:1>", b"http://z/", "1990-01-01T00:00:00Z"))
    (info, text), (response, block), (resource, plain), (revisit, head) = warc.warc_records(io.BytesIO(made))
    assert info[b"warc-type"] == b"warcinfo" and b"arc-version: 1 0 X" in text and info[b"warc-filename"] == b"a.warc.gz"
    assert response[b"warc-type"] == b"response" and block == records[1].block and response[b"warc-ip-address"] == b"1.2.3.4" and response[b"warc-date"] == b"1996-11-04T14:21:03Z"
    assert response[b"warc-payload-digest"] == b"sha1:" + base64.b32encode(hashlib.sha1(b"body!").digest()) and response[b"warc-block-digest"] == b"sha1:" + base64.b32encode(hashlib.sha1(block).digest())
    assert resource[b"warc-type"] == b"resource" and resource[b"content-type"] == b"text/plain" and plain == b"abc" and b"warc-ip-address" not in resource
    assert revisit[b"warc-type"] == b"revisit" and revisit[b"warc-refers-to"] == b"<urn:uuid:1>" and head == b"HTTP/1.0 200 OK\nA: b\n\n" and revisit[b"warc-profile"].endswith(b"identical-payload-digest")
    ids = [x[b"warc-record-id"] for x in (info, response, resource)]
    assert len({*ids}) == 3 and all(re.fullmatch(rb"<urn:uuid:[0-9a-f-]{36}>", x) for x in ids) and revisit[b"warc-record-id"] == ids[1]


# --- resampling


def plain_features(text, orders=2):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return [zlib.crc32(" ".join(words[i : i + n]).encode()) for n in range(1, orders + 1) for i in range(len(words) - n + 1)], len(words)


def plain_resample(docs, target, percent=25, least=20, buckets=10_000, orders=2):
    feats = [plain_features(t, orders) for _, t in docs]
    s, t = Counter(c % buckets for f, _ in feats for c in f), Counter(c % buckets for x in target for c in plain_features(x, orders)[0])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(((t[b] + 1) * (total_s + buckets)) / ((s[b] + 1) * (total_t + buckets)))) for b in range(buckets)]
    rows = []
    for (i, _), (f, words) in zip(docs, feats, strict=True):
        weight = sum(gain[c % buckets] for c in f) // len(f) if f else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(f), weight, score, None, words >= least and i is not None])
    fit = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0]))
    for rank, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in rows]


@pytest.mark.parametrize("orders,buckets,range_rows", [(2, 10_000, 1 << 18), (3, 70_000, 5), (1, 7, 3)])
def test_resampling_equals_a_plain_model(spark, monkeypatch, orders, buckets, range_rows):
    monkeypatch.setattr(resample, "RANGE_ROWS", range_rows)
    texts = corpus(3, 60) + ["É" * 30 + " Straße 東京 " * 15, "a" * 100_000, " ".join(f"w{i * i % 997}" for i in range(60_000)), "X" * 70 + " y"]
    df = documents(spark, texts).repartition(3).select("*", *(F.lit(-7).alias(c) for c in ("key", "copies", "n", "features", "bucket", "weight", "score", "rank", "order", "place", "range")))
    target = [texts[0], None, texts[5][:200], "w1 w2 W3"]
    got = resample.resample(df, spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string"), orders=orders, buckets=buckets, least_words=20)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = plain_resample([(3 * i, t) for i, t in enumerate(texts)], target, orders=orders, buckets=buckets)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_resampling_of_odd_rows(spark):
    """Rows without an id count in the source but are not drawn, rows that repeat an id have ranks of their own."""
    long = " ".join(f"w{i}" for i in range(30))
    docs = [(3, long)] * 6 + [(4, long + " x"), (5, None), (5, ""), (6, "few words"), (None, long), (None, None)]
    got = sorted((tuple(r) for r in resample.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "text string"), percent=100).collect()), key=repr)
    want = plain_resample(docs, [], percent=100)
    assert sorted((r[:4] for r in got), key=repr) == sorted((r[:4] for r in want), key=repr)
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 8)) and all(r[4] is None for r in got if r[0] in (None, 5, 6))
    nothing = spark.createDataFrame([], DOCS)
    assert resample.resample(nothing, nothing).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=80), st.sampled_from(ODD)), max_size=6), st.integers(1, 4))
def test_features_of_any_text(texts, orders):
    got = {}
    for a, b, row, found in resample.features(pa.array(texts, pa.string()), orders, 1 << 32):
        for i in range(a, b):
            got[i] = sorted(found[row == i - a].tolist())
    assert [got.get(i, []) for i in range(len(texts))] == [sorted(plain_features(t, orders)[0]) for t in texts]


# --- vector codes


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, x, label) for i, x, label in rows if x is not None and all(v is not None and math.isfinite(v) for v in x)]
    whole = [[math.floor(scale * v) for v in x] for _, x, _ in kept]
    width = len(whole[0]) // parts
    cut = lambda x, p: x[p * width : (p + 1) * width]
    order = sorted((k for k in range(len(kept)) if kept[k][0] is not None), key=lambda k: (kept[k][0], whole[k]))[:entries]
    books = [[cut(whole[k], p) for k in order] for p in range(parts)]
    for r in range(rounds + 1):
        near = [[min((sum((a - b) ** 2 for a, b in zip(cut(x, p), c, strict=True)), e) for e, c in enumerate(books[p])) for p in range(parts)] for x in whole]
        if r == rounds:
            break
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(x, p) for x, n in zip(whole, near, strict=True) if n[p][1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    error = [sum(d for d, _ in n) for n in near]
    by_label = Counter()
    for (_, _, label), e in zip(kept, error, strict=True):
        by_label[label] += e
    sha = hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for _, e in n), d, by_label[label], sha) for (i, _, label), n, d in zip(kept, near, error, strict=True)]


@pytest.mark.parametrize("parts,entries,rounds", [(8, 16, 6), (4, 3, 2), (1, 40, 1), (8, 16, 0)])
def test_vector_codes_equal_a_plain_model(spark, parts, entries, rounds):
    rng = np.random.default_rng(7)
    data = rng.normal(size=(120, 16)).round(3)
    data[30:50] = data[2]
    data[50:70] = data[3] + 0.25 * rng.integers(-1, 2, (20, 16))
    rows = [(int(i), [float(v) for v in x], None if i % 7 == 0 else int(i % 3)) for i, x in zip(rng.permutation(120) * 5, data, strict=True)]
    rows += [(1000, None, 1), (1001, [float("nan")] * 16, 1), (1002, [None] * 16, 1), (1003, [float("-inf")] + [0.0] * 15, 1), (1, [*map(float, data[9])], 2), (1, [*map(float, -data[9])], 2), (None, [*map(float, data[4])], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3).select("*", *(F.lit(-7).alias(c) for c in ("values", "code", "error", "entry", "component", "total", "count", "of", "x", "length")))
    got = codes.digest(df, parts, entries, rounds)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(plain_codes(rows, parts, entries, rounds), key=repr)


def test_vectors_that_are_odd(spark):
    schema = "vec_id long, embedding array<float>, label int"
    rows = [(1, [1.0] * 8, 0), (2, [2.0] * 8, 0), (3, [], 0), (4, [1.0] * 16, 0), (5, [float(codes.LARGE)] * 8, 0), (6, None, None)]
    got = codes.digest(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.vec_id, r.code, r.error) for r in got) == [(1, "00" * 8, 0), (2, "01" * 8, 0)]
    none = codes.digest(spark.createDataFrame([], schema))
    assert none.count() == 0 and none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert codes.digest(spark.createDataFrame(rows[5:], schema)).count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        codes.digest(spark.createDataFrame([(1, [1.0] * 9, 0)], schema)).count()


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 20), st.integers(1, 4), st.integers(1, 30))
def test_exponion_search_is_exact(seed, entries, width, spread):
    rng = np.random.default_rng(seed)
    book, x = rng.integers(-spread, spread, (entries, width)), rng.integers(-spread, spread, (50, width))
    best, least, asked = codes.Exponion(book).nearest(x, rng.integers(0, entries, 50))
    apart = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    assert (best == apart.argmin(axis=1)).all() and (least == apart.min(axis=1)).all() and asked <= 50 * entries


def test_exponion_search_leaves_entries_out():
    rng = np.random.default_rng(3)
    book = rng.integers(-(10**6), 10**6, (64, 4))
    x = book[rng.integers(0, 64, 2000)] + rng.integers(-50, 50, (2000, 4))
    _, _, first = codes.Exponion(book).nearest(x, np.zeros(2000, np.int64))
    best, _, _ = codes.Exponion(book).nearest(x, np.zeros(2000, np.int64))
    _, _, asked = codes.Exponion(book).nearest(x, best)
    assert asked == 2000 < first / 10


# --- bounds of earlier operators


@pytest.mark.parametrize("substring", [8, 16])
def test_recall_of_both_widths_of_substrings(spark, substring):
    from kinegrid.llm import ann

    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 48)) * 2
    data = (centres[rng.integers(0, 40, 1600)] + rng.normal(size=(1600, 48))).astype(np.float32).astype(np.float64)
    df = spark.createDataFrame([(i, [*map(float, v)], 0) for i, v in enumerate(data)], "vec_id long, embedding array<double>, label int")
    got = ann.search(df, every=20, k=20, substring=substring).toPandas()
    hit = sum(len({*g.vec_id} & {*[i for i in np.argsort(-(data @ data[q])) if i != q][:20]}) for q, g in got.groupby("query_id"))
    assert len(got) == 80 * 20 and hit / len(got) >= 0.95


def test_too_many_languages_are_an_error(spark):
    from kinegrid.llm import language

    rows = spark.createDataFrame([(f"text {i}", f"l{i}") for i in range(12)], "text string, lang string")
    with pytest.raises(ValueError, match="12 values of lang"):
        language.train(rows, most=11)
    assert len(language.train(rows, most=12).languages) == 12
