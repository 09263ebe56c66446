"""WARC archives and URL filters against brute force."""

import base64
import collections
import gzip
import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weftlog.llm import oracles, urls, warc

SCHEMA = "page_id long, url string, html string, rule string, first int, capture string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, None) for r in rows], SCHEMA).repartition(3)


ROWS = [
    (1, "http://a.example.com/x?q=1#f", "<p>é\r\n\r\nWARC/1.1\r\n</p>"), (2, "https://b.example.org", "same"), (9, "http://c.example.net/", "same"), (4, None, "same"), (5, "no scheme", None),
    (6, "http://d.example.com/a b\r\nX: y", ""), (None, "http://e.example.com/", "same"), (None, "http://f.example.com/", "alone"), (8, "http://g.example.com/", "<b>" + "x" * 300_000 + "\n\n"),
]


@pytest.mark.parametrize("most", [warc.MOST_BROADCAST, 0])
def test_round_trip(spark, tmp_path, most):
    warc.write_archives(pages(spark, ROWS), str(tmp_path / "w"), most_broadcast=most)
    captures = warc.assemble(warc.read_archives(spark, str(tmp_path / "w"))).collect()
    assert len(captures) == len(ROWS)
    largest = {}
    for i, _, h in ROWS:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if i is None else i)
    got, by_record = collections.Counter(), {}
    for c in captures:
        page = c.metadata[0].fields.get("page-id")
        by_record[c.response.record_id] = page
        assert c.request.kind == "request" and len(c.metadata) == 1 and c.request.record_id == c.capture
    for c in captures:
        page = c.metadata[0].fields.get("page-id")
        got[page and int(page), c.response.payload_bytes, c.response.payload_digest, c.response.kind, c.response.refers_to and int(by_record[c.response.refers_to])] += 1
    expected = collections.Counter()
    for i, _, h in ROWS:
        raw = (h or "").encode()
        first = largest[h or ""]
        again = first >= 0 and i != first
        expected[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first if again else None] += 1
    assert got == expected


def test_files_are_plain_warc(spark, tmp_path):
    warc.write_archives(pages(spark, ROWS[:2]).coalesce(1), str(tmp_path / "w"))
    records = [r for f in (tmp_path / "w").glob("*.gz") for r in warc.parse(gzip.decompress(f.read_bytes()))]
    assert collections.Counter(h["warc-type"] for h, _ in records) == {"request": 2, "response": 2, "metadata": 2}
    assert all(len(b) == int(h["content-length"]) for h, b in records)
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc"))


def test_damaged_payload():
    head = {"warc-type": "response", "warc-record-id": "r", "warc-payload-digest": "sha1:" + "A" * 32}
    with pytest.raises(ValueError):
        warc.described(head, b"HTTP/1.1 200 OK\r\n\r\nx")


@pytest.mark.parametrize("most", [warc.MOST_BROADCAST, 0])
def test_one_payload_in_most_pages(spark, tmp_path, most):
    rows = [(i, f"http://h{i}.example.com/", "<p>not found</p>" if i % 10 else f"<p>{i}</p>") for i in range(3000)]
    warc.write_archives(pages(spark, rows), str(tmp_path / "w"), most_broadcast=most)
    captures = warc.assemble(warc.read_archives(spark, str(tmp_path / "w"))).select("response.kind").groupBy("kind").count().collect()
    assert {r.kind: r["count"] for r in captures} == {"response": 301, "revisit": 2699}


def test_long_pages_make_short_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 4 << 20)
    rows = [(i, f"http://h{i}.example.com/", f"{i} " + chr(97 + i % 26) * (1 << 20)) for i in range(24)]
    warc.write_archives(pages(spark, rows).coalesce(1), str(tmp_path / "w"))
    assert len(list((tmp_path / "w").glob("*.gz"))) >= 6
    got = warc.assemble(warc.read_archives(spark, str(tmp_path / "w"))).select("response.payload_bytes").collect()
    assert sorted(r.payload_bytes for r in got) == sorted(len(h) for _, _, h in rows)


def test_repeated_rows(spark, tmp_path):
    """Rows with one id and one payload are all responses; what revisits them names that id."""
    (tmp_path / "pages.parquet").mkdir()
    rows = [(1, "http://a.example.com/", "same"), (7, "http://b.example.com/", "same"), (7, "http://b.example.com/", "same"), (None, None, "same"), (2, None, None), (3, None, "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.mode("overwrite").parquet(str(tmp_path / "pages.parquet"))
    got = sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in warc.op9_warc(spark, str(tmp_path)).collect())
    assert got == [(0, "revisit", 7, 4), (1, "revisit", 7, 4), (2, "revisit", 3, 0), (3, "response", None, 0), (7, "response", None, 4), (7, "response", None, 4)]


def test_empty_pages(spark, tmp_path):
    warc.write_archives(pages(spark, []), str(tmp_path / "w"))
    assert warc.assemble(warc.read_archives(spark, str(tmp_path / "w"))).count() == 0


URLS = [
    ("http://X.Example.COM/en/7?a", "x.example.com", "/en/7", "example.com/en/7", "allow"), ("http://example.com/en/5", "example.com", "/en/5", "com/en/", "block"), ("http://com/en/", "com", "/en/", "com/en/", "block"),
    ("http://badcom/en/", "badcom", "/en/", None, None), ("https://a.net/de/1#x", "a.net", "/de/1", "net/de/", "allow"), ("https://q.example.net/de/88", "q.example.net", "/de/88", "example.net/de/8", "block"),
    ("ftp://o.org/es/?x", "o.org", "/es/", "org/es/", "block"), ("http://o.org?es/", "o.org", "", None, None), ("nothing", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None), ("http://", "", "", None, None), ("x://ÀB.net/de/", "Àb.net", "/de/", "net/de/", "allow"),
]


def test_rules(spark):
    rows = [(i, u[0], "") for i, u in enumerate(URLS)] + [(None, "http://com/en/", ""), (0, URLS[0][0], "")]
    got = urls.judge(pages(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is not None:
            _, host, path, rule, verdict = URLS[r.page_id]
            assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict)
        assert r.verdict in ("allow", "block") and 0 <= r.score <= 1
    assert urls.judge(pages(spark, [])).count() == 0


def features(url):
    """The lexical features, one by one."""
    raw = (url or "").encode()
    _, found, rest = (url or "").partition("://")
    host = re.split(r"[/?#]", rest)[0] if found else ""
    tail = rest[len(host) :]
    path = re.split(r"[?#]", tail)[0]
    query = tail[len(path) + 1 :].split("#")[0] if tail[len(path) :].startswith("?") else ""
    shares = [n / len(raw) for n in collections.Counter(raw).values()]
    return [len(raw), len(host.encode()), path.count("/"), sum(c in "0123456789" for c in url or "") / max(1, len(raw)), -sum(p * math.log2(p) for p in shares), query.count("&") + bool(query), host.count(".") + 1, sum(c in "-_%~" for c in url or "")]


def test_features(spark):
    texts = [u[0] for u in URLS] + ["http://a.b/c?x=1&y=2#z?w", "http://a.b#c?d", "://x/?", "http://é.org/ü-_%~/1?é&", "x?http://a/b/c", "http://" + "a" * 5000 + ".com/" + "1/" * 3000]
    rows = spark.createDataFrame([(t,) for t in texts], "url string")
    got = rows.select("url", *(c.alias(k) for k, c in urls.placed(F.col("url"), urls.RULES).items())).toArrow()
    columns = [got.column(k).combine_chunks() for k in ("url", "host", "path", "query")]
    assert np.allclose(urls.lexical(*columns), [features(t) for t in got.column("url").to_pylist()])


def test_places_against_sql(spark):
    got = {tuple(r) for r in urls.op10_url_filter(spark, "/root/testdata/sf0.01").select("page_id", "host", "path", "rule").collect()}
    c = duckdb.connect()
    c.execute("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.01/pages.parquet'")
    assert got == set(c.execute(oracles.OP10_PLACES).fetchall()) and len({r[3] for r in got}) == 6


def made_pages(spark, n, seed=2):
    """Blocked or allowed by rule, as digits and depth say: com/en/ blocks, net/de/ allows."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        bad = r.random() < 0.4
        rest = "".join(r.choices("0123456789", k=12)) + "/a/b/c" if bad else "".join(r.choices("abcdefgh", k=r.randint(3, 12)))
        rows.append((i, f"http://{r.choice('xyz')}{i % 50}.site.{'com/en' if bad else 'net/de'}/{rest}", ""))
    return rows


def test_trees_learn(spark):
    rows = made_pages(spark, 3000)
    model = urls.train(pages(spark, rows))
    assert model.majority < 0.7 and model.accuracy > 0.95
    assert urls.train(pages(spark, [])).prior < 0 and urls.train(pages(spark, rows), {"com/en/": "block"}).prior > 0
    verdicts = {r.page_id: r.verdict for r in urls.judge(pages(spark, [(1, "http://q.other.org/" + "1" * 12 + "/a/b/c", ""), (2, "http://q.other.org/abcdef", "")]), model).collect()}
    assert verdicts == {1: "block", 2: "allow"}


def test_a_repeated_url_counts_once(spark):
    rows = made_pages(spark, 400)
    hot = rows + [(1000 + i, rows[0][1], "") for i in range(2000)]
    a, b = urls.train(pages(spark, rows)), urls.train(pages(spark, hot))
    assert all((a.stats[k] == b.stats[k]).all() for k in a.stats) and a.accuracy == b.accuracy and len(a.trees) == len(b.trees)
    assert sum(x[0] for x in a.stats["suffix"].reshape(-1, 2)) == len({u for _, u, _ in rows})


def test_statistics_cover_all_rows(spark):
    """The trees are fitted to a sample, the statistics count every labelled URL; a URL's own fold has no part in its own."""
    rows = made_pages(spark, 1000)
    model = urls.train(pages(spark, rows), sample=100)
    assert model.stats["domain"][:, :, 0].sum() == len({u for _, u, _ in rows})
    place, fold = np.array([5]), np.array([2])
    model.stats["suffix"][:] = 0
    model.stats["suffix"][5, 2], model.stats["suffix"][5, 3] = (10, 10), (8, 0)
    assert [float(x[0]) for x in model.rates("suffix", place, fold)] == [1 / 10, 1.0] and model.rates("suffix", place, None)[0][0] == 11 / 20


def test_held_out_accuracy(spark):
    """On URLs of the last fold, against the larger class's share of them."""
    model = urls.train(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"))
    print(model.accuracy, model.majority)
    assert model.accuracy >= model.majority and model.accuracy > 0.75
