"""What remote engines are asked, and reading from a small stand-in for one."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs

import pytest

from weftlog.engine import Engine
from weftlog.plans.parser import parse
from weftlog.sources.catalog import MemoryConnector, Unsupported, made
from weftlog.sources.remote import SplunkConnector
from weftlog.streaming.partial import Coordinator, partial_rows


def steps(text):
    return parse("c.t | " + text).steps[1:]


@pytest.mark.parametrize(
    ("text", "taken", "query"),
    [
        ('where a > 3 and t has "x"', 1, {"bool": {"must": [{"range": {"a": {"gt": 3}}}, {"match_phrase": {"t": "x"}}]}}),
        ('where not(a == 1) | where exists(n.k) | project a', 2, {"bool": {"must": [{"bool": {"must_not": {"term": {"a": 1}}}}, {"exists": {"field": "n.k"}}]}}),
        ('where 3 <= a | where t contains "x"', 1, {"range": {"a": {"gte": 3}}}),
        ('where t startswith "W" or a in (1, 2)', 1, {"bool": {"should": [{"match_phrase_prefix": {"t": "W"}}, {"terms": {"a": [1, 2]}}]}}),
        ("where l[0] == 1", 0, {"match_all": {}}),
    ],
)
def test_search_filters(text, taken, query):
    body, p = made({"type": "elasticsearch", "url": "http://x"}).compile("t", steps(text))
    assert (p.taken, body["query"]) == (taken, query)


def test_sorts_and_limits():
    es = made({"type": "elasticsearch", "url": "http://x", "aliases": {"t": {"ts": "@time"}}})
    body, p = es.compile("t", steps("top 5 by @time desc | limit 3 | count"))
    assert body["sort"] == [{"ts": {"order": "desc", "missing": "_last"}}] and body["size"] == 3 and p.taken == 2
    assert made({"type": "quickwit", "url": "http://x"}).compile("t", steps('where t has "x"'))[1].taken == 0
    spl = made({"type": "splunk", "url": "http://x"})
    assert spl.compile("t", steps('where a == 1 and t has "Ab" | count'))[0] == "search index=\"t\" | where ('a' = 1 AND like(lower('t'), \"%ab%\"))"
    assert spl.compile("t", steps("where a == 1 | count"))[0] == "search index=\"t\" | where 'a' = 1 | stats count as Count"
    assert spl.compile("t", steps("count"))[0] == '| tstats count as Count where index="t"'
    assert spl.compile("t", steps("summarize n=count(), m=avg(a), e=countif(exists(b)) by c"))[0] == 'search index="t" | stats count as n sum("a") as a1 count(eval(isnum(\'a\'))) as a1_n count("b") as a2 by "c" | rename "c" as k0'
    assert spl.compile("t", steps("top 2 by a desc"))[0] == 'search index="t" | sort 0 -a | head 2'


MANY = [{"a": i, "t": f"Word {i % 3}", "n": {"k": i}, "g": f"g{i % 4}", "h": i % 2 == 0, "ts": f"2024-01-01T00:00:{i % 60:02d}Z"} | ({} if i % 5 else {"e": i}) for i in range(25_000)]


class StandIn:
    """A search engine with one collection: scrolls with a cursor that the server keeps, slices, counts, groups; and search jobs."""

    def __init__(self):
        self.cursors, self.asked, self.rows, self.left_out, self.polls = {}, [], MANY, 0, 0

    def wanted(self, query):
        def ok(row, q):
            (kind, x), *_ = q.items()
            if kind == "match_all":
                return True
            if kind == "bool":
                return all(ok(row, y) for y in x.get("must", [])) and not any(ok(row, y) for y in [x[k] for k in ("must_not",) if k in x])
            name, v = next(iter(x.items()))
            if kind == "exists":
                return v in row
            if kind == "terms":
                return row.get(name) in v
            return row.get(name) == v if kind == "term" else all({"gt": row[name] > y, "gte": row[name] >= y, "lt": row[name] < y, "lte": row[name] <= y}[o] for o, y in v.items())

        return [r for r in self.rows if ok(r, query)]

    def page(self, cursor):
        rows, size = self.cursors[cursor]
        self.cursors[cursor] = rows[size:], size
        return {"_scroll_id": cursor, "hits": {"hits": [{"_source": r} for r in rows[:size]]}}

    def values(self, aggs, rows):
        out = {}
        for name, a in aggs.items():
            (kind, x), *_ = a.items()
            got = [r[x["field"]] for r in rows if x["field"] in r]
            out[name] = {"value": {"sum": sum, "value_count": len, "min": lambda v: min(v, default=None), "max": lambda v: max(v, default=None)}[kind](got)}
        return out

    def grouped(self, aggs, rows):
        if "g" in aggs and "composite" in aggs["g"]:
            c = aggs["g"]["composite"]
            fields = [next(iter(next(iter(x.values())).values()))["field"] for x in c["sources"]]
            by = {}
            for r in rows:
                if all(f in r for f in fields):
                    by.setdefault(tuple(r[f] for f in fields), []).append(r)
            keys = [k for k in sorted(by) if not c.get("after") or k > tuple(c["after"].values())][:3]  # pages of three
            buckets = [{"key": {f"k{i}": v for i, v in enumerate(k)}, "doc_count": len(by[k]), **self.values(aggs["g"]["aggs"], by[k])} for k in keys]
            return {"g": {"buckets": buckets, **({"after_key": buckets[-1]["key"]} if buckets else {})}}
        if any("terms" in a for a in aggs.values()):
            (name, a), *_ = aggs.items()
            by = {}
            for r in rows:
                if a["terms"]["field"] in r:
                    by.setdefault(r[a["terms"]["field"]], []).append(r)
            return {name: {"sum_other_doc_count": self.left_out, "buckets": [{"key": k, "doc_count": len(v), **self.grouped(a["aggs"], v)} for k, v in by.items()]}}
        return self.values(aggs, rows)

    def search(self, name, body):
        assert body.get("size", 0) <= 10_000, "the result window is too large"
        rows = self.wanted(body["query"]) if "query" in body else self.rows
        rows = rows * len(name.split(","))
        if "aggs" in body:
            return {"hits": {"total": {"value": len(rows)}, "hits": []}, "aggregations": self.grouped(body["aggs"], rows)}
        if body.get("size") == 0:
            return {"hits": {"total": {"value": len(rows)}, "hits": []}}
        for s in body.get("sort", []):
            (field, how), *_ = s.items()
            rows = sorted(rows, key=lambda r: r[field], reverse=how["order"] == "desc")
        if cut := body.get("slice"):
            rows = rows[cut["id"] :: cut["max"]]
        if "_source" in body:
            rows = [{k: v for k, v in r.items() if k in body["_source"]} for r in rows]
        cursor = f"c{len(self.cursors)}"
        self.cursors[cursor] = rows, body["size"]
        return self.page(cursor)

    def spl(self, text):
        """Of a search job: head, sort, count and one aggregation."""
        rows, *parts = [dict(r) for r in self.rows], *text.split(" | ")
        if text.startswith("| tstats"):
            return [{"Count": str(len(rows))}]
        for p in parts:
            if p.startswith("head "):
                rows = rows[: int(p[5:])]
            elif p.startswith("sort 0 "):
                rows = sorted(rows, key=lambda r: r[p[8:]], reverse=p[7] == "-")
            elif p == "where isnotnull('g')":
                pass
            elif p == "where 'a' >= 24990":
                rows = [r for r in rows if r["a"] >= 24990]
            elif p == "stats count as Count":
                rows = [{"Count": str(len(rows))}]
            elif p == 'stats count as n sum("a") as a1 by "g"':
                by = {}
                for r in rows:
                    by.setdefault(r["g"], []).append(r["a"])
                rows = [{"g": k, "n": str(len(v)), "a1": str(sum(v))} for k, v in by.items()]
            elif p == 'rename "g" as k0':
                rows = [{("k0" if k == "g" else k): v for k, v in r.items()} for r in rows]
            else:
                assert p.startswith(("search ", "fields ")), p
        return rows

    def answer(self, path, body, form):
        self.asked.append((path, body))
        if "/scroll" in path:
            return self.page(body["scroll_id"])
        if path.endswith("/_mapping"):
            return {"t": {"mappings": {"properties": {"a": {"type": "long"}, "e": {"type": "integer"}, "t": {"type": "text"}, "g": {"type": "keyword"}, "h": {"type": "boolean"}, "ts": {"type": "date"}}}}}
        if "/indexes/" in path:
            return {"index_config": {"doc_mapping": {"field_mappings": [{"name": "a", "type": "i64", "fast": True}, {"name": "g", "type": "text", "fast": True}, {"name": "t", "type": "text"}]}}}
        if path.endswith("/_count"):
            return {"count": len(self.wanted(body["query"])) * len(path.split("/")[-2].split(","))}
        if "_search" in path:
            return self.search(path.split("?")[0].split("/")[-2], body)
        if path.startswith("/services/search/jobs?"):
            self.job = self.spl(form["search"][0])
            return {"sid": "j"}
        if "results_preview" in path or "/results?" in path:
            at, count = (int(dict(x.split("=") for x in path.split("?")[1].split("&"))[k]) for k in ("offset", "count"))
            rows = self.job[: len(self.job) // 2] if "preview" in path else self.job
            return {"results": [{k: str(v) if isinstance(v, (int, float)) else v for k, v in r.items()} for r in rows[at : at + count]]}
        self.polls += 1
        return {"entry": [{"content": {"isDone": self.polls > 2}}]}


@pytest.fixture
def stand_in():
    engine, lock, failures = StandIn(), threading.Lock(), []

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def do_GET(self):
            self.tell(None, {})

        def do_POST(self):
            raw = self.rfile.read(int(self.headers["Content-Length"]))
            self.tell(*((None, parse_qs(raw.decode())) if self.path.startswith("/services") else (json.loads(raw), {})))

        def tell(self, body, form):
            try:
                with lock:
                    status, got = 200, engine.answer(self.path, body, form)
            except Exception as e:
                status, got = 400, {"error": repr(e)}
                failures.append(repr(e))
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps(got).encode())

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    engine.url = f"http://127.0.0.1:{server.server_address[1]}"
    yield engine
    server.shutdown()
    assert not failures


def engine_of(spark, stand_in, kind, **more):
    return Engine(spark, {"r": made({"type": kind, "url": stand_in.url, **more}), "m": MemoryConnector().rows(spark, "keys", [{"g": "g1"}, {"g": "g3"}])})


@pytest.mark.parametrize("kind", ["elasticsearch", "quickwit", "splunk"])
def test_limits(spark, stand_in, kind):
    engine = engine_of(spark, stand_in, kind)
    for n in (2, 0, 12_345):
        assert list(engine.rows(f"r.t | limit {n} | count")) == [{"Count": n}]
    assert [int(r["a"]) for r in engine.rows("r.t | top 3 by a desc | project a")] == [24_999, 24_998, 24_997]
    assert list(engine.rows("r.t | count")) == [{"Count": 25_000}]
    assert list(engine.rows("r.t | where a >= 24990 | limit 4 | count")) == [{"Count": 4}]
    assert len(list(engine.rows("r.t | limit 3"))) == 3
    if kind != "splunk":
        assert list(engine.rows("r.t | where a >= 24990 | count")) == [{"Count": 10}]


@pytest.mark.parametrize("kind", ["elasticsearch", "quickwit"])
def test_reading(spark, stand_in, kind):
    engine = engine_of(spark, stand_in, kind, aliases={"t": {"ts": "@time"}})
    assert list(engine.rows("r.t | where a >= 24990 | summarize n=count(), s=sum(n.k)")) == [{"n": 10, "s": float(sum(range(24_990, 25_000)))}]
    assert all(b is None or "_source" not in b or set(b["_source"]) == {"a", "n"} for p, b in stand_in.asked)  # only what is needed
    assert list(engine.rows("r.t | where a == 61 | project a, later=@time + 1s")) == [{"a": 61, "later": "2024-01-01T00:00:02.000Z"}]
    if kind == "quickwit":
        assert list(engine.rows('r.t.raw("{}") | count')) == [{"Count": 25_000}]
    else:
        assert {p.count("slice") or (b or {}).get("slice", {}).get("max") for p, b in stand_in.asked if p.endswith("scroll=1m")} == {8}
        with pytest.raises(Unsupported):
            list(engine.rows('r.t.raw("{}")'))


GROUPED = "r.t | where a < 1000 | summarize n=count(), s=sum(a), m=avg(a), lo=min(a), hi=max(a) by g"


@pytest.mark.parametrize(("kind", "left_out"), [("elasticsearch", 0), ("quickwit", 0), ("quickwit", 7)])
def test_aggregations(spark, stand_in, kind, left_out):
    """Grouped there, page by page; where an engine leaves groups out, its rows are read and grouped here."""
    stand_in.left_out = left_out
    engine = engine_of(spark, stand_in, kind)
    key = lambda r: r["g"]
    expected = [{"g": f"g{k}", "n": 250, "s": float(sum(range(k, 1000, 4))), "m": sum(range(k, 1000, 4)) / 250, "lo": k, "hi": 996 + k} for k in range(4)]
    assert sorted(engine.rows(GROUPED), key=key) == expected
    scrolls = [p for p, _ in stand_in.asked if "scroll" in p]
    assert bool(scrolls) == bool(left_out)
    engine.options.pushdown = False
    assert sorted(engine.rows(GROUPED), key=key) == expected
    engine.options.pushdown = True
    assert list(engine.rows("r.t | where a < 0 | summarize n=count(), m=avg(a), lo=min(a)")) == [{"n": 0, "m": 0.0, "lo": None}]
    stand_in.asked.clear()
    assert len(list(engine.rows("r.t | where a < 40 | summarize n=count() by t"))) == 3  # a text field is grouped here
    assert any("scroll" in p for p, _ in stand_in.asked)


def test_existence_is_counted_there(spark, stand_in):
    engine = engine_of(spark, stand_in, "elasticsearch")
    assert sorted(engine.rows("r.t | where a < 20 | summarize e=countif(exists(e)), x=count() by h"), key=str) == [{"h": False, "e": 2, "x": 10}, {"h": True, "e": 2, "x": 10}]
    assert not any("scroll" in p for p, _ in stand_in.asked)


def test_splunk_aggregations(spark, stand_in):
    engine = engine_of(spark, stand_in, "splunk")
    got = sorted(engine.rows("r.t | summarize n=count(), s=sum(a) by g"), key=str)
    assert got == [{"g": f"g{k}", "n": 6250, "s": float(sum(range(k, 25_000, 4)))} for k in range(4)]


@pytest.mark.parametrize("kind", ["elasticsearch", "quickwit"])
def test_unions_go_together(spark, stand_in, kind):
    engine = engine_of(spark, stand_in, kind)
    assert list(engine.rows("r.t | where a < 10 | union (r.u | where a < 10) | count")) == [{"Count": 20}]
    assert len(stand_in.asked) == 1 and "/t,u/" in stand_in.asked[0][0]
    assert list(engine.rows("r.t | where a < 10 | union (r.u | where a < 5) | count")) == [{"Count": 15}]


def test_keys_of_a_join_go_to_the_engine(spark, stand_in):
    engine = engine_of(spark, stand_in, "elasticsearch")
    text = "m.keys | project g=tostring(g) | join (r.t | where a < 8) on g | project a, g"
    expected = [{"a": a, "g": f"g{a % 4}"} for a in range(8) if a % 4 in (1, 3)]
    assert sorted(engine.rows(text), key=str) == expected
    assert any("terms" in json.dumps((b or {}).get("query", {})) for _, b in stand_in.asked)
    stand_in.asked.clear()
    engine.options.most_keys = 1
    assert sorted(engine.rows(text), key=str) == expected
    assert not any("terms" in json.dumps((b or {}).get("query", {})) for _, b in stand_in.asked)


def test_previews(spark, stand_in, monkeypatch):
    monkeypatch.setattr(SplunkConnector, "PREVIEW", 0.05)
    stand_in.rows = MANY[:40]
    engine = engine_of(spark, stand_in, "splunk")
    rows = list(partial_rows(engine, "r.t | where exists(g) | summarize n=count() by g", 0))
    marked, final = [r for r in rows if "_partial" in r], [r for r in rows if "_partial" not in r]
    assert sum(r["n"] for r in final) == 40 and marked and sum(r.get("n", 0) for r in marked if r["_partial"]["id"] == 0) == 20


def test_coordinator():
    c = Coordinator("ab")
    assert c.put("a", [1]) == [] and c.put("a", [1, 2]) == [] and c.put("b", [5]) == [{"a": [1], "b": [5]}]
    assert c.finish("b", [5, 6]) == [{"a": [1, 2], "b": [5, 6]}]
    assert c.put("a", [1, 2, 3]) == [{"a": [1, 2, 3], "b": [5, 6]}] and c.finish("a", [9]) == [] and not c.live
    c = Coordinator("ab", most=3)
    assert c.put("a", [1, 2]) == [] and c.put("a", [1, 2, 3]) == [] and sorted(c.waiting) == [0]


def test_explain_asks_nobody(spark, stand_in):
    engine = engine_of(spark, stand_in, "elasticsearch")
    assert "limit n=3" in engine.explain("r.t | where a > 3 | limit 3 | summarize n=count() by g")
    assert stand_in.asked == []
