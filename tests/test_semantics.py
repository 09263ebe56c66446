"""What queries mean where fields are missing, null, or of several types."""

import json

import pytest

from weftlog.engine import Engine
from weftlog.sources.catalog import MemoryConnector, NotFound, Unsupported


@pytest.fixture(scope="module")
def ask(spark):
    def run(text, *collections, **views):
        m = MemoryConnector()
        for name, rows in zip("abcdef", collections, strict=False):
            m.rows(spark, name, rows)
        engine = Engine(spark, {"m": m})
        for k, v in views.items():
            engine.create_view(k, v)
        return sorted(engine.rows(text), key=lambda r: json.dumps(r, sort_keys=True))

    return run


def canon(rows):
    return sorted(rows, key=lambda r: json.dumps(r, sort_keys=True))


MIXED = [{"x": 3}, {"x": 5.0}, {"x": "5"}, {"x": None}, {"y": 1}, {"x": True}, {"x": [1]}]

CASES = [
    # comparison: missing drops, null is least, types are ordered
    ("m.a | where x == 5", MIXED, [{"x": 5}]),
    ('m.a | where x == "5"', MIXED, [{"x": "5"}]),
    ("m.a | where x == null", MIXED, [{"x": None}]),
    ("m.a | where x <= 5", MIXED, [{"x": 3}, {"x": 5}, {"x": None}, {"x": True}]),
    ("m.a | where x >= 5", MIXED, [{"x": 5}, {"x": "5"}, {"x": [1]}]),
    ("m.a | where not(x == 5)", MIXED, [{"x": 3}, {"x": "5"}, {"x": None}, {"x": True}, {"x": [1]}]),
    ("m.a | where x between (null .. 4)", MIXED, [{"x": 3}, {"x": None}, {"x": True}]),
    ("m.a | where x in (3, null, nothing)", MIXED, [{"x": 3}, {"x": None}]),
    ("m.a | where exists(x) and not(exists(y))", MIXED, [r for r in MIXED if "x" in r]),
    ("m.a | where a == b", [{"a": 1, "b": 1}, {"a": 1, "b": 1.5}, {"a": 1}], [{"a": 1, "b": 1}]),
    # logic
    ("m.a | where a or b", [{"b": True}, {"a": False, "b": 1}, {"a": 0, "b": 0}, {"a": "t"}], [{"a": False, "b": 1}, {"a": "t"}]),
    ("m.a | where w", [{"w": 0}, {"w": 2}, {"w": ""}, {"w": "f"}, {"w": []}, {"w": [0]}, {"w": {}}, {"w": None}, {"w": {"k": 1}}], [{"w": 2}, {"w": "f"}, {"w": [0]}, {"w": {"k": 1}}]),
    # arithmetic
    ("m.a | project z=x * 2 / 4", [{"x": 3}, {"x": "s"}, {}], [{"z": 1.5}, {}, {}]),
    ("m.a | project z=x + x, d=x / 0", [{"x": 2}, {"x": 1.5}, {"x": "ab"}], [{"z": 4}, {"z": 3}, {"z": "abab"}]),
    ("m.a | project z=3 - x", [{"x": 5}], [{"z": -2}]),
    # text
    ('m.a | where t contains "b"', [{"t": "abc"}, {"t": "ABC"}, {"t": 1}, {"t": None}], [{"t": "abc"}]),
    ('m.a | where t contains ""', [{"t": "abc"}, {"t": 1}, {"t": None}], [{"t": "abc"}]),
    ('m.a | where t has "err.io"', [{"t": "x/ERR.IO,y"}, {"t": "xerr.io"}, {"t": "err.io_1"}, {"t": "errXio"}], [{"t": "x/ERR.IO,y"}, {"t": "err.io_1"}]),
    ('m.a | where t has_cs "Err"', [{"t": "an Err"}, {"t": "an err"}, {"t": "Errs"}], [{"t": "an Err"}]),
    ("m.a | where t has s", [{"t": "a b", "s": "B"}, {"t": "ab", "s": "b"}, {"t": "x", "s": ""}], [{"t": "a b", "s": "B"}, {"t": "x", "s": ""}]),
    (r'm.a | project g=extract("(\\d+)-(\\d+)", 2, t)', [{"t": "10-20"}, {"t": "no"}, {}], [{"g": "20"}, {"g": None}, {}]),
    (r'm.a | project g=extract("a(b)?(c*)", 1, t), h=extract("a(b)?(c*)", 2, t), i=extract("a", 3, t)', [{"t": "ab"}, {"t": "xacc"}], [{"g": "b", "h": "", "i": None}, {"g": None, "h": "cc", "i": None}]),
    ('m.a | where exists(extract("z", 0, t)) | count', [{"t": "a"}, {"t": 5}, {}], [{"Count": 1}]),
    ("m.a | where x == True or x == FALSE", [{"x": True}, {"x": False}, {"x": 1}], [{"x": True}, {"x": False}]),
    # conversions
    ("m.a | project s=tostring(x), l=tolong(x), r=toreal(x), b=tobool(x)", [{"x": 1}, {"x": "5.7"}, {"x": None}, {"x": True}, {"x": 2.0}], [{"s": "1", "l": 1, "r": 1.0, "b": True}, {"s": "5.7", "r": 5.7, "b": True}, {"s": "null", "l": 0, "r": 0.0, "b": False}, {"s": "true", "l": 1, "r": 1.0, "b": True}, {"s": "2", "l": 2, "r": 2.0, "b": True}]),
    ("m.a | project b=bin(x, 2)", [{"x": 5}, {"x": -1}, {"x": "s"}], [{"b": 4.0}, {"b": -2.0}, {}]),
    ('m.a | project c=case(x == 1, "one", f, "flag", "other")', [{"x": 1, "f": False}, {"x": 2, "f": None}, {"x": 2, "f": 1}, {"x": 2}, {}], [{"c": "one"}, {"c": "other"}, {"c": "flag"}, {}, {}]),
    ('m.a | project c=iff(x > 1, x, "low")', [{"x": 1}, {"x": 2}], [{"c": "low"}, {"c": 2}]),
    # projection
    ("m.a | project x, n.k, l[1]", [{"x": None, "n": {"k": 1}, "l": [1, 2]}, {"l": [3]}], [{"x": None, "n": {"k": 1}, "l": [None, 2]}, {}]),
    ("m.a | project p.q=x, p.r=y", [{"x": 1, "y": "s"}], [{"p": {"q": 1, "r": "s"}}]),
    ("m.a | extend x=x + 1, z=x", [{"x": 1}, {"x": "s", "k": 2}], [{"x": 2, "z": 1}, {"x": "s", "k": 2, "z": "s"}]),
    ("m.a | project-rename y=x, z=nothing", [{"x": 1, "k": 2}], [{"y": 1, "k": 2}]),
    ("m.a | project-rename n.b=n.a", [{"n": {"a": 1, "c": 2}}], [{"n": {"b": 1, "c": 2}}]),
    # expansion
    ("m.a | mv-expand b", [{"a": 1, "b": [1, None, "s"]}, {"a": 2, "b": 5}, {"a": 3}, {"a": 4, "b": []}, {"a": 5, "b": None}], [{"a": 1, "b": 1}, {"a": 1, "b": None}, {"a": 1, "b": "s"}, {"a": 2, "b": 5}, {"a": 3}, {"a": 5, "b": None}]),
    ("m.a | mv-expand b, c", [{"b": [1, 2], "c": ["x"]}, {"b": [3], "c": 9}], [{"b": 1, "c": "x"}, {"b": 2, "c": None}, {"b": 3, "c": 9}]),
    ("m.a | mv-expand o", [{"o": {"k": 1, "j": 2}}, {"o": {}}], [{"o": {"j": 2}}, {"o": {"k": 1}}]),
    ("m.a | mv-expand kind=array o", [{"o": {"k": 1}}], [{"o": "k"}, {"o": 1}]),
    ("m.a | mv-expand n.m", [{"n": {"m": [1, 2], "k": 0}}], [{"n": {"m": 1, "k": 0}}, {"n": {"m": 2, "k": 0}}]),
    # aggregation
    ("m.a | summarize count(), sum(x), avg(x), dcount(x), countif(x > 1)", [{"x": 1}, {"x": 3}, {"x": "s"}, {"x": None}, {}, {"x": 1.0}], [{"count_": 6, "sum_x": 5.0, "avg_x": 5 / 3, "dcount_x": 4, "countif_": 2}]),
    ("m.a | summarize lo=min(nothing), hi=max(x), n=count() | where lo < 5 and exists(hi)", [{"y": 1}], [{"lo": None, "hi": None, "n": 1}]),
    ("m.a | summarize lo=min(x) by k", [{"k": 1}, {"k": 2, "x": 5}], [{"k": 1, "lo": None}, {"k": 2, "lo": 5}]),
    ("m.a | project x=tolong(x) | summarize hi=max(x) | extend none=exists(hi) | project hi, none", [{"y": 1}], [{"hi": None, "none": True}]),
    ("m.a | summarize lo=min(x), hi=max(x)", [{"x": 4}, {"x": "s"}, {"x": True}, {}], [{"lo": True, "hi": "s"}]),
    ("m.a | summarize n=count() by k", [{"k": 1}, {"k": 1.0}, {"k": "1"}, {"k": None}, {}], [{"k": 1, "n": 2}, {"k": "1", "n": 1}]),
    ("m.a | summarize n=count() by nothing", [{"k": 1}], []),
    ("m.a | distinct k, j", [{"k": 1, "j": 2}, {"k": 1, "j": 2}, {"k": 1}], [{"k": 1, "j": 2}]),
    ("m.a | where k > 100 | summarize n=count(), s=sum(k)", [{"k": 1}], [{"n": 0, "s": 0.0}]),
    ('m.a | where temp > 900 | summarize by unit="kelvin", scale=3', [{"temp": 12}], []),
    ('m.a | summarize by unit="kelvin", scale=3', [{"temp": 12}, {"temp": 40}, {"fan": 1}], [{"unit": "kelvin", "scale": 3}]),
    ("m.a | count | count", [{"k": 1}], [{"Count": 1}]),
    # order
    ("m.a | top 2 by x desc", [{"x": 1}, {"x": "s"}, {"x": None}, {"x": 7}], [{"x": "s"}, {"x": 7}]),
    ("m.a | sort by x nulls first | limit 2", [{"x": 1}, {"x": None}, {"y": 3}], [{"x": None}, {"y": 3}]),
    ("m.a | limit 0", [{"x": 1}], []),
    ("m.a | top 1 by x", [{"x": [1, 3]}, {"x": [1, 2, 9]}], [{"x": [1, 2, 9]}]),
]


@pytest.mark.parametrize(("text", "rows", "expected"), CASES, ids=[c[0] for c in CASES])
def test_one_input(ask, text, rows, expected):
    assert ask(text, rows) == canon(expected)


TWO = [
    ("m.a | union (m.b)", [{"x": 1, "y": 2}], [{"x": "s"}, {"z": None}], [{"x": 1, "y": 2}, {"x": "s"}, {"z": None}]),
    ("m.a | union (m.b) | where x == 1 | count", [{"x": 1}], [{"x": 1}, {"x": "s"}], [{"Count": 2}]),
    ("m.a | join (m.b) on id", [{"id": 1, "v": "l"}, {"id": None, "v": "n"}, {"v": "-"}], [{"id": 1, "v": "r", "w": 0}, {"id": None, "v": "m"}, {"v": "+"}], [{"id": 1, "v": "l", "v1": "r", "w": 0}, {"id": None, "v": "n", "v1": "m"}]),
    ("m.a | join kind=outer (m.b) on id", [{"id": 1, "v": "l"}, {"id": 2, "v": "k"}, {"v": "-"}], [{"id": 1, "v": "r"}, {"id": 3, "v": "s"}], [{"id": 1, "v": "l", "v1": "r"}, {"id": 2, "v": "k"}, {"id": 3, "v": "s"}]),
    ("m.a | join kind=left (m.b) on id", [{"id": 1, "v": "l"}, {"id": 2, "v": "k"}, {"v": "-"}], [{"id": 1, "v": "r", "w": 5}], [{"id": 1, "v": "l", "w": 5}, {"id": 2, "v": "k"}]),
    ("m.a | join kind=right (m.b) on id", [{"id": 1, "v": "l", "w": 5}], [{"id": 1, "v": "r"}, {"id": 2, "v": "k"}], [{"id": 1, "v": "r", "w": 5}, {"id": 2, "v": "k"}]),
    ("m.a | join (m.b) on host", [{"host": "n1", "load": 4, "load1": 9, "load2": 6}], [{"host": "n1", "load": 5, "up": 1}], [{"host": "n1", "load": 4, "load1": 9, "load2": 6, "load3": 5, "up": 1}]),
    ("m.a | join (m.b) on $left.k == $right.j", [{"k": 1, "z": 1}], [{"j": 1.0, "z": 2}], [{"k": 1, "j": 1.0, "z": 1}]),
    ("m.a | join kind=outer (m.b | where false) on id", [{"id": 1}], [{"id": 1}], [{"id": 1}]),
    ("m.a | join (m.b | where false) on id", [{"id": 1}], [{"id": 1}], []),
    ("m.a | join hint.partitions=3 (m.b) on nothing", [{"id": 1}], [{"id": 1}], []),
]


@pytest.mark.parametrize(("text", "a", "b", "expected"), TWO, ids=[f"{i} {c[0]}" for i, c in enumerate(TWO)])
def test_two_inputs(ask, text, a, b, expected):
    assert ask(text, a, b) == canon(expected)


def test_left_join_gives_each_left_row_once(ask):
    got = ask("m.a | join kind=left (m.b) on id", [{"id": 1, "n": 1}, {"id": 1, "n": 2}], [{"id": 1, "w": 5}, {"id": 1, "w": 6}])
    assert [r["n"] for r in got] == [1, 2] and {r["w"] for r in got} <= {5, 6}


def test_lets_and_views(ask):
    rows = [{"x": i} for i in range(6)]
    assert ask("let big = m.a | where x > 2; let few = big | where x < 5; few | union (big | count)", rows) == canon([{"x": 3}, {"x": 4}, {"Count": 3}])
    assert ask("views.v | count", rows, v="m.a | where x > 3") == [{"Count": 2}]
    for text in ("nothing | count", "views.w", "n.a", "m.z"):
        with pytest.raises(NotFound):
            ask(text, rows)
    with pytest.raises(Unsupported):
        ask("", rows)


def test_empty_collection(ask):
    assert ask("m.a | where x > 1", []) == []
    assert ask("m.a | summarize n=count(), s=sum(x)", []) == [{"n": 0, "s": 0.0}]


def test_sinks(spark):
    m = MemoryConnector().by_key("k", "id")
    m.rows(spark, "a", [{"id": 1, "v": "x"}, {"id": 2, "v": "y"}])
    engine = Engine(spark, {"m": m})
    assert list(engine.rows("m.a | write m.out")) == []
    assert len(list(engine.rows("m.a | tee m.out | where id == 1"))) == 1
    assert list(engine.rows("m.out | count")) == [{"Count": 4}]
    list(engine.rows('m.a | extend v="z" | write m.k'))
    list(engine.rows("m.a | where id == 1 | write m.k"))
    assert canon(engine.rows("m.k")) == canon([{"id": 1, "v": "x"}, {"id": 2, "v": "z"}])
    with pytest.raises(Unsupported):
        list(engine.rows("m.a | project v | write m.k"))
    with pytest.raises(Unsupported):
        engine.register("views", m)


def test_status_and_failure(spark):
    m = MemoryConnector().rows(spark, "a", [{"x": 1}])
    engine = Engine(spark, {"m": m}, status=("m", "log"))
    list(engine.rows("m.a", "q1"))
    with pytest.raises(NotFound):
        list(engine.rows("m.none", "q2"))
    rows = engine.rows("m.a", "q3")
    next(rows)
    rows.close()
    assert {k: r["status"] for k, r in m.keyed["log"][1].items()} == {"q1": "success", "q2": "internal_error", "q3": "cancelled"}


def test_config(spark, tmp_path):
    (tmp_path / "logs.json").write_text('{"a": 1}\n{"a": "s", "b": null}\n')
    (tmp_path / "c.json").write_text(json.dumps({"connectors": {"f": {"type": "files", "root": str(tmp_path), "format": "json"}}, "query_status_collection": "f.x", "workflow_limits": {}}))
    engine = Engine.from_config(spark, str(tmp_path / "c.json"))
    engine.status = None
    assert canon(engine.rows("f.logs")) == canon([{"a": 1}, {"a": "s", "b": None}])
