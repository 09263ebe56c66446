"""Every query of the pipe language against its SQL on DuckDB; progressive results; the service."""

import io
import json
import shutil
import threading
import urllib.error
import urllib.request
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from weftlog import client
from weftlog.engine import tables
from weftlog.queries import ORACLE, QUERIES
from weftlog.server import serve
from weftlog.sources.catalog import FileConnector
from weftlog.streaming.partial import partial_rows

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rounded(v):
    return float(f"{v:.10g}") if isinstance(v, float) else v


def in_order(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(([rounded(r[i]) for i in order] for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet/*')" if Path(f"{SF}/{t}.parquet").is_dir() else f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = in_order(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLE:
        r = duck.execute(ORACLE[name])
        assert got == in_order([d[0] for d in r.description], r.fetchall())


def test_all_embeddings_are_expanded(spark, duck):
    df = QUERIES["mv_expand_array"](spark, SF)
    n = duck.execute("SELECT sum(len(embedding)), count(DISTINCT vec_id) FROM embeddings").fetchone()
    assert (df.count(), df.select("vec_id").distinct().count()) == n


def test_filters_reach_the_scan(spark):
    plan = tables(spark, SF).explain('t.lineitem | where l_quantity > 45 and l_returnflag == "R" and l_shipdate > datetime(1995-01-01) | project l_orderkey')
    assert "GreaterThan(l_quantity,45" in plan and "EqualTo(l_returnflag,R)" in plan and "GreaterThan(l_shipdate," in plan
    assert "l_comment" not in plan and "ReadSchema: struct<l_orderkey" in plan


@pytest.mark.parametrize(
    ("text", "pushed"),
    [
        ('t.orders | where o_orderstatus == "F" or o_totalprice > 200000', ["Or(EqualTo(o_orderstatus,F)", "GreaterThan(o_totalprice,200000.0)"]),
        ('t.orders | where not(o_orderstatus == "F" and o_orderkey < 500)', ["Or(Not(EqualTo(o_orderstatus,F))", "GreaterThanOrEqual(o_orderkey,500)"]),
        ('t.orders | where o_orderpriority in ("1-URGENT", "2-HIGH", 5)', ["In(o_orderpriority, [1-URGENT,2-HIGH])"]),
        ("t.lineitem | where l_quantity !between (2 .. 49)", ["Or(LessThan(l_quantity,2.0)", "GreaterThan(l_quantity,49.0)"]),
    ],
)
def test_other_filters_reach_the_scan(spark, text, pushed):
    plan = tables(spark, SF).explain(text)
    filters = next(x for x in plan.split("\n") if "PushedFilters" in x)
    assert all(p in filters for p in pushed), filters


def test_left_join_by_a_unique_key_is_not_reduced_first(spark):
    plan = tables(spark, SF).explain("t.orders | join kind=left (t.orders | summarize n=count() by o_custkey) on o_custkey")
    assert "min_by" not in plan and "min_by" in tables(spark, SF).explain("t.orders | join kind=left (t.customer) on $left.o_custkey == $right.c_custkey")


def test_explain_starts_no_job(spark, tmp_path):
    """With files that tell their schema, and json lines whose fields are those that the query mentions."""
    (tmp_path / "logs.json").write_text('{"a": 1, "b": {"c": 2}}\n{"a": "s", "d": null}\n')
    engine = tables(spark, SF)
    engine.register("j", FileConnector(str(tmp_path), "json"))
    spark.sparkContext.setJobGroup("explained", "")
    try:
        engine.explain("j.logs | where b.c == 2 | union (j.logs | tee m.kept) | write m.kept")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("explained")) == []
    assert list(engine.rows("j.logs | summarize n=count(), s=sum(b.c)")) == [{"n": 2, "s": 2.0}] and list(engine.rows("j.logs | count")) == [{"Count": 2}]
    assert sorted(engine.rows("j.logs"), key=str) == [{"a": "s", "d": None}, {"a": 1, "b": {"c": 2}}]


def test_parts_of_a_scan_do_not_grow_with_the_table(spark, tmp_path):
    """Four times the table gives no task more rows to write. All rows are kept, in six parts."""
    rows, most = spark.read.parquet(f"{SF}/lineitem.parquet"), {}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        for copies in (4, 16):
            table = tmp_path / str(copies) / "lineitem.parquet"
            table.mkdir(parents=True)
            for k in range(copies):
                shutil.copy(f"{SF}/lineitem.parquet", table / f"{k}.parquet")
            df = QUERIES["scan_parts"](spark, str(table.parent))
            assert [tuple(r) for r in df.collect()] == [(6000 * copies, 6)]
            kept = spark.read.parquet(*df.inputFiles())
            assert kept.select(rows.columns).exceptAll(spark.read.parquet(str(table))).isEmpty()
            most[copies] = max(r["count"] for r in kept.groupBy(F.input_file_name()).count().collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert most[16] == most[4]


def test_parts_of_few_rows(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet")
    for n, few in enumerate((rows.limit(0), rows.limit(12).repartition(12))):
        few.write.parquet(f"{tmp_path}/{n}/lineitem.parquet")
        assert [tuple(r) for r in QUERIES["scan_parts"](spark, f"{tmp_path}/{n}").collect()] == [(12 * n, 6 * n)]


def test_client(spark):
    server = serve(tables(spark, SF), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url, out = f"http://127.0.0.1:{server.server_address[1]}", io.StringIO()
    try:
        client.main(["--url", url], ["t.region \\\n", "| count\n", "\n", "t.region | where\n"], out)
        client.main(["--url", url, "--partial", "t.nation | union (t.nation) | count"], None, out)
    finally:
        server.shutdown()
    lines = out.getvalue().splitlines()
    assert lines[:2] == ['{"Count": 5}', "1 row"] and lines[2].startswith("error 1:") and lines[3] == "0 rows" and lines[-2:] == ['{"Count": 50}', "1 row"] and '[0] {"Count": 25}' in lines


def test_connectors_go_when_unused(spark):
    engine = tables(spark, SF)
    rows = engine.rows("t.customer")
    next(rows)
    gone = threading.Thread(target=engine.remove, args=("t",))
    gone.start()
    gone.join(0.3)
    assert gone.is_alive() and "t" not in engine.connectors
    rows.close()
    gone.join(20)
    assert not gone.is_alive()


def test_partial_rows(spark):
    engine = tables(spark, SF)
    text = "t.nation | project k=n_regionkey | union (t.nation | project k=n_regionkey) | summarize n=count() by k"
    rows = list(partial_rows(engine, text, 0))
    marks = [r["_partial"] for r in rows if "_partial" in r]
    final = [r for r in rows if "_partial" not in r]
    assert marks[-1] == {"id": 0, "done": True} and len(final) == 5 and {r["n"] for r in final} == {10}
    assert {r["n"] for r in rows if "_partial" in r and "n" in r} == {5}
    assert "_partial" not in json.dumps(list(partial_rows(engine, "t.region | count")))


def test_service(spark):
    server = serve(tables(spark, SF), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"

    def call(path, body=None, method=None):
        r = urllib.request.Request(base + path, None if body is None else json.dumps(body).encode(), method=method)
        try:
            with urllib.request.urlopen(r, timeout=60) as x:
                return x.status, x.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode()

    try:
        assert call("/health") == (200, "OK")
        assert call("/query", {"query": "t.region | count"}) == (200, 'data: {"Count": 5}\n\n')
        status, body = call("/query", {"query": "t.region | where | limit x"})
        assert status == 400 and len(json.loads(body)["_error"]["parse"]) == 2
        assert call("/query", {"query": "u.region"})[0] == 404
        assert "limit n=3" in call("/explain", {"query": "t.region | limit 3"})[1]
        assert call("/views/v", "t.region | limit 2")[0] == 200 and call("/views/v")[1] == '"t.region | limit 2"'
        assert call("/query", {"query": "views.v | count", "partial_stream": True})[1] == 'data: {"Count": 2}\n\n'
        assert call("/views/v", method="DELETE")[0] == 200 and call("/views/v")[0] == 404
        assert call("/connectors/x", {"type": "memory"})[0] == 200 and json.loads(call("/connectors/x")[1]) == {"type": "memory"}
        assert call("/connectors/x", method="DELETE")[0] == 200 and call("/connectors/y", {"type": "none"})[0] == 400
        assert "weftlog_queries_total" in call("/metrics")[1]
    finally:
        server.shutdown()
