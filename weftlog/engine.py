"""The engine: connectors, views and variables, and queries to DataFrames."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path as FilePath

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .functions import values as V
from .functions.expressions import NULLS, Expressions, bare
from .operators import steps as S
from .plans.needs import connectors, mentioned, needed, queries
from .plans.nodes import Call, Lit, Path, Query, Step
from .plans.parser import parse
from .sources.catalog import Connector, FileConnector, MemoryConnector, NotFound, Unsupported, made, stored
from .sources.remote import RemoteConnector

VIEWS = "views"


@dataclass
class Run:
    """One execution of a query: what its tees have kept, so that each writes once however often it is used.

    names: of a run that only plans, the fields that the query mentions; sources without a schema are not read for others, and
    nothing is written. steps: counters of the rows behind each step, if they are wanted.
    """

    names: set[str] | None = None
    kept: dict[int, tuple[Step, DataFrame]] = field(default_factory=dict)
    steps: list[tuple[str, Observation]] | None = None

    @property
    def dry(self) -> bool:
        return self.names is not None


@dataclass
class Options:
    """pushdown: whether remote engines do what they can of a query; most_keys: how many distinct keys of one side of a join go
    to the other side as a filter, if that is a remote scan; one_type: whether sort and group keys of several types are an
    error; count_steps: whether rows() counts what each step gives, and what its filters cannot tell; stats_age: seconds after
    which what is known of a collection is asked for again.
    """

    pushdown: bool = True
    most_keys: int = 10_000
    one_type: bool = False
    count_steps: bool = False
    stats_age: float = 3 * 3600.0


class Engine:
    """Queries over named connectors. Field names are case-sensitive and times are UTC, which the session is set to."""

    def __init__(self, spark: SparkSession, connectors: dict[str, Connector] | None = None, status: tuple[str, str] | None = None, options: Options | None = None):
        spark.conf.set("spark.sql.caseSensitive", "true")
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.connectors, self.options = spark, dict(connectors or {}), options or Options()
        self.views: dict[str, tuple[str, Query]] = {}
        self.status, self.lock, self.idle = status, threading.RLock(), threading.Condition()
        self.users: Counter[str] = Counter()
        self.metrics = {"queries": 0, "failed": 0, "cancelled": 0, "rows": 0, "running": 0, "seconds": 0.0}
        self.steps: Counter[tuple[str, str]] = Counter()
        self.known: dict[tuple[str, str], tuple[float, dict[str, int] | None]] = {}

    @classmethod
    def from_config(cls, spark: SparkSession, path: str) -> Engine:
        """A JSON file with `connectors` (id -> {"type", ...}), `query_status_collection` ("connector.collection") and `workflow_limits` (accepted; Spark spills instead), `options` (see Options)."""
        config = json.loads(FilePath(path).read_text())
        engine = cls(spark, {k: made(v) for k, v in config.get("connectors", {}).items()})
        engine.options = Options(**config.get("options", {}))
        if place := config.get("query_status_collection"):
            engine.status = tuple(place.split(".", 1)) if isinstance(place, str) else (place["connector"], place["collection"])
        return engine

    # connectors and views
    def register(self, name: str, connector: Connector) -> Engine:
        if name == VIEWS:
            raise Unsupported(f"{VIEWS!r} is reserved")
        with self.lock:
            self.connectors[name] = connector
        return self

    def connector(self, name: str) -> Connector:
        if name not in self.connectors:
            raise NotFound(f"no connector {name!r}")
        return self.connectors[name]

    def remove(self, name: str, timeout: float | None = None) -> None:
        """Takes a connector out at once; returns when the last query that uses it has ended."""
        self.connector(name)
        with self.lock:
            del self.connectors[name]
        with self.idle:
            self.idle.wait_for(lambda: not self.users[name], timeout)

    def stats(self, name: str, collection: str) -> dict[str, int] | None:
        """What is known of a collection without reading it, asked again after options.stats_age seconds."""
        at, found = self.known.get((name, collection), (float("-inf"), None))
        if time.monotonic() - at > self.options.stats_age:
            found = self.connector(name).stats(self.spark, collection)
            self.known[name, collection] = time.monotonic(), found
        return found

    def create_view(self, name: str, text: str) -> None:
        """The query is parsed now, so now() means this moment ever after."""
        self.views[name] = (text, parse(text))

    def view(self, name: str) -> tuple[str, Query]:
        if name not in self.views:
            raise NotFound(f"no view {name!r}")
        return self.views[name]

    # queries
    def query(self, text: str, now: datetime | None = None) -> DataFrame:
        return self.lower(self.parsed(text, now), {})

    def parsed(self, text: str, now: datetime | None = None) -> Query:
        q = parse(text, now)
        if not q.steps:
            raise Unsupported("the query is empty")
        return q

    def lower(self, q: Query, env: dict[str, Query], run: Run | None = None) -> DataFrame:
        df, env, steps, run = None, self.scope(q, env), q.steps, run or Run()
        if steps and steps[0].kind == "scan" and "raw" not in steps[0].args and steps[0].args["connector"] != VIEWS:
            a, rest = steps[0].args, steps[1:]
            source, fields = self.connector(a["connector"]), run.names
            if isinstance(source, RemoteConnector) and self.options.pushdown and not run.dry:
                df, done = source.pushed(self.spark, a["collection"], rest, a["connector"])
            else:
                df, done = source.read(self.spark, a["collection"], needed(rest) if fields is None else fields), 0
            steps = rest[done:]
        for step in steps:
            df = self.apply(df, step, env, run)
            if run.steps is not None:
                df = self.counted(df, step, run)
        if df is None:
            raise Unsupported("the query is empty")
        return df

    def scope(self, q: Query, env: dict) -> dict:
        env = dict(env)
        for name, value in q.lets:
            env[name] = (value, dict(env))
        return env

    def apply(self, df: DataFrame | None, step: Step, env: dict, run: Run | None = None) -> DataFrame:
        a, run = step.args, run or Run()
        if step.kind == "variable":
            if a["name"] not in env:
                raise NotFound(f"no variable {a['name']!r}")
            return self.lower(*env[a["name"]], run)
        if step.kind == "scan":
            if a["connector"] == VIEWS and "raw" not in a:
                return self.lower(self.view(a["collection"])[1], env, run)
            source = self.connector(a["connector"])
            return source.raw(self.spark, a["collection"], a["raw"]) if "raw" in a else source.read(self.spark, a["collection"], run.names)
        if df is None:
            raise Unsupported("a query starts with a source")
        if step.kind in ("tee", "write"):
            return self.sink(df, step, run)
        if step.kind == "union":
            return S.union(df, self.lower(a["query"], env, run))
        if step.kind == "join":
            right = a["query"] if run.dry else self.narrowed(df, a)
            return S.join(df, self.lower(right, env, run), a["kind"], a["left"], a["right"], a["partitions"], a["kind"] == "left" and unique(right, a["right"]))
        if self.options.one_type and not run.dry and step.kind in ("sort", "top", "summarize"):
            S.one_type(df, tuple(k.path for k in a["keys"]) if step.kind != "summarize" else tuple(i.expr for i in a["by"]))
        one = {
            "where": lambda: S.where(df, a["expr"]),
            "project": lambda: S.project(df, a["items"]),
            "extend": lambda: S.extend(df, a["items"]),
            "project-rename": lambda: S.rename(df, a["pairs"]),
            "mv-expand": lambda: S.expand(df, a["kind"], a["paths"]),
            "limit": lambda: df.limit(a["n"]),
            "sort": lambda: S.sort(df, a["keys"]),
            "top": lambda: S.top(df, a["n"], a["keys"]),
            "summarize": lambda: S.summarize(df, a["aggs"], a["by"]),
            "count": lambda: S.count(df),
        }
        return one[step.kind]()

    def sink(self, df: DataFrame, step: Step, run: Run) -> DataFrame:
        """Writes the rows, once in a run; a tee goes on with the rows that were kept, not with a second computation."""
        connector, collection = step.args["sink"]
        target = self.connector(connector)
        if run.dry:
            return df if step.kind == "tee" else df.limit(0)
        if id(step) not in run.kept:
            rows = stored(self.spark, df) if step.kind == "tee" and df.columns else df
            target.append(self.spark, collection, rows)
            run.kept[id(step)] = step, rows if step.kind == "tee" else df.limit(0)
        return run.kept[id(step)][1]

    def narrowed(self, left: DataFrame, a: dict) -> Query:
        """The right side of an inner or left join, with the left side's distinct keys as a filter if it is a remote scan and they are few."""
        q, path = a["query"], a["right"]
        remote = not q.lets and q.steps and q.steps[0].kind == "scan" and isinstance(self.connectors.get(q.steps[0].args["connector"]), RemoteConnector)
        if not remote or a["kind"] not in ("inner", "left") or not self.options.pushdown or any(ix for _, ix in path.parts) or any(s.kind not in ("scan", "where") for s in q.steps):
            return q
        key = Expressions(left).path(a["left"])
        if key.family not in (V.NUMBER, V.STRING, V.BOOL):
            return q
        found = left.select(key.col.alias("k")).filter("k is not null").distinct().limit(self.options.most_keys + 1).collect()  # most_keys rows at most
        if len(found) > self.options.most_keys or any(not isinstance(r.k, (bool, int, float, str)) for r in found):
            return q
        kinds = {bool: "bool", int: "int", float: "float", str: "string"}
        return Query(q.lets, (q.steps[0], Step("where", {"expr": Call("in", (path, *(Lit(kinds[type(r.k)], r.k) for r in found)))}), *q.steps[1:])) if found else q

    def counted(self, df: DataFrame, step: Step, run: Run) -> DataFrame:
        seen = Observation()
        run.steps.append((step.kind, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"))

    def explain(self, text: str) -> str:
        """The steps, and Spark's plan for them. No row is read and nothing is written; files tell their schema.

        Sources without a schema, remote ones among them, stand with the fields that the query mentions.
        """
        q = self.parsed(text)
        every = mentioned(q).union(*(mentioned(v) for _, v in self.views.values()))
        plan = self.lower(q, {}, Run(every))._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        lets = "".join(f"let {n} = {' | '.join(map(str, v.steps))};\n" for n, v in q.lets)
        return lets + "\n".join(f"{'  ' * i}{s}" for i, s in enumerate(q.steps)) + "\n\n" + plan

    @contextmanager
    def running(self, text: str, query_id: str | None = None):
        """A query's tag, by which its jobs can be ended, its row in the status collection, its counters, and its hold on connectors."""
        note, began, used = Status(self, query_id or str(uuid.uuid4()), text), time.monotonic(), set()
        self.spark.addTag(note.row["id"])
        self.metrics["running"] += 1
        try:
            q = self.parsed(text)
            used = connectors(q).union(*(connectors(v) for _, v in self.views.values())) if any(s.kind == "scan" and s.args["connector"] == VIEWS for x in queries(q) for s in x.steps) else connectors(q)
            with self.idle:
                self.users.update(used)
            yield note
            note.now("success", done=True)
        except GeneratorExit:
            self.metrics["cancelled"] += 1
            self.cancel(note.row["id"])
            note.now("cancelled", done=True)
            raise
        except Exception as e:
            self.metrics["failed"] += 1
            note.now("connector_error" if isinstance(e, OSError) else "internal_error", str(e), done=True)
            raise
        finally:
            self.spark.removeTag(note.row["id"])
            self.metrics["running"] -= 1
            self.metrics["seconds"] += time.monotonic() - began
            with self.idle:
                self.users.subtract({u: 1 for u in used})
                self.idle.notify_all()

    def rows(self, text: str, query_id: str | None = None) -> Iterator[dict]:
        """The rows as objects; a missing field is left out, a null is None. Keeps the status collection, if there is one."""
        with self.running(text, query_id) as note:
            run = Run(steps=[] if self.options.count_steps else None)
            df = self.lower(self.parsed(text), {}, run)
            note.now("running")
            lines = json_lines(df)
            if run.steps:  # counters come with a write; reading them would wait for ever without one
                lines = stored(self.spark, lines)
                for kind, seen in run.steps:
                    self.steps[kind, "rows"] += seen.get["rows"]
            for line in lines.toLocalIterator():
                self.metrics["rows"] += 1
                yield json.loads(line.value)

    def cancel(self, query_id: str) -> None:
        """Ends the jobs of a running query."""
        self.spark.interruptTag(query_id)


def unique(q: Query, key: Path) -> bool:
    """Whether a query gives each value of the key once: it ends in an aggregation by that alone."""
    last = q.steps[-1] if q.steps else None
    return last is not None and last.kind == "summarize" and [t for t in S.targets(last.args["by"])] == [key.names]


def json_lines(df: DataFrame) -> DataFrame:
    if not df.columns:
        return df.select(F.lit("{}").alias("value"))
    cols = [F.coalesce(V.to_variant(bare(f.name), f.dataType), V.null()).alias(f.name) if f.metadata.get(NULLS) else bare(f.name) for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*cols)).alias("value"))


class Status:
    """One query's row in the status collection: planning, running, then success, an error, or cancelled."""

    def __init__(self, engine: Engine, query_id: str, text: str):
        self.engine, self.began = engine, time.time()
        engine.metrics["queries"] += 1
        self.row = {"id": query_id, "status": None, "error": None, "start_time": stamp(self.began), "end_time": None, "run_time": None, "run_time_secs": None, "update_time": None, "query": text}
        self.now("planning")

    def now(self, status: str, error: str | None = None, done: bool = False) -> None:
        t = time.time()
        self.row |= {"status": status, "error": error, "update_time": stamp(t)}
        if done:
            self.row |= {"end_time": stamp(t), "run_time": f"{t - self.began:.6f}s", "run_time_secs": t - self.began}
        if self.engine.status:
            connector, collection = self.engine.status
            sink = self.engine.connector(connector)
            if isinstance(sink, MemoryConnector):
                if collection not in sink.keyed:
                    sink.by_key(collection, "id")
                sink.upsert(collection, self.row)


def stamp(t: float) -> str:
    return datetime.fromtimestamp(t, UTC).isoformat()


def tables(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine with the parquet tables of a folder as connector `t`; events have `@time`, and props as VARIANT."""
    return Engine(spark, {"t": FileConnector(sf_dir, aliases={"events": {"ts": "@time"}}, variants={"events": ["props"]}), "m": MemoryConnector()})
