"""Remote search engines: what of a query they can do themselves, as text for each of them, and reading over HTTP.

A scan gives the collection's fields as VARIANT columns, only those that the query can look at where it closes its rows. Filters
go to the engine and are repeated here, since an engine's text matching is wider than the language's. Behind filters that
engines answer exactly (comparisons, lists, existence), limits, sorted limits, counts and aggregations go there too.
Aggregations come back as partial groups, which Spark adds up, so that pages, slices and fallbacks may split a group.
Reading is a Python data source: one task a slice.
"""

from __future__ import annotations

import base64
import json
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.expressions import bare
from ..operators import steps as S
from ..plans.needs import needed, roots
from ..plans.nodes import Agg, Call, Item, Lit, Path, Query, Step
from .catalog import Connector, NotFound, Unsupported, dynamic

PAGE = 5000


class NotPushed(Exception):
    """The engine cannot do this part."""


def field_and_literal(e: Call, names: dict[str, str]) -> tuple[str, Any, bool]:
    """Field, literal, and whether they stand the other way round; paths with list indices are not pushed."""
    a, b = e.args
    turned = isinstance(a, Lit)
    path, lit = (b, a) if turned else (a, b)
    if not isinstance(path, Path) or not isinstance(lit, Lit) or any(ix for _, ix in path.parts) or lit.kind in ("null", "timespan"):
        raise NotPushed
    return field_of(path, names), lit.value.isoformat() + "Z" if lit.kind == "datetime" else lit.value, turned


def field_of(path: Any, names: dict[str, str]) -> str:
    """The engine's name of a field."""
    if not isinstance(path, Path) or any(ix for _, ix in path.parts):
        raise NotPushed
    name = ".".join(path.names)
    return names.get(name, name)


TURNED = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}
RANGES = {"<": "lt", "<=": "lte", ">": "gt", ">=": "gte"}


def search_filter(e, names: dict[str, str], phrase: str) -> dict:
    """A filter as query DSL; phrase: the text operator that the engine has (`has` or `has_cs`)."""
    if not isinstance(e, Call):
        raise NotPushed
    if e.name in ("and", "or"):
        return {"bool": {"must" if e.name == "and" else "should": [search_filter(x, names, phrase) for x in e.args]}}
    if e.name == "not":
        return {"bool": {"must_not": search_filter(e.args[0], names, phrase)}}
    if e.name == "exists":
        return {"exists": {"field": field_of(e.args[0], names)}}
    if e.name == "in" and all(isinstance(x, Lit) and x.kind != "null" for x in e.args[1:]):
        return {"terms": {field_of(e.args[0], names): [x.value for x in e.args[1:]]}}
    if e.name not in ("==", "!=", *RANGES, "startswith", phrase):
        raise NotPushed
    name, value, turned = field_and_literal(e, names)
    op = TURNED.get(e.name, e.name) if turned else e.name
    if op == "==":
        return {"term": {name: value}}
    if op == "!=":
        return {"bool": {"must": [{"exists": {"field": name}}], "must_not": {"term": {name: value}}}}
    if op in RANGES:
        return {"range": {name: {RANGES[op]: value}}}
    return {"match_phrase_prefix" if op == "startswith" else "match_phrase": {name: value}}


def spl_filter(e, names: dict[str, str]) -> str:
    """A filter as a `where` condition of the search language."""

    def text(v: Any) -> str:
        return json.dumps(v) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)

    if not isinstance(e, Call):
        raise NotPushed
    if e.name in ("and", "or"):
        return f"({spl_filter(e.args[0], names)} {e.name.upper()} {spl_filter(e.args[1], names)})"
    if e.name == "not":
        return f"NOT ({spl_filter(e.args[0], names)})"
    if e.name == "exists":
        return f"isnotnull('{field_of(e.args[0], names)}')"
    if e.name == "in" and all(isinstance(x, Lit) and x.kind != "null" for x in e.args[1:]):
        return f"'{field_of(e.args[0], names)}' IN ({', '.join(text(x.value) for x in e.args[1:])})"
    if e.name not in ("==", "!=", *RANGES, "startswith", "has", "has_cs"):
        raise NotPushed
    name, value, turned = field_and_literal(e, names)
    op = TURNED.get(e.name, e.name) if turned else e.name
    if op == "startswith":
        return f"like('{name}', {text(str(value) + '%')})"
    if op in ("has", "has_cs"):
        return f"like({'lower(' if op == 'has' else ''}'{name}'{')' if op == 'has' else ''}, {text('%' + (value.lower() if op == 'has' else value) + '%')})"
    return f"'{name}' {'=' if op == '==' else op} {text(value)}"


def exact(e) -> bool:
    """Whether engines answer the filter as the language means it: text search is theirs."""
    if e.name in ("and", "or", "not"):
        return all(isinstance(x, Call) and exact(x) for x in e.args)
    return e.name not in ("has", "has_cs", "startswith", "endswith", "contains")


@dataclass
class Pushed:
    """What an engine does of a pipeline's first steps, and how many of them it does for good."""

    collections: list[str]
    filters: list = field(default_factory=list)
    sort: list = field(default_factory=list)
    limit: int | None = None
    count: bool = False
    group: Step | None = None
    loose: bool = False
    taken: int = 0

    @property
    def closed(self) -> bool:
        return self.count or self.group is not None

    @property
    def plain(self) -> bool:
        """Nothing but filters."""
        return not (self.closed or self.sort or self.limit is not None)


def push(collection: str, steps: tuple[Step, ...], one_filter, groups=lambda step: False, joins=lambda q, wheres: None) -> Pushed:
    """Takes steps from the front: filters (not behind a sort or limit), unions with the same filters over another collection, a sort with a limit, limits, and one count or aggregation."""
    out, wheres = Pushed([collection]), []
    for s in steps:
        if out.closed:
            break
        if s.kind == "where" and not out.sort and out.limit is None:
            try:
                out.filters.append(one_filter(s.args["expr"]))
            except NotPushed:
                break
            wheres.append(s)
            out.loose = out.loose or not exact(s.args["expr"])
        elif out.loose:
            break
        elif s.kind == "union" and out.plain and (other := joins(s.args["query"], wheres)):
            out.collections.append(other)
        elif s.kind == "limit":
            out.limit = s.args["n"] if out.limit is None else min(out.limit, s.args["n"])
        elif s.kind == "top" and not out.sort and out.limit is None and not any(ix for k in s.args["keys"] for _, ix in k.path.parts):
            out.sort, out.limit = [(".".join(k.path.names), k.desc, k.nulls_first) for k in s.args["keys"]], s.args["n"]
        elif s.kind == "count" and out.limit is None and not out.sort:
            out.count = True
        elif s.kind == "summarize" and out.limit is None and not out.sort and groups(s):
            out.group = s
        else:
            break
        out.taken += 1
    return out


# partial groups: keys k0, k1, ..., rows n, and for each aggregation i a number or pair ai, ai_n


def partials(step: Step) -> list[tuple[str, str, Agg]]:
    """For each aggregation but count(): its name in a partial group, the engine's function, and itself."""
    kinds = {"sum": "sum", "avg": "sum", "min": "min", "max": "max", "countif": "value_count"}
    return [(f"a{i}", kinds[a.name], a) for i, a in enumerate(step.args["aggs"]) if a.name != "count"]


def of_row(row: dict, step: Step, names: dict[str, str]) -> dict:
    """A row as a partial group of its own."""

    def at(path: Path) -> Any:
        v: Any = row
        for part in field_of(path, names).split("."):
            v = v.get(part) if isinstance(v, dict) else None
        return v

    out: dict = {f"k{i}": at(item.expr) for i, item in enumerate(step.args["by"])} | {"n": 1}
    for name, kind, a in partials(step):
        v = at(a.arg.args[0] if a.name == "countif" else a.arg)
        number = isinstance(v, (int, float)) and not isinstance(v, bool)
        out[name] = int(v is not None) if kind == "value_count" else v if number or kind in ("min", "max") else 0
        if a.name == "avg":
            out[f"{name}_n"] = int(number)
    return out


def added_up(df: DataFrame, step: Step) -> DataFrame:
    """The groups of an aggregation from its partial groups."""
    field_path = lambda n: Path(((n, ()),))
    by, aggs = step.args["by"], step.args["aggs"]
    # names as the aggregation itself would give them
    shape = S.summarize(df.sparkSession.createDataFrame([], ", ".join(f"`{r}` double" for r in sorted(roots(step))) or "x int"), aggs, by)
    named = shape.columns[: len(by)]
    sums = [Agg(field_path("n"), "sum", field_path("n"))]
    for name, _, a in partials(step):
        sums.append(Agg(field_path(name), a.name if a.name in ("min", "max") else "sum", field_path(name)))
        if a.name == "avg":
            sums.append(Agg(field_path(f"{name}_n"), "sum", field_path(f"{name}_n")))
    found = S.summarize(df, tuple(sums), tuple(Item(field_path(f"g{i}"), field_path(f"k{i}")) for i in range(len(by))))
    cols = [bare(f"g{i}").alias(n) for i, n in enumerate(named)]
    for i, (a, name) in enumerate(zip(aggs, shape.columns[len(by) :], strict=True)):
        c = bare("n" if a.name == "count" else f"a{i}")
        if a.name in ("count", "countif"):
            c = c.cast("bigint")
        elif a.name == "avg":
            c = F.when(bare(f"a{i}_n") > 0, c / bare(f"a{i}_n")).otherwise(F.lit(0.0))
        cols.append(c.alias(name))
    return found.select(*cols)


class RemoteConnector(Connector):
    """url: the engine's; auth: {"user", "password"} or {"api_key"} or {"token"}; aliases: collection -> {field: alias}.

    push_limits: whether limits, counts and aggregations go to the engine behind exact filters, or alone.
    """

    phrase = "has"
    slices = 1

    def __init__(self, url: str, auth: dict | None = None, aliases: dict[str, dict[str, str]] | None = None, timeout: float = 30.0, push_limits: bool = True):
        self.url, self.auth, self.aliases, self.timeout, self.push_limits = url.rstrip("/"), auth or {}, aliases or {}, timeout, push_limits

    def headers(self) -> dict[str, str]:
        out = {"Content-Type": "application/json"}
        if "user" in self.auth:
            out["Authorization"] = "Basic " + base64.b64encode(f"{self.auth['user']}:{self.auth.get('password', '')}".encode()).decode()
        elif "api_key" in self.auth:
            out["Authorization"] = f"ApiKey {self.auth['api_key']}"
        elif "token" in self.auth:
            out["Authorization"] = f"Bearer {self.auth['token']}"
        return out

    def call(self, path: str, body: Any = None, method: str | None = None, raw: bytes | None = None) -> Any:
        data = raw if raw is not None else None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(self.url + path, data, self.headers(), method=method)
        with urllib.request.urlopen(request, timeout=self.timeout) as r:
            return json.loads(r.read() or b"null")

    def names(self, collection: str) -> dict[str, str]:
        return {alias: name for name, alias in self.aliases.get(collection, {}).items()}

    def fields(self, collection: str) -> dict[str, str]:
        """The types of fields that can be grouped and added up, by the engine's own name; empty if it does not tell."""
        return {}

    def groups(self, collection: str):
        """Whether an aggregation can go to the engine: plain keys, and numbers or existence to aggregate."""
        names = self.names(collection)

        def run(step: Step) -> bool:
            try:
                types = self.fields(collection)
                keys = [field_of(item.expr, names) for item in step.args["by"]]
                if any(types.get(k) in (None, "text", "date") for k in keys):
                    return False
                for a in step.args["aggs"]:
                    if a.name == "countif":
                        if not isinstance(a.arg, Call) or a.arg.name != "exists" or field_of(a.arg.args[0], names) not in types:
                            return False
                    elif a.name != "count" and (a.name == "dcount" or types.get(field_of(a.arg, names)) != "number"):
                        return False
                return True
            except (NotPushed, OSError, ValueError, KeyError):
                return False

        return run

    def joins(self, collection: str, connector: str | None):
        """The other collection of a union with the same filters on this connector, if both have the same aliases."""

        def run(q: Query, wheres: list[Step]) -> str | None:
            if connector is None or q.lets or not q.steps or q.steps[0].kind != "scan" or "raw" in q.steps[0].args:
                return None
            a = q.steps[0].args
            same = a["connector"] == connector and self.aliases.get(a["collection"], {}) == self.aliases.get(collection, {})
            return a["collection"] if same and list(map(str, q.steps[1:])) == list(map(str, wheres)) else None

        return run

    def compile(self, collection: str, steps: tuple[Step, ...], connector: str | None = None) -> tuple[Any, Pushed]:
        """The engine's own query for the steps that it takes."""
        names = self.names(collection)
        p = push(collection, steps, lambda e: search_filter(e, names, self.phrase), self.groups(collection), self.joins(collection, connector))
        query = {"bool": {"must": p.filters}} if len(p.filters) > 1 else p.filters[0] if p.filters else {"match_all": {}}
        body: dict = {"query": query}
        if p.sort:
            body["sort"] = [{names.get(n, n): {"order": "desc" if d else "asc", "missing": "_first" if f else "_last"}} for n, d, f in p.sort]
        if p.limit is not None:
            body["size"] = p.limit
        if p.group:
            body["group"] = {"keys": [field_of(i.expr, names) for i in p.group.args["by"]], "aggs": [[name, kind, field_of(a.arg.args[0] if a.name == "countif" else a.arg, names), a.name == "avg"] for name, kind, a in partials(p.group)]}
        if p.count:
            body["count"] = True
        return body, p

    def read(self, spark: SparkSession, name: str, fields: set[str] | None = None) -> DataFrame:
        return self.rows(spark, name, self.compile(name, ())[0], fields)

    def pushed(self, spark: SparkSession, name: str, steps: tuple[Step, ...], connector: str | None = None, fields: set[str] | None = None) -> tuple[DataFrame, int]:
        """The rows after the first steps, which the engine has done, and how many these are.

        Filters alone are repeated in Spark and so count as not done. fields: what to give at least, where that is known.
        """
        body, p = self.compile(name, steps, connector)
        if p.plain and len(p.collections) == 1 or not self.push_limits:
            own = tuple(s for s in steps[: next((i for i, s in enumerate(steps) if s.kind != "where"), len(steps))])
            body, _ = self.compile(name, own)
            return self.rows(spark, name, body, needed(steps) if fields is None else fields), 0
        name = ",".join(p.collections)
        if p.count:
            return self.lines(spark, name, body).select(F.get_json_object("value", "$.Count").cast("bigint").alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("Count")), p.taken
        if p.group:
            made = [f"k{i}" for i in range(len(p.group.args["by"]))] + ["n"] + [x for n, _, a in partials(p.group) for x in (n, f"{n}_n")[: 1 + (a.name == "avg")]]
            return added_up(dynamic(self.lines(spark, name, body), fields=set(made)), p.group), p.taken
        return self.rows(spark, name, body, needed(steps[p.taken :]) if fields is None else fields), p.taken

    def lines(self, spark: SparkSession, name: str, body: Any, slices: int = 1) -> DataFrame:
        spark.dataSource.register(PagedSource)
        return spark.read.format("weftlog_paged").options(kind=self.kind, url=self.url, auth=json.dumps(self.auth), collection=name, body=json.dumps(body), slices=str(slices)).load()

    def rows(self, spark: SparkSession, name: str, body: Any, fields: set[str] | None = None) -> DataFrame:
        """The rows of an engine's own query, their fields as VARIANT; a field with the alias @time as time. fields: those to be given, if they are known."""
        collection = name.split(",")[0]
        names, several = self.names(collection), not (isinstance(body, dict) and ("size" in body or "sort" in body))
        wanted = None if fields is None else {names.get(f, f) for f in fields}
        if isinstance(body, dict) and wanted is not None and "query" in body:
            body = body | {"_source": sorted(wanted)}
        df = dynamic(self.lines(spark, name, body, self.slices if several else 1), fields=wanted)
        for alias, field_name in names.items():
            if field_name in df.columns:
                df = df.withColumn(field_name, as_time(bare(field_name))) if alias == "@time" else df
                df = df.withColumnRenamed(field_name, alias)
        return df

    def pages(self, name: str, body: Any, part: int = 0, parts: int = 1) -> Iterator[dict]:
        raise NotImplementedError

    def describe(self) -> dict:
        return {"type": self.kind, "url": self.url}


def as_time(c):
    """A text of a time, or seconds or milliseconds since 1970, as timestamp."""
    n = F.try_variant_get(c, "$", "double")
    kind = F.substring(F.schema_of_variant(c), 1, 3)
    return F.when(kind == "STR", F.try_variant_get(c, "$", "string").try_cast("timestamp")).when(n.isNotNull(), F.timestamp_micros((n * F.when(F.abs(n) < 1e11, 1e6).otherwise(1e3)).cast("bigint")))


class SearchConnector(RemoteConnector):
    """What engines with the search API of JSON bodies and scrolls have in common."""

    prefix = ""

    def scroll(self, name: str, body: dict, part: int, parts: int) -> Iterator[dict]:
        """Page after page, and no more than the body's size in all."""
        limit, given = body.get("size"), 0
        if limit == 0:
            return
        body = {k: v for k, v in body.items() if k not in ("count", "group")} | {"size": PAGE if limit is None else min(PAGE, limit)}
        got = self.call(f"{self.prefix}/{name}/_search?scroll=1m", body | ({"slice": {"id": part, "max": parts}} if parts > 1 else {}))
        while hits := got["hits"]["hits"]:
            for h in hits:
                yield h["_source"]
                given += 1
                if given == limit:
                    return
            got = self.call(f"{self.prefix}/_search/scroll", {"scroll": "1m", "scroll_id": got["_scroll_id"]})

    def pages(self, name: str, body: dict, part: int = 0, parts: int = 1) -> Iterator[dict]:
        if body.get("count"):
            yield {"Count": self.total(name, body["query"])}
        elif "group" in body:
            yield from self.grouped(name, body)
        else:
            yield from self.scroll(name, body, part, parts)

    def total(self, name: str, query: dict) -> int:
        return self.call(f"{self.prefix}/{name}/_count", {"query": query})["count"]

    def grouped(self, name: str, body: dict) -> Iterator[dict]:
        raise NotImplementedError

    @staticmethod
    def metrics(group: dict) -> dict:
        """The aggregations inside a group; a mean is a sum and a count."""
        out = {n: {kind: {"field": f}} for n, kind, f, _ in group["aggs"]}
        return out | {f"{n}_n": {"value_count": {"field": f}} for n, _, f, mean in group["aggs"] if mean}

    @classmethod
    def partial(cls, bucket: dict, group: dict, keys: list) -> dict:
        values = {k: bucket[k]["value"] for k in cls.metrics(group)}
        return {f"k{i}": v for i, v in enumerate(keys)} | {"n": bucket["doc_count"]} | {k: v for k, v in values.items() if v is not None}


class ElasticsearchConnector(SearchConnector):
    kind = "elasticsearch"
    #: Parts in which all rows of a query are read at once.
    slices = 8

    def collections(self) -> list[str]:
        return sorted(x["index"] for x in self.call("/_cat/indices?format=json"))

    def fields(self, collection: str) -> dict[str, str]:
        out: dict[str, str] = {}

        def walk(properties: dict, path: str) -> None:
            for k, v in properties.items():
                t = v.get("type", "object")
                out[path + k] = "number" if t in ("long", "integer", "short", "byte", "double", "float", "half_float", "unsigned_long") else "date" if t.startswith("date") else t
                walk(v.get("properties", {}), f"{path}{k}.")

        for index in self.call(f"/{collection}/_mapping").values():
            walk(index["mappings"].get("properties", {}), "")
        return out

    def grouped(self, name: str, body: dict) -> Iterator[dict]:
        """Composite groups, page after page, so that no group is left out; one group for all rows where there are no keys."""
        group, after = body["group"], None
        if not group["keys"]:
            got = self.call(f"/{name}/_search", {"size": 0, "track_total_hits": True, "query": body["query"], "aggs": self.metrics(group)})
            yield self.partial({"doc_count": got["hits"]["total"]["value"], **got["aggregations"]}, group, []) if group["aggs"] else {"n": got["hits"]["total"]["value"]}
            return
        sources = [{f"k{i}": {"terms": {"field": k}}} for i, k in enumerate(group["keys"])]
        while True:
            composite = {"size": PAGE, "sources": sources} | ({"after": after} if after else {})
            got = self.call(f"/{name}/_search", {"size": 0, "query": body["query"], "aggs": {"g": {"composite": composite, "aggs": self.metrics(group)}}})["aggregations"]["g"]
            for b in got["buckets"]:
                yield self.partial(b, group, list(b["key"].values()))
            after = got.get("after_key")
            if not after or not got["buckets"]:
                return


class QuickwitConnector(SearchConnector):
    kind, phrase, prefix = "quickwit", "has_cs", "/api/v1/_elastic"
    #: Groups that one level of terms gives at most; where there are more, rows are read and grouped here.
    MOST = 65_000

    def collections(self) -> list[str]:
        return sorted(x["index_config"]["index_id"] for x in self.call("/api/v1/indexes"))

    def fields(self, collection: str) -> dict[str, str]:
        kinds = {"u64": "number", "i64": "number", "f64": "number", "datetime": "date", "text": "keyword", "bool": "boolean"}
        mapped = self.call(f"/api/v1/indexes/{collection}")["index_config"]["doc_mapping"]["field_mappings"]
        return {f["name"]: kinds.get(f["type"], "text") for f in mapped if f.get("fast")}

    def raw(self, spark: SparkSession, name: str, query: str) -> DataFrame:
        try:
            return self.rows(spark, name, json.loads(query))
        except ValueError:
            raise Unsupported("a raw query is a JSON body") from None

    def total(self, name: str, query: dict) -> int:
        return self.call(f"{self.prefix}/{name}/_search", {"size": 0, "track_total_hits": True, "query": query})["hits"]["total"]["value"]

    def grouped(self, name: str, body: dict) -> Iterator[dict]:
        """Terms inside terms; if one of them leaves groups out, every row is a group of its own."""
        group = body["group"]
        aggs = self.metrics(group)
        for i, k in reversed(list(enumerate(group["keys"]))):
            aggs = {f"k{i}": {"terms": {"field": k, "size": self.MOST}, "aggs": aggs}}
        got = self.call(f"{self.prefix}/{name}/_search", {"size": 0, "track_total_hits": True, "query": body["query"], "aggs": aggs})
        found: list[dict] = []

        def walk(bucket: dict, keys: list) -> bool:
            if len(keys) == len(group["keys"]):
                found.append(self.partial(bucket, group, keys))
                return True
            level = bucket[f"k{len(keys)}"]
            return not level.get("sum_other_doc_count") and all(walk(b, [*keys, b.get("key_as_string", b["key"])]) for b in level["buckets"])

        if walk({"doc_count": got["hits"]["total"]["value"], **got.get("aggregations", {})}, []):
            yield from found
            return
        at = lambda n: Path(tuple((x, ()) for x in n.split(".")))
        by = tuple(Item(None, at(k)) for k in group["keys"])
        rows = {int(n[1:]): Agg(None, "avg" if mean else {"value_count": "countif"}.get(kind, kind), Call("exists", (at(f),)) if kind == "value_count" else at(f)) for n, kind, f, mean in group["aggs"]}
        step = Step("summarize", {"aggs": tuple(rows.get(i, Agg(None, "count")) for i in range(max(rows, default=-1) + 1)), "by": by})
        for row in self.scroll(name, {"query": body["query"]}, 0, 1):
            yield of_row(row, step, {})


class SplunkConnector(RemoteConnector):
    kind = "splunk"
    #: Seconds between two looks at a job.
    POLL, PREVIEW = 0.5, 2.0

    def names(self, collection: str) -> dict[str, str]:
        return {"@time": "_time", **super().names(collection)}

    def collections(self) -> list[str]:
        return sorted(x["name"] for x in self.call("/services/data/indexes?output_mode=json&count=0")["entry"])

    def groups(self, collection: str):
        """All values are texts there, so numbers are told by the search language itself; least and greatest are left to Spark."""
        names = self.names(collection)

        def run(step: Step) -> bool:
            try:
                keys = [field_of(item.expr, names) for item in step.args["by"]]
                args = [field_of(a.arg.args[0] if a.name == "countif" else a.arg, names) for a in step.args["aggs"] if a.name != "count"]
                return "_time" not in (*keys, *args) and all(a.name in ("count", "sum", "avg") or a.name == "countif" and a.arg.name == "exists" for a in step.args["aggs"])
            except (NotPushed, AttributeError):
                return False

        return run

    def compile(self, collection: str, steps: tuple[Step, ...], connector: str | None = None) -> tuple[str, Pushed]:
        names = self.names(collection)
        p = push(collection, steps, lambda e: spl_filter(e, names), self.groups(collection), self.joins(collection, connector))
        where = " OR ".join(f'index="{c}"' for c in p.collections)
        if p.count and not p.filters:  # counted on the index, without reading events
            return f"| tstats count as Count where {where}", p
        parts = [f"search {where}", *(f"where {f}" for f in p.filters)]
        if p.sort and not (len(p.sort) == 1 and p.sort[0][:2] == ("@time", True)):
            parts.append("sort 0 " + ", ".join(("-" if d else "+") + names.get(n, n) for n, d, _ in p.sort))
        if p.limit is not None:
            parts.append(f"head {p.limit}")
        if p.count:
            parts.append("stats count as Count")
        if p.group:
            keys = [field_of(i.expr, names) for i in p.group.args["by"]]
            told = ["count as n"]
            for name, _, a in partials(p.group):
                f = field_of(a.arg.args[0] if a.name == "countif" else a.arg, names)
                told.append(f'count("{f}") as {name}' if a.name == "countif" else f'sum("{f}") as {name}')
                if a.name == "avg":
                    told.append(f'count(eval(isnum(\'{f}\'))) as {name}_n')
            parts.append(f"stats {' '.join(told)}" + (" by " + " ".join(f'"{k}"' for k in keys) if keys else ""))
            parts += [f'rename "{k}" as k{i}' for i, k in enumerate(keys)]
        return " | ".join(parts), p

    def rows(self, spark: SparkSession, name: str, body: Any, fields: set[str] | None = None) -> DataFrame:
        names = self.names(name.split(",")[0])
        if fields is not None and isinstance(body, str) and body.startswith("search "):
            body = f"{body} | fields {' '.join(json.dumps(names.get(f, f)) for f in sorted(fields))}" if fields else body
        return super().rows(spark, name, body, fields)

    def started(self, body: str) -> str:
        from urllib.parse import urlencode

        return self.call("/services/search/jobs?output_mode=json", raw=urlencode({"search": body, "exec_mode": "normal"}).encode())["sid"]

    def done(self, job: str) -> bool:
        return bool(self.call(f"/services/search/jobs/{job}?output_mode=json")["entry"][0]["content"]["isDone"])

    def found(self, job: str, kind: str = "results") -> Iterator[dict]:
        at = 0
        while rows := self.call(f"/services/search/jobs/{job}/{kind}?output_mode=json&count={PAGE}&offset={at}")["results"]:
            for r in rows:
                yield {k: numbered(v) if k == "n" or k == "Count" or k[:1] == "a" and k[1:].removesuffix("_n").isdigit() else v for k, v in r.items()}
            at += len(rows)

    def pages(self, name: str, body: str, part: int = 0, parts: int = 1) -> Iterator[dict]:
        import time

        job = self.started(body)
        while not self.done(job):
            time.sleep(self.POLL)
        yield from self.found(job)

    def previews(self, name: str, body: str) -> Iterator[tuple[bool, list[dict]]]:
        """What a running job has found so far, again and again, and at last (True) all that it found; bounded by what the search returns."""
        import time

        job, last = self.started(body), None
        while not self.done(job):
            rows = list(self.found(job, "results_preview"))
            if rows and rows != last:
                yield False, rows
                last = rows
            time.sleep(self.PREVIEW)
        yield True, list(self.found(job))


def numbered(v: Any) -> Any:
    """A number that came as text."""
    try:
        return int(v) if isinstance(v, str) and v.lstrip("-").isdigit() else float(v) if isinstance(v, str) else v
    except ValueError:
        return v


KINDS: dict[str, type[RemoteConnector]] = {c.kind: c for c in (ElasticsearchConnector, QuickwitConnector, SplunkConnector)}


def made(kind: str, options: dict) -> RemoteConnector:
    if kind not in KINDS:
        raise NotFound(f"no connector of type {kind!r}")
    return KINDS[kind](**options)


class PagedSource(DataSource):
    """Rows of a remote query as JSON texts."""

    @classmethod
    def name(cls) -> str:
        return "weftlog_paged"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(dict(self.options))


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(int(self.options["slices"]))]

    def read(self, partition: InputPartition):
        o = self.options
        source = made(o["kind"], {"url": o["url"], "auth": json.loads(o["auth"])})
        for row in source.pages(o["collection"], json.loads(o["body"]), partition.value, int(o["slices"])):
            yield (json.dumps(row),)
