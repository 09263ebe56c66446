"""Connectors: named sources of collections, and the sinks among them."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import bare
from ..operators.steps import union


class NotFound(LookupError):
    status = 404


class Unsupported(ValueError):
    status = 400


def dynamic(lines: DataFrame, column: str = "value", fields: set[str] | None = None) -> DataFrame:
    """JSON objects, one a row as text, to one VARIANT column for each key that any of them has, or for each of the fields.

    Without fields the keys are found by one pass over all rows. A key that a row lacks is missing (NULL) there, a JSON null
    stays a null. Texts that are no objects are left out.
    """
    rows = lines.select(F.try_parse_json(bare(column)).alias("v")).filter(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")))
    keys = sorted(fields) if fields is not None else sorted(r.k for r in rows.select(F.explode(F.map_keys(F.try_variant_get("v", "$", "map<string,variant>"))).alias("k")).distinct().collect())  # a schema's size
    place = lambda k: "$['" + k.replace("\\", "\\\\").replace("'", "\\'") + "']"
    return rows.select(*(F.try_variant_get("v", place(k), "variant").alias(k) for k in keys))


class Connector:
    """A source of collections; what a kind does not support raises Unsupported."""

    kind = "none"

    def collections(self) -> list[str]:
        return []

    def read(self, spark: SparkSession, name: str, fields: set[str] | None = None) -> DataFrame:
        """All rows; fields: those that the query can look at, where that is known, so that a source without a schema need not look for others."""
        raise NotFound(f"no collection {name!r}")

    def raw(self, spark: SparkSession, name: str, query: str) -> DataFrame:
        raise Unsupported(f"{self.kind} takes no raw queries")

    def append(self, spark: SparkSession, name: str, df: DataFrame) -> None:
        raise Unsupported(f"{self.kind} is no sink")

    def stats(self, spark: SparkSession, name: str) -> dict[str, int] | None:
        """What is known of a collection without reading it, such as {"bytes": n}; None if nothing is."""
        return None

    def describe(self) -> dict:
        return {"type": self.kind}


class MemoryConnector(Connector):
    """Collections that live as long as the engine: rows that only grow, or rows by a primary key that are replaced."""

    kind = "memory"

    def __init__(self):
        self.frames: dict[str, DataFrame] = {}
        self.keyed: dict[str, tuple[str, dict]] = {}
        self.lock = threading.Lock()

    def collections(self) -> list[str]:
        return sorted({*self.frames, *self.keyed})

    def put(self, name: str, df: DataFrame) -> MemoryConnector:
        self.frames[name] = df
        return self

    def rows(self, spark: SparkSession, name: str, rows: Iterable[dict]) -> MemoryConnector:
        """JSON-like rows of any shape."""
        return self.put(name, dynamic(spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")))

    def by_key(self, name: str, key: str) -> MemoryConnector:
        self.keyed[name] = (key, {})
        return self

    def upsert(self, name: str, row: dict) -> None:
        key, rows = self.keyed[name]
        if row.get(key) is None:
            raise Unsupported(f"a row has no {key!r}")
        with self.lock:
            rows[row[key]] = {**row}

    def read(self, spark: SparkSession, name: str, fields: set[str] | None = None) -> DataFrame:
        if name in self.keyed:
            return dynamic(spark.createDataFrame([(json.dumps(r, default=str),) for r in self.keyed[name][1].values()], "value string"), fields=fields)
        if name not in self.frames:
            raise NotFound(f"no collection {name!r}")
        return self.frames[name]

    def append(self, spark: SparkSession, name: str, df: DataFrame) -> None:
        """Rows are kept as files of the shared folder; a collection with a key takes them one by one."""
        if name in self.keyed:
            for line in df.select(F.to_json(F.struct("*")).alias("v")).toLocalIterator():
                self.upsert(name, json.loads(line.v))
            return
        kept = df if hasattr(df, "stored_at") else stored(spark, df)
        with self.lock:
            self.frames[name] = union(self.frames[name], kept) if name in self.frames else kept


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir; where that is unset a temporary one, if all of Spark runs in this one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        import re
        import tempfile

        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise Unsupported("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="weftlog-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/weftlog/{uuid.uuid4().hex}"


def stored(spark: SparkSession, df: DataFrame) -> DataFrame:
    path = shared_folder(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


class FileConnector(Connector):
    """Each collection is `<root>/<name>.<format>` (or the path given for it): parquet, json lines, csv or orc.

    aliases: collection -> {column: alias}, such as {"events": {"ts": "@time"}}; variants: collection -> JSON text columns.
    """

    kind = "files"

    def __init__(self, root: str, format: str = "parquet", paths: dict[str, str] | None = None, aliases: dict[str, dict[str, str]] | None = None, variants: dict[str, list[str]] | None = None):
        self.root, self.format, self.paths = root.rstrip("/"), format, paths or {}
        self.aliases, self.variants = aliases or {}, variants or {}

    def collections(self) -> list[str]:
        return sorted(self.paths)

    def read(self, spark: SparkSession, name: str, fields: set[str] | None = None) -> DataFrame:
        path = self.paths.get(name, f"{self.root}/{name}.{self.format}")
        try:
            if self.format == "json":
                own = {alias: c for c, alias in self.aliases.get(name, {}).items()}
                df = dynamic(spark.read.text(path), fields=None if fields is None else {own.get(f, f) for f in fields})
            else:
                df = spark.read.format(self.format).options(**({"header": "true", "inferSchema": "true"} if self.format == "csv" else {})).load(path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                raise NotFound(f"no collection {name!r}") from None
            raise
        names = self.aliases.get(name, {})
        cols = [F.try_parse_json(bare(c)).alias(names.get(c, c)) if c in self.variants.get(name, ()) else bare(c).alias(names.get(c, c)) for c in df.columns]
        return df.select(*cols)

    def raw(self, spark: SparkSession, name: str, query: str) -> DataFrame:
        """Spark SQL in which the collection is a view of its name."""
        self.read(spark, name).createOrReplaceTempView(name)
        return spark.sql(query)

    def append(self, spark: SparkSession, name: str, df: DataFrame) -> None:
        df.write.mode("append").format(self.format).save(self.paths.get(name, f"{self.root}/{name}.{self.format}"))

    def stats(self, spark: SparkSession, name: str) -> dict[str, int] | None:
        place = spark._jvm.org.apache.hadoop.fs.Path(self.paths.get(name, f"{self.root}/{name}.{self.format}"))
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        return {"bytes": files.getContentSummary(place).getLength()} if files.exists(place) else None

    def describe(self) -> dict:
        return {"type": self.kind, "root": self.root, "format": self.format}


class TableConnector(Connector):
    """Tables of the session's catalog."""

    kind = "tables"

    def __init__(self, database: str | None = None):
        self.database = database

    def _name(self, name: str) -> str:
        return f"{self.database}.{name}" if self.database else name

    def read(self, spark: SparkSession, name: str, fields: set[str] | None = None) -> DataFrame:
        if not spark.catalog.tableExists(self._name(name)):
            raise NotFound(f"no collection {name!r}")
        return spark.table(self._name(name))

    def raw(self, spark: SparkSession, name: str, query: str) -> DataFrame:
        return spark.sql(query)

    def append(self, spark: SparkSession, name: str, df: DataFrame) -> None:
        df.write.mode("append").saveAsTable(self._name(name))

    def describe(self) -> dict:
        return {"type": self.kind, "database": self.database}


def made(config: dict) -> Connector:
    """A connector from its configuration: {"type": "files", "root": ...} and the like."""
    kinds: dict = {"memory": MemoryConnector, "files": FileConnector, "tables": TableConnector}
    options = {k: v for k, v in config.items() if k != "type"}
    if config.get("type") in ("elasticsearch", "quickwit", "splunk"):
        from . import remote

        return remote.made(config["type"], options)
    if config.get("type") not in kinds:
        raise Unsupported(f"unknown type of connector {config.get('type')!r}")
    return kinds[config["type"]](**options)
