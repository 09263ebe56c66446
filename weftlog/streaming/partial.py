"""Progressive results: a query over unions, or over a source that tells what it has found so far, gives snapshots, then its final rows.

The branches of the unions before the last counting step (limit, top, summarize, count) run one after another; each is kept in
the shared folder, so that a snapshot reads what earlier ones have made and no branch runs twice. Branches that are scans of a
source with previews run there meanwhile; a Coordinator decides which of their previews make up a snapshot.
"""

from __future__ import annotations

import json
import queue
import threading
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame

from ..engine import Engine, Run, json_lines
from ..operators.steps import union
from ..plans.needs import roots
from ..plans.nodes import Query, Step
from ..sources.catalog import dynamic, stored
from ..sources.remote import SplunkConnector

MERGING = ("limit", "top", "summarize", "count")
PASSING = ("where", "project", "extend", "project-rename", "mv-expand")
MARK = "_partial"


def cut(steps: tuple[Step, ...]) -> int | None:
    """The merging step whose snapshots are shown: the last one, behind a union and with only passing steps after it."""
    for i in range(len(steps) - 1, -1, -1):
        if steps[i].kind in MERGING:
            return i if any(s.kind == "union" for s in steps[:i]) else None
        if steps[i].kind not in PASSING:
            return None
    return None


class Coordinator:
    """Which previews belong together: the n-th of all sources that still run, beside all that those which ended have found.

    What a source has found at last replaces its previews. Only the previews that wait for others are held, `most` rows of them;
    beyond that the largest waiting snapshot is left out.
    """

    def __init__(self, sources, most: int = 1_000_000):
        self.live, self.done, self.most = set(sources), {}, most
        self.given, self.waiting, self.next = dict.fromkeys(self.live, 0), {}, 0

    def put(self, source, rows: list) -> list[dict]:
        """A source's next preview; the snapshots that are complete now, each source -> rows."""
        n = self.given[source]
        self.given[source] += 1
        if n >= self.next:
            self.waiting.setdefault(n, {})[source] = rows
        size = {k: sum(map(len, v.values())) for k, v in self.waiting.items()}
        if sum(size.values()) > self.most:
            del self.waiting[max(size, key=size.get)]
        return self.complete()

    def finish(self, source, rows) -> list[dict]:
        self.live.discard(source)
        self.done[source] = rows
        for v in self.waiting.values():
            v.pop(source, None)
        return self.complete()

    def complete(self) -> list[dict]:
        out = []
        for n in sorted(self.waiting):
            if self.live and self.live <= self.waiting[n].keys():
                out.append({**self.done, **self.waiting[n]})
                for old in [k for k in self.waiting if k <= n]:
                    del self.waiting[old]
                self.next = n + 1
        return out


def branches(steps: tuple[Step, ...]) -> list[tuple[Query | None, list[Step]]]:
    """Each union's branch (its query; None: the first) with the steps that follow it; steps of other kinds between unions end the split before them."""
    first = max((i for i, s in enumerate(steps) if s.kind not in (*PASSING, "union")), default=0)
    parts: list[tuple[Query | None, list[Step]]] = [(None, list(steps[: first + 1]))]
    for s in steps[first + 1 :]:
        if s.kind == "union":
            parts.append((s.args["query"], []))
        else:
            for _, own in parts:
                own.append(s)
    return parts


def previewed(engine: Engine, part: tuple[Query | None, list[Step]]) -> tuple[SplunkConnector, str, list[Step]] | None:
    """For a branch that is a scan of a source with previews and passing steps: the source, the collection, and the steps."""
    q, own = part
    steps = [*(q.steps if q else ()), *own]
    if q and q.lets or not steps or steps[0].kind != "scan" or "raw" in steps[0].args or any(s.kind not in PASSING for s in steps[1:]):
        return None
    source = engine.connectors.get(steps[0].args["connector"])
    return (source, steps[0].args["collection"], steps[1:]) if isinstance(source, SplunkConnector) else None


def partial_rows(engine: Engine, text: str, debounce: float = 1.0, query_id: str | None = None) -> Iterator[dict]:
    """Rows of snapshots have `_partial: {"id": n}`; `{"_partial": {"id": n, "done": true}}` ends one; final rows have no mark.

    A snapshot that is due less than `debounce` seconds after the one before is left out.
    """
    q = engine.parsed(text)
    env, at, run = engine.scope(q, {}), cut(q.steps), Run()
    if at is None:
        at = next((i for i, s in enumerate(q.steps) if s.kind in MERGING), None)
        parts = branches(q.steps[:at]) if at else []
        if len(parts) != 1 or not previewed(engine, parts[0]):
            yield from engine.rows(text, query_id)
            return
    else:
        parts = branches(q.steps[:at])
    spark, found = engine.spark, queue.Queue()

    def after(df: DataFrame, steps) -> DataFrame:
        for s in steps:
            df = engine.apply(df, s, env, run)
        return df

    def objects(df: DataFrame) -> Iterator[dict]:
        for line in json_lines(after(df, q.steps[at:])).toLocalIterator():
            yield json.loads(line.value)

    def local(rows: list[dict], i: int) -> DataFrame:
        source, name, steps = watched[i]
        own = source.names(name)
        names = {own.get(r, r) for s in (*steps, *q.steps[at:]) for r in roots(s)} | {k for r in rows for k in r}
        df = dynamic(spark.createDataFrame([(json.dumps(r),) for r in rows], "value string"), fields=names)
        return after(df.withColumnsRenamed({f: alias for alias, f in own.items()}), steps)

    def watch(i: int) -> None:
        source, name, steps = watched[i]
        wheres = tuple(s for s in steps[: next((k for k, s in enumerate(steps) if s.kind != "where"), len(steps))])
        try:
            for done, rows in source.previews(name, source.compile(name, wheres)[0]):
                found.put((i, done, rows))
        except Exception as e:
            found.put((i, True, e))

    watched = {i: w for i, p in enumerate(parts) if (w := previewed(engine, p))}
    together, kept, number, shown = Coordinator(watched), {}, 0, float("-inf")
    for i in watched:
        threading.Thread(target=watch, args=(i,), daemon=True).start()

    def snapshot(previews: dict) -> Iterator[dict]:
        nonlocal number, shown
        frames = [kept[i] if i in kept else local(previews[i], i) for i in range(len(parts)) if i in kept or i in previews]
        if frames and time.monotonic() - shown >= debounce:
            so_far = frames[0]
            for f in frames[1:]:
                so_far = union(so_far, f)
            for row in objects(so_far):
                yield {**row, MARK: {"id": number}}
            yield {MARK: {"id": number, "done": True}}
            number, shown = number + 1, time.monotonic()

    def told(wait: bool) -> Iterator[dict]:
        """What the sources with previews have sent meanwhile; waits for one message if asked to."""
        while wait or not found.empty():
            i, done, rows = found.get()
            if isinstance(rows, Exception):
                raise rows
            if done:
                kept[i] = stored(spark, local(rows, i))
            for previews in together.finish(i, None) if done else together.put(i, rows):
                yield from snapshot(previews)
            wait = False

    with engine.running(text, query_id) as note:
        note.now("running")
        for i, (source, own) in enumerate(parts):
            if i in watched:
                continue
            df = engine.lower(source, env, run) if source else None
            kept[i] = stored(spark, after(df, own) if df is not None else engine.lower(Query((), tuple(own)), env, run))
            yield from told(False)
            if len(kept) < len(parts):
                yield from snapshot({})
        while len(kept) < len(parts):
            yield from told(True)
        whole = kept[0]
        for i in range(1, len(parts)):
            whole = union(whole, kept[i])
        for row in objects(whole):
            engine.metrics["rows"] += 1
            yield row
