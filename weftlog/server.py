"""A thin HTTP service: queries as server-sent events, plans, connectors, views, health and counters.

python -m weftlog.server --config config.json --listen 127.0.0.1:8080
"""

from __future__ import annotations

import argparse
import json
import logging
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .engine import Engine, Options
from .plans.parser import ParseError
from .sources.catalog import made
from .streaming.partial import partial_rows


def failure(e: Exception) -> tuple[int, dict]:
    """Status and body; what went wrong inside is not told."""
    if isinstance(e, ParseError):
        return 400, e.as_dict()
    status = getattr(e, "status", 500)
    return status, {"_error": str(e.args[0] if e.args else e) if status < 500 else "internal error"}


log = logging.getLogger("weftlog")

#: What the service answers, as an OpenAPI document.
PATHS = {
    "/query": {"post": "Runs a query ({query_id?, query, partial_stream?}); rows as server-sent events"},
    "/explain": {"post": "The steps and the plan of a query, which is not run"},
    "/connectors": {"get": "All connectors"},
    "/connectors/{id}": {"get": "One connector", "post": "Adds or replaces a connector", "delete": "Removes a connector once no query uses it"},
    "/views": {"get": "All views"},
    "/views/{id}": {"get": "One view", "post": "Adds or replaces a view", "delete": "Removes a view"},
    "/health": {"get": "OK"},
    "/metrics": {"get": "Counters"},
}


def openapi() -> dict:
    one = [{"name": "id", "in": "path", "required": True, "schema": {"type": "string"}}]
    return {"openapi": "3.0.3", "info": {"title": "weftlog", "version": "1"}, "paths": {p: {m: {"summary": t, "responses": {"200": {"description": "OK"}}, **({"parameters": one} if "{id}" in p else {})} for m, t in methods.items()} for p, methods in PATHS.items()}}


def counters(engine: Engine) -> str:
    """All counters, one a line; those of steps with the step's name."""
    lines = [f"weftlog_{k}{'' if k == 'running' else '_total'} {v}" for k, v in engine.metrics.items()]
    lines += [f'weftlog_step_{what}_total{{step="{step}"}} {n}' for (step, what), n in sorted(engine.steps.items())]
    lines += [f'weftlog_connector_users{{connector="{name}"}} {n}' for name, n in sorted(engine.users.items())]
    return "\n".join(lines) + "\n"


def handler(engine: Engine) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.0"

        def log_message(self, form: str, *args) -> None:
            log.info(form, *args)

        def answer(self, status: int, body, kind: str = "application/json") -> None:
            raw = (body if kind != "application/json" else json.dumps(body)).encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def body(self):
            return json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))) or b"null")

        def guarded(self, run) -> None:
            try:
                run()
            except BrokenPipeError:
                pass
            except Exception as e:
                self.answer(*failure(e))

        def do_GET(self) -> None:
            self.guarded(self.get)

        def do_POST(self) -> None:
            self.guarded(self.post)

        def do_DELETE(self) -> None:
            self.guarded(self.delete)

        def get(self) -> None:
            match self.path.strip("/").split("/"):
                case ["health"]:
                    self.answer(200, "OK", "text/plain")
                case ["metrics"]:
                    self.answer(200, counters(engine), "text/plain")
                case ["openapi.json"]:
                    self.answer(200, openapi())
                case [""]:
                    self.answer(200, "".join(f"<p><b>{m.upper()} {p}</b> {t}</p>" for p, x in PATHS.items() for m, t in x.items()), "text/html")
                case ["connectors"]:
                    self.answer(200, {k: c.describe() for k, c in engine.connectors.items()})
                case ["connectors", name]:
                    self.answer(200, engine.connector(name).describe())
                case ["views"]:
                    self.answer(200, {k: text for k, (text, _) in engine.views.items()})
                case ["views", name]:
                    self.answer(200, engine.view(name)[0])
                case _:
                    self.answer(404, {"_error": "no such page"})

        def post(self) -> None:
            match self.path.strip("/").split("/"):
                case ["query"]:
                    self.stream(self.body())
                case ["explain"]:
                    self.answer(200, engine.explain(self.body()["query"]), "text/plain")
                case ["connectors", name]:
                    engine.register(name, made(self.body()))
                    self.answer(200, {})
                case ["views", name]:
                    engine.create_view(name, self.body())
                    self.answer(200, {})
                case _:
                    self.answer(404, {"_error": "no such page"})

        def delete(self) -> None:
            match self.path.strip("/").split("/"):
                case ["connectors", name]:
                    engine.remove(name)
                    self.answer(200, {})
                case ["views", name]:
                    engine.view(name)
                    del engine.views[name]
                    self.answer(200, {})
                case _:
                    self.answer(404, {"_error": "no such page"})

        def stream(self, request: dict) -> None:
            engine.parsed(request["query"])  # errors of the text come before the stream
            partial = request.get("partial_stream")
            debounce = partial.get("debounce", 1.0) if isinstance(partial, dict) else 1.0
            rows = partial_rows(engine, request["query"], debounce, request.get("query_id")) if partial else engine.rows(request["query"], request.get("query_id"))
            first = next(rows, None)
            self.send_response(200)
            self.send_header("Content-Type", "text/event-stream")
            self.end_headers()
            try:
                while first is not None:
                    self.wfile.write(f"data: {json.dumps(first)}\n\n".encode())
                    self.wfile.flush()
                    first = next(rows, None)
            except BrokenPipeError:
                rows.close()  # the reader is gone: end the jobs
            except Exception as e:
                self.wfile.write(f"data: {json.dumps(failure(e)[1])}\n\n".encode())

    return Handler


def serve(engine: Engine, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    return ThreadingHTTPServer((host, port), handler(engine))


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"time": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(record.created)), "level": record.levelname, "message": record.getMessage()})


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    args = argparse.ArgumentParser(description="Serve queries over HTTP.")
    args.add_argument("--config", help="JSON file of connectors")
    args.add_argument("--listen", default="127.0.0.1:8080")
    args.add_argument("--log-json", action="store_true", help="log lines as JSON objects")
    args.add_argument("--no-optimizations", action="store_true", help="remote engines only give rows, and no keys go to them")
    args.add_argument("--dynamic-filter-max-distinct-values", type=int, default=None, help="distinct keys of a join's left side that go to a remote right side as a filter")
    args.add_argument("--count-steps", action="store_true", help="count the rows behind each step")
    return args.parse_args(given)


def configured(spark, got: argparse.Namespace) -> Engine:
    engine = Engine.from_config(spark, got.config) if got.config else Engine(spark, options=Options())
    if got.no_optimizations:
        engine.options.pushdown = False
    if got.dynamic_filter_max_distinct_values is not None:
        engine.options.most_keys = got.dynamic_filter_max_distinct_values
    engine.options.count_steps = engine.options.count_steps or got.count_steps
    return engine


def main() -> None:
    from pyspark.sql import SparkSession

    got = arguments()
    out = logging.StreamHandler()
    if got.log_json:
        out.setFormatter(JsonLines())
    logging.basicConfig(level=logging.INFO, handlers=[out])
    host, _, port = got.listen.rpartition(":")
    serve(configured(SparkSession.builder.appName("weftlog").getOrCreate(), got), host, int(port)).serve_forever()


if __name__ == "__main__":
    main()
