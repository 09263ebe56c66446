"""A small terminal client of the service: queries from arguments or line by line, rows as they come.

python -m weftlog.client --url http://127.0.0.1:8080 ["t.region | count"]; a line that ends in a backslash goes on.
"""

from __future__ import annotations

import argparse
import json
import sys
import urllib.error
import urllib.request
from collections.abc import Iterator


def ask(url: str, query: str, partial: bool = False) -> Iterator[dict]:
    """The objects that the service sends: rows, marks of snapshots, or `_error`."""
    body = json.dumps({"query": query, "partial_stream": partial}).encode()
    try:
        with urllib.request.urlopen(urllib.request.Request(f"{url.rstrip('/')}/query", body)) as r:
            for line in r:
                if line.startswith(b"data: "):
                    yield json.loads(line[6:])
    except urllib.error.HTTPError as e:
        yield json.loads(e.read())


def shown(rows: Iterator[dict], out) -> int:
    """Writes rows; snapshots stand behind their number. The number of final rows."""
    n = 0
    for row in rows:
        if "_error" in row:
            problems = row["_error"]["parse"] if isinstance(row["_error"], dict) else [{"message": row["_error"]}]
            for p in problems:
                print("error" + "".join(f" {p[k]}:" for k in ("line", "column") if k in p), p["message"], file=out)
        elif mark := row.pop("_partial", None):
            if not mark.get("done"):
                print(f"[{mark['id']}]", json.dumps(row, ensure_ascii=False), file=out)
        else:
            n += 1
            print(json.dumps(row, ensure_ascii=False), file=out)
    return n


def lines(source) -> Iterator[str]:
    held = ""
    for line in source:
        held += line.rstrip("\n")
        if held.endswith("\\"):
            held = held[:-1] + "\n"
        elif held.strip():
            yield held
            held = ""


def main(given: list[str] | None = None, source=None, out=None) -> None:
    args = argparse.ArgumentParser(description="Ask the service.")
    args.add_argument("query", nargs="?")
    args.add_argument("--url", default="http://127.0.0.1:8080")
    args.add_argument("--partial", action="store_true", help="show snapshots")
    got, out = args.parse_args(given), out or sys.stdout
    for query in [got.query] if got.query else lines(source or sys.stdin):
        n = shown(ask(got.url, query, got.partial), out)
        print(f"{n} row{'s' * (n != 1)}", file=out)


if __name__ == "__main__":
    main()
