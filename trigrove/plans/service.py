"""The requests over HTTP, and a command line."""

from __future__ import annotations

import argparse
import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import SparkSession

from ..config import Config
from .engine import BadRequest, SearchEngine, build, lookup_request, search_request

PAGE = "<!doctype html><title>Search</title><form action=/search><input name=q autofocus><button>Search</button></form><p><a href=/stats>Statistics</a>"
#: Fixed value: clients read it.
UNAUTHORIZED = "Provide Authorization: Bearer <token> header or ?token=<token> param"
_OPEN = ("/", "/health")


def authorized(token: str | None, path: str, header: str | None, query: str) -> bool:
    """With a token set, all but the page and /health want it: as a bearer, or as
    the parameter ``token``, compared as it stands in the address."""
    bearer = (header or "").removeprefix("Bearer ").strip() if (header or "").startswith("Bearer ") else None
    return not token or path in _OPEN or bearer == token or f"token={token}" in query.split("&")


def respond(engine: SearchEngine, path: str, params: dict[str, str]) -> tuple[int, dict | str]:
    try:
        if path == "/search":
            return 200, search_request(engine, params)
        if path == "/lookup":
            return 200, lookup_request(engine, params)
    except BadRequest as e:
        return 400, str(e)
    if path == "/stats":
        return 200, engine.stats()
    if path == "/health":
        return 200, {"status": "ok"}
    return (200, PAGE) if path == "/" else (404, "")


def server(engine: SearchEngine, port: int | None = None) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            at = urlsplit(self.path)
            if authorized(engine.config.auth_token, at.path, self.headers.get("Authorization"), at.query):
                status, body = respond(engine, at.path, dict(parse_qsl(at.query, keep_blank_values=True)))
            else:
                status, body = 401, {"error": "unauthorized", "message": UNAUTHORIZED}
            raw = (body if isinstance(body, str) else json.dumps(body, sort_keys=True)).encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/html" if body == PAGE else "text/plain" if isinstance(body, str) else "application/json")
            self.send_header("Access-Control-Allow-Origin", "*")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_OPTIONS(self) -> None:  # noqa: N802
            self.send_response(200)
            for name in ("Origin", "Methods", "Headers"):
                self.send_header(f"Access-Control-Allow-{name}", "*")
            self.end_headers()

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer(("", engine.config.port if port is None else port), Handler)


def main(argv: list[str] | None = None) -> None:
    """``import`` builds the index, ``serve`` answers requests, ``run`` does both."""
    p = argparse.ArgumentParser(prog="trigrove")
    p.add_argument("command", choices=("import", "serve", "run"))
    p.add_argument("--config", default="trigrove.toml")
    a = p.parse_args(argv)
    config = Config.load(a.config)
    spark = SparkSession.builder.appName("trigrove").getOrCreate()
    if a.command in ("import", "run"):
        done = build(spark, config)
        print(f"{done.rows} rows in {done.seconds:.1f} s")
    if a.command in ("serve", "run"):
        with server(SearchEngine(spark, config)) as s:
            s.serve_forever()


if __name__ == "__main__":
    main()
