"""A small JSON service over a store: routes as a table, requests as plain function calls, and a stdlib HTTP server."""

from __future__ import annotations

import json
import re
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from vecspark.sources.snapshots import to_results
from vecspark.sources.store import MemoryStore, StoreError

MAX_DESCRIPTION = 512


class HttpError(Exception):
    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


class Service:
    def __init__(self, store: MemoryStore):
        self.store, self.started = store, time.time()
        one = "/collections/(?P<name>[^/]+)"
        self.routes = [
            ("GET", "/health", self.health),
            ("GET", "/__instance", self.instance),
            ("GET", "/collections", self.list),
            ("PUT", one, self.create),
            ("GET", one, self.describe),
            ("DELETE", one, self.drop),
            ("PUT", f"{one}/points", self.upsert),
            ("GET", f"{one}/points/count", self.count),
            ("POST", f"{one}/points/search", self.search),
            ("POST", f"{one}/points/scroll", self.scroll),
            ("POST", f"{one}/points/delete", self.delete_by_filter),
            ("GET", f"{one}/points/(?P<id>[^/]+)", self.get),
            ("DELETE", f"{one}/points/(?P<id>[^/]+)", self.delete),
        ]

    def handle(self, method: str, path: str, body: dict | None = None) -> tuple[int, dict]:
        """Status and JSON answer of a request."""
        began = time.perf_counter()
        try:
            found = [(m, f, x) for m, pattern, f in self.routes if (x := re.fullmatch(pattern, path))]
            if not found:
                raise HttpError(404, f"no route {path}")
            call = next(((f, x) for m, f, x in found if m == method), None)
            if call is None:
                raise HttpError(405, f"{method} isn't allowed here")
            result = call[0](body or {}, **call[1].groupdict())
            return 200, {"result": result, "status": "ok", "time_ms": round((time.perf_counter() - began) * 1000, 3)}
        except HttpError as e:
            return e.status, {"status": "error", "error": str(e)}
        except (ValueError, KeyError, TypeError, StoreError) as e:
            return 400, {"status": "error", "error": str(e)}
        except Exception as e:  # noqa: BLE001
            return 500, {"status": "error", "error": str(e)}

    def _known(self, name: str) -> None:
        if not self.store.has(name):
            raise HttpError(404, f"there is no collection {name}")

    def health(self, body: dict) -> Any:
        return {"status": "closed" if self.store.is_closed else "up"}

    def instance(self, body: dict) -> Any:
        counts = {n: self.store.count(n) for n in self.store.names()}
        return {"uptime_ms": int((time.time() - self.started) * 1000), "collections": len(counts), "points_total": sum(counts.values())}

    def list(self, body: dict) -> Any:
        return {"collections": self.store.names()}

    def create(self, body: dict, name: str) -> Any:
        description = str(body.get("description") or "")
        if len(description) > MAX_DESCRIPTION:
            raise ValueError(f"the description has over {MAX_DESCRIPTION} characters")
        self.store.create(name, int(body.get("dimension", 128)), str(body.get("metric", "COSINE")).upper(), body.get("index_type"), body.get("index_params"), description)
        return True

    def describe(self, body: dict, name: str) -> Any:
        self._known(name)
        s = self.store.schema(name)
        return {"name": s.name, "dimension": s.dimension, "metric": s.metric, "index_type": s.index, "index_params": s.parameters, "description": s.description, "points_count": self.store.count(name), "indexed": self.store.is_indexed(name)}

    def drop(self, body: dict, name: str) -> Any:
        return self.store.drop(name)

    def upsert(self, body: dict, name: str) -> Any:
        self._known(name)
        points = body.get("points")
        if not isinstance(points, list):
            raise ValueError("points must be an array")
        self.store.upsert_batch(name, [(p["id"], p["vector"], p.get("payload")) for p in points])
        return {"upserted": len(points)}

    def get(self, body: dict, name: str, id: str) -> Any:
        point = self.store.get(name, id)
        if point is None:
            raise HttpError(404, f"there is no point {id}")
        return point

    def delete(self, body: dict, name: str, id: str) -> Any:
        return self.store.delete(name, id)

    def count(self, body: dict, name: str) -> Any:
        return {"count": self.store.count(name)}

    def search(self, body: dict, name: str) -> Any:
        self._known(name)
        if not isinstance(body.get("vector"), list):
            raise ValueError("vector must be an array")
        if body.get("build_index"):
            self.store.build_index(name)
        return to_results(self.store.search(name, body["vector"], int(body.get("limit", 10)), body.get("filter")))

    def scroll(self, body: dict, name: str) -> Any:
        self._known(name)
        limit = int(body.get("limit", 10))
        rows = self.store.scroll(name, limit + 1 if limit > 0 else 0, body.get("offset"), body.get("filter")).collect()
        page = [{"id": r["id"], "vector": r["vector"], "payload": json.loads(r["payload"] or "{}")} for r in rows[:limit]] if limit > 0 else []
        return {"points": page, "next_offset": page[-1]["id"] if len(rows) > limit > 0 else None}

    def delete_by_filter(self, body: dict, name: str) -> Any:
        self._known(name)
        return {"deleted": self.store.delete_by_filter(name, body.get("filter"))}

    def openapi(self) -> dict:
        """The routes as an OpenAPI document, made from the route table, so that it can't differ from what is served."""
        paths: dict[str, dict] = {}
        for method, pattern, f in self.routes:
            shown = re.sub(r"\(\?P<(\w+)>\[\^/\]\+\)", r"{\1}", pattern)
            names = re.findall(r"{(\w+)}", shown)
            paths.setdefault(shown, {})[method.lower()] = {"operationId": f.__name__, "parameters": [{"name": n, "in": "path", "required": True, "schema": {"type": "string"}} for n in names], "responses": {"200": {"description": "ok"}}}
        return {"openapi": "3.0.3", "info": {"title": "vecspark", "version": "1"}, "paths": paths}

    def serve(self, host: str = "127.0.0.1", port: int = 0, origins: str | None = None) -> ThreadingHTTPServer:
        """An HTTP server; call serve_forever() on it, and shutdown() to end it."""
        service = self

        class Handler(BaseHTTPRequestHandler):
            def answer(self) -> None:
                raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
                try:
                    status, out = service.handle(self.command, self.path.split("?")[0], json.loads(raw) if raw else None)
                except ValueError:
                    status, out = 400, {"status": "error", "error": "the body isn't JSON"}
                data = json.dumps(out, ensure_ascii=False).encode()
                self.send_response(status)
                self.send_header("Content-Type", "application/json; charset=utf-8")
                if origins:
                    self.send_header("Access-Control-Allow-Origin", origins)
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            do_GET = do_PUT = do_POST = do_DELETE = answer

            def log_message(self, *args) -> None:
                pass

        return ThreadingHTTPServer((host, port), Handler)
