"""The engine over HTTP: POST /api/{stats,ask,search,term,bool,verify} with a JSON object, and one page for people."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from tessera.engine import Engine
from tessera.plans.config import SearchConfig, VerifyConfig

PAGE = """<!doctype html><meta charset="utf-8"><title>tessera</title><body style="font:15px sans-serif;max-width:50em;margin:2em auto">
<form onsubmit="go();return false"><select id="o"><option>ask<option>search<option>bool<option>term<option>verify<option>stats</select>
<input id="q" size="50"> <button>go</button></form><pre id="r" style="white-space:pre-wrap"></pre><script>
async function go(){const q=document.getElementById('q').value,o=document.getElementById('o').value,
x=await fetch('/api/'+o,{method:'POST',body:JSON.stringify({query:q,term:q,claim:q})});
document.getElementById('r').textContent=JSON.stringify(await x.json(),null,1)}</script>"""


def search_config(p: dict, k: int) -> SearchConfig:
    """The search that a request's fields ask for."""
    return SearchConfig(
        k=int(p.get("k", k)), method=p.get("method", "tfidf"), champions=bool(p.get("champions")), eliminate=float(p.get("eliminate", 1.0)),
        proximity_weight=float(p.get("proximity", 0.5)), proximity_window=int(p.get("prox_window", 30)), static_weight=float(p.get("static", 0.0)),
    )


def respond(engine: Engine, operation: str, p: dict, verify: VerifyConfig = VerifyConfig()) -> dict:
    """The answer to one request; KeyError for an unknown operation or a missing field."""
    return {
        "stats": lambda: engine.stats(),
        "ask": lambda: engine.ask(p["query"], search_config(p, 5), int(p.get("sentences", 3)), verify, explain=bool(p.get("explain"))),
        "search": lambda: engine.search(p["query"], search_config(p, 10)),
        "term": lambda: engine.term(p["term"]),
        "bool": lambda: engine.boolean(p["query"], int(p.get("limit", 20))),
        "verify": lambda: engine.verify(p["claim"], int(p.get("k", 5)), verify),
    }[operation]()


OPERATIONS = ("stats", "ask", "search", "term", "bool", "verify")


def server(engine: Engine, host: str = "127.0.0.1", port: int = 8123, verify: VerifyConfig = VerifyConfig(), tries: int = 20) -> ThreadingHTTPServer:
    """A server on the first free port from port on; call serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, body: bytes, kind: str, status: int = 200) -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def _json(self, value: dict, status: int = 200) -> None:
            self._send(json.dumps(value, ensure_ascii=False, default=str).encode(), "application/json; charset=utf-8", status)

        def do_GET(self) -> None:
            if self.path == "/":
                self._send(PAGE.encode(), "text/html; charset=utf-8")
            else:
                self._json({"error": "not found"}, 404)

        def do_POST(self) -> None:
            operation = self.path.removeprefix("/api/")
            if not self.path.startswith("/api/") or operation not in OPERATIONS:
                return self._json({"error": "not found"}, 404)
            try:
                payload = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
            except ValueError as e:
                return self._json({"error": f"bad JSON: {e}"}, 400)
            try:
                self._json(respond(engine, operation, payload, verify))
            except Exception as e:  # a request that fails must not stop the server
                self._json({"error": f"{type(e).__name__}: {e}"}, 500)

        def log_message(self, *_) -> None:
            pass

    for p in range(port, port + tries):
        try:
            return ThreadingHTTPServer((host, p), Handler)
        except OSError:
            continue
    raise OSError(f"no free port from {port} to {port + tries - 1}")
