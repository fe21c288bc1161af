"""A small HTTP and WebSocket front end, on the standard library: ``/api/execute``, ``/api/insert``, ``/api/streams``, ``/api/status`` and ``/ws``."""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from pyspark.sql import DataFrame

from .errors import FlowError, ParseError
from .plans.engine import Engine

VERSION = "0.1.0"
#: Fixed by the WebSocket protocol.
WS_KEY = b"258EAFA5-E914-47DA-95CA-C5AB0DC85B11"
#: Rows of a query's result that one answer holds.
ANSWER_ROWS = 1000


def shown(value: Any) -> Any:
    if isinstance(value, DataFrame):
        return [r.asDict(recursive=True) for r in value.limit(ANSWER_ROWS).collect()]
    return value


class Handler(BaseHTTPRequestHandler):
    engine: Engine
    lock: threading.RLock
    protocol_version = "HTTP/1.1"
    verbose = False

    def log_message(self, *args: Any) -> None:
        if self.verbose:
            super().log_message(*args)

    def reply(self, body: Any, status: int = 200) -> None:
        data = json.dumps(body, default=str).encode()
        self.send_response(status)
        self.send_header("Content-Type", "application/json")
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def do_GET(self) -> None:
        if self.path == "/ws" and self.headers.get("Upgrade", "").lower() == "websocket":
            return self.websocket()
        catalog = self.engine.catalog
        if self.path == "/api/streams":
            return self.reply({"success": True, "streams": [self.engine.stream_info(n) for n in sorted(catalog.streams)]})
        if self.path == "/api/status":
            return self.reply({"status": "running", "version": VERSION, "streams": len(catalog.streams), "activeQueries": len(catalog.flows), "wsConnections": self.server.sockets, "uptime": time.time() - self.engine.started})
        self.reply({"success": False, "error": {"code": "NOT_FOUND", "message": self.path}}, 404)

    def do_POST(self) -> None:
        try:
            body = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))) or b"{}")
            if self.path == "/api/execute":
                out = self.execute(body["query"])
            elif self.path == "/api/insert":
                out = self.insert(body["target"], body["data"])
            else:
                return self.reply({"success": False, "error": {"code": "NOT_FOUND", "message": self.path}}, 404)
        except (KeyError, ValueError, TypeError) as e:
            return self.reply({"success": False, "error": {"code": "BAD_REQUEST", "message": str(e)}}, 400)
        self.reply(out, 200 if out["success"] else 400)

    def execute(self, query: str) -> dict[str, Any]:
        with self.lock:
            r = self.engine.execute(query)
            r.value = shown(r.value)
        return r.as_dict()

    def insert(self, target: str, data: Any) -> dict[str, Any]:
        try:
            with self.lock:
                return {"success": True, "inserted": self.engine.insert(target, data)}
        except FlowError as e:
            return {"success": False, "error": {"code": e.code, "message": str(e)}}

    # WebSocket

    def websocket(self) -> None:
        accept = base64.b64encode(hashlib.sha1(self.headers["Sec-WebSocket-Key"].encode() + WS_KEY).digest()).decode()
        self.send_response(101)
        for name, value in (("Upgrade", "websocket"), ("Connection", "Upgrade"), ("Sec-WebSocket-Accept", accept)):
            self.send_header(name, value)
        self.end_headers()
        subscribed: dict[str, int] = {}
        writing = threading.Lock()

        def send(body: Any) -> None:
            data = json.dumps(body, default=str).encode()
            n = len(data)
            head = struct.pack("!BB", 0x81, n) if n < 126 else struct.pack("!BBH", 0x81, 126, n) if n < 1 << 16 else struct.pack("!BBQ", 0x81, 127, n)
            with writing:
                self.wfile.write(head + data)

        self.server.sockets += 1
        try:
            while (text := self.read_frame()) is not None:
                self.answer(text, subscribed, send)
        except (ConnectionError, OSError):
            pass
        finally:
            self.server.sockets -= 1
            for i in subscribed.values():
                self.engine.catalog.subscriptions.pop(i, None)
            self.close_connection = True

    def read_frame(self) -> str | None:
        data = b""
        while True:
            head = self.rfile.read(2)
            if len(head) < 2:
                return None
            n = head[1] & 0x7F
            if n > 125:
                n = struct.unpack("!H" if n == 126 else "!Q", self.rfile.read(2 if n == 126 else 8))[0]
            mask = self.rfile.read(4) if head[1] & 0x80 else b"\0" * 4
            body = bytes(b ^ mask[i % 4] for i, b in enumerate(self.rfile.read(n)))
            kind = head[0] & 0x0F
            if kind == 8:
                return None
            if kind in (0, 1):
                data += body
                if head[0] & 0x80:
                    return data.decode()

    def answer(self, text: str, subscribed: dict[str, int], send: Any) -> None:
        message: dict[str, Any] = {}
        try:
            message = json.loads(text)
            kind = message["type"]
            if kind == "execute":
                out = self.execute(message["query"])
            elif kind == "insert":
                out = self.insert(message["target"], message["data"])
            elif kind == "subscribe":
                names = message.get("streams") or [message["stream"]]
                for n in names:
                    if n not in subscribed:
                        subscribed[n] = self.engine.catalog.subscribe(n, lambda s, d: send({"type": "data", "stream": s, "data": d}))
                out = {"success": True, "streams": names}
            elif kind == "unsubscribe":
                names = message.get("streams") or ([message["stream"]] if "stream" in message else list(subscribed))
                for n in names:
                    if n in subscribed:
                        self.engine.catalog.unsubscribe(subscribed.pop(n))
                out = {"success": True, "streams": names}
            else:
                raise ParseError(f"unknown message {kind!r}")
            send({"type": kind, **out} | ({"requestId": message["requestId"]} if "requestId" in message else {}))
        except (FlowError, KeyError, ValueError, TypeError) as e:
            code = e.code if isinstance(e, FlowError) else "BAD_REQUEST"
            asked = {"requestId": message["requestId"]} if isinstance(message, dict) and "requestId" in message else {}
            send({"type": "error", "success": False, "error": {"code": code, "message": str(e)}} | asked)


def serve(engine: Engine, host: str = "127.0.0.1", port: int = 3333, verbose: bool = False) -> ThreadingHTTPServer:
    """A server, not yet started; its address is ``server_address``."""
    handler = type("BoundHandler", (Handler,), {"engine": engine, "lock": threading.RLock(), "verbose": verbose})
    server = ThreadingHTTPServer((host, port), handler)
    server.daemon_threads = True
    server.sockets = 0
    return server
