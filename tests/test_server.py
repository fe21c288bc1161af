import base64
import json
import os
import socket
import struct
import threading
import urllib.error
import urllib.request

import pytest

from flowspark import Engine
from flowspark.server import serve


@pytest.fixture()
def server(spark):
    s = serve(Engine(spark), port=0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s
    s.shutdown()


def call(server, path, body=None):
    url = f"http://127.0.0.1:{server.server_address[1]}{path}"
    data = None if body is None else json.dumps(body).encode()
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data), timeout=60) as r:
            return r.status, json.loads(r.read())
    except urllib.error.HTTPError as e:
        return e.code, json.loads(e.read())


def test_http(server):
    assert call(server, "/api/execute", {"query": "create stream s"})[1]["success"]
    assert call(server, "/api/insert", {"target": "s", "data": [{"x": 1}, {"x": 5}]}) == (200, {"success": True, "inserted": 2})
    assert call(server, "/api/execute", {"query": "s | where x > 2"})[1]["value"] == [{"x": 5}]
    status, body = call(server, "/api/execute", {"query": "s | wher x"})
    assert status == 400 and body["error"]["code"] == "SYNTAX_ERROR"
    assert call(server, "/api/insert", {"target": "gone", "data": {}})[1]["error"]["code"] == "STREAM_NOT_FOUND"
    assert call(server, "/api/insert", {})[0] == 400 and call(server, "/nothing")[0] == 404
    assert "s" in [x["name"] for x in call(server, "/api/streams")[1]["streams"]]
    assert call(server, "/api/status")[1]["status"] == "running"


class Socket:
    def __init__(self, server):
        self.s = socket.create_connection(server.server_address, timeout=60)
        key = base64.b64encode(os.urandom(16)).decode()
        self.s.sendall(f"GET /ws HTTP/1.1\r\nHost: x\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Key: {key}\r\nSec-WebSocket-Version: 13\r\n\r\n".encode())
        self.f = self.s.makefile("rb")
        assert b"101" in self.f.readline()
        while self.f.readline().strip():
            pass

    def send(self, body):
        data, mask = json.dumps(body).encode(), os.urandom(4)
        head = struct.pack("!BB", 0x81, 0x80 | len(data)) if len(data) < 126 else struct.pack("!BBH", 0x81, 0x80 | 126, len(data))
        self.s.sendall(head + mask + bytes(b ^ mask[i % 4] for i, b in enumerate(data)))

    def get(self):
        n = self.f.read(2)[1]
        if n == 126:
            n = struct.unpack("!H", self.f.read(2))[0]
        return json.loads(self.f.read(n))


def test_websocket(server):
    call(server, "/api/execute", {"query": "create stream s"})
    w = Socket(server)
    w.send({"type": "subscribe", "stream": "s", "requestId": 1})
    assert w.get() == {"type": "subscribe", "success": True, "streams": ["s"], "requestId": 1}
    w.send({"type": "insert", "target": "s", "data": {"x": 1, "note": "y" * 200}})
    assert w.get()["data"]["x"] == 1 and w.get()["inserted"] == 1
    w.send({"type": "unsubscribe"})
    assert w.get()["streams"] == ["s"]
    w.send({"type": "execute", "query": "list streams", "requestId": "a"})
    assert w.get()["requestId"] == "a"
    w.send({"type": "dance", "requestId": 9})
    assert w.get()["requestId"] == 9
