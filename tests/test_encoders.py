"""The HTTP encoder against a service that answers in reverse order."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from quarry.sources.encoders import encoded, ordered, prefixes


class Service(BaseHTTPRequestHandler):
    def do_POST(self):
        texts = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["input"]
        data = [{"index": i, "embedding": [len(t), i, 1.0]} for i, t in enumerate(texts)]
        body = json.dumps({"data": data[::-1]}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *a):
        pass


def test_http(spark):
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    rows = [(k, "x" * k) for k in range(150)]
    got = encoded(spark.createDataFrame(rows, "id int, t string").coalesce(1), "t", "http", f"http://127.0.0.1:{server.server_port}/v1/embeddings", "m").collect()
    server.shutdown()
    assert [r.vec[0] for r in sorted(got)] == [float(k) for k in range(150)]


def test_refusals():
    for data in ([{"index": 1, "embedding": [1]}], [], [{"index": 0, "embedding": []}], [{"index": 0, "embedding": [float("nan")]}]):
        with pytest.raises(ValueError):
            ordered({"data": data}, 1)


def test_prefixes():
    assert prefixes("x/multilingual-E5-small") == ("query: ", "passage: ") and prefixes("e5", "", None) == ("", "passage: ") and prefixes("none") == ("", "")
