"""Feeds as a stream, from a server whose feed changes: each entry once, over restarts and failures."""

import os
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.errors import StreamingQueryException

from newsloom.sources.feeds import items
from newsloom.streaming.items import run_batches
from newsloom.streaming.source import REMEMBERED_POLLS, feed_stream, poll_feed


class Server:
    def __init__(self):
        shown, asked, status = {"/a": [1, 2], "/b": [1]}, [], {}
        self.shown, self.asked, self.status = shown, asked, status

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                tag = '"' + "-".join(map(str, shown[self.path])) + '"'
                code = status.get(self.path, 304 if self.headers["If-None-Match"] == tag else 200)
                asked.append((self.path, code))
                self.send_response(code)
                self.send_header("ETag", tag)
                self.end_headers()
                if code == 200:
                    entries = "".join(f"<item><title>t{i}</title><link>https://x.example{self.path}/{i}</link></item>" for i in shown[self.path])
                    self.wfile.write(f"<rss><channel>{entries}</channel></rss>".encode())

            def log_message(self, *_):
                pass

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.http.serve_forever, daemon=True).start()

    def requests(self, paths=("/a", "/b")):
        url = f"http://127.0.0.1:{self.http.server_port}"
        return [{"kind": "rss", "position": i, "label": p, "url": url + p, "name": p, "source_topics": ""} for i, p in enumerate(paths)]


@pytest.fixture
def server():
    s = Server()
    yield s
    s.http.shutdown()
    s.http.server_close()


def test_each_entry_once(spark, tmp_path, server):
    got = []

    def handle(df, _):
        got.append(sorted(r.link.removeprefix("https://x.example") for r in items(df).collect()))

    def poll(handle=handle):
        stream = feed_stream(spark, server.requests(), str(tmp_path / "spool"), 0, 0)
        run_batches(stream, handle, str(tmp_path / "checkpoint")).awaitTermination()
        new = [x for part in got for x in part]
        got.clear()
        return new

    assert poll() == ["/a/1", "/a/2", "/b/1"]
    server.shown["/a"] = [3, 2]  # one entry gone, one new; the other feed is as it was
    server.asked.clear()
    assert poll() == ["/a/3"] and sorted(server.asked) == [("/a", 200), ("/b", 304)]
    server.status["/b"] = 404  # a feed that fails keeps its position
    server.shown["/a"] = [1, 3]
    assert poll() == []
    server.status.clear()
    server.shown["/a"], server.shown["/b"] = [4], [1, 2]

    def failing(df, batch):
        handle(df, batch)
        raise OSError("the sink is gone")

    with pytest.raises(StreamingQueryException):
        poll(failing)
    assert got.pop() == ["/a/4", "/b/2"]
    server.shown["/a"] = [5]  # the batch that failed comes again as it was read, and the next poll is the next batch
    assert [x for _ in range(2) for x in poll()] == ["/a/4", "/b/2", "/a/5"]
    assert poll() == []
    assert len(os.listdir(tmp_path / "spool")) <= 2


def test_positions_of_a_feed(server):
    request = server.requests()[0]
    first = poll_feed(request, 1, None, 0)
    assert [e["title"] for e in first["entries"]] == ["t1", "t2"] and first["etag"] == '"1-2"'
    same = poll_feed(request, 2, first, 0)
    assert same["entries"] == [] and set(same["shown"].values()) == {2} and same["etag"] == first["etag"]
    server.shown["/a"] = [2, 2, 3]
    later = poll_feed(request, 3 + REMEMBERED_POLLS, same, 0)
    assert [e["title"] for e in later["entries"]] == ["t2", "t3"]  # so long after, the second comes again
    server.status["/a"] = 500
    assert poll_feed(request, 4, same, 0)["error"].startswith("HTTPError") and poll_feed(request, 4, same, 0)["shown"] == same["shown"]
    none = poll_feed({"url": "http://127.0.0.1:9/none", "kind": "rss"}, 1, None, 0)
    assert none["error"].startswith("URLError") and none["entries"] == []
