"""Live pages from servers of our own, on this machine."""

from __future__ import annotations

import threading
import time
from collections import defaultdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from shelf import cli
from shelf.engine import Engine
from shelf.sources import web

PAGE = "<html><head><title>{0}</title></head><body><article><p>Text of {0}, käse.</p></article></body></html>"


@pytest.fixture
def servers():
    """Two servers; their addresses, and when each path was asked for, by port."""
    asked: dict[int, list[tuple[float, str]]] = defaultdict(list)

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            port = self.server.server_port
            asked[port].append((time.monotonic(), self.path))
            times = sum(p == self.path for _, p in asked[port])
            if self.path.startswith("/flaky") and times < 3 or self.path == "/down":
                return self.answer(503, b"later")
            if self.path == "/gone":
                return self.answer(404, b"no")
            if self.path == "/moved":
                self.send_response(302)
                self.send_header("location", "/target")
                return self.end_headers()
            latin = self.path == "/latin"
            self.answer(200, PAGE.format(self.path).encode("latin-1" if latin else "utf-8"), "text/html; charset=" + ("latin-1" if latin else "utf-8"))

        def answer(self, code, body, kind="text/plain"):
            self.send_response(code)
            self.send_header("content-type", kind)
            self.send_header("content-length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    running = [ThreadingHTTPServer(("127.0.0.1", 0), Handler) for _ in range(2)]
    for s in running:
        threading.Thread(target=s.serve_forever, daemon=True).start()
    yield [f"http://127.0.0.1:{s.server_port}" for s in running], asked
    for s in running:
        s.shutdown()


def test_the_source_has_a_partition_for_each_host_waits_and_tries_again(spark, servers):
    (one, two), asked = servers
    urls = [f"{one}/a", f"{one}/flaky", f"{one}/latin", f"{two}/moved", f"{two}/gone", f"{two}/down", f"{one}/a", "http://127.0.0.1:9/none", "no-url"]
    spark.dataSource.register(web.PageSource)
    rows = spark.read.format("shelf_pages").option("urls", "\n".join(urls)).option("delay", "0.05").load()
    assert rows.rdd.getNumPartitions() == 4
    got = {r.url: r for r in rows.collect()}
    assert len(got) == 8 and got[f"{one}/a"].html == PAGE.format("/a") and got[f"{one}/latin"].html == PAGE.format("/latin") and got[f"{one}/flaky"].error is None
    assert got[f"{two}/moved"].final_url == f"{two}/target" and got[f"{two}/gone"].error.startswith("The server answered 404") and got[f"{two}/down"].error.startswith("The server answered 503")
    assert got["http://127.0.0.1:9/none"].error and got["no-url"].html is None
    counts = {path: [p for some in asked.values() for _, p in some].count(path) for path in ("/a", "/flaky", "/gone", "/down")}
    assert counts == {"/a": 1, "/flaky": 3, "/gone": 1, "/down": 3}
    for some in asked.values():
        whens = [t for t, _ in some]
        assert all(b - a > 0.045 for (a, p), (b, q) in zip(some, some[1:], strict=False) if q != "/target"), whens
    assert spark.read.format("shelf_pages").load().collect() == []


def test_a_table_of_urls_is_fetched_host_by_host(spark, servers):
    (one, two), asked = servers
    urls = spark.createDataFrame([(f"{h}/{k}",) for k in range(4) for h in (one, two)] + [(f"{one}/flaky2",)], "url string").repartition(4)
    got = web.fetch_pages(urls, 3, delay=0.03).collect()
    assert len(got) == 9 and all(r.error is None for r in got)
    for some in asked.values():
        assert all(b - a > 0.025 for (a, _), (b, _) in zip(some, some[1:], strict=False))


def test_the_command_adds_and_refreshes_live_pages(spark, servers, tmp_path, capsys):
    (one, two), asked = servers
    store = ["--store", f"{tmp_path}/store"]
    cli.main([*store, "add", f"{one}/a", f"{two}/moved", f"{two}/gone", "--no-embed", "--delay", "10"], spark)
    cli.main([*store, "refresh", "--all", "--no-embed"], spark)
    out = capsys.readouterr().out
    assert out.count("inserted #") == 2 and out.count("failed #None") == 1 and out.count("unchanged #") == 2
    assert sorted(r.url for r in Engine(spark, f"{tmp_path}/store").store.docs().collect()) == sorted([f"{one}/a", f"{two}/target"])
