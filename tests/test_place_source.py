"""Place search as a data source: ranges of pages, pushed filters, failing pages, HTTP, and pages as a stream."""

import http.server
import json
import threading
import urllib.parse

import pytest

from placeloom.sources import place_source as source

KEYWORDS = [(0, "park", "A", 2, 25), (1, "lake", "B", 3, 2), (2, "none", "A", 3, 4), (3, "park", "B", 4, 1)]
PLACES = {"park": 43, "lake": 9, "none": 0}


@pytest.fixture(scope="module")
def service():
    """A service that counts what it is asked for; its first answer to every page 2 of lake is an error."""
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            q = dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(self.path).query))
            size, page, word = int(q["page_size"]), int(q["page_num"]), q["keywords"]
            fails = word == "lake" and page == 2 and (word, page) not in [a[:2] for a in asked]
            asked.append((word, page, q["region"], q["key"]))
            rows = [{"id": f"{word}{i}"} for i in range((page - 1) * size, min(page * size, PLACES[word]))]
            body = json.dumps({"status": "0", "info": "busy"} if fails else {"status": "1", "pois": rows}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/", asked
    server.shutdown()


def expected(keywords):
    return sorted((o, k, r, i // size + 1, i % size, json.dumps({"id": f"{k}{i}"})) for o, k, r, size, most in keywords for i in range(min(PLACES[k], size * most)))


def test_batch(spark, service):
    at, asked = service
    made = source.read_pages(spark, spark.createDataFrame(KEYWORDS, "ord int, keyword string, region string, page_size int, max_pages int"), "placeloom.sources.place_source:http", at, "secret", pause_s=0)
    assert sorted(map(tuple, made.collect())) == expected(KEYWORDS)
    assert asked.count(("lake", 2, "B", "secret")) == 2  # once more after the error
    # Ranges of ten pages: the third one of park ends with its first page, which is short of places.
    assert {p for w, p, r, _ in asked if w == "park" and r == "A"} == set(range(1, 23))
    asked[:] = [("lake", 2, "B", "")]
    assert sorted(map(tuple, made.filter("region = 'B' AND keyword IN ('lake', 'sea') AND page > 1").collect())) == [x for x in expected(KEYWORDS[1:2]) if x[3] > 1]
    assert {(w, r) for w, _, r, _ in asked} == {("lake", "B")}
    assert source.read_pages(spark, [], "placeloom.sources.place_source:http", at, "x").count() == 0


def test_a_page_that_fails_for_good_fails_the_read(spark, service):
    made = source.read_pages(spark, KEYWORDS[:1], "placeloom.sources.place_source:http", "http://127.0.0.1:9/", "x", pause_s=0, tries=2)
    with pytest.raises(Exception, match="Connection refused|URLError"):
        made.collect()


def test_stream_goes_on_after_a_restart(spark, service, tmp_path):
    at, asked = service

    def run(pages):
        keywords, got = [(0, "park", "A", 2, pages), (1, "lake", "B", 3, 2)], []
        stream = source.stream_pages(spark, keywords, "placeloom.sources.place_source:http", at, "x", pause_s=0)
        q = stream.writeStream.foreachBatch(lambda df, n: got.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "c")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted(got), expected(keywords)

    asked[:] = [("lake", 2, "B", "")]
    first, whole = run(12)
    assert first == whole
    again, _ = run(12)
    assert again == []
    more, whole = run(15)
    assert sorted(first + more) == whole and {x[3] for x in more} == {13, 14, 15}
