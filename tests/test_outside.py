"""What comes from outside, with a canned catalog server and stand-ins: paging and pacing, PDF files, artifacts, citation batches, identifiers in answers."""

import json
import threading
import time
import urllib.error
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from fathomline.operators import citations, evidence_ids, relevance
from fathomline.plans.engine import Engine
from fathomline.plans.ingestion import Harvest, Ingestion
from fathomline.providers import HashProvider
from fathomline.sources import catalog_api, files
from fathomline.sources.catalog_api import AtomCatalog, AtomClient, Paced

ENTRY = """<entry><id>http://arxiv.org/abs/{id}</id><title>Paper  {id}
 on agents</title><summary> We study {id}. </summary><published>{day}T00:00:00Z</published><updated>{day}T01:00:00Z</updated>
<author><name>A. Writer</name></author><author><name>B. Other</name></author><arxiv:primary_category xmlns:arxiv="http://arxiv.org/schemas/atom" term="cs.AI"/><category term="cs.AI"/><category term="cs.LG"/>
<link href="http://arxiv.org/abs/{id}" rel="alternate"/><link title="pdf" href="http://arxiv.org/pdf/{id}" rel="related"/></entry>"""
PAPERS = [(f"26{k:02d}.0001v1", f"2026-{1 + k // 5:02d}-{1 + k % 5:02d}") for k in range(13)]


class Canned(BaseHTTPRequestHandler):
    def do_GET(self):
        server = self.server
        server.seen.append((time.monotonic(), self.path))
        if server.broken:
            self.send_response(server.broken.pop(0))
            self.send_header("Retry-After", "0.01")
            self.end_headers()
            return
        if self.path.startswith("/pdf"):
            self.send_response(404 if "v" in self.path.rsplit("/", 1)[1] else 200)
            self.end_headers()
            if "v" not in self.path.rsplit("/", 1)[1]:
                self.wfile.write(server.pdf)
            return
        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        low, high = (x[:8] for x in q["search_query"].split("[")[1].rstrip("]").split(" TO "))
        own = [p for p in PAPERS if low <= p[1].replace("-", "") <= high]
        part = own[int(q["start"]) : int(q["start"]) + int(q["max_results"])]
        body = f'<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><opensearch:totalResults xmlns:opensearch="x">{len(own)}</opensearch:totalResults>{"".join(ENTRY.format(id=i, day=d) for i, d in part)}</feed>'
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body.encode())

    def log_message(self, *args):
        pass


@pytest.fixture
def server():
    own = ThreadingHTTPServer(("127.0.0.1", 0), Canned)
    own.seen, own.broken, own.pdf = [], [], b"%PDF-1.7 body"
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield own
    own.shutdown()


def address(server):
    return f"http://127.0.0.1:{server.server_address[1]}"


def options(server, **more):
    return {"endpoint": f"{address(server)}/query", "category": "cs.AI", "from": "2026-01-01", "to": "2026-03-31", "pageSize": "2", "delay": "0.05"} | more


def test_batch_reads_each_page_once(spark, server):
    spark.dataSource.register(AtomCatalog)
    raw = spark.read.format("atom_catalog").options(**options(server)).load()
    rows = raw.collect()
    assert raw.rdd.getNumPartitions() == 3 and len(rows) == len(PAPERS)
    own = [p for _, p in server.seen]
    assert len(own) == len(set(own)) == 3 + 3 + 2  # five, five and three papers by two
    for month in {r["segment"] for r in rows}:
        assert [r["nth"] for r in rows if r["segment"] == month] == list(range(sum(r["segment"] == month for r in rows)))
    parsed = files.catalog_entries(spark.createDataFrame(rows)).orderBy("source_id").collect()
    assert [r["source_id"] for r in parsed] == [p for p, _ in PAPERS] and [r["published_date"] for r in parsed] == [d for _, d in PAPERS]
    assert (parsed[0]["title"], parsed[0]["abstract"], parsed[0]["authors"], parsed[0]["categories"], parsed[0]["primary_category"]) == ("Paper 2600.0001v1 on agents", "We study 2600.0001v1.", ["A. Writer", "B. Other"], ["cs.AI", "cs.LG"], "cs.AI")
    assert parsed[0]["pdf_url"].endswith("/pdf/2600.0001v1")


def test_requests_keep_their_distance(spark, server):
    spark.dataSource.register(AtomCatalog)
    spark.read.format("atom_catalog").options(**options(server, delay="0.2")).load().count()
    times = sorted(t for t, _ in server.seen)
    # the partitions begin one after the other and keep three times the distance each; tasks start with some jitter
    assert len(times) == 8 and times[-1] - times[0] > 1.0


def test_busy_answers_are_asked_for_again(spark, server):
    server.broken = [429, 503]
    spark.dataSource.register(AtomCatalog)
    assert spark.read.format("atom_catalog").options(**options(server, to="2026-01-31")).load().count() == 5 and len(server.seen) == 5
    server.broken = [404]
    with pytest.raises(urllib.error.HTTPError):
        Paced(0.0).get(f"{address(server)}/query")
    server.broken = [500, 500, 500, 500]
    with pytest.raises(urllib.error.HTTPError):
        Paced(0.0).get(f"{address(server)}/query")
    assert len(server.broken) == 1


def test_pace_without_waiting():
    clock, pauses = [0.0], []

    def sleep(s):
        pauses.append(s)
        clock[0] += s

    paced = Paced(3.1, 6.2, now=lambda: clock[0], sleep=sleep)
    paced._wait(), paced._wait()
    clock[0] += 10
    paced._wait()
    assert pauses == pytest.approx([6.2, 3.1])
    assert catalog_api.segments(catalog_api.date(2025, 12, 30), catalog_api.date(2026, 2, 1)) == [(catalog_api.date(2025, 12, 30), catalog_api.date(2025, 12, 31)), (catalog_api.date(2026, 1, 1), catalog_api.date(2026, 1, 31)), (catalog_api.date(2026, 2, 1), catalog_api.date(2026, 2, 1))]


def test_stream_goes_on_at_its_offset(spark, server, tmp_path):
    spark.dataSource.register(AtomCatalog)

    def batches(n):
        """Let a query take ``n`` pages, then stop it."""
        query = spark.readStream.format("atom_catalog").options(**options(server)).load().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="100 milliseconds").start()
        end = time.time() + 30
        while time.time() < end and len([p for p in query.recentProgress if p["numInputRows"]]) < n and query.isActive:
            time.sleep(0.1)
        query.stop()

    batches(2)
    first = len({p for _, p in server.seen})
    assert 2 <= first <= 8
    batches(8 - first)  # the pages that are left
    got = [(r["segment"], r["nth"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(got) == len(set(got)) == len(PAPERS)


def test_client_of_the_ingestion(spark, server, tmp_path):
    engine = Engine(spark, str(tmp_path), HashProvider())
    client = AtomClient(spark, f"{address(server)}/query")
    client.paced = Paced(3.1, sleep=lambda s: None)
    group = Ingestion(engine, client).discover_monthly(Harvest("cs.AI", "2026-01-01", "2026-01-31", page_size=3))
    assert (group["runs"], group["discovered"]) == (1, 5) and len(server.seen) == 2
    assert client.download(f"{address(server)}/pdf/2601.0001v2").startswith(b"%PDF")
    server.pdf = b"<html>"
    with pytest.raises(RuntimeError):
        client.download(f"{address(server)}/pdf/2601.0001v2")


# files

TEXT = ["Abstract\nWe study recovery of tool agents after a failure of their tools on many tasks.\n", "Experiments\nRecovery succeeded in most of the runs when agents planned again.\nFigure 1: Recovery rates of the agents\n"]


def extractor():
    def extract(content):
        body = content.decode("utf-8", "replace").split("\f")[1:]
        if not body:
            raise ValueError("no pages")
        return [(k + 1, p) for k, p in enumerate(body)]

    return extract  # made here, so that workers need not import this file


def test_pdfs_equal_the_text_path(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "deep").mkdir(parents=True)
    (folder / "deep" / "good.pdf").write_bytes(b"%PDF-1.4\f" + "\f".join(TEXT).encode())
    (folder / "broken.pdf").write_bytes(b"%PDF-1.4")
    (folder / "page.pdf").write_bytes(b"<html>")
    (folder / "bare.pdf").write_bytes(b"%PDF-1.4\f \f\n")
    engine = Engine(spark, str(tmp_path / "store"), HashProvider())
    about = spark.createDataFrame([("x/good.pdf", "Recovery", ["A"], "About recovery.", "2026-01-01", "https://arxiv.org/abs/2601.1", "preprint")], "uri string, title string, authors array<string>, abstract string, published_date string, source_url string, source_class string")
    out = engine.ingest_pdfs(str(folder), extractor(), about=about, now="2026-02-01T00:00:00+00:00")
    assert out["versions"] == 1 and {f["uri"].rsplit("/", 1)[1]: f["error"].split(":")[0] for f in out["failed"]} == {"broken.pdf": "ValueError", "page.pdf": "ValueError", "bare.pdf": "the file has no text"}
    plain = Engine(spark, str(tmp_path / "plain"), HashProvider())
    plain.ingest(spark.createDataFrame([("Recovery", "\n".join(TEXT), ["A"], "About recovery.", "2026-01-01", None, "preprint")], "title string, text string, authors array<string>, abstract string, published_date string, source_url string, source_class string"))
    rows = lambda e, table, *c: sorted(map(tuple, e.store.read(table).select(*c).collect()))
    for table, columns in (("sections", ("heading", "ordinal", "text")), ("evidence_passages", ("text",)), ("visual_evidence", ("label", "caption"))):
        assert rows(engine, table, *columns) == rows(plain, table, *columns) != []
    assert [tuple(r) for r in engine.store.read("sections").orderBy("ordinal").select("page_start", "page_end").collect()] == [(1, 2), (2, 2)]
    version = engine.store.read("paper_versions").first()
    body = (folder / "deep" / "good.pdf").read_bytes()
    assert files.read_artifact(spark, f"{engine.store.root}/_artifacts", "raw", version["content_hash"]) == body and version["artifact_uri"].endswith(version["content_hash"])
    assert {r["title"] for r in engine.search("recovery succeeded")["results"]} == {"Recovery"}
    assert engine.ingest_pdfs(str(folder), extractor(), about=about)["status"] == "already_ingested"


def test_artifacts_know_what_is_stored(spark, tmp_path):
    import os

    root = str(tmp_path)
    put = lambda *c: files.put_artifacts(spark.createDataFrame([(bytearray(x),) for x in c], "content binary"), root, "raw")
    count = lambda: sum(f.endswith(".parquet") for _, _, names in os.walk(root) for f in names)
    assert put(b"one", b"two", b"one").count() == 2
    before = count()
    assert put(b"two", b"one").count() == 2 and count() == before
    put(b"two", b"three")
    assert files.stored_artifacts(spark, root, "raw").count() == 3
    hashed = files.hashlib.sha256(b"one").hexdigest()
    assert files.read_artifact(spark, root, "raw", hashed) == b"one"
    for bad in ("../x", hashed[:-1], hashed.upper()):
        with pytest.raises(ValueError):
            files.read_artifact(spark, root, "raw", bad)
    with pytest.raises(KeyError):
        files.read_artifact(spark, root, "raw", "0" * 64)
    spark.createDataFrame([(hashed, bytearray(b"other"), hashed[:2])], files.STORED).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(f"{root}/raw")
    with pytest.raises(ValueError, match="damaged"):
        put(b"one")
    with pytest.raises(ValueError, match="damaged"):
        files.read_artifact(spark, root, "raw", hashed)


# answers


def service(log):
    class Service:  # made here, so that workers need not import this file
        def lookup(self, keys):
            with open(log, "a") as f:
                f.write(f"{len(keys)}\n")
            if "k13" in keys:
                raise OSError("down")
            return [None if k == "k1" else {"paperId": k} if k == "k2" else {"paperId": k, "citationCount": int(k[1:]), "influentialCitationCount": 1, "referenceCount": True if k == "k3" else 2} for k in keys]

    return Service()


def test_citation_batches(spark, tmp_path):
    rows = spark.createDataFrame([(f"p{k}", f"k{k}") for k in range(23)], "id string, key string").repartition(5)
    log = tmp_path / "calls"
    found = citations.asked(rows, service(str(log)), batch=5).persist()
    out = {r["id"]: (r["state"], r["citation_count"]) for r in found.collect()}
    sizes = [int(x) for x in log.read_text().split()]
    assert sizes == [5, 5, 5, 5, 3] and len(out) == 23
    failed = {i for i, (s, _) in out.items() if s == "failed"}
    assert "p13" in failed and len(failed) in (3, 5)
    for i, want in (("p1", "unmatched"), ("p2", "invalid"), ("p3", "invalid")):
        assert out[i][0] == want or i in failed
    assert all(c == int(i[1:]) for i, (s, c) in out.items() if s == "ok")
    told = citations.tally(found).first()
    assert told["eligible"] == 23 and told["refreshed"] + told["unmatched"] + told["invalid"] + told["failed"] == 23
    with pytest.raises(ValueError):
        citations.asked(rows, None, batch=501)


def test_a_busy_service_is_asked_again():
    calls, pauses = [], []

    def lookup(keys):
        calls.append(1)
        if len(calls) < 4:
            raise citations.Busy(after=30 if len(calls) == 2 else None)
        return [None] * len(keys)

    assert citations.patient(lookup, ["a"], pauses.append) == [None] and pauses == [1.0, 8.0, 4.0]
    with pytest.raises(RuntimeError, match="invalid batch"):
        citations.patient(lambda keys: [], ["a"])
    with pytest.raises(citations.Busy):
        citations.patient(lambda keys: (_ for _ in ()).throw(citations.Busy()), ["a"], pauses.append)


def test_relevance_answers():
    good = [{"discovery_id": "a", "relevance": 2, "reason": " so  it is "}, {"discovery_id": "b", "relevance": 0.25, "reason": "r"}]
    assert relevance.accepted(["a", "b"], {"scores": good}) == [("a", 1.0, "so it is"), ("b", 0.25, "r")]
    for bad in (None, {}, {"scores": "x"}, {"scores": good[:1]}, {"scores": [good[0], good[1] | {"relevance": True}]}, {"scores": [good[0], good[1] | {"reason": " "}]}, {"scores": [*good[:1], {"discovery_id": "c", "relevance": 1, "reason": "r"}]}):
        assert relevance.accepted(["a", "b"], bad) == []
    assert len(relevance.accepted(["a", "b"], {"scores": [*good, {"discovery_id": "c", "relevance": 1, "reason": "r"}]})) == 2


def test_evidence_ids_at_any_depth(spark):
    deep = '{"x":' * 300 + '{"evidence_id":"bottom"}' + "}" * 300
    rows = [(1, json.dumps({"evidence_id": "a", "parts": [{"evidence_ids": ["b", "a", 5, None]}, [[{"evidence_id": "c"}]]], "evidence_ids": "no list"})), (2, deep), (3, "{"), (4, None), (5, ""), (6, '"evidence_id"'), (7, '[{"evidence_id": {"evidence_id": "d"}}]'), (8, '{"evidence_ids": {"evidence_id": "e"}}')]
    found = evidence_ids.evidence_ids(spark.createDataFrame(rows, "n int, body string"), "n", "body").orderBy("n", "pos").collect()
    assert [tuple(r) for r in found] == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "bottom"), (7, 0, "d"), (8, 0, "e")]
    assert evidence_ids.evidence_ids(spark.createDataFrame(rows, "n int, body string").filter("n > 99"), "n", "body").count() == 0 
