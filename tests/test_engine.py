"""Store, sources, search, streaming and the facade, end to end on small inputs."""

import datetime as dt
import hashlib
import io
import json
import threading
import time
import urllib.error
import urllib.request
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.api import KnowledgeBase, serve
from lodestone.config import EngineConfig
from lodestone.functions import vectors as vx
from lodestone.lifecycle import IdleUnloader
from lodestone.operators import index as ix
from lodestone.operators import pipeline as pl
from lodestone.operators import ranking as rk
from lodestone.operators import search as se
from lodestone.operators import store as st
from lodestone.sources import files as fs
from lodestone.sources import readers as rd
from lodestone.streaming import watch as wa

CONFIG = EngineConfig(dims=64, store_buckets=4)


def docx(*paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    xml = f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
    return out.getvalue()


HTML = "<html><head><title> River page </title><script>var a = '</p>';</script></head><body><nav>menu</nav><article><p>First paragraph.<p>Second &amp; last.</article><footer>foot</footer></body></html>"


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in"
    for name, data in {
        "papers/ifc.md": "# IFC mapping\n\nThe schema maps building elements to files.\n\n# Walls\n\nWalls are extruded solids with openings.",
        "docs/flood.txt": "Flood routing uses discharge and stage at the river gauge.",
        "notes/bim.docx": docx("Building models hold rooms.", "Each room has a storey."),
        "web/page.html": HTML,
        "docs/short.txt": "tiny",
        "docs/bad.docx": b"no zip",
        "docs/scan.pdf": b"%PDF",
        "docs/picture.png": b"x",
        "node_modules/skip.md": "This must not be scanned at all, ever.",
    }.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data if isinstance(data, bytes) else data.encode())
    return root


@pytest.fixture
def kb(spark, tmp_path, folder):
    k = KnowledgeBase(spark, f"file://{tmp_path}/db", CONFIG)
    k.add_documents(str(folder))
    return k


def test_readers():
    assert rd.extract("a.md", b"x \xff y") == ("x  y", True) and rd.extract("a.xyz", b"x") == ("", False)
    assert rd.extract("a.docx", docx("one", "two"))[0] == "one\ntwo" and rd.extract("a.docx", b"bad") == ("", False)
    title, content = rd.page_content(HTML, "http://x/y")
    assert title == "River page" and content == "# River page\n\nsource: http://x/y\n\nFirst paragraph.\nSecond & last."
    assert rd.page_content("", "u")[0] == "Untitled" and "menu" not in rd.html_text(HTML)
    assert rd.first_text(b"", [lambda d: 1 / 0, lambda d: " ", lambda d: "text", lambda d: "no"]) == "text"
    assert rd.extract("a.pdf", b"", [lambda d: "x"], lambda d: "y" * 20, lambda t: True)[0] == "y" * 20


def test_scan(spark, folder):
    got = {r.source for r in fs.scan(spark, str(folder)).select("source").collect()}
    assert got == {"papers/ifc.md", "docs/flood.txt", "notes/bim.docx", "web/page.html", "docs/short.txt", "docs/bad.docx", "docs/scan.pdf"}
    image = fs.scan_images(spark, str(folder)).first()
    assert (image.image_path, image.file_name, image.source_doc) == ("docs/picture.png", "picture.png", "docs") and image.mtime_ns > 0
    assert fs.scan(spark, str(folder), c=EngineConfig(max_file_bytes=10)).count() == 3


def test_ranges(spark):
    df = spark.createDataFrame([("a", 401), ("b", 200), ("c", 0), ("d", None)], "id string, pages long")
    assert [tuple(r) for r in fs.page_ranges(df).orderBy("id", "segment").collect()] == [("a", 0, 1, 200), ("a", 1, 201, 400), ("a", 2, 401, 401), ("b", 0, 1, 200)]
    assert fs.fit_ranges(1, 10, lambda a, b: b - a + 1, 3) == [(1, 3), (4, 5), (6, 8), (9, 10)]
    with pytest.raises(ValueError):
        fs.fit_ranges(1, 2, lambda a, b: 9, 3)


def test_ingest_search_and_change(kb, folder):
    rows = kb.store.read()
    assert {r.source for r in rows.select("source").distinct().collect()} == {"papers/ifc.md", "docs/flood.txt", "notes/bim.docx", "web/page.html"}
    assert kb.add_documents(str(folder)) == {"chunks": 0, "documents": 0}
    first = rows.filter("source = 'papers/ifc.md'").orderBy("chunk_index").first()
    assert first.category == "paper" and len(first.vector) == 64 and len(first.doc_id) == 16 and first.ingested_at.endswith("Z")
    hit = kb.search_knowledge("river gauge discharge", search_mode="fts")
    assert hit.collect()[0]["source"] == "docs/flood.txt" and hit.trace["mode"] == "text" and hit.collect()[0]["relevance_score"] is None
    fused = kb.search_knowledge("walls openings", search_mode="hybrid", use_reranker=False)
    assert "Walls" in fused.collect()[0]["text"] and fused.trace["reranker"] == "rrf" and fused.trace["result_count"] == len(fused.collect())
    assert [r["source"] for r in kb.search_knowledge("walls", limit=20, search_mode="text", category_filter="paper").collect()] == ["papers/ifc.md"]
    answer = kb.ask_knowledge("flood stage")
    assert answer["evidence"][0]["cite"] == "[1]" and answer["evidence_block"].startswith("[1] source: docs/flood.txt (chunk #0)")
    assert "no evidence" in kb.ask_knowledge("zzz", search_mode="text")["evidence_block"].lower()
    assert kb.get_document("IFC.md").first().chunks == 2
    assert kb.search_similar(str(folder / "docs/flood.txt")).first().source == "docs/flood.txt"
    assert kb.search_similar(str(folder / "docs/flood.txt"), exclude_self=False).count() == kb.store.read().count()
    text = se.rendered(kb.search_knowledge("walls", search_mode="text"), "walls")
    assert "1. ifc.md #1 [paper]" in text and se.rendered(kb.search_knowledge("zz", search_mode="text"), "zz").startswith("Nothing")
    s = kb.get_knowledge_status()
    assert s["documents"] == 4 and s["categories"]["paper"] == 2
    assert {r.source for r in kb.list_documents("PAPER").collect()} == {"papers/ifc.md"}

    (folder / "docs/flood.txt").write_text("Flood routing was rewritten and now speaks of levees.")
    assert kb.update_document(str(folder / "docs/flood.txt")) == {"sources": 1, "deleted": 1, "added": 1}
    assert kb.get_document("flood").first().text.startswith("Flood routing was rewritten")
    (folder / "docs/flood.txt").write_text("no")
    with pytest.raises(ValueError):
        kb.update_document(str(folder / "docs/flood.txt"))
    assert kb.get_document("flood").count() == 1
    assert kb.add_single_document(str(folder / "papers/ifc.md"), str(folder)) == 0
    assert kb.add_single_document(str(folder / "papers/ifc.md"), str(folder), allow_repeats=True) == 2
    assert kb.dedupe() == 2 and kb.dedupe() == 0
    assert kb.ingest_url("https://host.example/a", HTML + "<p>" + "more words " * 20) == 1
    with pytest.raises(ValueError):
        kb.ingest_url("ftp://x", HTML)
    gone = kb.delete_documents("IFC")
    assert gone["deleted"] == 2 and gone["sources"] == ["papers/ifc.md"] and "warning" in kb.delete_documents()
    assert kb.add_documents(str(folder), reindex_all=True)["documents"] == 3
    assert kb.delete_documents(confirm_all=True)["remaining"] == 0
    with pytest.raises(ValueError):
        kb.search_knowledge("x")


def test_store_versions(spark, tmp_path):
    s = st.Store(spark, f"file://{tmp_path}/s", buckets=3)
    assert not s.exists() and s.read().count() == 0
    s.create()
    rows = spark.createDataFrame([("t%d" % i, None, f"s{i % 5}" if i % 7 else None, i, "", f"d{i % 4}" if i % 3 else " ", "", i) for i in range(40)], st.CHUNKS)
    v = s.append(rows)
    s.append(rows.filter("seq < 5"))
    assert s.read().count() == 45 and s.read(v).count() == 40
    seqs = [r.seq for r in s.read().select("seq").collect()]
    assert len(set(zip(seqs, [r.source for r in s.read().select("source").collect()]))) == 45
    _, gone = s.replace(st.source_match("S1"))
    assert gone == 8 and s.read().filter("source = 's1'").count() == 0
    n = s.read().count()
    s.compact()
    assert s.read().count() == n and s.vacuum(keep=1) > 0 and s.read().count() == n
    assert st.keep_first(rows).count() == rows.filter("doc_id = ' '").count() + 4
    assert st.purge_repeated(rows).count() == rows.filter("doc_id = ' '").count()
    other = st.Store(spark, s.path, buckets=3)
    with pytest.raises(st.ConcurrentCommit):
        other._publish(s.version() - 1, {"parts": [], "next_seq": 0})
    _, gone = s.replace(by=F.upper("source"), values=spark.createDataFrame([("S2",), ("S9",), (None,)], "x string"), added=rows.filter("seq = 2"))
    assert gone == 8 and s.read().filter("source = 's2'").count() == 1
    s.drop()
    assert not s.exists()


def test_a_store_takes_many_writes(spark, tmp_path):
    s = st.Store(spark, f"file://{tmp_path}/s", "source string, doc_id string, seq long", buckets=1)
    rows = spark.createDataFrame([("a", "1"), ("a", "2")], "source string, doc_id string").coalesce(1)
    s._publish(0, {"parts": [], "next_seq": 0})  # as an older version counted
    parts, _ = s._add(rows, 511 << 54)
    s._publish(1, {"parts": parts, "next_seq": 512 << 54})
    for k in range(600):
        if k < 5 or k > 595:
            s.append(rows)
        else:  # as many versions, without as many jobs
            m = s._manifest()
            s._publish(s.version(), {"parts": m["parts"], "seq_end": m["seq_end"] + 2})
    seqs = [r.seq for r in s.read().orderBy("seq").collect()]
    assert len(set(seqs)) == len(seqs) == 2 + 2 * 9 and seqs[0] == 511 << 54 and seqs[-1] < (511 << 54) + 3000
    assert s.version() == 602


def test_reranking(spark):
    rows = spark.createDataFrame([(i, f"text {i} " + ("river " if i == 3 else ""), i + 1) for i in range(40)], "id long, text string, position int")
    got = {r.id: r.score for r in rk.rerank(rows, "river stage").collect()}
    assert got[3] == 0.5 and got[35] == 0.0 and len(got) == 40
    plug = {r.id: r.score for r in rk.rerank(rows, "q", scorer=lambda q, t: [float(len(x)) for x in t]).collect()}
    assert plug[0] > 0 and plug[39] == 0.0
    a, b = (spark.createDataFrame(x, "id long, rank int") for x in ([(1, 1), (2, 2)], [(2, 1), (3, 2)]))
    assert [r.id for r in rk.merged(a, b).orderBy("position").collect()] == [1, 2, 3]
    fused = {r.id: r.score for r in rk.rrf([a, b]).collect()}
    assert fused[2] == pytest.approx(1 / 61 + 1 / 62) and max(fused, key=fused.get) == 2


def corpus(spark, n=300, dims=16):
    rng = np.random.default_rng(0)
    rows = [(i, i, f"word{i % 7} river {'stage ' * (i % 3)}", f"s{i % 9}", "note" if i % 2 else None, i, [float(x) for x in rng.normal(size=dims)]) for i in range(n)]
    return spark.createDataFrame(rows + [(n, n, None, None, None, None, None)], "id long, seq long, text string, source string, category string, chunk_index long, vector array<float>")


def test_failing_scorer_falls_back(spark):
    def bad(q, t):
        raise OSError("no model")

    c = corpus(spark)
    found = se.search(c, "river stage", [1.0] * 16, 5, "hybrid", scorer=bad)
    assert len(found.collect()) == 5 and found.trace["reranker"] == "rrf" and "failed" in found.trace["warning"]
    assert [se.search_mode(m) for m in (None, "", "FTS", "Hybrid", "odd")] == ["vector", "vector", "text", "hybrid", "vector"]
    assert se.search(c, "...", mode="text").collect() == []


def test_filters_come_after_vector_search_unless_asked(spark):
    c = corpus(spark)
    q = [1.0] * 16
    post = se.search(c, "x", q, 10, category_filter="note").collect()
    pre = se.search(c, "x", q, 10, category_filter="note", prefilter=True).collect()
    assert len(post) < 10 == len(pre)


def test_indexes_equal_scans(spark, tmp_path):
    c = corpus(spark)
    p = ix.PostingsIndex(spark, f"file://{tmp_path}/p", 4)
    p.append(c.filter("id < 100"))
    p.append(c.filter("id >= 100"))
    want = [(r.id, round(r.bm25, 9)) for r in rk.top_bm25(c, "stage word3 none", 15).collect()]
    assert [(r.id, round(r.bm25, 9)) for r in p.search("stage word3 none", 15).collect()] == want and p.search("...", 3).count() == 0
    for least in (1000, 10):
        v = ix.CellIndex(spark, f"file://{tmp_path}/v{least}", 16, c=EngineConfig(ivf_min_rows=least))
        v.build(c)
        got = [r.id for r in ix.CellIndex(spark, v.path, 16).search([1.0] * 16, 10, probes=99).collect()]
        assert got == [r.id for r in rk.top_vectors(c, [1.0] * 16, 10).orderBy("distance", "id").collect()]


def test_store_index_follows_the_store(spark, tmp_path):
    c = corpus(spark)
    s = st.Store(spark, f"file://{tmp_path}/s", buckets=3)
    for part in ("id < 100", "id >= 100"):
        s.append(c.filter(part).select("text", "vector", "source", F.col("id").alias("chunk_index"), "category", F.lit("d").alias("doc_id"), F.lit("").alias("ingested_at")))
    index = ix.StoreIndex(s, 16, EngineConfig(ivf_min_rows=10))
    assert index.refresh() == 2 and index.refresh() == 0

    def same():
        now = s.read().withColumn("id", ix.row_id())
        for where in (None, F.col("category") == "note"):
            allowed = None if where is None else now.filter(where).select("id")
            want = rk.top_bm25(now, "stage word3", 15, where=where)
            got = index.fetch(index.text_hits("stage word3", 15, allowed))
            assert {(r.id, r.text, round(r.bm25, 9)) for r in got.collect()} == {(r.id, r.text, round(r.bm25, 9)) for r in want.collect()}
            near = rk.top_vectors(now, [1.0] * 16, 12, where=where, prefilter=True)
            got = index.fetch(index.vector_hits([1.0] * 16, 12, allowed, probes=999))
            assert {(r.id, round(r.distance, 9)) for r in got.collect()} == {(r.id, round(r.distance, 9)) for r in near.collect()}

    same()
    s.replace(F.col("chunk_index") % 3 == 0)
    assert index.refresh() > 0
    same()
    s.compact()
    index.refresh()
    s.vacuum(1)
    assert index.vacuum() > 0
    same()
    s.replace(F.lit(True))
    assert index.text_hits("stage", 3).count() == 0 and index.fetch(index.vector_hits([1.0] * 16, 3)).count() == 0


def events(spark, rows):
    base = dt.datetime(2031, 1, 1)
    data = [(i, base + dt.timedelta(seconds=s) if s is not None else None, p, k, q) for i, (s, p, k, q) in enumerate(rows)]
    return spark.createDataFrame(data, "event_no long, happened_at timestamp, file_path string, change_kind string, dest_path string")


ROWS = [(0, "a.md", "created", None), (3, "a.md", "modified", None), (5, "a.md", "modified", None), (5.5, "a.md", "modified", None), (10, "a.md", " Modified", None), (11, "a.md", "modified", None), (6, "old.md", "moved", "a.md"),
        (1, "b\\c.md", "created", None), (2, "b/c.md", "modified", None), (1, "x.exe", "created", None), (1, ".git/x.md", "created", None), (1, "z.md", "deleted", None), (1, "z.md", "moved", " "), (None, "n.md", "created", None), (1, None, "created", None)]


def test_debounce(spark):
    got = {r.event_no for r in wa.debounce(wa.relevant(events(spark, ROWS))).collect()}
    assert got == {0, 3, 5, 6, 7}
    assert wa.debounce(wa.relevant(events(spark, ROWS).limit(0))).count() == 0


@pytest.mark.parametrize("watermark", [None, "1 hour"])
def test_stream_equals_batch(spark, tmp_path, watermark):
    df = wa.relevant(events(spark, ROWS))
    at = f"{tmp_path}/events"
    df.coalesce(1).write.parquet(at)
    stream = spark.readStream.schema(df.schema).parquet(at)
    q = wa.debounce_stream(stream, watermark=watermark).writeStream.format("memory").queryName(f"accepted{watermark is None}").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.target, r.at) for r in spark.table(f"accepted{watermark is None}").collect())
    assert got == sorted((r.target, r.happened_at) for r in wa.debounce(df).collect())


def test_watcher_updates_the_store(kb, folder):
    kb.start_watcher(str(folder))
    with pytest.raises(RuntimeError):
        kb.start_watcher(str(folder))
    (folder / "docs/new.txt").write_text("A new file about sediment arrives while watching.")
    until = time.time() + 60
    while time.time() < until and kb.get_document("new.txt").count() == 0:
        time.sleep(1)
    assert kb.stop_watcher() and not kb.stop_watcher()
    assert kb.get_document("new.txt").count() == 1
    with pytest.raises(ValueError):
        kb.start_watcher("/no/such/folder")


@pytest.mark.parametrize("trailing", [False, True])
def test_watcher_sees_rewritten_and_moved_files(spark, tmp_path, trailing):
    root = tmp_path / "in"
    (root / "node_modules").mkdir(parents=True)
    (root / "a.txt").write_text("one")
    (root / "b.txt").write_text("another")
    seen = []
    w = wa.Watcher(spark, str(root), lambda e: seen.append(sorted((r.target.rsplit("/", 1)[1], r.kind) for r in e.collect())), f"file://{tmp_path}/w", 3600, trailing)
    assert w.step() == 0 and not seen
    (root / "a.txt").write_text("rewritten")
    (root / "node_modules/c.txt").write_text("left out")
    (root / "d.exe").write_text("no text")
    assert w.step() == 1 and seen[-1] == [("a.txt", "modified")]
    (root / "a.txt").write_text("rewritten once more")  # within the wait
    (root / "b.txt").rename(root / "moved.txt")
    (root / "new.txt").write_text("created")
    assert w.step() == 2 and seen[-1] == [("moved.txt", "moved"), ("new.txt", "created")]
    (root / "new.txt").unlink()
    again = wa.Watcher(spark, str(root), w.apply, w.checkpoint, 0.0, trailing)  # goes on where the first one was
    assert again.step() == trailing and seen[-1] == ([("a.txt", "modified")] if trailing else [("moved.txt", "moved"), ("new.txt", "created")])
    assert w.step() == 0


def test_images(spark, tmp_path, folder):
    e = vx.HashingEmbedder(64)
    k = KnowledgeBase(spark, f"file://{tmp_path}/imgdb", CONFIG, e, image_embedder=lambda path: vx.embed(path, e))
    assert k.ingest_images(str(folder)) == 1 and k.ingest_images(str(folder)) == 0
    import os

    os.utime(folder / "docs/picture.png", (1, 1))
    assert k.ingest_images(str(folder)) == 1 and k.images.read().count() == 1
    other = KnowledgeBase(spark, k.path, CONFIG, vx.HashingEmbedder(8), image_embedder=k.image_embedder, image_text_embedder=e)
    assert other.search_images("docs picture png").first().similarity > 0.5  # the images' model, not that of texts
    got = k.search_images("docs picture png", source_filter="doc%")
    assert got.first().similarity > 0.5 and k.search_images("x", source_filter="none").count() == 0


def test_http(kb):
    server = serve(kb, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_address[1]}"

    def post(data: bytes):
        return json.load(urllib.request.urlopen(urllib.request.Request(at + "/api/search", data)))

    assert json.load(urllib.request.urlopen(at + "/api/status"))["documents"] == 4
    got = post(b'{"query": "walls", "mode": "text"}')
    assert got["ok"] and got["results"][0]["source"] == "papers/ifc.md"
    assert not post(b'{"query": " "}')["ok"]
    for path, data, code in (("/x", None, 404), ("/api/search", b"{", 400)):
        with pytest.raises(urllib.error.HTTPError) as e:
            urllib.request.urlopen(urllib.request.Request(at + path, data))
        assert e.value.code == code
    server.shutdown()


def test_rebuild(spark, tmp_path, folder):
    from lodestone.operators import rebuild as rb

    store = st.Store(spark, f"file://{tmp_path}/rb", buckets=2)
    at, bad = f"file://{tmp_path}/checkpoint", str(tmp_path / "bad")

    def reader(source, data):
        if source.endswith(".pdf") and not __import__("os").path.exists(bad):
            raise OSError("no converter")
        return ("converted text of the scan, long enough", True) if source.endswith(".pdf") else rd.extract(source, data)

    roots = [str(folder / "docs"), str(folder / "papers")]
    guess = rb.rebuild(store, roots, at, reader=reader, wait=0, dry_run=True).first()
    assert guess.files == 5 and guess.short == 3 and store.read().count() == 0
    first = {r.file_path.split("::")[1]: (r.status, r.chunks, r.attempt) for r in rb.rebuild(store, roots, at, reader=reader, wait=0).collect()}
    assert first == {"flood.txt": ("done", 1, 1), "short.txt": ("empty", 0, 1), "bad.docx": ("empty", 0, 1), "scan.pdf": ("failed", 0, 3), "ifc.md": ("done", 2, 1)}
    open(bad, "w").close()
    second = rb.rebuild(store, roots, at, reader=reader, wait=0).collect()
    assert [(r.file_path.split("::")[1], r.status, r.attempt) for r in second] == [("scan.pdf", "done", 4)] and store.read().count() == 4
    assert rb.rebuild(store, roots, at, reader=reader, wait=0).count() == 0
    text, names = rb.renumber_images("![a](images/x.png) ![b](images/y.jpg) ![a](images/x.png) ![c](images/gone.png)", {"images/x.png", "images/y.jpg"})
    assert text == "![a](images/img-001.png) ![b](images/img-002.jpg) ![a](images/img-001.png) ![c](images/gone.png)" and len(names) == 2
    cached = spark.createDataFrame([("p", 1, 2), ("q", 1, 2)], "path string, size long, mtime_ns long")
    assert [r.path for r in rb.uncached(cached, rb.uncached(cached.filter("path = 'p'"), spark.createDataFrame([], "cache_key string"))).collect()] == ["q"]


def test_report(spark):
    from lodestone.operators import manage as mg

    text = mg.report(corpus(spark, 20).withColumn("ingested_at", F.lit("2031-01-01T00:00:00Z")).withColumn("doc_id", F.lit("")))
    assert "Rows: 21" in text and "- note: 10" in text and "- s0 (3)" in text


def test_pipeline(spark, tmp_path):
    def pdf_reader(name, data):
        if b"broken" in data:
            raise ValueError("broken")
        return data.decode(), True

    root = tmp_path / "pdfs"
    (root / "deep").mkdir(parents=True)
    (root / "a.pdf").write_text("# Dams\n\nThe dam holds the water of the river.")
    (root / "deep/b.PDF").write_text("# Locks\n\nA lock lifts ships to the next reach.")
    (root / "bad.pdf").write_text("broken")
    store = st.Store(spark, f"file://{tmp_path}/db", buckets=2)
    assert pl.run(store, str(root), None)[1] == pl.NOTHING and pl.run(store, str(tmp_path / "db"), pdf_reader)[1] == pl.NOTHING
    summary, code = pl.run(store, str(root), pdf_reader, dry_run=True)
    assert code == pl.OK and summary["convert"]["first"] == ["a.pdf", "bad.pdf", "deep/b.PDF"] and not store.exists()
    summary, code = pl.run(store, str(root), pdf_reader, wait=0.0)
    assert code == pl.FAILED and summary["convert"]["done"] == 2 and summary["convert"]["errors"][0][0] == "bad.pdf"
    assert summary["ingest"] == {"done": 2} and {r.source for r in store.read().collect()} == {"a.md", "deep/b.md"}
    (root / "bad.pdf").write_text("# Weirs\n\nA weir keeps the level of the water.")
    summary, code = pl.run(store, str(root), pdf_reader, resume=True, wait=0.0)
    assert code == pl.OK and summary["convert"]["skipped"] == 2 and summary["ingest"] == {"done": 1} and store.read().count() == 3


def test_split_manifest(tmp_path):
    at = tmp_path / "big.pdf"
    at.write_bytes(b"x" * 3_000_000)
    m = pl.split_manifest(str(at), 450, lambda a, b: (b - a + 1) * 10, most_bytes=1500)
    assert [(s["page_start"], s["page_end"]) for s in m["segments"]] == [(1, 100), (101, 200), (201, 300), (301, 400), (401, 450)]
    assert m["segments"][1]["name"] == "big.part-0002.pages-0101-0200.pdf" and m["source_sha256"] == hashlib.sha256(b"x" * 3_000_000).hexdigest()
    for bad in ({"most_pages": 0}, {"most_bytes": 5}):
        with pytest.raises(ValueError):
            pl.split_manifest(str(at), 2, lambda a, b: 10, **bad)


def test_idle_unloading():
    def fails():
        raise RuntimeError

    for last, now, timeout, want in ((1000, 1301, 300, True), (1000, 1200, 300, False), (None, 1e9, 300, False), (0, 1e9, 0, False)):
        u = IdleUnloader(timeout)
        u.last = last
        u.register("bad", fails)
        u.register("good", lambda: True)
        u.register("empty", lambda: False)
        assert u.check(now) == (["good"] if want else []) and u.check(now + 1) == []


def test_embedding_falls_back(spark):
    class Fails(vx.HashingEmbedder):
        def encode(self, texts):
            raise RuntimeError

    df = spark.createDataFrame([("a b",), (None,)], "t string")
    got = df.select(vx.embed(F.col("t"), Fails(8), vx.HashingEmbedder(8)).alias("v")).collect()
    assert np.allclose([r.v for r in got], vx.HashingEmbedder(8).encode(["a b", ""]))


def test_pages_are_capped():
    assert rd.read_pages(3, lambda i: ["one", " ", "three"][i]) == "one\n\nthree"
    assert "first 2 of 3" in rd.read_pages(3, lambda i: "x", 2) and rd.read_pages(3, lambda i: "x", 0) == "x\n\nx\n\nx"


def test_command_line(spark, tmp_path, folder, capsys, monkeypatch):
    from lodestone import __main__ as cli

    monkeypatch.setenv("LODESTONE_DIMS", "64")
    db, out = f"file://{tmp_path}/db", tmp_path / "md"
    assert cli.main([db, "add", str(folder), "--markdown-dir", str(out)]) == 0
    assert (out / "docs/flood.md").read_text().startswith("Flood routing")
    assert cli.main([db, "search", "walls", "--mode", "text", "--full"]) == 0 and "papers/ifc.md" in capsys.readouterr().out
    for command in (["status"], ["list"], ["report"], ["dedupe"], ["delete", "flood"], ["update", str(folder / "papers/ifc.md")], ["rebuild", str(folder), "--dry-run"]):
        assert cli.main([db, *command]) == 0
    assert cli.main([db, "pipeline", str(folder)]) == pl.NOTHING
    assert '"remaining": 4' in capsys.readouterr().out
