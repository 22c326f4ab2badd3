import contextlib
import http.server
import io
import json
import sys
import threading
import types
import urllib.error
import urllib.request
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark import api, providers
from quillspark.operators import build, extract
from quillspark.server import make_server
from quillspark.sources import readers, sinks
from quillspark.streaming.ingest import ingest

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def docx():
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p("One") + '<w:p><w:r><w:br w:type="page"/></w:r></w:p>' + p("Two") + f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('')}{cell('')}</w:tr></w:tbl>"
    return zipped({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/header1.xml": f"<w:hdr {W}>{p('Head')}</w:hdr>", "word/footer1.xml": f"<w:ftr {W}>{p('Foot')}</w:ftr>"})


def pptx():
    sp = lambda t: f"<p:sp><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>"
    slide = lambda b: f"<p:sld {A}><p:cSld><p:spTree>{b}</p:spTree></p:cSld></p:sld>"
    return zipped({"ppt/slides/slide1.xml": slide(sp("Title") + f"<p:grpSp>{sp('Inner')}</p:grpSp>"), "ppt/slides/slide2.xml": slide(""), "ppt/notesSlides/notesSlide1.xml": f"<p:notes {A}>{sp('Said')}</p:notes>"})


def test_documents(spark, tmp_path):
    (tmp_path / "a.md").write_text("  hello   world  \n\n\n\nsecond ﬁle")
    (tmp_path / "b.docx").write_bytes(docx())
    (tmp_path / "c.pptx").write_bytes(pptx())
    got = {(r["file_name"], r["page_number"]): r["content"] for r in readers.read_documents(spark, str(tmp_path)).collect()}
    assert got[("a.md", 1)] == "hello world\n\nsecond file"
    assert got[("b.docx", 1)] == "Head One" and got[("b.docx", 2)].startswith("Two") and "a | b" in got[("b.docx", 2)]
    assert got[("c.pptx", 1)] == "Title Inner Notes: Said" and got[("c.pptx", 2)] == ""


def test_unsupported():
    with pytest.raises(ValueError):
        readers.parse_bytes("x.xyz", b"")


def span(x, size, y, text, flags=0):
    return {"bbox": (x, 0, 0, 0), "size": size, "origin": (x, y), "text": text, "flags": flags}


def block(y, x, *lines):
    return {"bbox": (x, y, 0, 0), "lines": [{"spans": line} for line in lines]}


def test_pdf_helpers():
    assert readers.superscripts("x2 and y2", ["2", "2"]) == "x^2 and y^2"
    one = lambda t: [span(0, 10, 0, t)]
    assert readers.layout_text([block(10.2, 5, one("b")), block(10.2, 1, one("a")), block(2, 0, one("top")), {"bbox": (0, 0, 0, 0)}]) == "top\n\na\n\nb"
    assert readers.line_text([span(8, 6, 95, "3"), span(0, 10, 100, "10")]) == "10^3"
    # smaller than 0.85 of the usual size and more than 1 above the mean baseline, or flagged
    assert readers.line_text([span(0, 10, 100, "a"), span(5, 8.4, 96, "b"), span(9, 10, 100, "c")]) == "a^bc"
    assert readers.line_text([span(0, 10, 100, "a"), span(5, 8.6, 90, "b"), span(9, 10, 100, "c")]) == "abc"
    assert readers.line_text([span(0, 10, 100, "a"), span(5, 5, 99.5, "b"), span(9, 10, 100, "c")]) == "abc"
    assert readers.line_text([span(0, 10, 100, "a"), span(5, 10, 100, "b", flags=1)]) == "a^b"


class FakePdf:
    """The two engines' interfaces over pages of (plain text, blocks)."""

    pages = []

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass

    def __len__(self):
        return len(self.pages)

    def load_page(self, i):
        return types.SimpleNamespace(get_text=lambda kind: {"blocks": self.pages[i][1]}, get_pixmap=lambda dpi: types.SimpleNamespace(tobytes=lambda form: b"png"))


def test_pdf_engines(monkeypatch):
    long = "Long enough to be a page of its own, with more than ten words in it"
    FakePdf.pages = [("x2 = y " + long, [block(0, 0, [span(0, 10, 100, "x"), span(5, 6, 90, "2"), span(9, 10, 100, " = y")])]), (None, []), ("poor", [])]

    def text(value):
        def run():
            if value is None:
                raise RuntimeError("broken")
            return value

        return types.SimpleNamespace(extract_text=run)

    plumber = types.ModuleType("pdfplumber")
    plumber.open = lambda data: contextlib.nullcontext(types.SimpleNamespace(pages=[text(t) for t, _ in FakePdf.pages]))
    fitz = types.ModuleType("fitz")
    fitz.open = lambda stream, filetype: FakePdf()
    monkeypatch.setitem(sys.modules, "fitz", None)
    monkeypatch.setitem(sys.modules, "pdfplumber", None)
    with pytest.raises(RuntimeError, match="optional"):
        readers.pdf_pages(b"")
    monkeypatch.setitem(sys.modules, "pdfplumber", plumber)
    assert readers.pdf_pages(b"") == ["x2 = y " + long, "", "poor"]
    monkeypatch.setitem(sys.modules, "fitz", fitz)
    assert readers.parse_bytes("a.PDF", b"") == ["x^2 = y " + long, "", "poor"]
    monkeypatch.setattr(readers, "_recognised", lambda page, dpi: "Read by sight: " + long)
    assert readers.pdf_pages(b"") == ["x^2 = y " + long, "Read by sight: " + long, "Read by sight: " + long]
    monkeypatch.setitem(sys.modules, "pdfplumber", None)
    assert readers.pdf_pages(b"", ocr=False) == ["x^2 = y", "", ""]


def test_ppt_needs_an_office_suite(monkeypatch):
    monkeypatch.setattr(readers.shutil, "which", lambda name: None)
    with pytest.raises(RuntimeError, match="office"):
        readers.parse_bytes("x.ppt", b"")


def test_running_heads_go(spark, tmp_path):
    """Lines that repeat at the head or foot of a document's pages are removed."""
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    page = '<w:p><w:r><w:br w:type="page"/></w:r></w:p>'
    body = page.join(p("1. Annual report:") + p(f"Body {i}.") + p("More.") + p("Company confidential.") for i in range(4))
    (tmp_path / "r.docx").write_bytes(zipped({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"}))
    got = [r["content"] for r in readers.read_documents(spark, str(tmp_path)).orderBy("page_number").collect()]
    assert got == [f"Body {i}.\nMore." for i in range(4)]
    plain = readers.read_documents(spark, str(tmp_path), clean=False).first()["content"]
    assert "Annual report" in plain


def test_load_markdown(spark, tmp_path):
    f = tmp_path / "s.md"
    f.write_text("# Sample.pdf\n\n## Metadata\n\n- title: First\n- title: Sample: Document\n- tag\n- _No metadata_\n\n---\n\n# Page 1\n\n\n# page 2\n\nText\n\n# Page 2\n\nAgain\n")
    rows = readers.load(spark, str(f)).collect()
    assert [(r["page_number"], r["content"]) for r in rows] == [(1, ""), (2, "Text"), (2, "Again")]
    assert rows[0]["name"] == "Sample.pdf" and rows[0]["metadata"] == {"title": "Sample: Document"}


def test_load_json(spark, tmp_path):
    f = tmp_path / "s.json"
    f.write_text('{"FileName": "x", "FileContent": [{"page_no": 1, "content": ""}, {"page_no": 2, "content": "t"}]}')
    assert [(r["name"], r["page_number"], r["content"]) for r in readers.load(spark, str(f)).collect()] == [("x", 1, ""), ("x", 2, "t")]


def answers(spark, raw):
    df = spark.createDataFrame([("d", 1, raw, [1, 2])], "document_id string, batch_id long, raw string, allowed array<int>")
    return extract.parse_answers(df)


def test_answers(spark):
    raw = """{"concepts": [{"name": " Magic ", "page_numbers": ["1", 2.7, true, 9, "x"], "aliases": "Spell", "keywords": ["k", " ", null]}, {"name": ""}, 5],
      "relationships": [{"source": "spell", "target": "Other", "type": "USES", "page_numbers": 2}],
      "aliases": [{"alias": "m", "concept": "Magic"}, ["n", "Magic"], ["x"]], "glossary": {"Term": {"definition": "d", "pages": [1]}}}"""
    a = answers(spark, raw)
    c = extract.concepts(a)
    row = c.collect()
    assert [(r["concept_id"], r["page_numbers"], r["aliases"], r["keywords"]) for r in row] == [("magic", [1, 2], ["Spell"], ["k"])]
    assert [(r["source"], r["target"], r["type"], r["page_numbers"]) for r in extract.relationships(a, c).collect()] == [("magic", "other", "uses", [2])]
    assert sorted((r["alias"], r["concept_id"]) for r in extract.aliases(a).collect()) == [("m", "magic"), ("n", "magic")]
    assert [(r["key"], r["page_numbers"]) for r in extract.entries(a, "glossary").collect()] == [("Term", [1])]


def test_answer_without_json_fails(spark):
    with pytest.raises(Exception, match="no JSON"):
        answers(spark, "sorry").select(F.to_json("v")).collect()


def test_retries():
    class Flaky:
        calls = 0

        def complete(self, prompt, images=None):
            self.calls += 1
            if self.calls < 3:
                raise extract.ProviderError("busy")
            return "{}", 1, 1

    assert extract.call_provider(Flaky(), "x", None, 3, 0)[0] == "{}"
    with pytest.raises(extract.ProviderError):
        extract.call_provider(Flaky(), "x", None, 1, 0)


@pytest.fixture(scope="module")
def pages(spark):
    rows = [("doc-a", "A", 1, "sample magic arts are taught in the school"), ("doc-a", "A", 2, "sample energy flows through magic things"), ("doc-a", "A", 3, " "), ("doc-b", "B", 1, "other potion needs magic water")]
    return spark.createDataFrame(rows, "document_id string, title string, page_number int, content string")


def test_build_and_ask(spark, pages, tmp_path):
    root = str(tmp_path / "kb")
    with pytest.raises(FileNotFoundError):
        sinks.current_snapshot(spark, root)
    api.build_kb(pages, root)
    docs = {r["document_id"]: r for r in sinks.read_table(spark, root, "documents").collect()}
    assert (docs["doc-a"]["pages"], docs["doc-a"]["pages_extracted"], docs["doc-a"]["dropped_pages"]) == (3, 2, [3])
    out = api.ask(spark, root, "which magic is taught?")
    assert out["concepts_used"] and out["documents_used"] == ["doc-a", "doc-b"] and "sample-magic-arts" in out["concepts_used"]
    assert api.ask(spark, root, "zzzz")["answer"] == api.NO_RESULT
    api.build_kb(pages.where("document_id = 'doc-b'"), root)
    again = {r["document_id"]: r["version"] for r in api.list_bundles(spark, root).collect()}
    assert again == {"doc-a": 1, "doc-b": 2}
    assert api.registry_stats(spark, root).first()["documents"] == 2
    assert api.page(spark, root, "doc-a", 2).count() == 1 and api.concept(spark, root, "doc-a", "sample-magic-arts").count() == 1
    assert set(api.indexes(spark, root, "doc-a")) == {"keyword", "page", "alias", "glossary", "procedure", "api"}
    nodes, _ = api.merged_graph(spark, root)
    assert nodes.count() == 3


def changed_pages(spark, title, text):
    return spark.createDataFrame([("doc-b", title, 1, text)], "document_id string, title string, page_number int, content string")


def test_builds_in_parallel(spark, pages, tmp_path):
    """A build that another one overtakes fails and changes nothing; a reader keeps
    the state that it opened; a crash before the commit leaves the old state."""
    root = str(tmp_path / "kb")
    first = api.build_kb(pages, root)
    opened = sinks.current_snapshot(spark, root)
    rows = {t: opened.read(spark, t) for t in api.TABLES}
    second = api.build_kb(changed_pages(spark, "B2", "entirely new words here"), root)
    assert (first.number, second.number) == (1, 2) and sinks.current_snapshot(spark, root).number == 2
    with pytest.raises(sinks.StoreChanged):
        sinks.write_snapshot(spark, rows, opened)
    assert sinks.current_snapshot(spark, root) == second
    assert opened.read(spark, "documents").where("document_id = 'doc-b'").first()["title"] == "B"
    assert sinks.read_table(spark, root, "documents").where("document_id = 'doc-b'").first()["title"] == "B2"
    (tmp_path / "kb" / "manifests" / "000000000009.draft").write_text("{")  # a writer that stopped
    assert sinks.current_snapshot(spark, root).number == 2
    (tmp_path / "kb" / "manifests" / "000000000003.json").write_text("{")  # unreadable is not absent
    with pytest.raises(ValueError):
        api.build_kb(pages, root)


def test_a_change_rewrites_its_bucket_only(spark, pages, tmp_path):
    root = str(tmp_path / "kb")
    config = api.Config(buckets=64)
    first = api.build_kb(pages, root, config=config)
    second = api.build_kb(changed_pages(spark, "B2", "other potion needs fire"), root, config=config)
    bucket = str(spark.createDataFrame([("doc-b",)], "document_id string").select(first.bucket_of()).first()[0])
    for t in ("documents", "pages", "concepts"):
        old, new = first.tables[t]["folders"], second.tables[t]["folders"]
        assert len(old) == 2 and set(old) == set(new) and old[bucket] != new[bucket]
        assert {b: f for b, f in old.items() if b != bucket} == {b: f for b, f in new.items() if b != bucket}
    rows = second.read(spark, "pages").collect()
    assert {(r["document_id"], r["content"]) for r in rows if r["document_id"] == "doc-b"} == {("doc-b", "other potion needs fire")} and len(rows) == 3


class Naming(extract.WordProvider):
    """Names the first two words of a page as an alias of its concept."""

    def complete(self, prompt, images=None):
        answer = json.loads(super().complete(prompt)[0])
        answer["aliases"] = [{"alias": c["aliases"][0], "concept": c["name"]} for c in answer["concepts"]]
        return json.dumps(answer), 1, 1


def test_first_alias_stays(spark, tmp_path):
    """The concept of the build that came first, not of the smallest id."""
    page = lambda doc, text: spark.createDataFrame([(doc, doc, 1, text)], "document_id string, title string, page_number int, content string")
    root = str(tmp_path / "kb")
    api.build_kb(page("doc-z", "red fox runs"), root, Naming())
    api.build_kb(page("doc-a", "red fox sleeps"), root, Naming())
    alias = {r["alias"]: r["concept_id"] for r in api.open_store(spark, root).registry_aliases.collect()}
    assert alias["red fox"] == "red-fox-runs"
    api.build_kb(page("doc-z", "grey wolf hunts"), root, Naming())  # what was registered stays
    assert {r["alias"]: r["concept_id"] for r in api.open_store(spark, root).registry_aliases.collect()}["red fox"] == "red-fox-runs"


class Seeing(extract.WordProvider):
    """Answers with the images that it was shown."""

    supports_images = True

    def complete(self, prompt, images=None):
        if images is None:
            return super().complete(prompt)
        return json.dumps({"concepts": [{"name": f"{len(images)} images {images[0]}", "page_numbers": [2]}]}), 1, 1


def test_image_pages(spark, tmp_path):
    """Paths are resolved, missing files dropped and reported, the others sent as data
    URLs."""
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "p2.png").write_bytes(b"PNG")
    rows = [("d", "D", 1, "some text here"), ("d", "D", 2, "img/x/../p2.png"), ("d", "D", 3, "img/p3.png")]
    pages = spark.createDataFrame(rows, "document_id string, title string, page_number int, content string")
    tables = api.build_tables(pages, Seeing(), api.Config(image_folder=str(tmp_path / "img" / "..").replace("/img/..", "")))
    assert tables["documents"].first()["dropped_pages"] == [3]
    names = {r["name"] for r in tables["concepts"].collect()}
    assert "1 images data:image/png;base64,UE5H" in names
    batches = spark.createDataFrame([("d", 1, "image", [2, 3], ["/a", "/b"])], "document_id string, batch_id long, content_type string, page_numbers array<int>, images array<string>")
    files = spark.createDataFrame([("/a",)], "path string")
    assert [r["error"] for r in build.image_errors(batches, files).collect()] == ["Batch 1: image file for page 3 not readable: /b"]


def test_server(spark, pages, tmp_path):
    root = str(tmp_path / "kb")
    api.build_kb(pages, root)
    server = make_server(spark, root, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}/api/"

    def get(path, body=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, json.dumps(body).encode() if body is not None else None)) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    assert [b["document_id"] for b in get("bundles")[1]["bundles"]] == ["doc-a", "doc-b"]
    assert get("registry")[1]["documents"] == 2 and get("bundle/doc-a")[1]["document"]["title"] == "A"
    assert get("bundle/doc-a/concept/sample-magic-arts")[1]["name"] == "sample magic arts"
    assert get("bundle/doc-a/page/2")[1]["content"].startswith("sample energy")
    assert {n["id"] for n in get("graph/all")[1]["nodes"]} >= {"sample-magic-arts"} and set(get("bundle/doc-b/indexes")[1]["indexes"]) >= {"keyword_index", "page_index"}
    assert [get(p)[0] for p in ("bundle/doc-x", "bundle/doc-a/page/9", "nothing")] == [404] * 3
    assert get("ask", {"query": "which magic is taught?"})[1]["documents_used"] == ["doc-a", "doc-b"]
    assert [get("ask", b)[0] for b in ({}, {"query": "x", "scope": "doc-a"}, {"query": "x", "scope": ["doc-x"]})] == [400] * 3
    server.shutdown()


def test_chat_provider():
    """The request, the answer and the kinds of errors, against a local service."""
    seen, replies = [], []

    class Service(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.path, self.headers["Authorization"], json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            status, body = replies.pop(0)
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *_):
            pass

    service = http.server.HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=service.serve_forever, daemon=True).start()
    chat = providers.ChatProvider(f"http://127.0.0.1:{service.server_address[1]}/v1/", "m", "Be brief.", "key", extra_body={"top_p": 1})
    good = {"choices": [{"message": {"content": "{}"}}], "usage": {"prompt_tokens": 3, "completion_tokens": 2}}
    replies += [(200, good), (200, {"choices": [{"message": {"content": [{"text": "a"}, {"text": "b"}]}}]})]
    assert chat.complete("hello") == ("{}", 3, 2) and chat.complete("see", ["data:x"]) == ("ab", 0, 0)
    assert seen[0] == ("/v1/chat/completions", "Bearer key", {"model": "m", "messages": [{"role": "system", "content": "Be brief."}, {"role": "user", "content": "hello"}], "temperature": 0.0, "top_p": 1})
    assert seen[1][2]["messages"][1]["content"] == [{"type": "text", "text": "see"}, {"type": "image_url", "image_url": {"url": "data:x"}}]
    for status, body, kind in ((401, {}, extract.AuthenticationError), (429, {}, providers.RateLimited), (400, {}, providers.BadRequest), (503, {}, extract.ProviderError), (200, {}, extract.ProviderError), (200, {"choices": [{"message": {"content": ""}}]}, extract.ProviderError)):
        replies.append((status, body))
        with pytest.raises(kind):
            chat.complete("x")
    replies += [(429, {}), (503, {}), (200, good)]
    assert extract.call_provider(chat, "x", None, 3, 0)[0] == "{}"
    replies += [(401, {}), (200, good)]
    with pytest.raises(extract.AuthenticationError):  # not tried again
        extract.call_provider(chat, "x", None, 3, 0)
    service.shutdown()
    assert providers.full_name("m", "p") == "p/m" and providers.full_name("a/m", "p") == "a/m"


def test_run_sync():
    async def one():
        return 1

    async def inside():
        return api.run_sync(one())

    assert api.run_sync(one()) == 1 and api.run_sync(inside()) == 1


def test_export_and_dump(spark, pages, tmp_path):
    root, out = str(tmp_path / "kb"), tmp_path / "out"
    api.build_kb(pages, root)
    api.export_bundles(spark, root, str(out))
    assert {p.name for p in (out / "concepts").iterdir() if p.is_dir()} == {"document_id=doc-a", "document_id=doc-b"}
    api.ask(spark, root, "which magic is taught?", config=api.Config(dump=str(tmp_path / "steps")))
    assert {"terms", "found", "bm25", "top", "evidence"} <= {p.name for p in (tmp_path / "steps").iterdir()}


def test_export_sorts_keys(spark, tmp_path):
    df = spark.createDataFrame([(2, {"z": 1, "a": 2})], "b int, a map<string,int>")
    sinks.export_json(df, str(tmp_path / "out"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"a":{"a":2,"z":1},"b":2}']


def test_streaming(spark, pages, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "kb")
    pages.coalesce(1).write.parquet(source)
    ingest(spark, source, root, str(tmp_path / "cp")).awaitTermination(120)
    assert sinks.read_table(spark, root, "documents").count() == 2


def test_vision_gate(spark):
    batches = spark.createDataFrame([("d", "image")], "document_id string, content_type string")
    with pytest.raises(ValueError):
        extract.check_vision(batches, extract.WordProvider())
