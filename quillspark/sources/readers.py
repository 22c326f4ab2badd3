"""Reading documents: markdown, JSON, DOCX, PPTX, PDF, and parsed files.

``read_documents`` is the one entry: a directory listing as ``binaryFile`` rows,
parsed where the file is, one output row per page.  Formats whose libraries are
not installed raise for the files that need them.
"""
from __future__ import annotations

import importlib
import io
import os
import re
import shutil
import subprocess
import tempfile
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import build
from ..shipping import ship
from ..workspace import Workspace

EXTENSIONS = (".pdf", ".docx", ".pptx", ".ppt", ".md", ".markdown")
PAGE_SCHEMA = "path string, file_name string, page_number long, content string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"


def extension(path: str) -> str:
    m = re.search(r"\.[^./\\]+$", path)
    return m[0].lower() if m else ""


# -- DOCX ------------------------------------------------------------------------
def _run_text(node) -> str:
    out = []
    for x in node.iter():
        if x.tag == _W + "t":
            out.append(x.text or "")
        elif x.tag == _W + "tab":
            out.append("\t")
        elif x.tag == _W + "br":
            out.append("\f" if x.get(_W + "type") == "page" else "\n")
        elif x.tag == _W + "lastRenderedPageBreak":
            out.append("\f")
    return "".join(out)


def _table_rows(table, row: str, cell: str, text) -> list[str]:
    lines = []
    for r in table.iter(row):
        cells = [" ".join(text(c).split()) for c in r.iter(cell)]
        if any(cells):
            lines.append(" | ".join(cells))
    return lines


def docx_text(data: bytes) -> str:
    """Headers, body (page breaks as form feeds), tables, footers."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted(z.namelist())
        part = lambda name: ElementTree.fromstring(z.read(name))
        edges = {k: [part(n) for n in names if re.fullmatch(rf"word/{k}\d*\.xml", n)] for k in ("header", "footer")}
        body = part("word/document.xml").find(_W + "body")
    lines = [t for root in edges["header"] for p in root.iter(_W + "p") if (t := _run_text(p)).strip()]
    tables = []
    for child in body:
        if child.tag == _W + "p":
            lines.append(_run_text(child))
        elif child.tag == _W + "tbl":
            tables += _table_rows(child, _W + "tr", _W + "tc", _run_text)
    lines += tables
    lines += [t for root in edges["footer"] for p in root.iter(_W + "p") if (t := _run_text(p)).strip()]
    return "\n".join(lines)


def split_form_feeds(text: str) -> list[str]:
    """Non-empty parts between form feeds; one page if there is none."""
    parts = [p.strip() for p in text.split("\f")]
    return [p for p in parts if p] or [text.strip()]


# -- PPTX ------------------------------------------------------------------------
def pptx_pages(data: bytes) -> list[str]:
    """A page per slide: text of shapes (groups included), tables, then notes."""
    pages = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        slides = sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        for name in slides:
            root, lines = ElementTree.fromstring(z.read(name)), []
            paragraphs = lambda node: [t for p in node.iter(_A + "p") if (t := "".join(x.text or "" for x in p.iter(_A + "t"))).strip()]

            def walk(node):
                for x in node:
                    if x.tag == _P + "sp":
                        lines.extend(paragraphs(x))
                    elif x.tag == _P + "graphicFrame":
                        lines.extend(_table_rows(x, _A + "tr", _A + "tc", lambda c: " ".join(paragraphs(c))))
                    elif x.tag in (_P + "grpSp", _P + "spTree", _P + "cSld"):
                        walk(x)

            walk(root)
            notes = name.replace("slides/slide", "notesSlides/notesSlide")
            if notes in names:
                said = paragraphs(ElementTree.fromstring(z.read(notes)))
                if said:
                    lines.append("Notes: " + "\n".join(said))
            pages.append("\n".join(lines))
    return pages


# -- PDF -------------------------------------------------------------------------
# The flag of a raised span, and what counts as smaller and higher.
RAISED_FLAG, SMALLER, HIGHER = 1, 0.85, 1.0


def raised(spans: list[dict]) -> list[dict]:
    """The exponents among a line's spans (``text``, ``size``, ``origin``, ``flags``):
    flagged ones, and those smaller than 0.85 of the line's usual size that lie more
    than 1 above its mean baseline."""
    sizes = [s["size"] for s in spans if s["size"] > 0]
    usual = max(set(sizes), key=lambda v: (sizes.count(v), v)) if sizes else 0.0
    base = sum(s["origin"][1] for s in spans) / len(spans) if spans else 0.0
    high = lambda s: usual > 0 and s["size"] < SMALLER * usual and s["origin"][1] < base - HIGHER
    return [s for s in spans if s["text"] and (s.get("flags", 0) & RAISED_FLAG or high(s))]


def superscripts(text: str, spans: list[str]) -> str:
    """A caret before the right-most place of each span that has none yet."""
    for span in spans:
        at = len(text)
        while span and (at := text.rfind(span, 0, at)) >= 0:
            if at == 0 or text[at - 1] != "^":
                text = text[:at] + "^" + text[at:]
                break
    return text


def line_text(spans: list[dict]) -> str:
    """A line from its spans, left to right, a caret before each exponent."""
    spans = sorted(spans, key=lambda s: s["bbox"][0])
    high = [id(s) for s in raised(spans)]
    return "".join(("^" if id(s) in high else "") + s["text"] for s in spans if s["text"])


def layout_text(blocks: list[dict]) -> str:
    """Text blocks from top to bottom, then left to right, a line each for the lines
    that have text."""
    ordered = sorted((b for b in blocks if "lines" in b), key=lambda b: (round(b["bbox"][1], 1), b["bbox"][0]))
    texts = ["\n".join(t for line in b["lines"] if (t := line_text(line["spans"]))) for b in ordered]
    return "\n\n".join(t for t in texts if t)


def is_poor(text: str, min_chars: int = 50, min_words: int = 10) -> bool:
    return len(text.strip()) < min_chars or len(re.findall(r"\w+", text)) < min_words


def is_better(new: str, old: str) -> bool:
    """Whether a second reading of a page takes the place of the first."""
    return not is_poor(new) and (len(new) > len(old) or len(re.findall(r"\w+", new)) > len(re.findall(r"\w+", old)))


def _optional(name: str):
    try:
        return importlib.import_module(name)
    except ImportError:
        return None


def _page_image(page, dpi: int, form: str = "png") -> bytes:
    data = page.get_pixmap(dpi=dpi).tobytes("png")
    if form == "png":
        return data
    image = _optional("PIL.Image")
    if image is None:
        raise RuntimeError(f"{form} images of pages need the optional package pillow")
    out = io.BytesIO()
    image.open(io.BytesIO(data)).save(out, format=form.upper())
    return out.getvalue()


def _recognised(page, dpi: int) -> str:
    """The page's text by OCR, empty where no engine is installed or it fails."""
    engine, image = _optional("pytesseract"), _optional("PIL.Image")
    if engine is None or image is None:
        return ""
    try:
        return engine.image_to_string(image.open(io.BytesIO(_page_image(page, dpi))))
    except Exception:  # a page that cannot be recognised keeps its first reading
        return ""


def pdf_pages(data: bytes, ocr: bool = True, dpi: int = 200) -> list[str]:
    """Page texts by the installed engines.

    ``pdfplumber`` gives the text and ``fitz`` the exponents in it; alone, ``fitz``
    lays the page out from its spans.  A poor page is read again by OCR, which is
    taken if it is better.  A page that fails is empty; without either engine the
    call raises."""
    plumber, fitz = _optional("pdfplumber"), _optional("fitz")
    if plumber is None and fitz is None:
        raise RuntimeError("reading PDF needs one of the optional packages pdfplumber and pymupdf")
    texts, pages = None, None
    if plumber is not None:
        with plumber.open(io.BytesIO(data)) as pdf:
            texts = []
            for page in pdf.pages:
                try:
                    texts.append(page.extract_text() or "")
                except Exception:  # a broken page is an empty page
                    texts.append("")
    if fitz is None:
        return texts
    out = []
    with fitz.open(stream=data, filetype="pdf") as pdf:
        pages = [pdf.load_page(i) for i in range(len(pdf))]
        for i, page in enumerate(pages):
            blocks = page.get_text("dict").get("blocks", [])
            if texts is None:
                text = layout_text(blocks)
            else:
                spans = [s for b in blocks for line in b.get("lines", []) for s in raised(line["spans"])]
                text = superscripts(texts[i] if i < len(texts) else "", [s["text"] for s in sorted(spans, key=lambda s: -s["bbox"][0])])
            if ocr and is_poor(text) and is_better(again := _recognised(page, dpi), text):
                text = again
            out.append(text)
    return out


def ppt_to_pptx(data: bytes) -> bytes:
    """A binary presentation converted by an installed office suite, in a folder that
    is removed again."""
    office = shutil.which("soffice") or shutil.which("libreoffice")
    if office is None:
        raise RuntimeError("reading .ppt needs an office suite (soffice) on the executors")
    with tempfile.TemporaryDirectory() as folder:
        source = os.path.join(folder, "slides.ppt")
        with open(source, "wb") as f:
            f.write(data)
        done = subprocess.run([office, "--headless", "--convert-to", "pptx", "--outdir", folder, source], capture_output=True, timeout=300)
        target = os.path.join(folder, "slides.pptx")
        if done.returncode or not os.path.exists(target):
            raise RuntimeError(f"the .ppt file cannot be converted: {done.stderr.decode(errors='replace')[-300:]}")
        with open(target, "rb") as f:
            return f.read()


def parse_bytes(path: str, data: bytes) -> list[str]:
    kind = extension(path)
    if kind in (".md", ".markdown"):
        return [data.decode("utf-8", "replace")]
    if kind == ".docx":
        return split_form_feeds(docx_text(data))
    if kind == ".pptx":
        return pptx_pages(data)
    if kind == ".ppt":
        return pptx_pages(ppt_to_pptx(data))
    if kind == ".pdf":
        return pdf_pages(data)
    raise ValueError(f"unsupported format: {kind or path}")


def _parsed(batches):
    for rows in batches:
        out = []
        for path, data in zip(rows["path"], rows["content"]):
            name = path.rsplit("/", 1)[-1]
            out += [(path, name, i, page) for i, page in enumerate(parse_bytes(path, data), 1)]
        yield pd.DataFrame(out, columns=["path", "file_name", "page_number", "content"])


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    return files.load(path).select("path", "content")


def read_documents(spark: SparkSession, path: str, glob: str = "*", clean: bool = True) -> DataFrame:
    """``(path, file_name, page_number, content)`` of the files below ``path``.

    Unless ``clean`` is off, pages are cleaned (NFKC first), and lines that repeat at
    the head or foot of a document's pages are removed."""
    pages = _files(spark, path, glob).mapInPandas(_parsed, PAGE_SCHEMA)
    if not clean:
        return pages
    from ..functions.unicode import nfkc

    # written once: the headers are found and removed without parsing again
    once = Workspace(spark, "parsed").keep(pages.withColumn("content", T.cleanup_page(nfkc(F.col("content")))), "pages")
    done = build.remove_headers(once.withColumnRenamed("path", "document_id"))
    return done.select(F.col("document_id").alias("path"), "file_name", "page_number", "content")


def page_images(spark: SparkSession, path: str, glob: str = "*.pdf", dpi: int = 200, form: str = "webp") -> DataFrame:
    """``(path, page_number, name, image)``: every PDF page as an image, named
    ``<safe file name>_page_<n>.<form>``.  Needs ``fitz`` on the executors."""

    def run(batches):
        fitz = _optional("fitz")
        if fitz is None:
            raise RuntimeError("images of PDF pages need the optional package pymupdf")
        for rows in batches:
            for file, data in zip(rows["path"], rows["content"]):
                stem = re.sub(r'[\\/:*?"<>|]', "_", file.rsplit("/", 1)[-1].rsplit(".", 1)[0]).strip(". ") or "document"
                with fitz.open(stream=data, filetype="pdf") as pdf:
                    for i in range(len(pdf)):
                        image = _page_image(pdf.load_page(i), dpi, form)
                        yield pd.DataFrame([(file, i + 1, f"{stem}_page_{i + 1}.{form}", image)], columns=["path", "page_number", "name", "image"])

    return _files(spark, path, glob).mapInPandas(run, "path string, page_number long, name string, image binary")


# -- parsed files ------------------------------------------------------------------
def load_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Parsed markdown -> ``(path, name, metadata, page_number, content)``.

    The file starts with ``# name``, may have a ``## Metadata`` block, and has
    ``# Page N`` sections; what stands before the first page is dropped and
    repeated page numbers stay rows of their own."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))
    wrong = F.raise_error(F.concat(F.lit("a parsed markdown file starts with a # line: "), F.col("path")))
    files = files.withColumn("text", F.when(F.col("text").startswith("#"), F.col("text")).otherwise(wrong))
    mark = r"(?mi)^#[^\S\n]*Page[^\S\n]+([0-9]+)[^\S\n]*$"
    head = F.element_at(F.split("text", mark), 1)
    lines = F.split(head, "\n")
    entries = F.filter(lines, lambda s: s.rlike(r"^\s*(-\s*)?[^#_\s-][^:]*:") & ~s.rlike(r"^\s*(#|---|_.*_\s*$)"))
    pairs = F.transform(entries, lambda s: F.named_struct(F.lit("key"), F.trim(F.regexp_extract(s, r"^\s*-?\s*([^:]+):", 1)), F.lit("value"), F.trim(F.regexp_extract(s, r"^[^:]+:(.*)$", 1))))
    latest = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    has = F.exists(lines, lambda s: s.rlike(r"(?i)^\s*##\s*metadata"))
    metadata = F.when(has, F.map_from_entries(latest)).otherwise(F.create_map().cast("map<string,string>"))
    numbers = F.regexp_extract_all("text", F.lit(mark), 1)
    bodies = F.slice(F.split("text", mark), 2, F.size(F.split("text", mark)))
    rows = files.select("path", F.trim(F.regexp_replace(F.element_at(lines, 1), "^#+", "")).alias("name"), metadata.alias("metadata"), F.explode(F.arrays_zip(numbers.alias("n"), bodies.alias("b"))).alias("p"))
    return rows.select("path", "name", "metadata", F.col("p.n").cast("long").alias("page_number"), T.strip("p.b").alias("content"))


def load_json(spark: SparkSession, path: str) -> DataFrame:
    """Parsed JSON, in either spelling of its keys, as :func:`load_markdown`'s rows."""
    page = "array<struct<page_number:string,page_no:string,content:string>>"
    schema = f"file_name string, FileName string, metadata map<string,string>, pages {page}, FileContent {page}"
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", schema, {"mode": "FAILFAST"}).alias("d"))
    rows = files.select("path", F.coalesce("d.file_name", "d.FileName").alias("name"), F.coalesce("d.metadata", F.create_map().cast("map<string,string>")).alias("metadata"), F.explode(F.coalesce("d.pages", "d.FileContent")).alias("p"))
    number = F.coalesce("p.page_number", "p.page_no")
    known = F.when(number.isNull(), F.raise_error(F.lit("a page has no number"))).otherwise(number)
    return rows.select("path", "name", "metadata", known.cast("long").alias("page_number"), F.coalesce("p.content", F.lit("")).alias("content"))


def load_text(spark: SparkSession, path: str) -> DataFrame:
    """The plain-text layout of :func:`quillspark.operators.build.format_text`."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    mark = r"(?m)^PAGE_NO : ([0-9]+)$"
    bodies = F.slice(F.split("text", mark), 2, F.size(F.split("text", mark)))
    rows = files.select("path", F.regexp_extract("text", r"^FILE_NAME : (.*)", 1).alias("name"), F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(mark), 1).alias("n"), bodies.alias("b"))).alias("p"))
    body = F.regexp_replace(F.regexp_replace("p.b", r"^\s*CONTENT:\n", ""), r"\n-{51}\s*$", "")
    return rows.select("path", "name", F.create_map().cast("map<string,string>").alias("metadata"), F.col("p.n").cast("long").alias("page_number"), body.alias("content"))


def load(spark: SparkSession, path: str) -> DataFrame:
    """By suffix; an unknown one is tried as markdown."""
    return {".json": load_json, ".txt": load_text}.get(extension(path), load_markdown)(spark, path)
