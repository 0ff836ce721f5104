"""Book files as rows: discovery, hashes, and the pages of EPUB and PDF files."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectorium.functions.python_udfs import cleaned, html_text
from lectorium.functions.text import detect_format

PROBE = "source_path string, book_format string, title string, author string, page_count int, toc array<struct<title:string,page:int>>, error string"
PAGES = "source_path string, page_num int, text string, error string"


def find_books(spark: SparkSession, path: str) -> DataFrame:
    """(source_path, book_format, file_hash, size) of a file, or of all .pdf and .epub files below a folder.

    A single file is taken whatever its name; one of an unknown format has the format ''.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = files.select(F.col("path").alias("source_path"), detect_format(F.col("path")).alias("book_format"), F.sha2("content", 256).alias("file_hash"), F.col("length").alias("size"))
    single = F.regexp_replace(F.col("source_path"), "^file:/*", "/") == path
    return named.where((F.col("book_format") != "") | single)


def contents(spark: SparkSession, path: str) -> DataFrame:
    """(source_path, book_format, content) of the same files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("source_path"), detect_format(F.col("path")).alias("book_format"), "content")


def folder_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(folder, files, bytes) of each folder directly below `path`, with all that is in it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    inside = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + path.rstrip("/") + "/", "")
    return files.groupBy(F.regexp_extract(inside, "^([^/]*)/", 1).alias("folder")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


class Epub:
    """Metadata, contents and pages of an EPUB file; a page is a document of the spine."""

    def __init__(self, raw: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(raw))
        container = ElementTree.fromstring(self.zip.read("META-INF/container.xml"))
        self.opf_path = next(e.attrib["full-path"] for e in container.iter() if _local(e.tag) == "rootfile")
        self.folder = posixpath.dirname(self.opf_path)
        self.opf = ElementTree.fromstring(self.zip.read(self.opf_path))
        self.items = {e.attrib["id"]: e.attrib for e in self.opf.iter() if _local(e.tag) == "item"}

    def _meta(self, name: str) -> str:
        return next(((e.text or "").strip() for e in self.opf.iter() if _local(e.tag) == name), "")

    @property
    def title(self) -> str:
        return self._meta("title")

    @property
    def author(self) -> str:
        return self._meta("creator")

    def documents(self) -> list[str]:
        """Paths of the spine's documents in reading order; all documents if the spine names none."""
        texts = {i: a for i, a in self.items.items() if a.get("media-type") in ("application/xhtml+xml", "text/html")}
        spine = [e.attrib.get("idref", "") for e in self.opf.iter() if _local(e.tag) == "itemref"]
        chosen = [texts[i] for i in spine if i in texts] or list(texts.values())
        return [posixpath.normpath(posixpath.join(self.folder, unquote(a["href"]))) for a in chosen]

    def pages(self) -> list[str]:
        return [cleaned(html_text(self.zip.read(p).decode("utf-8", "replace")) or "") for p in self.documents()]

    def contents(self) -> list[str]:
        """Titles of the table of contents, nested ones in their place: of the navigation document, else of the NCX."""
        nav = next((a for a in self.items.values() if "nav" in a.get("properties", "").split()), None)
        titles = self._nav_titles(self._item(nav)) if nav else []
        ncx = next((a for a in self.items.values() if a.get("media-type") == "application/x-dtbncx+xml"), None)
        if titles or ncx is None:
            return titles
        root = ElementTree.fromstring(self._item(ncx))
        return ["".join(e.itertext()).strip() for e in root.iter() if _local(e.tag) == "navLabel" and e is not None][_doc_titles(root):]

    def _item(self, attributes: dict[str, str]) -> bytes:
        return self.zip.read(posixpath.normpath(posixpath.join(self.folder, unquote(attributes.get("href", "")))))

    @staticmethod
    def _nav_titles(raw: bytes) -> list[str]:
        """Labels of the entries in the `nav` whose type is toc; landmarks and lists of pages are left out."""
        root = ElementTree.fromstring(raw)
        found = [e for e in root.iter() if _local(e.tag) == "nav"]
        chosen = next((e for e in found if any(_local(k) == "type" and "toc" in v.split() for k, v in e.attrib.items())), None)
        if chosen is None:
            return []
        labels = (next((c for c in e if _local(c.tag) in ("a", "span")), None) for e in chosen.iter() if _local(e.tag) == "li")
        return [title for label in labels if label is not None and (title := " ".join("".join(label.itertext()).split()))]


def _doc_titles(root: ElementTree.Element) -> int:
    """navLabels that stand outside the navMap come first and aren't entries."""
    nav = next((e for e in root.iter() if _local(e.tag) == "navMap"), None)
    inside = sum(_local(e.tag) == "navLabel" for e in nav.iter()) if nav is not None else 0
    return sum(_local(e.tag) == "navLabel" for e in root.iter()) - inside


def _open_pdf(raw: bytes):
    try:
        import fitz
    except ImportError as missing:
        raise RuntimeError("no PDF library is installed") from missing
    return fitz.open(stream=raw, filetype="pdf")


def _probe_one(path: str, kind: str, raw: bytes) -> tuple:
    if kind == "epub":
        book = Epub(raw)
        return path, kind, book.title, book.author, len(book.documents()), [{"title": t, "page": None} for t in book.contents()], None
    if kind == "pdf":
        with _open_pdf(raw) as doc:
            meta, toc = doc.metadata or {}, [{"title": t, "page": p} for level, t, p in doc.get_toc(simple=True) if level == 1]
            return path, kind, meta.get("title") or "", meta.get("author") or "", len(doc), toc, None
    raise ValueError("unsupported format")


def _pages_one(kind: str, raw: bytes) -> list[str]:
    if kind == "epub":
        return Epub(raw).pages()
    with _open_pdf(raw) as doc:
        return [page.get_text("text") for page in doc]


def probe(files: DataFrame) -> DataFrame:
    """Metadata of each file of `contents`; a file that can't be read has its error and no pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, kind, raw in zip(batch["source_path"], batch["book_format"], batch["content"]):
                try:
                    rows.append(_probe_one(path, kind, bytes(raw)))
                except Exception as error:  # noqa: BLE001 - any broken file is reported, not fatal
                    rows.append((path, kind, "", "", 0, [], f"{type(error).__name__}: {error}"[:300]))
            yield pd.DataFrame(rows, columns=["source_path", "book_format", "title", "author", "page_count", "toc", "error"])

    return files.mapInPandas(run, PROBE)


def pages(files: DataFrame) -> DataFrame:
    """(source_path, page_num, text, error): a row a page, or one row with the error of a file that can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, kind, raw in zip(batch["source_path"], batch["book_format"], batch["content"]):
                try:
                    texts = _pages_one(kind, bytes(raw))
                    yield pd.DataFrame({"source_path": path, "page_num": range(1, len(texts) + 1), "text": texts, "error": None})
                except Exception as error:  # noqa: BLE001
                    yield pd.DataFrame({"source_path": [path], "page_num": [0], "text": [None], "error": [f"{type(error).__name__}: {error}"[:300]]})

    return files.mapInPandas(run, PAGES)
