"""Reading uploaded files: whole contents, text by suffix, checks before ingest."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import basename, mime_of, trim_all
from docloom.storage import slices
from docloom.sources.pdf import pdf_text

MAX_BYTES, WARN_BYTES = 50 << 20, 10 << 20
SKIPPED = {"script", "style", "head", "noscript"}
BREAKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "ul", "table"}


class _Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.parts, self.depth = [], 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in SKIPPED
        if tag in BREAKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.depth -= tag in SKIPPED and self.depth > 0
        if tag in BREAKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)


def html_text(html: str) -> str:
    parser = _Text()
    parser.feed(html)
    parser.close()
    lines = (re.sub(r"\s+", " ", x).strip() for x in "".join(parser.parts).split("\n"))
    return "\n".join(x for x in lines if x)


#: Unpacked bytes that are read from one office file at most; larger ones are errors.
MAX_UNPACKED = 16 * MAX_BYTES


def _own(tag: str) -> str:
    """A tag's name without its namespace."""
    return tag.rpartition("}")[2]


def _parts(data: bytes, pattern: str) -> list[ElementTree.Element]:
    """The XML parts of an office file whose names fit, by the numbers in their names."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = sorted((n for n in z.namelist() if re.fullmatch(pattern, n)), key=lambda n: [int(x) for x in re.findall(r"\d+", n)])
            if sum(z.getinfo(n).file_size for n in names) > MAX_UNPACKED:
                raise ValueError("too large when unpacked")
            return [ElementTree.fromstring(z.read(n)) for n in names]
    except (zipfile.BadZipFile, ElementTree.ParseError, RuntimeError, NotImplementedError) as e:  # broken, encrypted, unknown packing
        raise ValueError(str(e)) from e


def paragraphs(data: bytes, pattern: str) -> str:
    """The paragraphs of a text or slide file, a line each."""
    lines = ("".join(t.text or "" for t in p.iter() if _own(t.tag) == "t").strip() for root in _parts(data, pattern) for p in root.iter() if _own(p.tag) == "p")
    return "\n".join(x for x in lines if x)


def sheet_rows(data: bytes) -> str:
    """The rows of a workbook, a line each, cells separated by tabs; empty cells are left out."""
    shared = ["".join(t.text or "" for t in si.iter() if _own(t.tag) == "t") for root in _parts(data, r"xl/sharedStrings\.xml") for si in root]

    def value(cell: ElementTree.Element) -> str:
        text = "".join(v.text or "" for v in cell.iter() if _own(v.tag) in {"v", "t"})
        return shared[int(text)] if cell.get("t") == "s" and text.isdigit() and int(text) < len(shared) else text

    rows = ("\t".join(x for c in row if (x := value(c))) for root in _parts(data, r"xl/worksheets/sheet\d+\.xml") for row in root.iter() if _own(row.tag) == "row")
    return "\n".join(x for x in rows if x)


#: Old binary office formats, and names that declare raw bytes: nothing here reads them, whatever looks like text in them.
UNREADABLE = {"doc", "xls", "ppt", "bin"}


def plain_text(data: bytes) -> str:
    return data.decode("utf-8", "replace")


EXTRACTORS: dict[str, Callable[[bytes], str]] = {
    **dict.fromkeys(("txt", "md"), plain_text),
    **dict.fromkeys(("html", "htm"), lambda b: html_text(plain_text(b))),
    "docx": lambda b: paragraphs(b, r"word/document\.xml"),
    "pptx": lambda b: paragraphs(b, r"ppt/slides/slide\d+\.xml"),
    "xlsx": sheet_rows,
    "pdf": pdf_text,
}


def sniffed(data: bytes) -> str | None:
    """The suffix of a kind of file that the bytes show; None if no extractor reads it."""
    if b"%PDF-" in data[:1024]:
        return "pdf"
    if data[:2] == b"PK":
        return next((k for k, part in (("docx", b"word/"), ("pptx", b"ppt/"), ("xlsx", b"xl/")) if part in data), None)
    if re.search(rb"<(?:!doctype html|html|body)\b", data[:2000], re.I):
        return "html"
    try:
        return None if b"\0" in data else "txt" if data.decode() else None
    except UnicodeDecodeError:
        return None


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, filename, file_size, mime_type, content) of whole files."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return described(raw)


def described(raw: DataFrame) -> DataFrame:
    name = basename(F.col("path"))
    return raw.select("path", name.alias("filename"), F.col("length").alias("file_size"), mime_of(name).alias("mime_type"), "content")


def validated(files: DataFrame, size: str = "file_size") -> DataFrame:
    """``files`` with status: empty, too_large, large or ok."""
    n = F.col(size)
    return files.withColumn("status", F.when(n < 1, "empty").when(n > MAX_BYTES, "too_large").when(n > WARN_BYTES, "large").otherwise("ok"))


def new_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose name no stored chunk has."""
    return files.join(known.select("filename").distinct(), "filename", "left_anti")


READ = "filename string, file_size long, mime_type string, text string, reason string"


def read_all(files: DataFrame, extractors: dict[str, Callable[[bytes], str]] = EXTRACTORS) -> DataFrame:
    """``files`` with ``text``, or null and the reason: ``unsupported`` where no extractor fits the suffix or, for
    unknown suffixes, the bytes; ``broken: ...`` where it fails; ``empty`` where it finds nothing."""

    def one(name: str, data: bytes) -> tuple[str | None, str | None]:
        suffix = name.rpartition(".")[2].lower()
        of = extractors.get(suffix) or (None if suffix in UNREADABLE else extractors.get(sniffed(data)))
        if not of:
            return None, "unsupported"
        try:
            text = of(data)
        except ValueError as e:
            return None, f"broken: {e}"
        return (text, None) if text.strip() else (None, "empty")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own in slices(b, "content"):
                found = [one(name, data) for name, data in zip(own.column("filename").to_pylist(), own.column("content").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*own.columns[:3], pa.array([t for t, _ in found], pa.string()), pa.array([r for _, r in found], pa.string())], names=["filename", "file_size", "mime_type", "text", "reason"])

    return files.select("filename", F.col("file_size").cast("long").alias("file_size"), "mime_type", "content").mapInArrow(run, READ)


def extracted(files: DataFrame, extractors: dict[str, Callable[[bytes], str]] = EXTRACTORS) -> DataFrame:
    """``files`` with ``text``, null where no extractor fits or it fails."""
    return read_all(files, extractors).drop("reason")


def rejected(files: DataFrame, extractors: dict[str, Callable[[bytes], str]] = EXTRACTORS) -> DataFrame:
    """(filename, file_size, mime_type, reason) of files without text."""
    return read_all(files, extractors).filter("reason is not null").drop("text")


def html_column(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    of = F.pandas_udf(lambda s: s.map(lambda x: None if x is None else html_text(x)), "string")
    return df.withColumn(out, of(html))


def non_blank(df: DataFrame, text: str = "text") -> DataFrame:
    return df.filter(trim_all(F.col(text)) != "")
