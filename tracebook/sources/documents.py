"""Office files, books and web pages read to page-level text.

Each reader takes the bytes of one file; `read_pages` runs them over a folder
with the binary file source, one Arrow batch of files at a time.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "source_file string, source_kind string, source_sha1 string, page_no int, page_label string, text string, char_count int, is_scan boolean, has_table boolean, section_title string, warning string"
BLOCKS = frozenset("address article aside blockquote br dd div dl dt figcaption footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
SILENT = frozenset("script style head title".split())
SCAN_BELOW = 30
Page = tuple[str, str, bool, str | None] | tuple[str, str, bool, str | None, str | None]  # label, text, has_table, section_title, warning


class Unreadable(Exception):
    """A file of which no page can be read, and why."""


#: Elements without content, which never stay open.
EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Reader(HTMLParser):
    """Keeps the open elements; text counts unless one of them is silent, and
    every block begins and ends a line. Cells of one table row are set apart."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.lines: list[str] = [""]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.lines.append("")
        if tag not in EMPTY:
            self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:  # what was opened within it and not closed ends with it
            while self.open.pop() != tag:
                pass
        if tag in BLOCKS:
            self.lines.append("")

    def handle_data(self, data: str) -> None:
        if SILENT.isdisjoint(self.open):
            self.lines[-1] += data


def tidy(text: str) -> str:
    lines = [x.strip() for x in text.replace("\xa0", " ").replace("　", " ").replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def html_text(markup: str) -> str:
    """Text of a page: no scripts, styles or head; a new line at block tags."""
    reader = _Reader()
    reader.feed(markup)
    reader.close()
    return tidy("\n".join(reader.lines))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def read_docx(data: bytes) -> list[Page]:
    """Every paragraph with text, also in table cells, numbered in order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    found = []
    for p in root.iter():
        if _local(p.tag) == "p":
            text = tidy("".join(t.text or "" for t in p.iter() if _local(t.tag) == "t"))
            if text:
                found.append(text)
    return [(f"第{i}段", t, False, None) for i, t in enumerate(found, 1)]


def _shape(shape: ElementTree.Element) -> tuple[tuple[int, int], str, bool]:
    off = next((x for x in shape.iter() if _local(x.tag) == "off"), None)
    at = (int(off.get("y", 0)), int(off.get("x", 0))) if off is not None else (0, 0)
    rows = [x for x in shape.iter() if _local(x.tag) == "tr"]
    if rows:
        cells = lambda r: ["".join(t.text or "" for t in c.iter() if _local(t.tag) == "t").strip() for c in r if _local(c.tag) == "tc"]
        return at, "\n".join(" | ".join(cells(r)) for r in rows), True
    paragraphs = ["".join(t.text or "" for t in p.iter() if _local(t.tag) == "t") for p in shape.iter() if _local(p.tag) == "p"]
    return at, "\n".join(x for x in paragraphs if x.strip()), False


def _related(z: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """Of a part of an office file the related parts: id to (kind, path)."""
    folder, name = posixpath.split(part)
    rels = f"{folder}/_rels/{name}.rels"
    if rels not in z.namelist():
        return {}
    out = {}
    for r in ElementTree.fromstring(z.read(rels)):
        target = r.get("Target", "")
        path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
        out[r.get("Id", "")] = (r.get("Type", "").rpartition("/")[2], path)
    return out


def _slides(z: zipfile.ZipFile) -> list[str]:
    """The slides in the order of the presentation's list, which is not that of their file names."""
    deck = "ppt/presentation.xml"
    if deck in z.namelist():
        related = _related(z, deck)
        listed = [v for x in ElementTree.fromstring(z.read(deck)).iter() if _local(x.tag) == "sldId" for k, v in x.attrib.items() if _local(k) == "id" and k != "id"]
        found = [related[i][1] for i in listed if i in related]
        if found:
            return [x for x in found if x in z.namelist()]
    return sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", posixpath.basename(n))[0]))


def read_pptx(data: bytes) -> list[Page]:
    """Slides in the order of the presentation; shapes from top to bottom and
    left to right, tables row by row, the slide's own speaker notes at the end."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for i, name in enumerate(_slides(z), 1):
            tree = ElementTree.fromstring(z.read(name))
            shapes = sorted((_shape(s) for s in tree.iter() if _local(s.tag) in ("sp", "graphicFrame")), key=lambda s: s[0])
            text = "\n".join(t for _, t, _ in shapes if t.strip())
            for kind, notes in _related(z, name).values():
                if kind == "notesSlide" and notes in z.namelist():
                    said = "\n".join(t for _, t, _ in (_shape(s) for s in ElementTree.fromstring(z.read(notes)).iter() if _local(s.tag) == "sp") if t.strip())
                    text += f"\n[备注] {said}" if said else ""
            text = tidy(text)
            out.append((f"Slide {i}", text, any(t for *_, t in shapes), text.split("\n")[0][:60] or None))
    return out


def read_epub(data: bytes) -> list[Page]:
    """The parts of the spine in order; a short first line is the title."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        container = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = next(x.get("full-path") for x in container.iter() if _local(x.tag) == "rootfile")
        package = ElementTree.fromstring(z.read(opf))
        items = {x.get("id"): x.get("href") for x in package.iter() if _local(x.tag) == "item"}
        for i, ref in enumerate((x.get("idref") for x in package.iter() if _local(x.tag) == "itemref"), 1):
            path = posixpath.normpath(posixpath.join(posixpath.dirname(opf), items.get(ref) or ""))
            if path not in z.namelist():
                continue
            markup = z.read(path).decode("utf-8", "replace")
            text = html_text(markup)
            first = text.split("\n")[0]
            out.append((f"第{i}节", text, "<table" in markup.lower(), first if 0 < len(first) <= 60 else None))
    return out


def read_pdf(data: bytes) -> list[Page]:
    """Every page with the text of its text layer. A page that cannot be read
    is empty and carries a warning; an encrypted file has no pages."""
    from tracebook.sources.pdf import Encrypted, pages_of

    try:
        return [(str(i), tidy(text), False, None, warning) for i, (text, warning) in enumerate(pages_of(data), 1)]
    except Encrypted as e:
        raise Unreadable("encrypted") from e


#: Readers by file suffix; others are registered with `register`.
READERS: dict[str, Callable[[bytes], list[Page]]] = {
    "pdf": read_pdf, "docx": read_docx, "pptx": read_pptx, "epub": read_epub,
    "html": lambda b: [("第1节", html_text(b.decode("utf-8", "replace")), b"<table" in b.lower(), None)],
    "txt": lambda b: [("第1节", tidy(b.decode("utf-8-sig", "replace")), False, None)],
}


#: Readers that can stand in for others, by name; `register` adds to them.
ENGINES: dict[str, dict[str, Callable[[bytes], list[Page]]]] = {suffix: {"own": reader} for suffix, reader in READERS.items()}


def register(suffix: str, reader: Callable[[bytes], list[Page]], name: str | None = None) -> None:
    """Add a reader of a suffix, such as another PDF backend. Without a name it
    is used from now on; with one once `choose` names it."""
    ENGINES.setdefault(suffix.lower(), {})[name or "registered"] = reader
    if name is None:
        READERS[suffix.lower()] = reader


def choose(engines: dict[str, str]) -> None:
    """Use the named reader for each suffix; ValueError lists what there is."""
    for suffix, name in engines.items():
        known = ENGINES.get(suffix.lower(), {})
        if name not in known:
            raise ValueError(f"no reader {name!r} for {suffix!r}: {', '.join(sorted(known)) or 'none'}")
        READERS[suffix.lower()] = known[name]


def _pages(root: str, readers: dict):
    import hashlib

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path, content in zip(f["path"], f["content"]):
                kind = path.rpartition(".")[2].lower()
                sha1, name, warning = hashlib.sha1(content).hexdigest(), path.removeprefix(root).lstrip("/"), None
                try:
                    pages = readers[kind](content)
                except Exception as e:  # a file that can't be read is a row of its own
                    pages, warning = [], f"{type(e).__name__}: {e}"[:200]
                for i, (label, text, table, title, *said) in enumerate(pages, 1):
                    out.append((name, kind, sha1, i, label, text, len(text), len(text) < SCAN_BELOW and kind != "docx", table, title, said[0] if said else None))
                if not pages:
                    out.append((name, kind, sha1, None, None, None, None, None, None, None, warning or "no pages"))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PAGES.split(", ")])

    return run


def read_pages(spark: SparkSession, root: str, known: DataFrame | None = None) -> DataFrame:
    """Pages of all files under `root` that have a reader. Files that `known`
    (source_file, source_sha1) has with the same content are not read again. A
    file without pages gives one row with null page_no and a warning."""
    suffixes = "{" + ",".join(READERS) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffixes}").load(root)
    base = root if "://" in root or root.startswith("file:") else f"file:{root}"
    plain = files.withColumn("path", F.regexp_replace("path", "^file:/+", "file:/"))
    base = re.sub("^file:/+", "file:/", base)
    if known is not None:
        name = F.regexp_replace("path", f"^\\Q{base.rstrip('/')}\\E/+", "")
        plain = plain.join(known.select(F.col("source_file").alias("_f"), F.col("source_sha1").alias("_s")).distinct(), (name == F.col("_f")) & (F.sha1("content") == F.col("_s")), "left_anti")
    return plain.select("path", "content").mapInPandas(_pages(base.rstrip("/"), dict(READERS)), PAGES)


def collect_files(listing: DataFrame, duplicates: DataFrame | None = None) -> DataFrame:
    """Of files (path) those that have a reader and are not declared duplicates
    (column `drop`), each once, in no order."""
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kept = listing.select("path").filter(kind.isin(*READERS) & ~F.element_at(F.split("path", "/"), -1).startswith("~$")).distinct()
    return kept if duplicates is None else kept.join(duplicates.select(F.col("drop").alias("path")).distinct(), "path", "left_anti")


def known_files(pages: DataFrame) -> DataFrame:
    """file_id, source_sha1, course, pages of what has been read before. A file
    whose rows disagree keeps the least value."""
    return pages.filter("file_id is not null").groupBy("file_id").agg(F.min("source_sha1").alias("source_sha1"), F.min("course").alias("course"), F.count_distinct("page_no").alias("pages"))


def replaced_files(current: DataFrame, read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pages once the files of `read` (PAGES) have taken the place of the
    same files in `current`, and a report: source_file, outcome (new, changed,
    failed), pages, warnings. A file of which no page could be read keeps the
    pages it had."""
    good = read.filter("page_no is not null")
    files = good.select("source_file").distinct()
    kept = current.join(files, "source_file", "left_anti")
    had = current.select("source_file").distinct().withColumn("_had", F.lit(True))
    per = read.groupBy("source_file").agg(F.count("page_no").alias("pages"), F.count("warning").alias("warnings")).join(had, "source_file", "left")
    outcome = F.when(F.col("pages") == 0, "failed").when(F.col("_had"), "changed").otherwise("new")
    return kept.unionByName(good, allowMissingColumns=True), per.select("source_file", outcome.alias("outcome"), "pages", "warnings")
