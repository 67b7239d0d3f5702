"""Word documents as rows, read with the standard library from a binary column."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree
from xml.parsers import expat
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.sources.batches import gathered, slices

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
ELEMENTS = (
    "path string, seq int, text string, element_type string, paragraph_index int, table_index int, row_index int, cell_index int, "
    "style_name string, is_bold boolean, is_italic boolean, runs array<string>, error string"
)
_KINDS = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.list_(pa.string()), pa.string()]
_NAMES = [x.split(" ")[0] for x in ELEMENTS.split(", ")]


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, length, modificationTime) of every file; unused columns are never read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(name, path, size) without reading any content."""
    return files(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", F.coalesce("length", F.lit(0)).alias("size"))


def _stored(content: bytes, item: zipfile.ZipInfo) -> bytes | None:
    """A part's bytes as they lie in the file, None where they need more than the plain form."""
    head = content[item.header_offset : item.header_offset + 30]
    if item.flag_bits & 0x1 or item.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) or head[:4] != b"PK\x03\x04":
        return None
    start = item.header_offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")
    own = content[start : start + item.compress_size]
    return own if len(own) == item.compress_size else None


class _Archive:
    """A file's parts; one that is plainly stored is read where it lies, any other as ``zipfile`` reads it."""

    def __init__(self, content: bytes):
        self.content, self.zip = content, zipfile.ZipFile(io.BytesIO(content))
        self._read: dict[str, bytes] = {}

    def namelist(self) -> list[str]:
        return self.zip.namelist()

    def read(self, name: str) -> bytes:
        if name not in self._read:
            item = self.zip.getinfo(name)
            own, data = _stored(self.content, item), None
            if own is not None:
                try:
                    data = zlib.decompress(own, -15) if item.compress_type == zipfile.ZIP_DEFLATED else own
                except zlib.error:
                    data = None
            if data is None or len(data) != item.file_size or zlib.crc32(data) != item.CRC:
                data = self.zip.read(name)
            self._read[name] = data
        return self._read[name]

    def _sound(self, item: zipfile.ZipInfo) -> bool:
        """Reads a part, so that a damaged one fails here as it always has; of parts with one name the last is read."""
        self.read(item.filename)
        return self.zip.getinfo(item.filename) is item

    def written(self, changed: dict[str, bytes]) -> bytes:
        """The file with some parts given anew; the others are taken over as they are stored."""
        out, at, directory = [], 0, []
        items = self.zip.infolist()
        if len(items) > 65_000 or len(self.content) + sum(map(len, changed.values())) > 1 << 31:
            return self._rewritten(changed)
        for item in items:
            if item.filename in changed:
                data = changed[item.filename]
                own, kind, crc, size = zlib.compress(data, wbits=-15), zipfile.ZIP_DEFLATED, zlib.crc32(data), len(data)
            elif self._sound(item) and (own := _stored(self.content, item)) is not None:
                kind, crc, size = item.compress_type, item.CRC, item.file_size
            else:
                return self._rewritten(changed)
            name = item.filename.encode()
            # Version, names in UTF-8, kind, time and date of 1980, sum, sizes, length of the name, nothing else.
            head = struct.pack("<HHHHHIIIHH", 20, 0x800, kind, 0, 0x21, crc, len(own), size, len(name), 0)
            out += [b"PK\x03\x04" + head, name, own]
            directory.append(b"PK\x01\x02" + struct.pack("<H", 20) + head + struct.pack("<HHHII", 0, 0, 0, 0o600 << 16, at) + name)
            at += 30 + len(name) + len(own)
        listed = b"".join(directory)
        return b"".join([*out, listed, b"PK\x05\x06", struct.pack("<HHHHIIH", 0, 0, len(items), len(items), len(listed), at, 0)])

    def _rewritten(self, changed: dict[str, bytes]) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as to:
            for item in self.zip.infolist():
                to.writestr(item.filename, changed[item.filename] if item.filename in changed else self.zip.read(item.filename))
        return out.getvalue()


def _text(p) -> str:
    out = []
    for x in p.iter():
        if x.tag == _W + "t":
            out.append(x.text or "")
        elif x.tag == _W + "tab":
            out.append("\t")
        elif x.tag in (_W + "br", _W + "cr"):
            out.append("\n")
    return "".join(out)


def _runs(p) -> list[str]:
    return [_text(r) for r in p.iter(_W + "r")]


def _has(p, mark: str) -> bool:
    """Whether any run is set in bold (b) or italics (i)."""
    return any((m := r.find(f"{_W}rPr/{_W}{mark}")) is not None and m.get(_W + "val") not in ("0", "false", "none") for r in p.iter(_W + "r"))


def _style(p, names: dict[str, str]) -> str | None:
    s = p.find(f"{_W}pPr/{_W}pStyle")
    return names.get(s.get(_W + "val"), s.get(_W + "val")) if s is not None else "Normal"


def parse(content: bytes, blanks: bool = False) -> Iterator[tuple]:
    """Elements in order: body paragraphs, table cells, headers and footers. Blank ones are left out unless ``blanks``.

    In the structured form a cell is one element, bold or italic as its first paragraph is; with ``blanks`` every
    paragraph of a cell is an element.
    """
    z = _Archive(content)
    names: dict[str, str] = {}
    if "word/styles.xml" in z.namelist():
        for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(_W + "style"):
            if (n := s.find(_W + "name")) is not None:
                names[s.get(_W + "styleId")] = n.get(_W + "val", "").title() if n.get(_W + "val", "").startswith("heading") else n.get(_W + "val")
    document = ElementTree.fromstring(z.read("word/document.xml"))
    body = document.find(_W + "body")
    seq = 0
    for k, p in enumerate(body.findall(_W + "p")):
        text = _text(p)
        if blanks or text.strip():
            yield seq, text if blanks else text.strip(), "paragraph", k, -1, -1, -1, _style(p, names), _has(p, "b"), _has(p, "i"), _runs(p)
            seq += 1
    for t, table in enumerate(body.findall(_W + "tbl")):
        for r, row in enumerate(table.findall(_W + "tr")):
            for c, cell in enumerate(row.findall(_W + "tc")):
                own = cell.findall(_W + "p")
                groups = [(k, [p]) for k, p in enumerate(own)] if blanks else [(-1, own)]
                for k, ps in groups:
                    text = "\n".join(map(_text, ps))
                    if ps and (blanks or text.strip()):
                        yield seq, text if blanks else text.strip(), "table_cell", k, t, r, c, _style(ps[0], names), _has(ps[0], "b"), _has(ps[0], "i"), [x for p in ps for x in _runs(p)]
                        seq += 1
    for kind, name in linked_parts(z, document):
        for k, p in enumerate(ElementTree.fromstring(z.read(name)).findall(_W + "p")):
            text = _text(p)
            if blanks or text.strip():
                yield seq, text if blanks else text.strip(), kind, k, -1, -1, -1, _style(p, names), _has(p, "b"), _has(p, "i"), _runs(p)
                seq += 1


def linked_parts(z: zipfile.ZipFile | _Archive, document=None, links: list[tuple[int, str, str | None]] | None = None) -> list[tuple[str, str]]:
    """(kind, part) of the headers and footers that sections link as their default, each part once, in order.

    A file whose sections link none, as a shortened one, gives the parts that are named as such. ``document`` is the main
    part where it has been parsed, ``links`` what has been found in it.
    """
    names, found = z.namelist(), []
    targets = {}
    if "word/_rels/document.xml.rels" in names:
        targets = {x.get("Id"): x.get("Target", "") for x in ElementTree.fromstring(z.read("word/_rels/document.xml.rels"))}
    if links is None:
        document = ElementTree.fromstring(z.read("word/document.xml")) if document is None else document
        links = [
            (k, kind, link.get(_R + "id"))
            for k, section in enumerate(document.iter(_W + "sectPr"))
            for kind in ("header", "footer")
            for link in section.findall(f"{_W}{kind}Reference")
            if link.get(_W + "type", "default") == "default"
        ]
    for _, kind, link in sorted(links, key=lambda x: (x[0], x[1] == "footer")):
        target = targets.get(link, "")
        part = target.lstrip("/") if target.startswith("/") else f"word/{target}"
        if part in names and (kind, part) not in found:
            found.append((kind, part))
    return found or [(kind, n) for kind in ("header", "footer") for n in sorted(names) if n.startswith(f"word/{kind}") and n.endswith(".xml")]


def elements(docs: DataFrame, blanks: bool = False) -> DataFrame:
    """The elements of every file (path, content); a file that can't be read gives one row with its error."""

    def rows(batches):
        for b in slices(batches):
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                try:
                    own = [(path, *e, None) for e in parse(content, blanks)]
                except Exception as e:  # noqa: BLE001 - any damage belongs to its file
                    own = [(path, *[None] * 11, f"{type(e).__name__}: {e}")]
                yield from own

    def run(batches):
        yield from gathered(rows(batches), _KINDS, _NAMES)

    return docs.select("path", "content").mapInArrow(run, ELEMENTS)


def flat_text(docs: DataFrame) -> DataFrame:
    """(path, text): body paragraphs and then cell paragraphs, blanks kept, joined by blank lines; no headers or footers."""
    own = elements(docs, blanks=True).filter(F.col("element_type").isin("paragraph", "table_cell"))
    return own.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


def properties(docs: DataFrame) -> DataFrame:
    """(path, metadata, image_count, has_headers, has_footers, error) of every file; a damaged one gives empty metadata and its error.

    A file has headers if a header that a section links has a paragraph, even a blank one.
    """
    wanted = {"title": "title", "creator": "author", "created": "created", "modified": "modified", "subject": "subject", "keywords": "keywords"}

    def rows(batches):
        for b in slices(batches):
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                found, images, has, error = dict.fromkeys(wanted.values(), ""), 0, [False, False], None
                try:
                    z = _Archive(content)
                    parts = z.namelist()
                    if "docProps/core.xml" in parts:
                        for x in ElementTree.fromstring(z.read("docProps/core.xml")):
                            if (n := x.tag.rpartition("}")[2]) in wanted:
                                found[wanted[n]] = x.text or ""
                    if "word/_rels/document.xml.rels" in parts:
                        images = sum("image" in x.get("Target", "") for x in ElementTree.fromstring(z.read("word/_rels/document.xml.rels")))
                    for kind, part in linked_parts(z):
                        has[kind == "footer"] |= ElementTree.fromstring(z.read(part)).find(_W + "p") is not None
                except Exception as e:  # noqa: BLE001 - any damage belongs to its file
                    error = f"{type(e).__name__}: {e}"
                yield path, list(found.items()), images, *has, error

    def run(batches):
        kinds = (pa.string(), pa.map_(pa.string(), pa.string()), pa.int32(), pa.bool_(), pa.bool_(), pa.string())
        yield from gathered(rows(batches), kinds, ("path", "metadata", "image_count", "has_headers", "has_footers", "error"))

    return docs.select("path", "content").mapInArrow(run, "path string, metadata map<string,string>, image_count int, has_headers boolean, has_footers boolean, error string")


def pages_text(docs: DataFrame, reader: Callable[[bytes], Iterator[str]]) -> DataFrame:
    """(path, text, page_count, success, error) by a reader of page texts, as for PDF files; empty pages are left out of the text."""

    def rows(batches):
        for b in slices(batches):
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                try:
                    pages = [p or "" for p in reader(content)]
                    yield path, "\n\n".join(p for p in pages if p), len(pages), True, None
                except Exception as e:  # noqa: BLE001 - any damage belongs to its file
                    yield path, None, 0, False, str(e)

    def run(batches):
        # A row is a whole text, so fewer of them.
        yield from gathered(rows(batches), (pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.string()), ("path", "text", "page_count", "success", "error"), 64)

    return docs.select("path", "content").mapInArrow(run, "path string, text string, page_count int, success boolean, error string")


class _Edit:
    """The paragraphs of a part with the places of their runs' texts in the file's bytes; only changed runs are written anew.

    All else (declarations, properties, unknown elements) stays byte for byte.
    """

    _TEXTS = {"t": None, "tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-"}
    _WATCHED = frozenset(("p", "r", *_TEXTS))

    def __init__(self, xml: bytes, root: str):
        head = xml[:200].lower()
        if xml[:2] in (b"\xff\xfe", b"\xfe\xff"):
            xml = xml.decode("utf-16").replace('encoding="UTF-16"', 'encoding="UTF-8"').replace('encoding="utf-16"', 'encoding="utf-8"').encode()
        elif b"encoding=" in head and b"utf-8" not in head:
            raise ValueError("only UTF-8 and UTF-16 parts can be written")
        self.xml, self.root = xml, root
        #: place -> runs; a run is (its end, name prefix, [(start, end, text)]).
        self.paragraphs: dict[tuple[int, ...], list[list]] = {}
        self._stack: list[tuple[str, dict]] = []
        self._place: tuple[int, ...] | None = None
        self._run: list | None = None
        parser = expat.ParserCreate(namespace_separator="}")
        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = self._start, self._end, self._data
        parser.buffer_text = True
        self._parser, self._held, self._from = parser, [], 0
        #: (section, kind, id) of the default headers and footers that sections link.
        self.links: list[tuple[int, str, str | None]] = []
        self._sections = 0
        parser.Parse(xml, True)
        del self._parser

    def _start(self, name: str, given: dict[str, str]) -> None:
        uri, _, tag = name.rpartition("}")
        tag = tag if "{" + uri + "}" == _W else "?" + tag
        above = self._stack[-1] if self._stack else ("", {})
        above[1][tag] = above[1].get(tag, -1) + 1
        self._stack.append((tag, {}))
        if tag not in self._WATCHED:
            if tag == "sectPr":
                self._sections += 1
                self._stack[-1][1]["#"] = self._sections
            elif tag in ("headerReference", "footerReference") and self._stack[-2][0] == "sectPr" and given.get(_W[1:] + "type", "default") == "default":
                self.links.append((self._stack[-2][1]["#"], tag[:6], given.get(_R[1:] + "id")))
            return
        tags = tuple([t for t, _ in self._stack])
        if tag == "p" and (tags[-2:] == (self.root, "p") or tags[-5:] == (self.root, "tbl", "tr", "tc", "p")) and self._place is None:
            depth = 2 if tags[-2:] == (self.root, "p") else 5
            self._place = tuple(counts[t] for (_, counts), t in zip(self._stack[-depth:], tags[1 - depth :]))
            self.paragraphs[self._place] = []
        elif tag == "r" and self._place is not None and self._run is None:
            self._run = [0, self._prefix(), []]
        elif self._run is not None and tag in self._TEXTS and "rPr" not in tags:
            self._held, self._from = [], self._parser.CurrentByteIndex

    def _prefix(self) -> bytes:
        at = self._parser.CurrentByteIndex
        name = re.match(rb"<([^\s/>]+)", self.xml[at : at + 200])[1]
        return name.rpartition(b":")[0] + b":" if b":" in name else b""

    def _data(self, text: str) -> None:
        self._held.append(text)

    def _end(self, name: str) -> None:
        tag, _ = self._stack.pop()
        at = self._parser.CurrentByteIndex
        if self._run is not None and tag in self._TEXTS and not any(t == "rPr" for t, _ in self._stack):
            text = self._TEXTS[tag]
            self._run[2].append((self._from, self.xml.index(b">", at) + 1, "".join(self._held) if text is None else text))
        elif tag == "r" and self._run is not None and not any(t == "r" for t, _ in self._stack):
            # A run without an end tag is empty and stays so.
            self._run[0] = at if self.xml[at : at + 2] == b"</" else 0
            self.paragraphs[self._place].append(self._run)
            self._run = None
        elif tag == "p" and self._place is not None and not any(t == "p" for t, _ in self._stack):
            self._place = None

    def runs(self, place: tuple[int, ...]) -> list[str]:
        return ["".join(t for *_, t in texts) for _, _, texts in self.paragraphs[place]]

    def written(self, changed: dict[tuple[int, ...], list[str]]) -> bytes:
        """The part with runs replaced; texts beyond the last run go to its end."""
        edits = []
        for place, new in changed.items():
            runs = self.paragraphs[place]
            for k, ((end, prefix, texts), old) in enumerate(zip(runs, self.runs(place))):
                text = (new[k] if k < len(new) else "") + ("".join(new[len(runs) :]) if k == len(runs) - 1 else "")
                if text != old and (texts or end):
                    edits += [(a, b, b"") for a, b, _ in texts]
                    at = texts[0][0] if texts else end
                    edits.append((at, at, self._text(text, prefix)))
        out, at = [], 0
        for a, b, put in sorted(edits, key=lambda e: (e[0], e[1])):
            out += [self.xml[at:a], put]
            at = b
        return b"".join([*out, self.xml[at:]])

    @staticmethod
    def _text(text: str, prefix: bytes) -> bytes:
        """Elements of a run's text: tabs and line ends are elements of their own."""
        out = []
        for part in re.split("([\t\n])", text):
            if part == "\t":
                out.append(b"<" + prefix + b"tab/>")
            elif part == "\n":
                out.append(b"<" + prefix + b"br/>")
            elif part:
                clean = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", "", part)
                out.append(b"<" + prefix + b't xml:space="preserve">' + escape(clean).encode("utf-8", "replace") + b"</" + prefix + b"t>")
        return b"".join(out)


#: Kinds of the paragraphs of a file in the order in which substitution meets them.
PARTS = ("body", "cell", "header", "header_cell", "footer", "footer_cell")


class Document:
    """A file's paragraphs, by part, group and place, with the texts of their runs, and the file with those changed."""

    def __init__(self, content: bytes):
        self._zip = _Archive(content)
        self._edits = {"word/document.xml": _Edit(self._zip.read("word/document.xml"), "body")}
        #: (part, group, seq, runs) of each paragraph; a cell, and each header or footer, is a group of its own.
        self.paragraphs: list[tuple[str, int, int, list[str]]] = []
        self._at: list[tuple[str, tuple[int, ...]]] = []
        group = 0
        for kind, name in [("body", "word/document.xml"), *linked_parts(self._zip, links=self._edits["word/document.xml"].links)]:
            if kind != "body":
                self._edits[name] = _Edit(self._zip.read(name), "hdr" if kind == "header" else "ftr")
            edit = self._edits[name]
            cell = "cell" if kind == "body" else f"{kind}_cell"
            groups: dict[tuple, int] = {}
            for place in sorted(edit.paragraphs, key=lambda p: (len(p), p)):
                part = kind if len(place) == 1 else cell
                key = place[:-1]
                if key not in groups:
                    groups[key], group = group, group + 1
                self.paragraphs.append((part, groups[key], place[-1], edit.runs(place)))
                self._at.append((name, place))

    def written(self, runs: list[list[str]]) -> bytes:
        """The file with the runs of all paragraphs given anew."""
        changed: dict[str, dict] = {}
        for (name, place), (*_, old), new in zip(self._at, self.paragraphs, runs):
            if new != old:
                changed.setdefault(name, {})[place] = new
        return self._zip.written({name: self._edits[name].written(own) for name, own in changed.items()})


def written(content: bytes, texts: dict[tuple, list[str]]) -> bytes:
    """The file with the runs of paragraphs replaced. Keys: ("body", k) and ("cell", table, row, cell, k)."""
    edit = _Edit(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"), "body")
    changed = edit.written({key[1:]: new for key, new in texts.items()})
    z, out = zipfile.ZipFile(io.BytesIO(content)), io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as to:
        for name in z.namelist():
            to.writestr(name, changed if name == "word/document.xml" else z.read(name))
    return out.getvalue()


def made(paragraphs: list[list[str]], cells: list[list[str]] = (), header: str | None = None) -> bytes:
    """A small file: paragraphs as lists of runs, one table of rows of cells, a header."""
    run = lambda t: b"<w:r>" + _Edit._text(t, b"w:") + b"</w:r>"
    p = lambda runs: b"<w:p>" + b"".join(map(run, runs)) + b"</w:p>"
    rows = b"".join(b"<w:tr>" + b"".join(b"<w:tc>" + p([c]) + b"</w:tc>" for c in row) + b"</w:tr>" for row in cells)
    names = b'xmlns:w="' + _W[1:-1].encode() + b'" xmlns:r="' + _R[1:-1].encode() + b'"'
    start = b'<?xml version="1.0" encoding="UTF-8"?>\n'
    link = b'<w:sectPr><w:headerReference w:type="default" r:id="rId1"/></w:sectPr>' if header is not None else b""
    body = b"<w:document " + names + b"><w:body>" + b"".join(map(p, paragraphs)) + (b"<w:tbl>" + rows + b"</w:tbl>" if rows else b"") + link + b"</w:body></w:document>"
    office, package = b"http://schemas.openxmlformats.org/officeDocument/2006/relationships", b"http://schemas.openxmlformats.org/package/2006/"
    main = b"application/vnd.openxmlformats-officedocument.wordprocessingml."
    files = {
        "[Content_Types].xml": b'<Types xmlns="' + package + b'content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        b'<Override PartName="/word/document.xml" ContentType="' + main + b'document.main+xml"/><Override PartName="/word/header1.xml" ContentType="' + main + b'header+xml"/></Types>',
        "_rels/.rels": b'<Relationships xmlns="' + package + b'relationships"><Relationship Id="rId1" Type="' + office + b'/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": body,
    }
    if header is not None:
        files["word/_rels/document.xml.rels"] = b'<Relationships xmlns="' + package + b'relationships"><Relationship Id="rId1" Type="' + office + b'/header" Target="header1.xml"/></Relationships>'
        files["word/header1.xml"] = b"<w:hdr " + names + b">" + p([header]) + b"</w:hdr>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as to:
        for name, data in files.items():
            to.writestr(zipfile.ZipInfo(name), data if name == "word/document.xml" else start + data)
    return out.getvalue()
