"""Documents to normalized blocks and tables.

A normalized document has blocks (heading with level, paragraph, list item, code block with language) and tables (headers, rows). Parsers are plain
Python over one document; `parse_files` runs them on executors, one Arrow batch after another, and gives an error row for what cannot be parsed."""

from __future__ import annotations

import csv
import hashlib
import html
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import column_letter
from ..runtime import ship
from ..schema import NORMALIZED

#: A table of more rows takes the heading just before it away: it is a label of data.
LARGE_TABLE = 200
#: Extensions by parser, compared as they are written.
EXTENSIONS = {"markdown": ("md", "markdown"), "text": ("txt",), "html": ("html", "htm"), "spreadsheet": ("csv", "xlsx", "xls", "ods", "xlsb"), "office": ("docx", "pptx"), "pdf": ("pdf",), "image": ("png", "jpg", "jpeg", "webp", "gif", "bmp", "tiff")}
_INLINE = [
    (re.compile(r"!\[([^\]]*)\]\([^)]*\)"), r"\1"), (re.compile(r"\[([^\]]*)\]\([^)]*\)"), r"\1"), (re.compile(r"</?[A-Za-z][^>]*>"), ""),
    (re.compile(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1"), r"\2"), (re.compile(r"(?<![\w*])\*(?=\S)(.+?)(?<=\S)\*(?!\w)"), r"\1"), (re.compile(r"(?<![\w_])_(?=\S)(.+?)(?<=\S)_(?!\w)"), r"\1"), (re.compile(r"~~(.+?)~~"), r"\1"),
]
_ITEM = re.compile(r"^(\s*)(?:[-*+]|\d{1,9}[.)])\s+(.*)$")
_RULE = re.compile(r"^ {0,3}([-*_])(?:\s*\1){2,}\s*$")
_DIVIDER = re.compile(r"^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")


def block(kind: str, text: str, level: int | None = None, language: str | None = None) -> dict:
    return {"kind": kind, "level": level, "text": text, "language": language, "span_start": 0, "span_end": 0}


def _table(headers: list[str], rows: list[list[str]]) -> dict:
    return {"headers": headers, "rows": rows, "span_start": 0, "span_end": 0}


def inline_text(text: str) -> str:
    """Text without inline markup; code spans stay as they are."""
    parts = re.split(r"(`+)(.+?)\1", text)
    out = []
    for k in range(0, len(parts), 3):
        plain = parts[k]
        for pattern, by in _INLINE:
            plain = pattern.sub(by, plain)
        out.append(html.unescape(re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", plain)))
        if k + 2 < len(parts):
            out.append(parts[k + 2])
    return re.sub(r"\s+", " ", "".join(out)).strip()


def _cells(line: str) -> list[str]:
    line = line.strip()
    line = line[1:] if line.startswith("|") else line
    line = line[:-1] if line.endswith("|") and not line.endswith("\\|") else line
    return [inline_text(c.replace("\\|", "|")) for c in re.split(r"(?<!\\)\|", line)]


def parse_markdown(text: str) -> dict:
    """Blocks and tables of Markdown: headings, paragraphs, one block for each outer list item with what is nested in it, code blocks and tables. Quotes,
    rules and HTML blocks are left out. The first heading of level 1 is the title."""
    lines = text.replace("\r\n", "\n").split("\n")
    blocks, tables, title, k = [], [], None, 0
    while k < len(lines):
        line = lines[k]
        fence = re.match(r"^ {0,3}(```+|~~~+)\s*([^\s`]*)", line)
        if not line.strip():
            k += 1
        elif fence:
            end = k + 1
            while end < len(lines) and not re.match(rf"^ {{0,3}}{re.escape(fence[1][0])}{{{len(fence[1])},}}\s*$", lines[end]):
                end += 1
            blocks.append(block("code", "\n".join(lines[k + 1 : end]), language=fence[2] or None))
            k = end + 1
        elif m := re.match(r"^ {0,3}(#{1,6})(?:\s+(.*?))?(?:\s+#+)?\s*$", line):
            blocks.append(block("heading", inline_text(m[2] or ""), level=len(m[1])))
            k += 1
        elif _RULE.match(line):
            k += 1
        elif line.lstrip().startswith(">"):
            while k < len(lines) and lines[k].strip() and (lines[k].lstrip().startswith(">") or not _ITEM.match(lines[k])):
                k += 1
        elif re.match(r"^ {0,3}<(?:!--|/?[A-Za-z])", line):
            while k < len(lines) and lines[k].strip():
                k += 1
        elif "|" in line and k + 1 < len(lines) and _DIVIDER.match(lines[k + 1]) and "-" in lines[k + 1] and len(_cells(line)) == len(_cells(lines[k + 1])):
            headers, rows, k = _cells(line), [], k + 2
            while k < len(lines) and lines[k].strip() and "|" in lines[k]:
                cells = _cells(lines[k])
                rows.append((cells + [""] * len(headers))[: len(headers)])
                k += 1
            if len(rows) > LARGE_TABLE and blocks and blocks[-1]["kind"] == "heading":
                blocks.pop()
            tables.append(_table(headers, rows))
        elif m := _ITEM.match(line):
            indent, parts, k = len(m[1]), [m[2]], k + 1
            while k < len(lines):
                n = _ITEM.match(lines[k])
                if not lines[k].strip():
                    after = lines[k + 1] if k + 1 < len(lines) else ""
                    if not after.strip() or len(after) - len(after.lstrip()) <= indent:
                        break
                elif n and len(n[1]) <= indent:
                    break
                elif not n and re.match(r"^ {0,3}(#{1,6}\s|```|~~~)", lines[k]):
                    break
                else:
                    parts.append(n[2] if n else lines[k])
                k += 1
            if words := inline_text(" ".join(p.strip() for p in parts)):
                blocks.append(block("list_item", words))
        else:
            start = k
            while k < len(lines) and lines[k].strip() and not (k > start and re.match(r"^ {0,3}(#{1,6}(\s|$)|```|~~~|>)", lines[k])):
                under = k > start and re.match(r"^ {0,3}(=+|-+)\s*$", lines[k])
                if under or (k > start and (_ITEM.match(lines[k]) or _RULE.match(lines[k]))):
                    break
                k += 1
            words = inline_text(" ".join(x.strip() for x in lines[start:k]))
            if k < len(lines) and lines[k].strip() and (m := re.match(r"^ {0,3}(=+|-+)\s*$", lines[k])):
                blocks.append(block("heading", words, level=1 if m[1][0] == "=" else 2))
                k += 1
            elif words:
                blocks.append(block("paragraph", words))
    for b in blocks:
        if b["kind"] == "heading" and b["level"] == 1:
            title = b["text"]
            break
    return {"title": title, "blocks": blocks, "tables": tables}


class _HtmlToMarkdown(HTMLParser):
    """Selected elements in the order of the document. An element inside another of the selection is given by itself and within the outer one."""

    TAGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "pre", "table"})
    VOID = frozenset({"br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"})

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.open: list[dict] = []
        self.raw = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.raw += 1
        if tag == "br":
            self.handle_data("\n")
        in_table = any(x["tag"] == "table" for x in self.open)
        if in_table:
            table = next(x for x in reversed(self.open) if x["tag"] == "table")
            if tag == "tr":
                table["rows"].append([])
            elif tag in ("td", "th"):
                if not table["rows"]:
                    table["rows"].append([])
                table["rows"][-1].append("")
                table["cell"] = True
        if tag == "code" and (pre := next((x for x in reversed(self.open) if x["tag"] == "pre"), None)) and pre["language"] is None:
            classes = (dict(attrs).get("class") or "").split()
            pre["language"] = next((c[9:] for c in classes if c.startswith("language-")), "")
        if tag in self.TAGS and not (in_table and tag in ("p", "li")):
            if tag == "p" and self.open and self.open[-1]["tag"] == "p":
                self.open.pop()
            item = {"tag": tag, "text": [], "rows": [], "cell": False, "language": None}
            self.out.append(item)
            self.open.append(item)

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.raw = max(0, self.raw - 1)
        if tag in ("td", "th"):
            for x in self.open:
                x["cell"] = False
        if any(x["tag"] == tag for x in self.open):
            while self.open.pop()["tag"] != tag:
                pass

    def handle_data(self, data):
        if self.raw and not self.open:
            return
        for x in self.open:
            if x["tag"] == "table":
                if x["cell"] and x["rows"] and x["rows"][-1]:
                    x["rows"][-1][-1] += data
            else:
                x["text"].append(data)


def html_to_markdown(text: str) -> str:
    parser = _HtmlToMarkdown()
    parser.feed(text)
    parser.close()
    parts = []
    for x in parser.out:
        words = re.sub(r"\s+", " ", "".join(x["text"])).strip()
        if x["tag"][0] == "h" and x["tag"] != "hr" and words:
            parts.append("#" * int(x["tag"][1]) + " " + words)
        elif x["tag"] == "p" and words:
            parts.append(words)
        elif x["tag"] == "li" and words:
            parts.append("- " + words)
        elif x["tag"] == "pre":
            parts.append(f"```{x['language'] or ''}\n{''.join(x['text']).strip(chr(10))}\n```")
        elif x["tag"] == "table" and x["rows"]:
            rows = [[re.sub(r"\s+", " ", c).strip().replace("|", "\\|") for c in r] for r in x["rows"] if r]
            if rows:
                width = len(rows[0])
                lines = ["| " + " | ".join((r + [""] * width)[:width]) + " |" for r in rows]
                parts.append("\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]))
    return "\n\n".join(parts)


def sheet_table(rows: list[list[str]], numeric: list[bool] | None = None) -> dict:
    """A sheet as a table: the first row is the header if all its cells are texts that are not empty, else headers are letters."""
    width = max((len(r) for r in rows), default=0)
    rows = [r + [""] * (width - len(r)) for r in rows]
    if rows and all(c.strip() for c in rows[0]) and not any(numeric or []):
        return _table(rows[0], rows[1:])
    return _table([column_letter(k) for k in range(width)], rows)


def parse_csv(content: bytes) -> list[dict]:
    rows = list(csv.reader(io.StringIO(content.decode("utf-8-sig", "replace"))))
    return [sheet_table(rows)] if rows else []


def parse_xlsx(content: bytes) -> list[dict]:
    """All sheets of an XLSX workbook, in order."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        names = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))
        for name in names:
            rows, first = [], None
            for row in ElementTree.fromstring(z.read(name)).iterfind(".//m:sheetData/m:row", ns):
                cells, kinds = [], []
                for c in row.findall("m:c", ns):
                    letters = re.match(r"[A-Z]+", c.get("r") or "")
                    if letters:
                        at = 0
                        for ch in letters[0]:
                            at = at * 26 + ord(ch) - 64
                        while len(cells) < at - 1:
                            cells.append("")
                            kinds.append(False)
                    v, kind = c.find("m:v", ns), c.get("t", "n")
                    raw = (v.text or "") if v is not None else "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t"))
                    cells.append(shared[int(raw)] if kind == "s" and raw else raw)
                    kinds.append(kind in ("n", "b") and raw != "")
                first = kinds if first is None else first
                rows.append(cells)
            if rows:
                out.append(sheet_table(rows, first))
    return out


def office_to_markdown(content: bytes) -> str:
    """Paragraphs, headings, list items and tables of a DOCX, or the paragraphs of a PPTX with a heading for each slide, as Markdown."""
    parts: list[str] = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if "word/document.xml" in z.namelist():
            w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
            words = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t")).strip()
            for e in ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body"):
                if e.tag == f"{w}p" and words(e):
                    style = e.find(f"{w}pPr/{w}pStyle")
                    name = style.get(f"{w}val", "") if style is not None else ""
                    level = 1 if name == "Title" else int(m[1]) if (m := re.fullmatch(r"Heading([1-6])", name)) else 0
                    parts.append(("#" * level + " " if level else "- " if e.find(f"{w}pPr/{w}numPr") is not None else "") + words(e))
                elif e.tag == f"{w}tbl":
                    rows = [[words(c).replace("|", "\\|") for c in r.findall(f"{w}tc")] for r in e.findall(f"{w}tr")]
                    if rows:
                        lines = ["| " + " | ".join(r) + " |" for r in rows]
                        parts.append("\n".join([lines[0], "|" + " --- |" * len(rows[0]), *lines[1:]]))
        else:
            a = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
            for n, name in enumerate(sorted((x for x in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", x)), key=lambda x: int(re.search(r"(\d+)\.xml", x)[1])), 1):
                found = ["".join(t.text or "" for t in p.iter(f"{a}t")).strip() for p in ElementTree.fromstring(z.read(name)).iter(f"{a}p")]
                found = [f for f in found if f]
                parts += [f"## {found[0]}" if found else f"## Slide {n}", *found[1:]]
    return "\n\n".join(parts)


def document_id(content: bytes) -> str:
    return "doc." + hashlib.sha256(content).hexdigest()[:8]


def parse_document(path: str | None, content: bytes, hooks: dict[str, Callable[[bytes], str]] | None = None) -> dict:
    """The normalized document of a file. hooks: functions from bytes to Markdown for pdf and image files."""
    base = {"id": document_id(content), "source_path": path, "sha256": hashlib.sha256(content).hexdigest(), "title": None, "blocks": [], "tables": [], "error": None}
    name = (path or "").rpartition("/")[2]
    extension = name.rpartition(".")[2] if "." in name else ""
    kind = next((k for k, e in EXTENSIONS.items() if extension in e), None)
    try:
        if not extension or kind is None:
            raise ValueError(f"unsupported file type: {name or path}")
        if kind in ("markdown", "text"):
            return base | parse_markdown(content.decode("utf-8", "replace"))
        if kind == "html":
            return base | parse_markdown(html_to_markdown(content.decode("utf-8", "replace")))
        if kind == "spreadsheet":
            if extension not in ("csv", "xlsx"):
                raise ValueError(f"no reader for .{extension} sheets here")
            return base | {"title": name.rpartition(".")[0], "tables": parse_csv(content) if extension == "csv" else parse_xlsx(content)}
        if kind == "office":
            return base | parse_markdown(office_to_markdown(content))
        hook = (hooks or {}).get(kind)
        if hook is None:
            raise ValueError(f"no reader for {kind} files is set")
        words = hook(content)
        if not words.strip():
            raise ValueError(f"the {kind} reader found no text")
        return base | parse_markdown(words)
    except Exception as e:  # a file that cannot be parsed is a row with an error
        return base | {"error": f"{type(e).__name__}: {e}"}


def parse_files(files: DataFrame, hooks: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """Normalized documents of files(path, content)."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([parse_document(p, bytes(c) if c is not None else b"", hooks) for p, c in zip(batch["path"], batch["content"], strict=True)], columns=["id", "source_path", "sha256", "title", "blocks", "tables", "error"])

    return files.select("path", "content").mapInPandas(run, NORMALIZED)


def inline_documents(texts: DataFrame) -> DataFrame:
    """Normalized documents of Markdown texts(path, text)."""
    return parse_files(texts.select(F.concat(F.coalesce("path", F.lit("inline")), F.when(F.col("path").endswith(".md"), "").otherwise(".md")).alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content")))
