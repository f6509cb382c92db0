"""Text of binary documents: bytes in, text out. Office files and e-books are archives of XML or HTML, read with the standard library."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from xml.etree import ElementTree


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _parts(data: bytes, pattern: str) -> list[bytes]:
    """Members of an archive whose names match, those with numbers in the order of these."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        found = [n for n in z.namelist() if re.fullmatch(pattern, n)]
        return [z.read(n) for n in sorted(found, key=lambda n: ([int(x) for x in re.findall(r"\d+", n)], n))]


def _lines(xml: bytes, line: str) -> list[str]:
    """Texts of all elements named line: their runs (t), tabs and breaks."""
    out = []
    for e in ElementTree.fromstring(xml).iter():
        if _local(e.tag) == line:
            runs = (x.text or "" if _local(x.tag) == "t" else "\t" if _local(x.tag) == "tab" else "\n" if _local(x.tag) in ("br", "cr") else "" for x in e.iter())
            out.append("".join(runs))
    return [x for x in out if x.strip()]


def docx_text(data: bytes) -> str:
    return "\n".join(line for part in _parts(data, r"word/document\.xml") for line in _lines(part, "p"))


def pptx_text(data: bytes) -> str:
    """A blank line between slides."""
    return "\n\n".join("\n".join(_lines(part, "p")) for part in _parts(data, r"ppt/slides/slide\d+\.xml"))


def xlsx_text(data: bytes) -> str:
    """A line a row, tabs between cells, a blank line between sheets; formulas as their stored values."""
    shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for part in _parts(data, r"xl/sharedStrings\.xml") for si in ElementTree.fromstring(part) if _local(si.tag) == "si"]
    sheets = []
    for part in _parts(data, r"xl/worksheets/sheet\d+\.xml"):
        rows = []
        for row in (e for e in ElementTree.fromstring(part).iter() if _local(e.tag) == "row"):
            cells = []
            for c in row:
                value = "".join(x.text or "" for x in c.iter() if _local(x.tag) in ("v", "t"))
                cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
            rows.append("\t".join(cells))
        sheets.append("\n".join(r for r in rows if r.strip()))
    return "\n\n".join(sheets)


def epub_text(data: bytes) -> str:
    """Chapters in the order of the book's spine."""
    from tessera.sources.registry import html_text

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        container = ElementTree.fromstring(z.read("META-INF/container.xml"))
        book = next(e.get("full-path") for e in container.iter() if _local(e.tag) == "rootfile")
        root, base = ElementTree.fromstring(z.read(book)), book.rpartition("/")[0]
        files = {e.get("id"): e.get("href") for e in root.iter() if _local(e.tag) == "item"}
        order = [files[e.get("idref")] for e in root.iter() if _local(e.tag) == "itemref" and e.get("idref") in files]
        return "\n\n".join(html_text(z.read(f"{base}/{f}" if base else f).decode("utf-8", "replace")) for f in order)


def rtf_text(data: bytes) -> str:
    """Text of an RTF file: control words go, paragraphs and tabs stay, \\'hh and \\uN are characters, groups of tables and pictures are skipped."""
    text, out, skip, stack = data.decode("latin-1"), [], False, []
    token = re.compile(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-f]{2})|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n])", re.I)
    hidden = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "object", "header", "footer"}
    after = 0  # characters that stand in for a unicode one
    for word, number, code, sign, brace, char in token.findall(text):
        if brace == "{":
            stack.append(skip)
        elif brace == "}":
            skip = stack.pop() if stack else False
        elif sign == "*" or word in hidden:
            skip = True
        elif skip:
            continue
        elif word in ("par", "line", "row"):
            out.append("\n")
        elif word in ("tab", "cell"):
            out.append("\t")
        elif word == "u" and number:
            out.append(chr(int(number) % 65536))
            after = 1
        elif code or char or sign in ("\\", "{", "}", "~"):
            if after:
                after -= 1
                continue
            out.append(bytes.fromhex(code).decode("cp1252", "replace") if code else " " if sign == "~" else char or sign)
    return "".join(out).strip()


_PDF_STRING = rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)"
_PDF_TOKEN = re.compile(rb"(\[(?:\s*(?:" + _PDF_STRING + rb"|[-+.\d]+))*\s*\])\s*TJ|(" + _PDF_STRING + rb")\s*(?:Tj|'|\")|\b(Td|TD|T\*|ET)\b", re.S)
_PDF_ESCAPE = {b"n": b"\n", b"r": b"\n", b"t": b"\t", b"b": b"", b"f": b""}


def pdf_text(data: bytes) -> str:
    """Text of a simple PDF: strings shown in plain or deflated content streams, in their order, in one-byte encodings. Scans and fonts with codes of their own need another extractor."""
    literal = lambda s: re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) % 256]) if m[1].isdigit() else _PDF_ESCAPE.get(m[1], m[1]), s[1:-1], flags=re.S)
    out: list[bytes] = []
    for m in re.finditer(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", data, re.S):
        body = m[2]
        if b"FlateDecode" in m[1]:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        if b"BT" not in body:
            continue
        for array, string, _ in _PDF_TOKEN.findall(body):
            out.append(b"".join(map(literal, re.findall(_PDF_STRING, array, re.S))) if array else literal(string) if string else b"\n")
        out.append(b"\n")
    lines = b"".join(out).decode("cp1252", "replace").split("\n")
    return "\n".join(x.strip() for x in lines if x.strip())


EXTRACTORS = {"docx": docx_text, "pptx": pptx_text, "xlsx": xlsx_text, "epub": epub_text, "rtf": rtf_text, "pdf": pdf_text}
