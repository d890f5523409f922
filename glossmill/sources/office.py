"""Office files as zip archives of XML: paragraphs of DOCX, PPTX, XLSX and HWPX, safety checks, and rewriting."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame

from glossmill.functions.tags import encode_pieces, merge_runs, repaired

# Limits of an archive, and of the elements in a part.
MOST_MEMBERS, MOST_TOTAL, MOST_PART, MOST_ELEMENTS = 5000, 150 << 20, 48 << 20, 2_000_000
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
H = "{http://www.hancom.co.kr/hwpml/2011/paragraph}"
#: Parts, and tags of paragraphs, runs, run properties and texts, by kind of file.
KINDS = {
    "docx": (r"word/(?:document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml", W + "p", W + "r", W + "rPr", W + "t"),
    "pptx": (r"ppt/(?:slides/slide\d+|notesSlides/notesSlide\d+)\.xml", A + "p", A + "r", A + "rPr", A + "t"),
    "xlsx": (r"xl/(?:sharedStrings|comments\d*)\.xml", S + "si", S + "r", S + "rPr", S + "t"),
    "hwpx": (r"Contents/section\d+\.xml", H + "p", H + "run", "", H + "t"),
}


class Unsafe(ValueError):
    pass


def checked(data: bytes) -> zipfile.ZipFile:
    """The archive, if it has no traps: counts, sizes, paths outside, document types."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise Unsafe("no zip archive") from e
    members = z.infolist()
    if len(members) > MOST_MEMBERS:
        raise Unsafe("too many members")
    if sum(m.file_size for m in members) > MOST_TOTAL or any(m.file_size > MOST_PART for m in members):
        raise Unsafe("too large")
    for m in members:
        if m.flag_bits & 1:
            raise Unsafe("encrypted")
        if m.filename.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", m.filename) or re.match(r"[A-Za-z]:", m.filename):
            raise Unsafe("unsafe path")
    return z


def parsed(data: bytes) -> ElementTree.Element:
    """The tree of a part without a document type, its namespaces under the names that it gives them."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff") or b"\0" in data[:64]:
        data = data.decode("utf-16").encode()
        data = re.sub(rb"""(<\?xml[^>]*?)\s+encoding=("[^"]*"|'[^']*')""", rb"\1", data, count=1)
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data or b"<!doctype" in data[:4096]:
        raise Unsafe("document type")
    if data.count(b"<") > 2 * MOST_ELEMENTS:
        raise Unsafe("too many elements")
    return ElementTree.fromstring(data)


def serialized(root: ElementTree.Element, source: bytes) -> bytes:
    """XML of a changed tree. Namespaces keep the prefixes of the source, and all that its root declares stay declared:
    attributes such as mc:Ignorable name prefixes in their values."""
    head = source[: source.find(b">", source.find(b"<", source.find(b"?>") + 1 if b"?>" in source[:200] else 0)) + 1].decode("utf-8", "replace")
    own = dict(re.findall(r"""xmlns:([\w.-]+)\s*=\s*["']([^"']*)["']""", head))
    default = re.search(r"""xmlns\s*=\s*["']([^"']*)["']""", head)
    names = {uri: prefix for prefix, uri in own.items()}
    if default:
        names[default[1]] = ""
    for _, (prefix, uri) in ElementTree.iterparse(io.BytesIO(source), events=["start-ns"]):
        names.setdefault(uri, prefix if prefix and prefix not in names.values() else f"n{len(names)}")
    names["http://www.w3.org/XML/1998/namespace"] = "xml"

    def short(tag: str, attribute: bool = False) -> str:
        if tag[0] != "{":
            return tag
        uri, _, local = tag[1:].partition("}")
        prefix = names[uri]
        if attribute and not prefix:  # an attribute has no default namespace
            prefix = next((p for p, u in own.items() if u == uri), None) or "d0"
            own.setdefault(prefix, uri)
        return f"{prefix}:{local}" if prefix else local

    out: list[str] = []
    todo: list = [root]
    while todo:
        e = todo.pop()
        if isinstance(e, str):
            out.append(e)
            continue
        attributes = "".join(f" {short(k, True)}={quoteattr(v)}" for k, v in e.attrib.items())
        out.append(f"<{short(e.tag)}{'{declared}' if e is root else ''}{attributes}")
        tail = escape(e.tail) if e.tail and e is not root else ""
        if len(e) or e.text:
            out.append(">" + escape(e.text or ""))
            todo.append(f"</{short(e.tag)}>{tail}")
            todo += reversed(e)
        else:
            out.append("/>" + tail)
    every = {prefix: uri for uri, prefix in names.items() if prefix not in ("", "xml")} | own
    declared = (f' xmlns="{default[1]}"' if default else "") + "".join(f" xmlns:{p}={quoteattr(u)}" for p, u in every.items())
    out[0] = out[0].replace("{declared}", declared, 1)
    return ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + "".join(out)).encode()


def _own(p, paragraph: str, wanted: str) -> list:
    """Elements of a name inside a paragraph, but not inside a paragraph within it."""
    out, todo = [], list(reversed(p))
    while todo:
        e = todo.pop()
        if e.tag == paragraph:
            continue
        if e.tag == wanted:
            out.append(e)
        else:
            todo += reversed(e)
    return out


def _look(e, properties: str) -> str:
    """A run's format as one string, whatever the order of its parts and the names of its namespaces."""
    found = e.find(properties) if properties else None
    if found is None:
        return e.get("charPrIDRef", "")
    return "|".join(sorted(f"{x.tag}{sorted(x.attrib.items())}" for x in found.iter() if x is not found))


def _runs(p, paragraph: str, run: str, properties: str, text: str) -> list[dict]:
    """Pieces of a paragraph, each with its element."""
    pieces = []
    for e in _own(p, paragraph, run):
        words = "".join(t.text or "" for t in _own(e, paragraph, text))
        pieces.append({"kind": "text" if words else "atom", "key": _look(e, properties), "text": words, "element": e})
    if not pieces:
        pieces = [{"kind": "text", "key": "", "text": "".join(t.text or "" for t in _own(p, paragraph, text)), "element": None}]
    return pieces


def _write_runs(p, pieces: list[dict], paragraph: str, text: str, output: str) -> None:
    """A paragraph's texts as a tagged output has them, each in a run of its format; runs that it leaves out are emptied."""
    source = encode_pieces(pieces)
    weight: dict[str, int] = {}
    for r in pieces:
        if r["kind"] == "text":
            weight[r["key"]] = weight.get(r["key"], 0) + len(r["text"])
    base = max(weight, key=weight.__getitem__)
    runs = merge_runs(pieces)
    texts = [i for i, r in enumerate(runs) if r[0] == "text"]
    inner = runs[texts[0] : texts[-1] + 1]
    tagged = [r[1] for r in inner if r[0] == "text" and r[1] != base]
    keys = {"base": base} | {f"g{n}": key for n, key in enumerate(tagged, 1)}
    if any(r["element"] is None for r in pieces):
        elements = _own(p, paragraph, text)
        for k, t in enumerate(elements):
            t.text = plain(source, output) if k == 0 else ""
        return
    # the places that can take text, in order; each output piece goes on in the first one left of its format
    places = [(r["key"], _own(r["element"], paragraph, text)) for r in pieces if r["kind"] == "text"]
    words: list[list[str]] = [[] for _ in places]
    at = 0
    for piece in repaired(source, output) if "<" in source else [{"kind": "text", "key": "base", "text": output}]:
        if piece["kind"] != "text":
            continue
        key = keys.get(piece["key"], base)
        later = [i for i in range(at, len(places)) if places[i][0] == key]
        at = later[0] if later else next((i for i, (k, _) in enumerate(places) if k == key), 0)
        words[at].append(piece["text"])
    for (_, elements), new in zip(places, words, strict=True):
        for k, t in enumerate(elements):
            t.text = "".join(new) if k == 0 else ""
            if k == 0 and t.text != t.text.strip():
                t.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")


def plain(source: str, output: str) -> str:
    return "".join(p["text"] for p in repaired(source, output)) if "<" in source else output


def paragraphs(data: bytes, kind: str) -> list[tuple[str, int, str]]:
    """(part, pos, tagged text) of each paragraph with letters; only the parts that hold text are unpacked."""
    parts, p, run, properties, text = KINDS[kind]
    out = []
    with checked(data) as z:
        for name in sorted(z.namelist()):
            if re.fullmatch(parts, name):
                for pos, e in enumerate(parsed(z.read(name)).iter(p)):
                    tagged = encode_pieces(_runs(e, p, run, properties, text))
                    if tagged is not None:
                        out.append((name, pos, tagged))
    return out


def formula_literals(data: bytes) -> set[str]:
    """Quoted strings of a workbook's formulas: cells of that text must stay as they are."""
    out: set[str] = set()
    with checked(data) as z:
        for name in z.namelist():
            if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", name):
                for f in re.findall(rb"<(?:f|formula1|formula2)\b[^>]*>(.*?)</", z.read(name), re.S):
                    text = f.decode("utf-8", "replace").replace("&quot;", '"').replace("&amp;", "&")
                    out |= {m.replace('""', '"') for m in re.findall(r'"((?:[^"]|"")*)"', text)}
    return out


def table_headers(data: bytes) -> set[str]:
    """Column names of a workbook's tables: cells of that text must stay as they are."""
    with checked(data) as z:
        parts = [parsed(z.read(n)) for n in z.namelist() if re.fullmatch(r"xl/tables/table\d+\.xml", n)]
    return {xml_unescaped(c.get("name", "")) for t in parts for c in t.iter(S + "tableColumn")} - {""}


def protected_cells(data: bytes) -> set[str]:
    """Texts of a workbook that must not change: formula literals and table headers."""
    return formula_literals(data) | table_headers(data)


def xml_escaped(text: str) -> str:
    """`_xHHHH_` for characters that XML can't hold, and for what looks like such an escape."""
    text = re.sub(r"_(?=x[0-9A-Fa-f]{4}_)", "_x005F_", text)
    return re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", lambda m: f"_x{ord(m[0]):04X}_", text)


def xml_unescaped(text: str) -> str:
    return re.sub(r"_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text)


def rewritten(data: bytes, change: Callable[[str, bytes], bytes | None]) -> bytes:
    """A copy of the archive; change gives a member's new bytes, or None to keep it."""
    out = io.BytesIO()
    with checked(data) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
        for m in z.infolist():
            old = z.read(m)
            new = change(m.filename, old)
            target.writestr(m, old if new is None else new)
    return out.getvalue()


def replaced(data: bytes, kind: str, outputs: dict[tuple[str, int], str]) -> bytes:
    """The file with paragraphs' texts replaced by tagged outputs, each piece in a run of its format."""
    parts, p, run, properties, text = KINDS[kind]

    def change(name: str, old: bytes) -> bytes | None:
        if not re.fullmatch(parts, name) or not any(part == name for part, _ in outputs):
            return None
        root = parsed(old)
        for pos, e in enumerate(root.iter(p)):
            pieces = _runs(e, p, run, properties, text) if (name, pos) in outputs else []
            if encode_pieces(pieces) is not None:
                _write_runs(e, pieces, p, text, outputs[name, pos])
        return serialized(root, old)

    return rewritten(data, change)


def docx(blocks: list[dict]) -> bytes:
    """A DOCX of blocks (kind, level, text, rows)."""

    def paragraph(text: str, style: str = "") -> str:
        look = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
        return f'<w:p>{look}<w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'

    body = []
    for b in blocks:
        if b["kind"] == "table":
            rows = "".join("<w:tr>" + "".join(f"<w:tc>{paragraph(c)}</w:tc>" for c in r) + "</w:tr>" for r in b["rows"])
            body.append(f"<w:tbl>{rows}</w:tbl>")
        else:
            body += [paragraph(line, f"Heading{b['level']}" if b["kind"] == "heading" else "") for line in b["text"].split("\n")]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("_rels/.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W[1:-1]}"><w:body>{"".join(body)}</w:body></w:document>')
    return out.getvalue()


def office_units(files: DataFrame) -> DataFrame:
    """file, part, pos, text, error of files (name, content): broken or unsafe files give one row with the error."""

    def run(batches):
        for batch in batches:
            rows = []
            for name, content in zip(batch["name"], batch["content"], strict=True):
                try:
                    rows += [(name, *u, None) for u in paragraphs(bytes(content), name.rpartition(".")[2].lower())]
                except (Unsafe, KeyError, ElementTree.ParseError) as e:
                    rows.append((name, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["file", "part", "pos", "text", "error"]).astype({"pos": "Int32"})

    return files.select("name", "content").mapInPandas(run, "file string, part string, pos int, text string, error string")
