"""Word documents (.docx): text extraction and a plain writer, with the standard library only.

Paragraphs come first, then table rows with cells joined by ' | '. A file that
is not a readable package gives a null text. PDF and legacy .doc files need
programs that a query engine does not bring; ``extract`` takes readers by suffix.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator, Mapping
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MONTHS = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
#: Fixed: the format's namespace.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_docx(content: bytes) -> str | None:
    """Text of a document, None if it cannot be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None

    def text(node: ElementTree.Element) -> str:
        parts = (c.text or "" if c.tag == f"{_W}t" else "\t" if c.tag == f"{_W}tab" else "" for r in node.iter(f"{_W}r") for c in r)
        return "".join(parts).strip()

    if body is None:
        return ""
    lines = [t for p in body.findall(f"{_W}p") if (t := text(p))]
    for row in body.iter(f"{_W}tr"):
        cells = [t for c in row.findall(f"{_W}tc") if (t := text(c))]
        if cells:
            lines.append(" | ".join(cells))
    return "\n".join(lines)


def write_docx(lines: list[str]) -> bytes:
    """A document with one paragraph per line."""
    paragraphs = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in lines)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_W[1:-1]}"><w:body>{paragraphs}</w:body></w:document>')
    return out.getvalue()


#: A line that ends in dates, which stand at the right edge.
_DATED = re.compile(rf"^(.*?\S)\s+\(?((?:{_MONTHS}\s+)?(?:19|20)\d{{2}}\s*(?:[-–—]|to)\s*(?:Present|Current|(?:{_MONTHS}\s+)?(?:19|20)\d{{2}}))\)?$", re.I)


def paragraph(line: str, edge: int = 9360) -> str:
    """A line as a paragraph; dates at its end go to a right tab at ``edge`` (twentieths of a point)."""
    say = lambda t: f'<w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r>'
    dated = _DATED.match(line)
    if not dated:
        return f"<w:p>{say(line)}</w:p>"
    return f'<w:p><w:pPr><w:tabs><w:tab w:val="right" w:pos="{edge}"/></w:tabs></w:pPr>{say(dated[1])}<w:r><w:tab/></w:r>{say(dated[2])}</w:p>'


def fill_docx(skeleton: bytes, lines: list[str]) -> bytes:
    """The skeleton package with these lines as its body; styles, headers, footers and the page's section stay."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(skeleton)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for part in old.infolist():
            data = old.read(part)
            if part.filename == "word/document.xml":
                text = data.decode("utf-8")
                body = re.search(r"(<w:body[^>]*>)(.*)(</w:body>)", text, re.S)
                if body is None:
                    raise ValueError("the skeleton has no body")
                page = re.findall(r"<w:sectPr\b(?:(?!<w:sectPr\b).)*?(?:</w:sectPr>|/>)\s*$", body[2], re.S)
                data = (text[: body.end(1)] + "".join(map(paragraph, lines)) + "".join(page) + text[body.start(3) :]).encode()
            new.writestr(part.filename, data)
    return out.getvalue()


def extract(files: DataFrame, readers: Mapping[str, Callable[[bytes], str | None]] | None = None) -> DataFrame:
    """path, text of files(path, content): the reader of the path's suffix decides; unknown suffixes give blank texts."""
    use = {"docx": read_docx, "txt": lambda b: b.decode("utf-8", "replace"), **(readers or {})}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [use.get(p.rpartition(".")[2].lower(), lambda _: "")(c) for p, c in zip(b["path"], b["content"], strict=True)]
            yield pd.DataFrame({"path": b["path"], "text": [t and t.strip() for t in texts]})

    return files.select("path", "content").mapInPandas(run, "path string, text string")


def render(items: DataFrame) -> DataFrame:
    """doc_id, content (a .docx) of items(doc_id, pos, line); a document's lines are gathered in order of pos."""
    gathered = items.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("rows"))
    lines = gathered.select("doc_id", F.col("rows.line").alias("lines"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "content": [write_docx([x for x in rows if x]) for rows in b["lines"]]})

    return lines.mapInPandas(run, "doc_id long, content binary")
