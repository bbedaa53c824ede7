"""Text of PDF files: objects by their marks, Flate streams, and the text operators of page contents.

What a file needs that is not here (encryption, fonts with codes of their own, pictures of text) gives ''. Lines come in the order in which the
page writes them: a move to another height starts a line, a wide gap in a TJ array is a space.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b(.*?)(?:\bendobj\b|(?=\d+\s+\d+\s+obj\b)|$)", re.S)
_STREAM = re.compile(rb"^(.*?)\bstream\r?\n(.*?)(?:\r?\n)?\bendstream\b", re.S)
_REF = re.compile(rb"(\d+)\s+(\d+)\s+R\b")
_TOKEN = re.compile(
    rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]*|[+-]?(?:\d+\.?\d*|\.\d+)|[A-Za-z'\"*]+[0-9*]?|<<|>>|%[^\r\n]*", re.S)
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)\Z")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: Thousandths of the font's size that make a gap in a TJ array a space.
GAP = 200
#: Bytes that a stream may inflate to.
LARGEST = 64 << 20


def inflate(data: bytes) -> bytes:
    """A Flate stream; of a damaged one, what comes before the damage."""
    machine = zlib.decompressobj()
    out = bytearray()
    for at in range(0, len(data), 4096):
        try:
            out += machine.decompress(data[at : at + 4096], LARGEST - len(out))
        except zlib.error:
            break
        if machine.eof or len(out) >= LARGEST:
            break
    return bytes(out)


def _content(body: bytes) -> bytes | None:
    """The bytes of an object's stream; None without one or with a filter other than Flate."""
    found = _STREAM.search(body)
    if not found:
        return None
    head, data = found[1], found[2]
    length = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", head)
    if length and int(length[1]) <= len(body) - found.start(2):
        exact = body[found.start(2) : found.start(2) + int(length[1])]
        data = exact if len(exact) >= len(data) - 2 else data
    if b"/Filter" not in head:
        return data
    filters = re.search(rb"/Filter\s*\[?\s*((?:/\w+\s*)+)", head)
    return inflate(data) if filters and re.findall(rb"/(\w+)", filters[1]) in ([b"FlateDecode"], [b"Fl"]) else None


def _objects(data: bytes) -> dict[int, bytes]:
    """Objects by number, the last of each; those in object streams too."""
    found = {int(m[1]): m[3] for m in _OBJECT.finditer(data)}
    for body in list(found.values()):
        if b"/ObjStm" not in body[:400]:
            continue
        inner, n, first = _content(body), re.search(rb"/N\s+(\d+)", body), re.search(rb"/First\s+(\d+)", body)
        if inner is None or not n or not first:
            continue
        heads = list(map(int, re.findall(rb"\d+", inner[: int(first[1])])[: 2 * int(n[1])]))
        at = [*heads[1::2], len(inner)]
        for i, number in enumerate(heads[0::2]):
            found.setdefault(number, inner[int(first[1]) + at[i] : int(first[1]) + at[i + 1] if i + 2 < len(at) else len(inner)])
    return found


def _refs(text: bytes, key: bytes) -> list[int]:
    """Object numbers behind a key: one reference or an array of them."""
    found = re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R\b)", text)
    return [int(m[1]) for m in _REF.finditer(found[1])] if found else []


def _pages(objects: dict[int, bytes]) -> Iterator[bytes]:
    """Page objects in the order of the page tree; by number where there is no tree."""
    is_page = lambda b: re.search(rb"/Type\s*/Page\b(?!s)", b) is not None
    roots = [n for n, b in objects.items() if re.search(rb"/Type\s*/Pages\b", b) and not re.search(rb"/Parent\b", b)]
    seen: set[int] = set()
    stack = sorted(roots, reverse=True)
    while stack:
        n = stack.pop()
        body = objects.get(n)
        if n in seen or body is None:
            continue
        seen.add(n)
        if is_page(body):
            yield body
        stack += reversed(_refs(body, b"Kids"))
    if not roots:
        yield from (objects[n] for n in sorted(objects) if is_page(objects[n]))


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        def plain(m: re.Match) -> bytes:
            c = m[1]
            if c[:1].isdigit():
                return bytes([int(c, 8) & 255])
            return b"" if c in (b"\n", b"\r", b"\r\n") else _ESCAPES.get(c, c)

        raw = re.sub(rb"\\([0-7]{1,3}|\r\n|.)", plain, token[1:-1], flags=re.S)
    return raw.decode("utf-16", "replace") if raw[:2] in (b"\xfe\xff", b"\xff\xfe") else raw.decode("cp1252", "replace")


def page_text(content: bytes) -> str:
    """What the text operators of a page's content show."""
    lines, line, stack = [], "", []
    height: float | None = None

    def moved(to: float | None) -> None:
        nonlocal line, height
        if line and (to is None or to != height):
            lines.append(line)
            line = ""
        elif line and not line.endswith(" "):
            line += " "
        height = to

    for token in (m[0] for m in _TOKEN.finditer(content)):
        if not token[:1].isalpha() and token not in (b"'", b'"'):
            if token[:1] != b"%":
                stack.append(token)
            continue
        number = lambda i: float(stack[i]) if len(stack) >= -i and _NUMBER.match(stack[i]) else 0.0
        if token == b"BT":
            moved(height if height is None else 0.0)
        elif token in (b"Td", b"TD"):
            moved((height or 0.0) + number(-1))
        elif token == b"Tm":
            moved(number(-1))
        elif token in (b"T*", b"'", b'"', b"T"):
            moved((height or 0.0) - 1)
        if token in (b"Tj", b"'", b'"') and stack and stack[-1][:1] in (b"(", b"<"):
            line += _string(stack[-1])
        elif token == b"TJ" and b"[" in stack:
            for part in stack[len(stack) - stack[::-1].index(b"[") :]:
                if part[:1] in (b"(", b"<"):
                    line += _string(part)
                elif _NUMBER.match(part) and float(part) <= -GAP and not line.endswith(" "):
                    line += " "
        stack = []
    return "\n".join(x.strip() for x in [*lines, line] if x.strip())


def _without_repeats(pages: list[str], edge: int = 3, share: float = 0.6) -> list[str]:
    """Pages without lines that stand among the first or last three of most pages (of two at least)."""
    fold = lambda x: " ".join(x.split()).casefold()
    counts: Counter = Counter()
    for page in pages:
        lines = [fold(x) for x in page.split("\n") if x.strip()]
        counts.update(("top", x) for x in lines[:edge])
        counts.update(("end", x) for x in lines[-edge:])
    often = {x for (_, x), n in counts.items() if n >= max(2, int(len(pages) * share))}
    return ["\n".join(x for x in page.split("\n") if fold(x) not in often).strip() for page in pages] if len(pages) > 1 else pages


def read_pdf(data: bytes) -> str:
    """Texts of all pages without running heads and feet, with a blank line between; '' for what is no PDF or cannot be read.

    First the pages of the page tree; where they give no text, every content stream in the order of the file.
    """
    if b"%PDF-" not in data[:1024] or re.search(rb"/Encrypt\s+\d+", data):
        return ""
    objects = _objects(data)
    pages = []
    for page in _pages(objects):
        parts = [_content(objects.get(n, b"")) for n in _refs(page, b"Contents")]
        pages.append(page_text(b"\n".join(p for p in parts if p)))
    if not any(pages):
        pages = [page_text(c) for body in objects.values() if (c := _content(body)) and b"BT" in c]
    return "\n\n".join(p for p in _without_repeats([p for p in pages if p]) if p)


def write_pdf(pages: list[list[str]], compress: bool = True) -> bytes:
    """Pages of lines in one of the standard fonts, for round trips."""
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(pages), b" ".join(b"%d 0 R" % (4 + 2 * i) for i in range(len(pages)))), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    for i, lines in enumerate(pages):
        shown = [b"(" + re.sub(rb"([\\()])", rb"\\\1", x.encode("cp1252", "replace")) + b") Tj T*" for x in lines]
        content = b"BT /F1 11 Tf 14 TL 72 720 Td\n" + b"\n".join(shown) + b"\nET"
        content = zlib.compress(content) if compress else content
        head = b"<< /Length %d%s >>" % (len(content), b" /Filter /FlateDecode" if compress else b"")
        objects += [b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (5 + 2 * i), head + b"\nstream\n" + content + b"\nendstream"]
    out = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i + 1, o) for i, o in enumerate(objects))
    return out + b"trailer << /Root 1 0 R /Size %d >>\n%%%%EOF\n" % (len(objects) + 1)
