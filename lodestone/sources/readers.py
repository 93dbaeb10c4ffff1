"""Text out of files: plain, DOCX, HTML; PDF and recognition by plug-ins. Errors give empty text, never a failed task."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from html.parser import HTMLParser
from xml.etree import ElementTree

#: bytes -> text; set for .pdf where a library is at hand
Plugin = Callable[[bytes], str]
PLAIN = (".md", ".txt", ".py", ".js", ".ts", ".json", ".yaml", ".yml", ".toml")
# Elements whose content isn't shown as text or isn't the page's own.
DROPPED = ("script", "style", "nav", "footer", "header", "aside")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


class _Page(HTMLParser):
    """Text pieces of a page with the open elements around each; unclosed elements end with their parent."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.pieces: list[tuple[str, frozenset[str]]] = []
        self.title: str | None = None

    def handle_starttag(self, tag, attrs):
        if tag not in _VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        inside = frozenset(self.open)
        if inside & set(DROPPED):
            return
        if "title" in inside and self.title is None and data.strip():
            self.title = data.strip()
        if data.strip():
            self.pieces.append((data.strip(), inside))


def _parsed(html: str) -> _Page:
    p = _Page()
    p.feed(html)
    p.close()
    return p


def html_text(html: str) -> str:
    """All text of a page, a line for each piece."""
    return "\n".join(t for t, _ in _parsed(html).pieces)


def page_content(html: str, url: str) -> tuple[str, str]:
    """(title, content): the article's, else main's, else the body's text, under the title and a line with the address."""
    p = _parsed(html)
    title = p.title or "Untitled"
    body = next((found for part in ("article", "main", "body") if (found := [t for t, inside in p.pieces if part in inside])), None)
    lines = [x.strip() for t in (body if body is not None else [t for t, _ in p.pieces]) for x in t.split("\n")]
    return title, f"# {title}\n\nsource: {url}\n\n" + "\n".join(x for x in lines if x)


def docx_text(data: bytes) -> str:
    """Paragraphs of a DOCX body; tables are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    body = root.find(f"{_W}body")
    out = []
    for p in body.findall(f"{_W}p") if body is not None else []:
        out.append("".join("\t" if e.tag == f"{_W}tab" else "\n" if e.tag in (f"{_W}br", f"{_W}cr") else (e.text or "") for e in p.iter() if e.tag in (f"{_W}t", f"{_W}tab", f"{_W}br", f"{_W}cr")))
    return "\n".join(out)


def first_text(data: bytes, stages: list[Plugin]) -> str:
    """The first stage's text that isn't blank; the last one's whatever it is. A stage that fails gives an empty text."""
    text = ""
    for stage in stages:
        try:
            text = stage(data)
        except Exception:  # noqa: BLE001
            text = ""
        if text.strip():
            break
    return text


def read_pages(count: int, read: Callable[[int], str], most: int = 50) -> str:
    """Texts of a document's pages, blank ones left out, and a note if only the first ``most`` were read; 0 reads all."""
    limit = min(count, most) if most > 0 else count
    parts = [t for t in map(read, range(limit)) if t.strip()]
    if limit < count:
        parts.append(f"\n\n[only the first {limit} of {count} pages were read]\n")
    return "\n\n".join(parts)


def extract(path: str, data: bytes, pdf: list[Plugin] = (), recognise: Plugin | None = None, needs: Callable[[str], bool] | None = None) -> tuple[str, bool]:
    """(text, is Markdown) of a file by its extension; unknown kinds and errors give ("", False).

    recognise reads scanned pages if ``needs`` says so of a PDF's text; what it gives counts from 20 characters on.
    """
    ext = re.search(r"\.[^./\\]*$", path.lower())
    ext = ext[0] if ext else ""
    try:
        if ext in PLAIN:
            return data.decode("utf-8", "ignore"), ext == ".md"
        if ext == ".docx":
            return docx_text(data), False
        if ext in (".html", ".htm"):
            return html_text(data.decode("utf-8", "ignore")), False
        if ext == ".pdf":
            text = first_text(data, list(pdf))
            if recognise is not None and needs is not None and needs(text):
                read = recognise(data)
                text = read if len(read.strip()) >= 20 else text
            return text, False
    except Exception:  # noqa: BLE001
        pass
    return "", False
