"""File-type parsers: HTML, CSS, JSON, source maps, manifests, XML / SVG, Vue / Svelte.

CSS, XML and the regular parts are scans. HTML and JSON are no regular languages: the standard
library's parsers walk them, a content at a time. All run in the same Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from weblode.functions import urls as U
from weblode.functions.scan import HIT_TYPE, Hit, Lines, Rule, Texts, arrow_hits, hit, scan, sliced

W = r"[\t\n\f\r ]*"
# Where HTML keeps URLs, and keys that name one in JSON.
TAG_ATTRIBUTES = {
    "a": ("href",), "link": ("href",), "script": ("src",), "img": ("src",), "iframe": ("src",), "source": ("src",), "embed": ("src",),
    "object": ("data",), "area": ("href",), "base": ("href",), "form": ("action",), "video": ("src", "poster"), "audio": ("src",),
    "track": ("src",), "input": ("src",),
}
EVENT_ATTRIBUTES = (
    "onclick", "onload", "onerror", "onsubmit", "onchange", "onmouseover", "onmouseout", "onfocus", "onblur", "onkeyup", "onkeydown",
    "onkeypress", "onresize", "onscroll", "ondblclick", "oncontextmenu", "oninput", "onreset",
)
RAW_TEXT_TAGS = ("script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp")
URL_KEYS = (
    "url", "href", "src", "endpoint", "path", "link", "uri", "redirect", "callback", "webhook", "origin", "host", "action", "target",
    "location", "base_url", "baseurl", "api_url",
)
MANIFEST_KEYS = ("start_url", "scope", "sourceRoot", "file")
SNIPPET = re.compile(r"""["']([^"']*(?:https?://|/)[^"']*)["']""")
SCRIPT_LITERAL = re.compile(r"""["']((?:https?://|/)[^"'\s]{2,})["']""", re.A)
RAW_JSON = Rule(r'"((?:https?://|/)[^"]+)"', confidence="low", keep=U.usable_text)
CSS_URL = Rule(rf"url\({W}[\"']?([^\"')]+?)[\"']?{W}\)", confidence="high", change=str.strip, keep=lambda u: U.usable_text(u) and not u.startswith("data:"))
CSS_IMPORT = Rule(r"@import[\t\n\f\r ]+[\"']([^\"']+)[\"']", confidence="high", change=str.strip, keep=U.usable_text)
XML = (
    ("xml_href", Rule(rf"(?i)\bhref{W}={W}[\"']([^\"']+)[\"']", confidence="high", keep=U.usable_text)),
    ("xml_xlink_href", Rule(rf"(?i)\bxlink:href{W}={W}[\"']([^\"']+)[\"']", confidence="high", keep=U.usable_text)),
    ("xml_src", Rule(rf"(?i)\bsrc{W}={W}[\"']([^\"']+)[\"']", confidence="high", keep=U.usable_text)),
    ("xml_action", Rule(rf"(?i)\baction{W}={W}[\"']([^\"']+)[\"']", keep=U.usable_text)),
    ("xml_namespace", Rule(rf"(?i)\bxmlns(?::[0-9A-Za-z_]+)?{W}={W}[\"'](https?://[^\"']+)[\"']", category="external_service", confidence="low")),
)
XML_SCRIPT = r"(?is)<script[^>]*>(.*?)</script>"


def _row(url: str, line: int, confidence: str, detection: str, category: str | None = None, technique: int = 0) -> dict:
    return {
        "url": url, "source_line": line, "http_method": "", "query_params": [], "body_params": [], "category": category,
        "confidence": confidence, "detection_method": detection, "technique_id": technique,
    }


PARSED_TYPE = ArrayType(StructType([*HIT_TYPE.elementType.fields, StructField("technique_id", IntegerType())]))
Parsed = tuple  # a hit with the technique's number at its end


def snippet_urls(code: str) -> list[str]:
    return [u for m in SNIPPET.findall(code) if (u := m.strip()) not in U.UNUSABLE]


class _Pages(HTMLParser):
    """URLs of start tags in document order, and the text of scripts without a source."""

    CDATA_CONTENT_ELEMENTS = RAW_TEXT_TAGS

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.scripts: list[dict] = []
        self.in_script = False

    def goahead(self, end: bool) -> None:
        self.no_comment_from: int | None = None
        super().goahead(end)

    def parse_comment(self, i: int, report: bool = True) -> int:
        """The end of a comment, -1 if it never ends; the rest of the text is searched for one end only once."""
        if self.no_comment_from is not None and i >= self.no_comment_from:
            return -1
        end = super().parse_comment(i, report)
        if end < 0:
            self.no_comment_from = i
        return end

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        line = self.getpos()[0]
        have = {k: v or "" for k, v in attrs}
        for name in TAG_ATTRIBUTES.get(tag, ()):
            url = have.get(name, "").strip()
            if url not in U.UNUSABLE:
                self.rows.append(_row(url, line, "high", f"html_{tag}_{name}"))
        if tag == "meta" and have.get("http-equiv", "").lower() == "refresh":
            head, found, url = have.get("content", "").lower().partition("url=")
            url = have["content"][len(head) + 4 :].strip().strip("'\"") if found else ""
            if url:
                self.rows.append(_row(url, line, "high", "html_meta_refresh"))
        for candidate in have.get("srcset", "").split(","):
            if (parts := candidate.split()) and parts[0] not in U.UNUSABLE:
                self.rows.append(_row(parts[0], line, "high", "html_srcset"))
        for name in sorted(have):
            value = have[name].strip()
            if name.startswith("data-") and (value.startswith(("http://", "https://", "//")) or (value.startswith("/") and len(value) > 1)):
                self.rows.append(_row(value, line, "medium", "html_data_attr"))
        for name in EVENT_ATTRIBUTES:
            self.rows += [_row(u, line, "medium", "html_event_handler") for u in snippet_urls(have.get(name, ""))]
        if tag == "script" and "src" not in have:
            self.in_script = True

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        self.in_script = False

    def handle_endtag(self, tag: str) -> None:
        if tag == "script":
            self.in_script = False

    def handle_data(self, data: str) -> None:
        if self.in_script and data.strip():
            self.scripts.append({"content": data, "line": self.getpos()[0]})


def page(text: str) -> _Pages:
    """A page read once: its `rows` and its inline `scripts`."""
    page = _Pages()
    page.feed(text[: text.rfind(">") + 1])  # behind the last one nothing is whole
    page.close()
    return page


def html_rows(text: str) -> list[dict]:
    return page(text).rows


def inline_scripts(text: str) -> list[dict]:
    return page(text).scripts


def _no_constant(name: str):
    raise ValueError(name)


def load_json(text: str):
    """The value of strict JSON; ValueError otherwise."""
    try:
        return json.loads(text, parse_constant=_no_constant)
    except RecursionError as deep:
        raise ValueError("nested too deep") from deep


def _texts(value: object) -> str:
    return value if isinstance(value, str) else ""


def manifest_rows(data: dict) -> list[dict]:
    rows = [_row(_texts(data.get(k)), 1, "high", f"manifest_{k}", "page_route", 46) for k in MANIFEST_KEYS if _texts(data.get(k))]
    icons = data.get("icons")
    sources = [_texts(i.get("src")) for i in icons if isinstance(i, dict)] if isinstance(icons, list) else []
    return rows + [_row(s, 1, "high", "manifest_icon", "static_asset", 46) for s in sources if s]


def source_map_rows(data: dict) -> list[dict]:
    """A map's file, root, sources against the root, and URLs in the sources' texts (named by their source)."""
    rows = []
    if _texts(data.get("file")):
        rows.append(_row(data["file"], 1, "high", "sourcemap_file", "source_map", 44))
    root = _texts(data.get("sourceRoot"))
    if root:
        rows.append(_row(root, 1, "high", "sourcemap_sourceRoot", "source_map", 44))
    sources = data.get("sources") if isinstance(data.get("sources"), list) else []
    for s in map(_texts, sources):
        if s:
            full = s if not root or s.startswith(("/", "http://", "https://")) else root.rstrip("/") + "/" + s
            rows.append(_row(full, 1, "high", "sourcemap_source", "source_map", 44))
    contents = data.get("sourcesContent") if isinstance(data.get("sourcesContent"), list) else []
    for code in map(_texts, contents):
        line = Lines(code)
        rows += [_row(m.group(1), line(m.start()), "medium", "sourcemap_content", None, 44) for m in SCRIPT_LITERAL.finditer(code) if m.group(1) not in U.UNUSABLE]
    return rows


def _json_like(text: str) -> bool:
    return text.startswith(("http://", "https://", "//")) or (text.startswith("/") and len(text) > 1 and not set(text[:2]) & set(" \t\n") and " " not in text)


def _walk(value: object, key: str) -> Iterator[dict]:
    todo = [(value, key)]
    while todo:
        value, key = todo.pop()
        if isinstance(value, dict):
            todo += [(v, k.lower()) for k, v in reversed(value.items())]
        elif isinstance(value, list):
            todo += [(v, key) for v in reversed(value)]
        elif isinstance(value, str) and (key in URL_KEYS or _json_like(value)):
            url = value.strip()
            if url not in U.UNUSABLE and len(url.encode("utf-8", "replace")) > 1:
                named = key in URL_KEYS
                yield _row(url, 1, "high" if named else "medium", "json_url_key" if named else "json_value")


def json_rows(text: str) -> list[dict] | None:
    """None where the text is no JSON."""
    try:
        data = load_json(text)
    except ValueError:
        return None
    if isinstance(data, dict) and "sources" in data and "mappings" in data:
        return source_map_rows(data)
    rows = manifest_rows(data) if isinstance(data, dict) and "start_url" in data else []
    return rows + list(_walk(data, ""))


def source_map_text(text: str) -> list[dict]:
    try:
        data = load_json(text)
    except ValueError:
        return []
    return source_map_rows(data) if isinstance(data, dict) else []


def as_hits(doc: int, rows: list[dict]) -> Iterator[Parsed]:
    for r in rows:
        yield *hit(doc, r["url"], r["source_line"], r["confidence"], r["detection_method"], r["category"]), r["technique_id"]


def _scanned(hits: Iterator[Hit]) -> Iterator[Parsed]:
    return ((*h, 0) for h in hits)


def _each(read: Callable[[str], list[dict]]) -> Callable[[Texts], Iterator[Parsed]]:
    return lambda texts: (h for doc in texts.having(()).nonzero()[0].tolist() for h in as_hits(doc, read(texts.text(doc))))


def find_css(texts: Texts) -> Iterator[Parsed]:
    yield from _scanned(scan(texts, CSS_URL, "css_url"))
    yield from _scanned(scan(texts, CSS_IMPORT, "css_import"))


def find_json(texts: Texts) -> Iterator[Parsed]:
    """Values and keys of JSON; quoted URLs of a text that is none."""
    broken = texts.having(())
    for doc in broken.nonzero()[0].tolist():
        rows = json_rows(texts.text(doc))
        if rows is not None:
            broken[doc] = False
            yield from as_hits(doc, rows)
    for doc, line, (_, url) in texts.matches(RAW_JSON.pattern, (1,), broken):
        if U.usable_text(url):
            yield *hit(doc, url, line, RAW_JSON.confidence, "json_regex_fallback"), 0


def _elements(texts: Texts, tag: str) -> Iterator[tuple[int, int, int, str]]:
    """(document, line of the tag, line of the body, body) of every element of that name; they do not nest."""
    end = f"</{tag}>"
    for doc, line, (whole, body) in texts.matches(rf"(?is)<{tag}[^>]*>(.*?){end}", (1,)):
        yield doc, line, line + whole.count("\n", 0, len(whole) - len(body) - len(end)), body


def find_xml(texts: Texts) -> Iterator[Parsed]:
    for name, rule in XML:
        yield from _scanned(scan(texts, rule, name))
    for doc, line, _, body in _elements(texts, "script"):
        for url in snippet_urls(body):
            yield *hit(doc, url, line, "medium", "xml_embedded_script"), 0


def find_component(texts: Texts) -> Iterator[Parsed]:
    """The first template as HTML, the scripts' literals, the styles as CSS; lines count from the fragment's own plus one."""
    seen = set()
    for doc, _, line, body in _elements(texts, "template"):
        if doc not in seen:
            seen.add(doc)
            yield from as_hits(doc, [r | {"source_line": r["source_line"] + line} for r in html_rows(body)])
    for doc, _, line, body in _elements(texts, "script"):
        inner = Lines(body)
        for u in SCRIPT_LITERAL.finditer(body):
            if u.group(1) not in U.UNUSABLE:
                yield *hit(doc, u.group(1), inner(u.start()) + line, "high", "vue_svelte_script"), 0
    styles = list(_elements(texts, "style"))
    bodies = Texts(pa.array([body for *_, body in styles], pa.large_string()))
    for n, *found in sorted(find_css(bodies), key=lambda h: h[0]) if styles else ():
        yield styles[n][0], found[0], found[1] + styles[n][2], *found[2:]


FINDERS: dict[str, Callable[[Texts], Iterator[Parsed]]] = {
    "html": _each(html_rows),
    "css": find_css,
    "json": find_json,
    "sourcemap": _each(source_map_text),
    "xml": find_xml,
    "svg": find_xml,
    "vue": find_component,
    "svelte": find_component,
}


def _column(find: Callable[[Texts], Iterator[Parsed]]) -> Callable[[Column], Column]:
    def run(contents: pa.Array) -> pa.Array:
        from pyspark.sql.pandas.types import to_arrow_type

        part = lambda contents, _: arrow_hits(len(contents), list(find(Texts(contents))), ("technique_id",))
        return sliced(contents, part, to_arrow_type(PARSED_TYPE))

    return lambda content: F.arrow_udf(run, PARSED_TYPE)(F.make_valid_utf8(content))


#: The parsers by file type, as expressions over a content column: array of hit structs.
PARSERS = {kind: _column(find) for kind, find in FINDERS.items()}
