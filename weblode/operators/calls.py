"""Layer 2: techniques 15-33, URLs at the places that use them."""

from __future__ import annotations

import re
from collections.abc import Iterator

from weblode.functions import decode, urls as U
from weblode.functions.scan import Hit, Rule, Technique, Texts, hit, ruled, scan, scan_all

# The patterns of the detection rules. W is ASCII white space, L a quoted literal on one line.
W = r"[\t\n\f\r ]*"
L = "[\"'`]([^\"'`\\n]+)[\"'`]"
VERBS = "GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS"


def path_like(u: str) -> bool:
    return "/" in u


def promoted(u: str) -> str:
    """An event stream is an endpoint even where its path looks like a page."""
    own = U.category_of(u)
    return "api_endpoint" if own == "page_route" else own


def _site(pattern: str, gate: tuple[str, ...], confidence: str = "high", **more) -> Rule:
    return Rule(pattern, confidence=confidence, gate=gate, **({"keep": path_like, "params": "query"} | more))


XHR = _site(rf"\.open{W}\({W}[\"'`]({VERBS})[\"'`]{W},{W}{L}", (".open(",), group=2, method=1)
JQUERY = ("$.", "jQuery")
AJAX_TEXT = _site(rf"(?:\$|jQuery){W}\.{W}ajax{W}\({W}{L}", JQUERY)
AJAX_GET = _site(rf"(?:\$|jQuery){W}\.{W}(?:get|getJSON){W}\({W}{L}", JQUERY, method="GET")
AJAX_POST = _site(rf"(?:\$|jQuery){W}\.{W}post{W}\({W}{L}", JQUERY, method="POST")
BEACON = _site(rf"\bnavigator{W}\.{W}sendBeacon{W}\({W}{L}", ("sendBeacon",), method="POST")
_SOCKETS = ("EventSource", "WebSocket")
SOCKET = _site(rf"\bnew[\t\n\f\r ]+WebSocket{W}\({W}{L}", _SOCKETS, category="websocket", keep=None)
EVENTS = _site(rf"\bnew[\t\n\f\r ]+EventSource{W}\({W}{L}", _SOCKETS, category=promoted, keep=None)
IMPORT = _site(rf"(?:^|[^.0-9A-Za-z_])import{W}\({W}{L}{W}\)", ("import(",), keep=None, params="")
REQUIRE = _site(rf"\brequire{W}\({W}{L}{W}\)", ("require(",), params="")
LOCATION = (
    _site(rf"(?:document|window){W}\.{W}location{W}(?:\.href)?{W}={W}{L}", ("location",)),
    _site(rf"(?:document{W}\.{W}|window{W}\.{W})?location{W}\.{W}(?:assign|replace){W}\({W}{L}", ("location",)),
)
WINDOW = _site(rf"\bwindow{W}\.{W}open{W}\({W}{L}", ("window.",))
PROPERTY = _site(rf"\.{W}(?:src|href|action){W}={W}{L}", (".src", ".href"), "medium")
ATTRIBUTE = _site(rf"\.setAttribute{W}\({W}[\"'`](?:src|href|action)[\"'`]{W},{W}{L}{W}\)", ("setAttribute",))
INNER = (rf"\.(?:inner|outer)HTML{W}={W}[\"'`]([^\"'`]+)[\"'`]", rf"\.(?:inner|outer)HTML{W}\+={W}[\"'`]([^\"'`]+)[\"'`]")
INNER_URL = r"(?:src|href|action)[\t\n\f\r ]*=[\t\n\f\r ]*\\?[\"'`]([^\"'`\\\t\n\f\r >]+)\\?[\"'`]"
FORM = r"(?i)<form\b([^>]*)>"
FORM_ACTION = re.compile(rf"\baction{W}={W}[\"'`]([^\"'`\n>]+)[\"'`]", re.I | re.A)
FORM_METHOD = re.compile(rf"\bmethod{W}={W}[\"'`]?(GET|POST)[\"'`]?", re.I | re.A)
FORM_TEXT = _site(rf"(?:[\"'`]|\\[\"'`]){W}action{W}={W}(?:\\?[\"'`])([^\"'`\\\n>]+)(?:\\?[\"'`])", ("<form", "action="), "medium", method="POST")
SERVICE_WORKER = _site(rf"\bnavigator{W}\.{W}serviceWorker{W}\.{W}register{W}\({W}{L}", ("serviceWorker",), keep=None, params="")
WORKER = _site(rf"\bnew[\t\n\f\r ]+(?:Worker|SharedWorker){W}\({W}{L}", ("Worker(",), keep=None, params="")
_WEBPACK = ("require.ensure", "require.context", "__webpack_require__")
ENSURE = rf"\brequire{W}\.{W}ensure{W}\({W}\[([^\]]*)\]"
CONTEXT = _site(rf"\brequire{W}\.{W}context{W}\({W}{L}", _WEBPACK, "medium", keep=None, params="")
WEBPACK = _site(rf"\b__webpack_require__{W}\({W}{L}{W}\)", _WEBPACK, "medium", params="")
CREATE_SCRIPT = re.compile(rf"createElement{W}\({W}[\"'`]script[\"'`]{W}\)")
SCRIPT_SOURCE = re.compile(rf"\.src{W}={W}{L}")
WRITE_SCRIPT = _site(
    rf"(?:document\.write|document\.writeln){W}\({W}[\"'`][^\"'`]*<script[^>]*\bsrc{W}=[\t\n\f\r ]*\\?[\"'`]([^\"'`\\\n>]+)\\?[\"'`]",
    ("createElement",), params="",
)
AHEAD_BYTES = 500


def _nested(texts: Texts, outer: tuple[str, ...], inner: str, gate: tuple[str, ...], name: str, params: bool = False) -> Iterator[Hit]:
    """The URLs of every inner match inside every outer match, on the outer's line."""
    inside = re.compile(inner)
    for pattern in outer:
        for doc, line, (_, body) in texts.matches(pattern, (1,), texts.having(gate)):
            for url in filter(path_like, inside.findall(body)):
                yield hit(doc, url, line, "medium", name, query=U.names_in_query(url) if params else ())


def _forms(texts: Texts) -> Iterator[Hit]:
    for doc, line, (_, attributes) in texts.matches(FORM, (1,), texts.having(("<form", "action="))):
        action, method = FORM_ACTION.search(attributes), FORM_METHOD.search(attributes)
        if action and path_like(action[1]):
            yield hit(doc, action[1], line, "medium", "form_action", method=method[1].upper() if method else "GET", query=U.names_in_query(action[1]))
    yield from scan(texts, FORM_TEXT, "form_action")


def _scripts(texts: Texts) -> Iterator[Hit]:
    """A script element's first source within the next bytes, and scripts written into the page."""

    def created(text: str) -> Iterator[decode.Found]:
        for m in CREATE_SCRIPT.finditer(text):
            ahead = text[m.end() : m.end() + AHEAD_BYTES].encode("utf-8", "replace")[:AHEAD_BYTES].decode("utf-8", "replace")
            source = SCRIPT_SOURCE.search(ahead)
            if source and path_like(source[1]):
                yield source[1], m.start(), {}

    yield from decode.hits(texts, created, "high", "dynamic_script", ("createElement",))
    yield from scan(texts, WRITE_SCRIPT, "dynamic_script")


def _jquery(texts: Texts) -> Iterator[Hit]:
    """Calls with a configuration, with a URL, and short calls of either method by line, get before post on the same line."""
    configured = texts.having(JQUERY) & texts.having(("ajax",))
    yield from decode.hits(texts, decode.jquery_configs, "high", "jquery_ajax", among=configured)
    yield from scan(texts, AJAX_TEXT, "jquery_ajax")
    yield from sorted(scan_all(texts, (AJAX_GET, AJAX_POST), "jquery_ajax"), key=lambda h: h[2])


def _walked(name: str, find, confidence: str, mark: str) -> Technique:
    return Technique(name, lambda texts: decode.hits(texts, find, confidence, name, (mark,)), (mark,))


def _windows(texts: Texts) -> Iterator[Hit]:
    opening = texts.having((".open(",))
    return (h for h in scan(texts, WINDOW, "window_open") if opening[h[0]])


def _webpack(texts: Texts) -> Iterator[Hit]:
    yield from _nested(texts, (ENSURE,), L, _WEBPACK, "webpack_require")
    yield from scan_all(texts, (CONTEXT, WEBPACK), "webpack_require")


TECHNIQUES = {
    15: _walked("fetch_calls", decode.fetch_calls, "high", "fetch"),
    16: ruled("xmlhttprequest", (XHR,)),
    17: _walked("axios_calls", decode.axios_calls, "high", "axios"),
    18: Technique("jquery_ajax", _jquery, JQUERY),
    19: ruled("sendbeacon", (BEACON,)),
    20: ruled("eventsource_websocket", (SOCKET, EVENTS)),
    21: ruled("dynamic_import", (IMPORT,)),
    22: ruled("require_calls", (REQUIRE,)),
    23: ruled("location_assign", LOCATION),
    24: Technique("window_open", _windows, (".open(",)),
    25: ruled("element_src_href", (PROPERTY,)),
    26: ruled("set_attribute", (ATTRIBUTE,)),
    27: Technique("innerhtml_urls", lambda texts: _nested(texts, INNER, INNER_URL, ("innerHTML", "outerHTML"), "innerhtml_urls", True), ("innerHTML", "outerHTML")),
    28: _walked("postmessage", decode.message_origins, "medium", "postMessage"),
    29: Technique("form_action", _forms, ("<form", "action=")),
    30: ruled("serviceworker", (SERVICE_WORKER,)),
    31: ruled("webworker", (WORKER,)),
    32: Technique("webpack_require", _webpack, _WEBPACK),
    33: Technique("dynamic_script", _scripts, ("createElement",)),
}
