"""Layer 1: techniques 1-14, URLs recognised by their form."""

from __future__ import annotations

import re
from collections.abc import Iterator

from weblode.functions import decode, urls as U
from weblode.functions.scan import MIB, Hit, Lines, Rule, Technique, Texts, first_of_each, hit, ruled

Q = "[\"'`]"
# The patterns of the detection rules.
_SEGMENTS = r"(?:/[a-zA-Z0-9_\-~.%{}:]+)"
_TAIL = r"(?:\?[^\"'`\t\n\f\r <>]*)?)(?:[\"'`\t\n\f\r ;,]|\z)"
_HEAD = r"(?:[\"'`]|=[\t\n\f\r ]*)("


def _api(body: str, gate: tuple[str, ...]) -> Rule:
    return Rule(_HEAD + body + _TAIL, category="api_endpoint", gate=gate, line_group=True)


def _bytes(u: str) -> int:
    return len(u.encode("utf-8", "replace"))


def _shortened(u: str) -> str:
    return u[:120] + "..." if _bytes(u) > 120 else u


def _anything(u: str) -> bool:
    return True


def _octets(u: str) -> bool:
    return all(int(n) <= 255 for n in u.split(":")[0].split("."))


ABSOLUTE = Rule(r"(?i)((?:https?|ftp|wss?)://[^\t\n\f\r \"'`<>{}\[\]|\\^\x00-\x1f]{3,})", clean=True, gate=("://",))
PROTOCOL_RELATIVE = Rule(
    r"(?:^|[=(\"'`\t\n\f\r ])(//(?:[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}[^\t\n\f\r \"'`<>)]*)",
    clean=True, line_group=True, gate=("//",), keep=lambda u: _bytes(u) >= 5,
)
RELATIVE = Rule(
    r"[\"'`]((?:\.{1,2})?/(?:[a-zA-Z0-9_\-~.%@:]+/)*[a-zA-Z0-9_\-~.%@:]*(?:\?[^\"'`\t\n\f\r ]*)?(?:#[^\"'`\t\n\f\r ]*)?)[\"'`]",
    line_group=True, keep=lambda u: u not in ("/", "./", "../") and not u.startswith("//") and _bytes(u) >= 2,
)
API = (
    _api(r"/api(?:/v\d+)?" + _SEGMENTS + "*", ("/api/",)),
    _api(r"/graphql(?:/[a-zA-Z0-9_\-~.%{}:]*)*", ("/graphql",)),
    _api("/rest" + _SEGMENTS + "+", ("/rest/",)),
    _api("/rpc" + _SEGMENTS + "+", ("/rpc/",)),
    _api("/ws" + _SEGMENTS + "*", ("/ws/",)),
    _api(r"/v\d+" + _SEGMENTS + "+", tuple(f"/v{d}" for d in range(10))),
)
QUERY = Rule(
    r"(?i)((?:https?://[^\t\n\f\r \"'`<>]+|/[a-zA-Z0-9_\-/.]+)\?[a-zA-Z0-9_\-=&%.+*!~]+(?:#[^\t\n\f\r \"'`<>]*)?)",
    clean=True, gate=("?",), params="names",
)
BARE_QUERY = Rule(r"[\"'`](\?[a-zA-Z_][a-zA-Z0-9_\-]*=[^\"'`\t\n\f\r ]+)[\"'`]", confidence="low", cap=2 * MIB, params="names", gate=("?",), line_group=True)
HASH = (
    Rule(r"[\"'`](#/[a-zA-Z0-9_\-/.~%:]+(?:\?[^\"'`\t\n\f\r <>]*)?)[\"'`]", category="page_route", gate=("#/",), line_group=True),
    Rule(r"(?i)href[\t\n\f\r ]*=[\t\n\f\r ]*[\"'](#/[a-zA-Z0-9_\-/.~%:]+(?:\?[^\"'\t\n\f\r <>]*)?)[\"']", category="page_route", confidence="high", gate=("#/",), cap=2 * MIB, line_group=True),
)
TEMPLATE = Rule(r"`([^`]*\$\{[^}]*\}[^`]*)`", cap=2 * MIB, gate=("${",))
DATA_URI = Rule(
    r"(?i)(data:[a-zA-Z0-9]+/[a-zA-Z0-9+.\-]+(?:;[a-zA-Z0-9\-]+=?[a-zA-Z0-9\-]*)*(?:;base64)?,(?:[A-Za-z0-9+/=]|%[0-9A-Fa-f][0-9A-Fa-f])*)",
    category="data_uri", gate=("data:",), line_group=True,
    change=_shortened,
)
BLOB = (
    Rule(r"(?i)(blob:(?:https?://)?[^\t\n\f\r \"'`<>]{3,})", clean=True, gate=("blob:",), keep=_anything),
    Rule(r"(?i)(javascript:[^\t\n\f\r \"'`<>]+)", clean=True, gate=("javascript:",), keep=_anything),
)
MAILTO = Rule(r"(?i)(mailto:[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}(?:\?[^\t\n\f\r \"'`<>]*)?)", category="mailto", confidence="high", clean=True, gate=("mailto:",), keep=_anything)
_IPV4 = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?::\d{1,5})?"
IP = (
    Rule(r"(?i)(https?://" + _IPV4 + r"(?:/[^\t\n\f\r \"'`<>]*)?)", clean=True, confidence="high", cap=2 * MIB, gate=("://",), keep=_anything),
    Rule(r"(?i)(https?://\[[0-9a-fA-F:]+\](?::\d{1,5})?(?:/[^\t\n\f\r \"'`<>]*)?)", clean=True, confidence="high", cap=2 * MIB, gate=("://[",), keep=_anything),
    Rule(r"[\"'`](" + _IPV4 + ")[\"'`]", category="internal_infra", confidence="low", cap=2 * MIB, line_group=True,
         keep=_octets),
)
SCHEME_MARKS = (
    "ndroid-app://", "os-app://", "ntent://", "eeplink://", "fb://", "witter://", "hatsapp://", "tg://", "lack://", "iber://", "line://", "tel://",
    "sms://", "geo://", "aps://", "arket://", "tms-app", "ebcal://", "vn+ssh://", "ssh://", "s3://", "gs://", "az://",
)
SCHEMES = (
    Rule(r"(?i)((?:android-app|ios-app|intent|deeplink|fb|twitter|whatsapp|tg|slack|viber|line|tel|sms|geo|maps|market|itms-apps?|webcal|svn\+ssh|ssh|s3|gs|az)://[^\t\n\f\r \"'`<>)]+)",
         category="custom_protocol", clean=True, gate=SCHEME_MARKS, keep=_anything),
    Rule(r"(?i)(intent://[^\t\n\f\r \"'`<>]*;end)", category="custom_protocol", confidence="high", gate=SCHEME_MARKS),
)


# Slashed text that is not a path: dates, fractions, expressions, and a single word.
_NO_PATH = re.compile(r"/\^|[a-zA-Z]*/[a-zA-Z]+\Z|[a-zA-Z]+/[a-zA-Z0-9.+\-]+\Z|\d{1,4}/\d{1,2}/\d{1,4}\Z|\d+/\d+\Z", re.A)


def _literal(q: str) -> Rule:
    body = r"(?:/[a-zA-Z0-9_\-~.%@:{}]+)+(?:\.[a-zA-Z0-9]+)?(?:\?[^" + q + r"\t\n\f\r ]*)?"
    return Rule(f"{q}({body}){q}", confidence="low", cap=2 * MIB, keep=_path, line_group=True)


def _path(u: str) -> bool:
    return not (u.endswith("$/") or _NO_PATH.match(u))


LITERALS = (_literal('"'), _literal("'"), _literal("`"))
# A chain of quoted strings and names joined by `+`: literals first, or a name before literals. The second
# form takes a name's leading digits and dots along: they end up in the placeholder anyway. Loops are
# possessive, so that a chain that leads nowhere is read once.
_GAP = r"[\t\n\f\r ]*+"
_PLUS = _GAP + r"\+" + _GAP
_LITERAL = r"(?:\"[^\"]*+\"|'[^']*+')"
_NAME = r"[a-zA-Z_$][a-zA-Z0-9_$.]*+"
CONCATENATION = (
    re.compile(f"{_LITERAL}(?:(?:{_PLUS}{_LITERAL})++(?:(?:{_PLUS}{_NAME})++{_PLUS}{_LITERAL})?|(?:{_PLUS}{_NAME})++{_PLUS}{_LITERAL})"),
    re.compile(rf"(?<![a-zA-Z0-9_$.])[0-9.]*+{_NAME}{_PLUS}(?:{_LITERAL}{_GAP}\+?{_GAP})++"),
)
HOLE = re.compile(r"\$\{[^}]*\}")


def _templates(texts: Texts) -> Iterator[Hit]:
    for doc, line, (_, body) in texts.matches(TEMPLATE.pattern, (1,), texts.having(TEMPLATE.gate, TEMPLATE.cap)):
        if "/" in HOLE.sub("", body):
            yield hit(doc, HOLE.sub(U.DYNAMIC, body), line, "medium", "template_literals")


def _joined(expression: str) -> str:
    """Literals of a concatenation put together, names as placeholders."""
    parts = filter(None, (p.strip() for p in expression.split("+")))
    quoted = lambda p: len(p) > 1 and p[0] == p[-1] and p[0] in "\"'"
    return "".join(p[1:-1] if quoted(p) else "" if p in ('"', "'") else U.DYNAMIC for p in parts)


def _concatenations(texts: Texts) -> Iterator[Hit]:
    for doc in texts.having(("+",), 2 * MIB).nonzero()[0].tolist():
        text, line = texts.text(doc), None
        for pattern in CONCATENATION:
            for m in pattern.finditer(text):
                url = _joined(m.group())
                if url != U.DYNAMIC and "/" in url:
                    line = line or Lines(text)
                    yield hit(doc, url, line(m.start()), "low", "string_concatenation")


TECHNIQUES = {
    1: ruled("absolute_urls", (ABSOLUTE, PROTOCOL_RELATIVE)),
    2: ruled("relative_paths", (RELATIVE,)),
    3: ruled("api_patterns", API, once=True),
    4: ruled("query_strings", (QUERY, BARE_QUERY), once=True),
    5: ruled("hash_fragments", HASH),
    6: Technique("template_literals", _templates, TEMPLATE.gate),
    7: Technique("string_concatenation", lambda texts: first_of_each(_concatenations(texts)), ("+",)),
    8: ruled("data_uris", (DATA_URI,)),
    9: ruled("blob_javascript_uris", BLOB),
    10: ruled("mailto_links", (MAILTO,)),
    11: ruled("ip_based_urls", IP),
    12: decode.ENCODED,
    13: ruled("custom_protocols", SCHEMES),
    14: ruled("string_literals", LITERALS, once=True),
}
