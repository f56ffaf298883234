"""Layer 5: techniques 50-53, host names and well-known services."""

from __future__ import annotations

from weblode.functions.scan import Rule, Technique, first_of_each, ruled, scan_all

# The patterns of the detection rules.
_LABEL = r"[a-z0-9](?:[a-z0-9\-]{0,61}[a-z0-9])?"
_HOST = rf"{_LABEL}(?:\.{_LABEL})+\.[a-z]{{2,63}}"
JS_HEADS = (
    "object.", "array.", "string.", "number.", "boolean.", "function.", "math.", "date.", "regexp.", "json.", "promise.", "symbol.", "error.",
    "map.", "set.", "weakmap.", "weakset.", "proxy.", "reflect.", "intl.", "console.", "module.", "exports.", "require.", "process.", "window.",
    "document.", "navigator.", "global.", "self.", "this.", "proto.", "prototype.", "constructor.", "__webpack", "__esmodule", "e.exports",
    "t.exports", "n.exports", "r.exports", "a.exports",
)


def _three_labels(u: str) -> bool:
    return u.count(".") >= 2


def _no_code(u: str) -> bool:
    return not u.lower().startswith(JS_HEADS)


SUBDOMAIN = (
    Rule(rf"(?i)(?:https?://|//)({_HOST})", gate=("//",), keep=_three_labels),
    Rule(rf"(?i)(?:[\"'`= ]|^)({_HOST})(?:[/\"'`\t\n\f\r :,;)\]}}>]|\z)", gate=(".",), keep=lambda u: _three_labels(u) and _no_code(u)),
)
CDN = Rule(
    r"(?i)https?://(?:"
    r"[a-z0-9][a-z0-9.\-]*\.s3[.\-][a-z0-9.\-]*\.amazonaws\.com|s3[.\-][a-z0-9.\-]*\.amazonaws\.com/|s3\.amazonaws\.com/|"
    r"[a-z0-9][a-z0-9\-]*\.cloudfront\.net|[a-z0-9][a-z0-9\-]*\.blob\.core\.windows\.net|storage\.googleapis\.com/|firebasestorage\.googleapis\.com/|"
    r"[a-z0-9][a-z0-9\-]*\.akamaihd\.net|[a-z0-9][a-z0-9\-]*\.akamaized\.net|[a-z0-9][a-z0-9\-]*\.akamai\.net|"
    r"[a-z0-9][a-z0-9\-]*\.fastly\.net|[a-z0-9][a-z0-9\-]*\.fastlylb\.net|[a-z0-9][a-z0-9\-]*\.cdninstagram\.com|cdnjs\.cloudflare\.com/|"
    r"[a-z0-9][a-z0-9\-]*\.r2\.cloudflarestorage\.com)[^\t\n\f\r \"'<>]*",
    group=0, category="cloud_resource", confidence="high", gate=("://",),
)
_PRIVATE = r"(?:10\.\d{1,3}\.\d{1,3}\.\d{1,3}|172\.(?:1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3}|127\.0\.0\.1|localhost)"


def _unquoted(u: str) -> str:
    return u[1:-1] if len(u) > 1 and u[0] == u[-1] and u[0] in "\"'" else u


def _internal(pattern: str, gate: tuple[str, ...]) -> Rule:
    return Rule(pattern, group=0, category="internal_infra", confidence="high", gate=gate, change=_unquoted)


INTERNAL = (
    _internal(r"(?i)https?://[a-z0-9][a-z0-9.\-]*\.(?:internal|local|staging|dev|test|corp|private)(?:[:/?#][^\t\n\f\r \"'<>]*|)", ("://",)),
    _internal(r"(?i)[\"'][a-z0-9][a-z0-9.\-]*\.(?:internal|local|staging|corp|private)[\"']", (".",)),
    _internal(rf"https?://{_PRIVATE}(?::\d+)?[^\t\n\f\r \"'<>]*", ("://",)),
    _internal(rf"[\"']{_PRIVATE}(?::\d+)?[^\t\n\f\r \"'<>]*[\"']", ("10.", "172.", "192.168.", "127.0.0.1", "localhost")),
)
WEBSOCKET = Rule(r"wss?://[^\t\n\f\r \"'<>`)]+", group=0, category="websocket", confidence="high", gate=("ws://", "wss://"))

TECHNIQUES = {
    50: Technique("subdomain_extract", lambda texts: first_of_each(scan_all(texts, SUBDOMAIN, "subdomain_extract"), str.lower), ("//", ".")),
    51: ruled("cdn_asset_domains", (CDN,), once=True),
    52: ruled("internal_hostnames", INTERNAL, once=True),
    53: ruled("websocket_endpoints", (WEBSOCKET,), once=True),
}
