"""What patterns alone cannot read: balanced call arguments and encoded text.

The finders here take one content each and yield (url, offset, other fields); the decoders read
what a scan found. Contents get here only if they have the marker.
"""

from __future__ import annotations

import base64
import binascii
import html
import re
from collections.abc import Callable, Iterator

import numpy as np

from weblode.functions import urls as U
from weblode.functions.scan import HIT_TYPE, MIB, Hit, Lines, Technique, Texts, first_of_each, hit
from weblode.functions.urls import clean, names_in_query

__all__ = ["HIT_TYPE", "Lines", "clean", "names_in_query"]
Found = tuple[str, int, dict]


def hits(texts: Texts, find: Callable[[str], Iterator[Found]], confidence: str, name: str, gate: tuple[str, ...] = (), among: np.ndarray | None = None) -> Iterator[Hit]:
    """The hits of a finder over single contents."""
    for doc in np.flatnonzero(texts.having(gate) if among is None else among).tolist():
        text, line = texts.text(doc), None
        for url, offset, more in find(text):
            line = line or Lines(text)
            yield hit(doc, url, line(offset), confidence, name, **more)


# ---- call sites -------------------------------------------------------------------------

_BRACKET = re.compile(r"""[()\[\]{},"'`]""")


def _string_end(text: str, quote: int) -> int:
    """Offset of the quote that closes the one at `quote`, or -1; a quote after a backslash does not close."""
    at = quote
    while (at := text.find(text[quote], at + 1)) >= 0:
        if text[at - 1] != "\\":
            return at
    return -1


class Calls:
    """Where the parentheses of a text close, found in passes that never read the same stretch twice.

    A pass reads brackets and skips quoted strings from one opening parenthesis on. Another one that
    meets a parenthesis that an earlier pass has read goes on behind its end: from there on both would
    read the same, whatever stands in quotes before.
    """

    def __init__(self, text: str):
        self.text = text
        self.closing: dict[int, int] = {}

    def _read(self, opening: int) -> None:
        text, stack, at = self.text, [], opening
        while m := _BRACKET.search(text, at):
            c, at = m.group(), m.end()
            if c in "\"'`":
                end = _string_end(text, m.start())
                if end < 0:
                    break
                at = end + 1
            elif c == "(":
                known = self.closing.get(m.start())
                if known is None:
                    stack.append(m.start())
                elif known < 0:
                    break
                else:
                    at = known + 1
            elif c == ")":
                self.closing[stack.pop()] = m.start()
                if not stack:
                    return
        for unclosed in stack:
            self.closing[unclosed] = -1

    def inside(self, opening: int) -> str:
        """What stands between the parenthesis at `opening` and the one that balances it; empty if none does."""
        if opening not in self.closing:
            self._read(opening)
        return self.text[opening + 1 : max(self.closing[opening], opening + 1)]


def call_text(text: str, opening: int) -> str:
    return Calls(text).inside(opening)


def argument(call: str, number: int) -> str:
    """The call's argument of that number, trimmed; empty if there are fewer."""
    depth, at, start, seen = 0, 0, 0, 0
    while m := _BRACKET.search(call, at):
        c, at = m.group(), m.end()
        if c in "\"'`":
            end = _string_end(call, m.start())
            at = len(call) if end < 0 else end + 1
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif not depth:
            if seen == number:
                return call[start : m.start()].strip()
            seen, start = seen + 1, m.end()
    return call[start:].strip() if seen == number else ""


def literal(text: str) -> str:
    """The value of a quoted literal at the text's start, else empty."""
    text = text.strip()
    if len(text) < 2 or text[0] not in "\"'`":
        return ""
    if text[-1] == text[0]:
        return text[1:-1]
    end = text.find(text[0], 1)
    return text[1:end] if end >= 0 else ""


# Options of call objects.
_VERBS = "GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS"
_METHOD = re.compile(rf"""method\s*:\s*["'`]({_VERBS})["'`]""", re.I | re.A)
_TYPE = re.compile(r"""(?:^|[,{\s])type\s*:\s*["'`](GET|POST|PUT|DELETE|PATCH)["'`]""", re.I | re.A)
_BODY = re.compile(r"body\s*:\s*(?:JSON\.stringify\s*\()?\s*\{([^}]*)\}", re.I | re.A)
_KEY = re.compile(r"""["'`]?(\w+)["'`]?\s*:""", re.A)
_URL = re.compile(r"""(?:^|[,{\s])url\s*:\s*["'`]([^"'`\n]+)["'`]""", re.I | re.A)
_FETCH = re.compile(r"\bfetch\s*\(", re.A)
_AXIOS_VERB = re.compile(r"\baxios\s*\.\s*(get|post|put|delete|patch|head|options)\s*\(", re.A)
_AXIOS_CONFIG = re.compile(r"\baxios(?:\s*\.\s*request)?\s*\(\s*\{", re.A)
_JQUERY_CONFIG = re.compile(r"(?:\$|jQuery)\s*\.\s*ajax\s*\(\s*\{", re.A)
_POST_MESSAGE = re.compile(r"\.postMessage\s*\(", re.A)


def _first(pattern: re.Pattern, text: str) -> str:
    m = pattern.search(text)
    return m.group(1) if m else ""


def fetch_calls(text: str) -> Iterator[Found]:
    calls = Calls(text)
    for m in _FETCH.finditer(text):
        call = calls.inside(m.end() - 1)
        url = literal(argument(call, 0))
        if "/" in url:
            options = argument(call, 1)
            body = _KEY.findall(_first(_BODY, options))
            yield url, m.start(), {"method": _first(_METHOD, options).upper(), "query": names_in_query(url), "body": body}


def axios_calls(text: str) -> Iterator[Found]:
    calls = Calls(text)
    for m in _AXIOS_VERB.finditer(text):
        url = literal(argument(calls.inside(m.end() - 1), 0))
        if "/" in url:
            yield url, m.start(), {"method": m.group(1).upper(), "query": names_in_query(url)}
    yield from _configured(calls, _AXIOS_CONFIG, lambda call: _first(_METHOD, call))


def jquery_configs(text: str) -> Iterator[Found]:
    yield from _configured(Calls(text), _JQUERY_CONFIG, lambda call: _first(_METHOD, call) or _first(_TYPE, call))


def _configured(calls: Calls, pattern: re.Pattern, method: Callable[[str], str]) -> Iterator[Found]:
    for m in pattern.finditer(calls.text):
        call = calls.inside(calls.text.index("(", m.start()))
        url = _first(_URL, call)
        if "/" in url:
            yield url, m.start(), {"method": method(call).upper(), "query": names_in_query(url)}


def message_origins(text: str) -> Iterator[Found]:
    calls = Calls(text)
    for m in _POST_MESSAGE.finditer(text):
        origin = literal(argument(calls.inside(m.end() - 1), 1))
        if "/" in origin:
            yield origin, m.start(), {}


# ---- encoded text -----------------------------------------------------------------------


def code_point(n: int) -> str:
    """The character of a number; numbers that are none give the replacement character."""
    return chr(n) if 0 <= n <= 0x10FFFF and not 0xD800 <= n <= 0xDFFF else "�"


_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")


def percent(text: str) -> str:
    """Percent escapes as bytes; `+` and malformed escapes stay."""
    return _PERCENT.sub(lambda m: bytes.fromhex(m.group().replace("%", "")).decode("utf-8", "replace"), text)


def unicode_escapes(text: str) -> str:
    return re.sub(r"\\u([0-9A-Fa-f]{4})", lambda m: code_point(int(m.group(1), 16)), text)


def hex_escapes(text: str) -> str:
    return re.sub(r"\\x([0-9A-Fa-f]{2})", lambda m: code_point(int(m.group(1), 16)), text)


def entities(text: str) -> str:
    return html.unescape(text)


def every_encoding(text: str) -> str:
    for step in (percent, unicode_escapes, hex_escapes, entities):
        text = step(text)
    return percent(text) if "%" in text else text


# Runs of escapes.
_ENCODED = r"(?i)((?:https?(?:%3A|:)(?:%2F|/){2}|%2F)[^\t\n\f\r \"'`<>]*%[0-9A-Fa-f][0-9A-Fa-f][^\t\n\f\r \"'`<>]*)"
_RUNS = (
    ("\\u00", r"(?:\\u[0-9A-Fa-f]{4}){3,}", unicode_escapes),
    ("\\x2", r"(?:\\x[0-9A-Fa-f]{2}){3,}", hex_escapes),
    ("&#", r"(?:&#x?[0-9A-Fa-f]+;){3,}", entities),
)
_MIXED = r"[\"'`]([^\"'`]*(?:%2[Ff]|\\u002[Ff]|\\x2[Ff]|&#(?:x2[Ff]|47);)[^\"'`]*)[\"'`]"
_PERCENT_MARKS = ("%2F", "%2f", "%3A", "%3a")
_ENCODED_MARKS = (*_PERCENT_MARKS, "\\u00", "\\x2", "&#")


def _size(text: str) -> int:
    return len(text.encode("utf-8", "replace"))


def _encoded(texts: Texts) -> Iterator[Hit]:
    cap = 2 * MIB
    for doc, line, (_, run) in texts.matches(_ENCODED, (1,), texts.having(_PERCENT_MARKS, cap)):
        if url := clean(percent(percent(run))):
            yield hit(doc, url, line, "medium", "encoded_urls")
    for marker, pattern, decode in _RUNS:
        for doc, line, (run,) in texts.matches(pattern, (), texts.having((marker,), cap)):
            plain = decode(run)
            url = clean(plain)
            if ("/" in plain or "." in plain) and _size(url) >= 3:
                yield hit(doc, url, line, "medium", "encoded_urls")
    mixed = ((doc, clean(every_encoding(run)), line) for doc, line, (_, run) in texts.matches(_MIXED, (1,), texts.having(_ENCODED_MARKS, cap)))
    yield from first_of_each(hit(*m, "medium", "encoded_urls") for m in mixed if _size(m[1]) >= 3)


ENCODED = Technique("encoded_urls", _encoded, _ENCODED_MARKS)


def printable(raw: bytes) -> bool:
    """At most a tenth of the bytes are control bytes other than tab and line ends."""
    odd = sum(b < 0x20 and b not in b"\n\r\t" for b in raw)
    return bool(raw) and odd * 10 <= len(raw)


def from_base64(text: str) -> str | None:
    """The text of standard or URL-safe Base64, padded or not, if printable."""
    text = text.replace("\n", "").replace("\r", "")
    if "-" in text or "_" in text:
        if "+" in text or "/" in text:
            return None
        text = text.replace("-", "+").replace("_", "/")
    bare = text.rstrip("=")
    padded = bare != text
    if padded and len(text) % 4 or "=" in bare or len(bare) % 4 == 1 or len(text) - len(bare) > 2:
        return None
    try:
        raw = base64.b64decode(bare + "=" * (-len(bare) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None
    return raw.decode("utf-8", "replace") if printable(raw) else None


_ABSOLUTE = re.compile(U.DECODED_ABSOLUTE)
_PATH = re.compile(U.DECODED_PATH)
_HOST = re.compile(r"[a-zA-Z0-9][a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}(?:/|\Z)")


def urls_in(text: str) -> list[str]:
    found = [u.rstrip(U.TEXT_TRAILING) for u in _ABSOLUTE.findall(text)] + [p for p in _PATH.findall(text) if len(p) > 2]
    return list(dict.fromkeys(found))


def url_like(text: str) -> bool:
    if len(text.encode("utf-8", "replace")) < 2:
        return False
    return text.startswith(("http://", "https://", "ftp://", "ws://", "wss://", "//")) or (text[0] == "/" and text[1] != "/") or bool(_HOST.match(text))


# Obfuscated text.
_BASE64 = r"[\"']([A-Za-z0-9+/=_\-]{20,})[\"']"
_HEX_RUN = r"(?:\\x[0-9a-fA-F]{2}){4,}"
_UNICODE_RUN = r"(?:\\u[0-9a-fA-F]{4}){4,}"
_ARRAY = r"(?:var|let|const)[\t\n\f\r ]+[a-zA-Z_$][a-zA-Z0-9_$]*[\t\n\f\r ]*=[\t\n\f\r ]*\[([^\]]{10,})\]"
_QUOTED = re.compile(r"""["']([^"']+)["']""")
_CHAR_CODES = r"String\.fromCharCode\(([0-9,\t\n\f\r ]+)\)"
_ATOB = r"atob\([\"']([A-Za-z0-9+/=_\-]+)[\"']\)"
_REVERSED = r"[\"']([^\"']+)[\"']\.split\([\"'][\"']\)\.reverse\(\)\.join\([\"'][\"']\)"
_SPLIT_JOIN = r"[\"']([^\"']+)[\"']\.split\([\"']([^\"']*)[\"']\)\.join\([\"']([^\"']*)[\"']\)"


def _printable_text(text: str) -> str | None:
    return text if printable(text.encode("utf-8", "replace")) else None


def _char_codes(codes: str) -> str | None:
    numbers = [int(n) for n in codes.split(",") if n.strip()] if not re.search(r"\d\s+\d", codes) else [-1]
    return "".join(map(code_point, numbers)) if all(0 <= n <= 0x10FFFF for n in numbers) else None


def _hex_text(run: str) -> str | None:
    raw = bytes.fromhex(run.replace("\\x", ""))
    return raw.decode("utf-8", "replace") if printable(raw) else None


def _hidden(name: str, gate: tuple[str, ...], steps: tuple, confidence: str = "low", cap: int | None = None, itself: bool = False) -> Technique:
    """URLs in what a pattern's matches decode to: (pattern, groups, decoder of whole and groups to texts).

    itself: a decoded text that looks like one URL is one, too.
    """

    def find(texts: Texts) -> Iterator[Hit]:
        for pattern, groups, decode in steps:
            for doc, line, found in texts.matches(pattern, groups, texts.having(gate, cap)):
                for plain in decode(*found):
                    if plain is not None:
                        for url in (*urls_in(plain), *([plain] if itself and url_like(plain) else ())):
                            yield hit(doc, url, line, confidence, name)

    return Technique(name, lambda texts: first_of_each(find(texts)), gate)


HIDDEN = {
    60: _hidden("base64_decode", (), ((_BASE64, (1,), lambda _, code: (from_base64(code),)),), cap=5 * MIB - 1),
    61: _hidden("hex_decode", ("\\x",), ((_HEX_RUN, (), lambda run: (_hex_text(run),)),)),
    62: _hidden("unicode_decode", ("\\u",), ((_UNICODE_RUN, (), lambda run: (_printable_text(unicode_escapes(run)),)),)),
    63: _hidden("array_obfuscation", ("var", "let", "const"), ((_ARRAY, (1,), lambda _, body: _QUOTED.findall(body)),), cap=2 * MIB - 1, itself=True),
    64: _hidden("fromcharcode", ("fromCharCode",), ((_CHAR_CODES, (1,), lambda _, codes: (_char_codes(codes),)),)),
    65: _hidden("atob_calls", ("atob",), ((_ATOB, (1,), lambda _, code: (from_base64(code),)),), "medium", itself=True),
    66: _hidden(
        "reverse_split_join", (".reverse()", ".split("),
        ((_REVERSED, (1,), lambda _, text: (text[::-1],)), (_SPLIT_JOIN, (1, 2, 3), lambda _, text, old, new: (text.replace(old, new),))), itself=True,
    ),
}
