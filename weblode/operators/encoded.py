"""Layer 7: techniques 60-67, URLs recovered from encoded or assembled text."""

from __future__ import annotations

import re
from collections.abc import Iterator

from weblode.functions import decode
from weblode.functions.scan import Hit, Rule, Technique, Texts, first_of_each, hit, scan

# The patterns of the detection rules.
_W = r"[\t\n\f\r ]*"
URL_PAIR = rf"new[\t\n\f\r ]+URL\({_W}[\"']([^\"']+)[\"']{_W},{_W}[\"']([^\"']+)[\"']{_W}\)"
URL_ONE = Rule(rf"new[\t\n\f\r ]+URL\({_W}[\"'](https?://[^\"']+)[\"']{_W}\)", confidence="high", gate=("new URL(",))


_ORIGIN = re.compile(r".*?://[^/]*")


def resolve(base: str, path: str) -> str:
    """The path against its base: absolute ones stay, rooted ones take the origin, others are appended."""
    if path.startswith(("http://", "https://")):
        return path
    base = base.rstrip("/")
    if path.startswith("/"):
        origin = _ORIGIN.match(base)
        return (origin.group() if origin else base) + path
    return f"{base}/{path}"


def _constructed(texts: Texts) -> Iterator[Hit]:
    for doc, line, (_, path, base) in texts.matches(URL_PAIR, (1, 2), texts.having(URL_ONE.gate)):
        yield hit(doc, resolve(base, path), line, "high", "url_constructor")
    yield from scan(texts, URL_ONE, "url_constructor")


TECHNIQUES = decode.HIDDEN | {67: Technique("url_constructor", lambda texts: first_of_each(_constructed(texts)), URL_ONE.gate)}
