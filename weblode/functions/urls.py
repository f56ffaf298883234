"""URL expressions: category, validity, trimming, parameters, and URLs inside free text.

What runs over whole columns is a Catalyst expression, which stays below the dedup's shuffle and
can be pushed; `functions.sql` publishes some of them to SQL. The scans, which run in Arrow
batches, use the plain functions at the end, for one string each.
"""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column, functions as F

# Category names, file name of each, and the words that decide them.
CATEGORY_FILES = {
    "api_endpoint": "api_endpoints.txt",
    "page_route": "page_routes.txt",
    "static_asset": "static_assets.txt",
    "external_service": "external_services.txt",
    "internal_infra": "internal_infra.txt",
    "websocket": "websockets.txt",
    "source_map": "source_maps.txt",
    "cloud_resource": "cloud_resources.txt",
    "inferred": "inferred_endpoints.txt",
    "data_uri": "data_uris.txt",
    "mailto": "emails.txt",
    "custom_protocol": "custom_protocols.txt",
}
APP_SCHEMES = ("android-app://", "ios-app://", "intent://", "deeplink://")
CLOUD_MARKS = ("s3.amazonaws.com", "s3-", "cloudfront.net", "blob.core.windows.net", "storage.googleapis.com", "firebasestorage.googleapis.com")
INTERNAL_MARKS = (
    ".internal", ".local", ".staging", ".dev", ".test", "localhost", "127.0.0.1", "10.",
    *(f"172.{n}." for n in range(16, 32)), "192.168.",
)
STATIC_EXTENSIONS = (
    "js", "mjs", "css", "png", "jpg", "jpeg", "gif", "svg", "ico", "woff", "woff2", "ttf", "eot", "otf", "mp4", "webm", "mp3", "ogg", "pdf",
    "map", "webp", "avif",
)
API_PATTERN = r"(?i)(?:/api/|/graphql|/rest/|/rpc/|/v\d+/)"
MIME_FAMILIES = ("application", "text", "image", "audio", "video", "font", "multipart", "message", "model", "chemical")
ENCODED_HEADS = ("2F", "252F", "25252F", "3A", "253A")
CODE_HEADS = (
    "String.fromCharCode", "function(", "function ", "var ", "let ", "const ", "return ", "typeof ", "undefined", "null", "true", "false",
    "NaN", "Infinity", "Object.", "Array.", "Math.", "Date.", "RegExp(", "JSON.", "Promise.", "Symbol(", "Error(",
)
BARE_MARKS = ("*", ".", "..", "#", "?", ":", "//", "//:")
COMMON_TOKENS = ("true/false", "yes/no", "on/off", "0/0", "n/a", "N/A")
KNOWN_HEADS = (
    "http://", "https://", "ftp://", "ws://", "wss://", "//", "data:", "blob:", "javascript:", "mailto:", *APP_SCHEMES,
    "/", "./", "../", "#/", "graphql:", "process.env.", "import.meta.env.",
)
UNUSABLE = ("", "#", "?", "javascript:void(0)", "javascript:;", "about:blank", "about:srcdoc")
DYNAMIC = "{{DYNAMIC}}"
TRAILING = ".,;:!?)]}>'\"`"
TEXT_TRAILING = ".,;:!?)"


def any_of(tests) -> Column:
    return functools.reduce(operator.or_, tests)


def contains_any(text: Column, marks) -> Column:
    return any_of(text.contains(m) for m in marks)


def starts_any(text: Column, heads) -> Column:
    return any_of(text.startswith(h) for h in heads)


def categorize_url(url: Column) -> Column:
    """The category of a URL; the first rule that holds decides."""
    return (
        F.when((F.octet_length(url) >= 4) & starts_any(url, ("ws:", "wss:")), "websocket")
        .when(url.endswith(".map") & (F.octet_length(url) > 4), "source_map")
        .when(url.startswith("data:"), "data_uri")
        .when(url.startswith("mailto:"), "mailto")
        .when(starts_any(url, APP_SCHEMES), "custom_protocol")
        .when(contains_any(url, CLOUD_MARKS), "cloud_resource")
        .when(contains_any(url, INTERNAL_MARKS), "internal_infra")
        .when(url.rlike(API_PATTERN), "api_endpoint")
        .when(url.rlike(r"(?s).\.(?:" + "|".join(STATIC_EXTENSIONS) + r")\z"), "static_asset")
        .when((F.octet_length(url) >= 8) & starts_any(url, ("http://", "https://")), "external_service")
        .otherwise("page_route")
    )


def is_valid_url(url: Column) -> Column:
    """Whether a found string is worth keeping: thirteen rules, all on the string alone."""
    size, data = F.octet_length(url), url.startswith("data:")
    rejects = [
        (size < 2) | ((size > 2048) & ~data),
        ~data & url.rlike(r"[ \t\n\r]"),
        url.rlike(r"[\x00-\x1f\x7f]"),
        url.isin(*BARE_MARKS),
        url.rlike("(?i)^(?:" + "|".join(MIME_FAMILIES) + ")/") & ~url.contains("//") & ~url.contains("?"),
        url.rlike(r"^[0-9.]+\z"),
        (size >= 3) & starts_any(url, ENCODED_HEADS),
        starts_any(url, CODE_HEADS),
        url.contains(DYNAMIC) & (url.contains("//") | url.contains(";") | (size > 100)),
        url.contains("\\x") | url.contains("\\u"),
        url == "/",
        url.isin(*COMMON_TOKENS),
        ~(starts_any(url, KNOWN_HEADS) | (url.contains(".") & url.rlike(r"^[\p{L}\p{Nd}]"))),
    ]
    return F.coalesce(~any_of(rejects), F.lit(False))


def usable(url: Column) -> Column:
    """Whether an attribute's or value's text can be a URL at all."""
    return ~url.isin(*UNUSABLE)


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def clean_url(url: Column) -> Column:
    """Without trailing punctuation; a closing parenthesis stays while the opening ones are at least as many."""
    run = F.regexp_extract(url, r"[.,;:!?)\]}>'\"`]+\z", 0)

    def shorter(text: Column, _: Column) -> Column:
        balanced = text.endswith(")") & (_count(text, "(") >= _count(text, ")"))
        return F.when(balanced, text).otherwise(F.substring(text, F.lit(1), F.length(text) - 1))

    stripped = F.aggregate(F.sequence(F.lit(1), F.length(run)), url, shorter)
    return F.rtrim(F.when(run == "", url).otherwise(stripped), F.lit(" \t\n\r"))


def query_params(url: Column) -> Column:
    """Names in the query part, in order and with repeats."""
    query = F.substring_index(F.substring(url, F.instr(url, "?") + 1, F.length(url)), "#", 1)
    names = F.transform(F.split(query, "&"), lambda pair: F.trim(F.substring_index(pair, "=", 1), F.lit(" \t\n\r\f\x0b")))
    return F.when(url.contains("?"), F.filter(names, lambda n: n != "")).otherwise(F.array().cast("array<string>"))


# What counts as a URL inside a comment, and inside decoded text.
TEXT_ABSOLUTE = r"(?i)(?:https?|ftp|wss?)://[^\t\n\f\r \"'<>\)`\]\}]+"
TEXT_PROTOCOL_RELATIVE = r"//[a-zA-Z0-9][a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}[^\t\n\f\r \"'<>\)`]*"
TEXT_PATH = r"(?:^|[\t\n\f\r \"'=\(])(/[a-zA-Z0-9_\-][a-zA-Z0-9_\-./]*[a-zA-Z0-9_\-])"
TEXT_DOMAIN = r"(?i)[a-z0-9][a-z0-9\-]*\.[a-z0-9][a-z0-9\-]*\.[a-z]{2,63}(?:/[^\t\n\f\r \"'<>]*)?"
DECODED_ABSOLUTE = r"(?i)(?:https?|ftp|wss?)://[^\t\n\f\r \"'<>`]+"
DECODED_PATH = r"(?:^|[\t\n\f\r \"'=])(/[a-zA-Z0-9_\-][a-zA-Z0-9_\-./]*[a-zA-Z0-9_\-])"


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _trimmed(found: Column) -> Column:
    return F.transform(found, lambda u: F.rtrim(u, F.lit(TEXT_TRAILING)))


def _long(found: Column) -> Column:
    return F.filter(found, lambda u: F.length(u) > 2)


def text_urls(text: Column) -> Column:
    """Distinct URLs, paths and host names in a comment's text."""
    parts = (
        _trimmed(_all(text, TEXT_ABSOLUTE, 0)),
        _trimmed(_all(text, TEXT_PROTOCOL_RELATIVE, 0)),
        _long(_all(text, TEXT_PATH, 1)),
        _trimmed(_all(text, TEXT_DOMAIN, 0)),
    )
    return F.array_distinct(F.concat(*parts))


# ---- the same for one string ------------------------------------------------------------


def clean(url: str) -> str:
    """As `clean_url`."""
    opened, closed, end = url.count("("), url.count(")"), len(url)
    while end and url[end - 1] in TRAILING:
        if url[end - 1] == ")":
            if opened >= closed:
                break
            closed -= 1
        end -= 1
    return url[:end].rstrip(" \t\n\r")


def usable_text(url: str) -> bool:
    return url not in UNUSABLE


def names_in_query(url: str) -> list[str]:
    """As `query_params`."""
    if "?" not in url:
        return []
    query = url.split("?", 1)[1].split("#", 1)[0]
    return [n for pair in query.split("&") if (n := pair.split("=", 1)[0].strip())]


_NAME_BEFORE_EQUALS = re.compile(r"[?&]([a-zA-Z_][a-zA-Z0-9_\-.]*)=")


def names_before_equals(url: str) -> list[str]:
    """Distinct names before `=` after `?` or `&`, in order."""
    return list(dict.fromkeys(_NAME_BEFORE_EQUALS.findall(url)))


_API = re.compile(API_PATTERN, re.A)


def category_of(url: str) -> str:
    """As `categorize_url`."""
    size = len(url.encode("utf-8", "replace"))
    rules = (
        ("websocket", size >= 4 and url.startswith(("ws:", "wss:"))),
        ("source_map", size > 4 and url.endswith(".map")),
        ("data_uri", url.startswith("data:")),
        ("mailto", url.startswith("mailto:")),
        ("custom_protocol", url.startswith(APP_SCHEMES)),
        ("cloud_resource", any(m in url for m in CLOUD_MARKS)),
        ("internal_infra", any(m in url for m in INTERNAL_MARKS)),
        ("api_endpoint", bool(_API.search(url))),
        ("static_asset", any(url.endswith("." + e) and len(url) > len(e) + 1 for e in STATIC_EXTENSIONS)),
        ("external_service", size >= 8 and url.startswith(("http://", "https://"))),
    )
    return next((name for name, holds in rules if holds), "page_route")
