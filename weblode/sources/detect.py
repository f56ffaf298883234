"""What kind of file a document is: by name, then MIME type, then its first characters."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# File types by extension.
EXTENSIONS = {
    "js": "js", "mjs": "js", "ts": "ts", "tsx": "ts", "jsx": "jsx", "html": "html", "htm": "html", "json": "json", "xml": "xml", "svg": "svg",
    "css": "css", "map": "sourcemap", "vue": "vue", "svelte": "svelte",
}
SNIFF_BYTES = 512
BINARY_BYTES = 8000


def type_by_name(name: Column) -> Column:
    extension = F.lower(F.regexp_extract(name, r"\.([^./\\]*)\z", 1))
    kinds = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    return F.coalesce(F.try_element_at(kinds, extension), F.lit("unknown"))


def type_by_mime(mime: Column) -> Column:
    return (
        F.when(mime.contains("html"), "html")
        .when(mime.contains("javascript") | mime.contains("ecmascript"), "js")
        .when(mime.contains("json"), "json")
        .when(mime.contains("svg"), "svg")
        .when(mime.contains("xml"), "xml")
        .when(mime.contains("css"), "css")
        .otherwise("unknown")
    )


def type_by_sniffing(content: Column) -> Column:
    head = F.lower(F.trim(F.substring(content, 1, SNIFF_BYTES), F.lit(" \t\n\r\f\x0b")))
    return (
        F.when(head.startswith("<!doctype html") | head.startswith("<html"), "html")
        .when(head.startswith("{") | head.startswith("["), "json")
        .when(head.startswith("<?xml") | head.startswith("<svg"), "xml")
        .otherwise("unknown")
    )


def file_type(name: Column, mime: Column, content: Column) -> Column:
    """The first of name, MIME type and sniffing that knows."""
    by_name, by_mime = type_by_name(name), type_by_mime(mime)
    return F.when(by_name != "unknown", by_name).when(by_mime != "unknown", by_mime).otherwise(type_by_sniffing(content))


def is_binary(raw: Column) -> Column:
    """A zero byte among the first ones."""
    return F.contains(F.substring(raw, 1, BINARY_BYTES), F.lit(b"\x00"))
