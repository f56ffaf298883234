"""Layer 6: techniques 54-59, URLs in comments."""

from __future__ import annotations

import re
from collections.abc import Iterator

from weblode.functions import urls as U
from weblode.functions.scan import Hit, Rule, Technique, Texts, first_of_each, in_texts, scan_all

# The patterns of the detection rules.
LINE_COMMENT = r"(?m)(?:^|[^:])//(.*)$"
BLOCK_COMMENT = r"(?s)/\*(.+?)\*/"
HTML_COMMENT = r"(?s)<!--(.+?)-->"
DOC_LINKS = (
    Rule(r"\{@link[\t\n\f\r ]+([^\t\n\f\r \}]+)\}", confidence="low", gate=("@link",)),
    Rule(r"@link[\t\n\f\r ]+(https?://[^\t\n\f\r \}]+)", confidence="low", gate=("@link",)),
    Rule(r"@see[\t\n\f\r ]+(https?://[^\t\n\f\r ]+)", confidence="low", gate=("@see",)),
)
EXAMPLE = r"(?m)@example[\t\n\f\r ]+(.*)$"
ANNOTATION = r"(?im)//[\t\n\f\r ]*(?:API|endpoint|url|route|server|host|base|TODO)[:\t\n\f\r ]+(.+)$"
ANY_LINE = r"(?m)//[\t\n\f\r ]*(.+)$"
CODE = re.compile(r"[=(;]")


def text_urls(texts: Texts) -> list[list[str]]:
    """As `urls.text_urls`, for every text of a batch."""
    found: list[dict[str, None]] = [{} for _ in range(len(texts))]
    for pattern, group in ((U.TEXT_ABSOLUTE, 0), (U.TEXT_PROTOCOL_RELATIVE, 0), (U.TEXT_PATH, 1), (U.TEXT_DOMAIN, 0)):
        for i, _, groups in texts.matches(pattern, (group,)):
            url = groups[1] if group else groups[0].rstrip(U.TEXT_TRAILING)
            if not group or len(url) > 2:
                found[i].setdefault(url)
    return [list(f) for f in found]


def _texts(texts: Texts, pattern: str, gate: tuple[str, ...]) -> list[tuple[int, int, str]]:
    return [(doc, line, text) for doc, line, (_, text) in texts.matches(pattern, (1,), texts.having(gate))]


def _comments(name: str, pattern: str, gate: tuple[str, ...]) -> Technique:
    return Technique(name, lambda texts: first_of_each(in_texts(texts, _texts(texts, pattern, gate), text_urls, "low", name)), gate)


def _docs(texts: Texts) -> Iterator[Hit]:
    yield from scan_all(texts, DOC_LINKS, "jsdoc_tags")
    yield from in_texts(texts, _texts(texts, EXAMPLE, ("@example",)), text_urls, "low", "jsdoc_tags")


def _code(texts: Texts) -> Iterator[Hit]:
    """Comments that look like code: whole line comments, and single lines of block comments."""
    lines = _texts(texts, ANY_LINE, ("//",))
    blocks = [(doc, line, part.strip().lstrip("* ")) for doc, line, block in _texts(texts, BLOCK_COMMENT, ("*/",)) for part in block.split("\n")]
    for found in (lines, blocks):
        yield from in_texts(texts, [f for f in found if CODE.search(f[2])], text_urls, "low", "commented_code")


TECHNIQUES = {
    54: _comments("single_line_comments", LINE_COMMENT, ("//",)),
    55: _comments("multi_line_comments", BLOCK_COMMENT, ("*/",)),
    56: _comments("html_comments", HTML_COMMENT, ("-->",)),
    57: Technique("jsdoc_tags", lambda texts: first_of_each(_docs(texts)), ("@link", "@see", "@example")),
    58: _comments("dev_annotations", ANNOTATION, ("//",)),
    59: Technique("commented_code", lambda texts: first_of_each(_code(texts)), ("//", "*/")),
}
