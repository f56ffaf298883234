"""Pattern scans over batches of contents: every match of a pattern with its groups and line.

A scan runs a pattern over all contents of an Arrow batch at once, in the linear-time engine that
Arrow brings along (the dialect that detection rules are published in), and reads the matches off
the marked-up copy it returns: text between matches, match, groups. Each content is walked once
for a rule, lines are counted along the way, so the cost grows with text plus matches. One Arrow
UDF runs all wanted techniques over a content; markers are tested before it, natively.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from weblode.functions import urls as U

MIB = 1 << 20
#: Most bytes of contents that one scan marks up at once; a longer content is scanned alone.
SLICE_BYTES = 8 * MIB
_FIELDS = ("url", "source_line", "http_method", "query_params", "body_params", "category", "confidence", "detection_method")
_STRINGS = ArrayType(StringType())
_HIT_FIELDS = [StructField(n, IntegerType() if n == "source_line" else _STRINGS if n.endswith("params") else StringType()) for n in _FIELDS]
HIT_TYPE = ArrayType(StructType(_HIT_FIELDS))
_ARROW = {"source_line": pa.int32(), "technique_id": pa.int32(), "stage": pa.int32()} | {n: pa.list_(pa.string()) for n in ("query_params", "body_params")}
#: (document, url, line, method, query names, body names, category, confidence, detection)
Hit = tuple[int, str, int, str, list, list, "str | None", str, str]


@dataclass(frozen=True)
class Rule:
    """One pattern of a technique.

    gate: literals of which one must occur; cap: most content bytes; line_group: the line is
    where the group begins, not the match; change, keep: what becomes of the URL, and whether it
    stays; category: None for the URL's own; method: group number, or a fixed word; params:
    which names to read.
    """

    pattern: str
    group: int = 1
    confidence: str = "medium"
    category: str | Callable[[str], str] | None = None
    gate: tuple[str, ...] = ()
    cap: int | None = None
    clean: bool = False
    line_group: bool = False
    keep: Callable[[str], bool] | None = None
    change: Callable[[str], str] | None = None
    method: int | str = ""
    params: str = ""


class Lines:
    """Line numbers of offsets: one pass over the text, then binary search."""

    def __init__(self, text: str):
        self.breaks = [m.start() for m in re.finditer("\n", text)]

    def __call__(self, offset: int) -> int:
        return bisect.bisect_left(self.breaks, offset) + 1


class Texts:
    """Contents of a batch, and scans over them; null contents are empty ones."""

    def __init__(self, contents: pa.Array):
        self.contents = pc.fill_null(contents.cast(pa.large_string()), "")
        self.sizes = pc.binary_length(self.contents).to_numpy(zero_copy_only=False)
        self._with: dict[str, np.ndarray] = {}
        self._text: dict[int, str] = {}

    def __len__(self) -> int:
        return len(self.contents)

    def text(self, i: int) -> str:
        if i not in self._text:
            self._text[i] = self.contents[i].as_py()
        return self._text[i]

    @cached_property
    def marks(self) -> tuple[str, str]:
        """Two characters that no content has: private ones, else any."""
        absent = (chr(c) for part in ((0xE000, 0xF900), (0xF0000, 0x10FFFE), (1, 0xD800)) for c in range(*part))
        free = (c for c in absent if not pc.any(pc.match_substring(self.contents, c)).as_py())
        return next(free), next(free)

    def having(self, marks: Iterable[str], cap: int | None = None) -> np.ndarray:
        """Documents with one of the literals (all, if there are none) and no more bytes than the cap."""
        marks = tuple(marks)
        for m in marks:
            if m not in self._with:
                self._with[m] = pc.match_substring(self.contents, m).to_numpy(zero_copy_only=False)
        found = np.logical_or.reduce([self._with[m] for m in marks]) if marks else self.sizes > 0
        return found & (self.sizes <= cap) if cap is not None else found

    def matches(self, pattern: str, groups: tuple[int, ...] = (), among: np.ndarray | None = None) -> Iterator[tuple[int, int, list[str]]]:
        """(document, line where the match begins, [whole, group, ...]) of all matches, documents and matches in order."""
        rows = np.flatnonzero(self.having(()) if among is None else among)
        if not len(rows):
            return
        part = self.contents if len(rows) == len(self) else self.contents.take(pa.array(rows))
        ends, cut = self.marks
        marked = pc.replace_substring_regex(part, pattern, ends + cut.join(f"\\{g}" for g in (0, *groups)) + ends)
        changed = np.flatnonzero(pc.binary_length(marked).to_numpy(zero_copy_only=False) != self.sizes[rows])
        for i, text in zip(rows[changed].tolist(), marked.take(pa.array(changed)).to_pylist(), strict=True):
            pieces, line = text.split(ends), 1
            for n in range(1, len(pieces), 2):
                line += pieces[n - 1].count("\n")
                found = pieces[n].split(cut)
                yield i, line, found
                line += found[0].count("\n")


def hit(doc: int, url: str, line: int, confidence: str, detection: str, category: str | None = None, method: str = "", query=(), body=()) -> Hit:
    """One hit; a null category means the URL's own, decided after the dedup."""
    return doc, url, line, method, query, body, category, confidence, detection


def scan(texts: Texts, rule: Rule, name: str) -> Iterator[Hit]:
    """All hits of one rule."""
    methodical = isinstance(rule.method, int)
    groups = (rule.group, *([rule.method] if methodical else []))
    names = {"names": U.names_before_equals, "query": U.names_in_query, "": lambda u: ()}[rule.params]
    kind = rule.category if callable(rule.category) else lambda u: rule.category
    keep = rule.keep or (bool if rule.clean else lambda u: True)
    for doc, line, found in texts.matches(rule.pattern, groups, texts.having(rule.gate, rule.cap)):
        raw = found[1]
        if rule.line_group:
            line += found[0].count("\n", 0, found[0].find(raw))
        url = U.clean(raw) if rule.clean else raw
        url = rule.change(url) if rule.change else url
        if keep(url):
            yield doc, url, line, found[2].upper() if methodical else rule.method, names(url), (), kind(url), rule.confidence, name


def scan_all(texts: Texts, rules: Iterable[Rule], name: str) -> Iterator[Hit]:
    """The hits of several rules, in the rules' order."""
    for rule in rules:
        yield from scan(texts, rule, name)


def first_of_each(hits: Iterable[Hit], key: Callable[[str], str] = lambda u: u) -> Iterator[Hit]:
    """The first hit of every URL in its document."""
    seen = set()
    for h in hits:
        if (k := (h[0], key(h[1]))) not in seen:
            seen.add(k)
            yield h


def in_texts(texts: Texts, found: list[tuple[int, int, str]], read: Callable[[Texts], list[list[str]]], confidence: str, name: str) -> Iterator[Hit]:
    """Hits for what `read` finds in parts (document, line, text) of the contents, on the part's line."""
    if found:
        for (doc, line, _), urls in zip(found, read(Texts(pa.array([t for *_, t in found], pa.large_string()))), strict=True):
            for url in urls:
                yield hit(doc, url, line, confidence, name)


@dataclass(frozen=True)
class Technique:
    """What a technique finds in contents. gate: literals of which each content with a hit has one; none if empty."""

    name: str
    find: Callable[[Texts], Iterable[Hit]]
    gate: tuple[str, ...] = ()


def ruled(name: str, rules: tuple[Rule, ...], once: bool = False) -> Technique:
    """A technique that is a list of rules; with `once` each URL is reported once a document."""
    find = lambda texts: first_of_each(scan_all(texts, rules, name)) if once else scan_all(texts, rules, name)
    gate = tuple(dict.fromkeys(m for r in rules for m in r.gate)) if all(r.gate for r in rules) else ()
    return Technique(name, find, gate)


def arrow_hits(docs: int, hits: list[tuple], extra: tuple[str, ...] = ()) -> pa.ListArray:
    """Hits, in their order within each document, as one list of structs a document; `extra` names further fields at their end."""
    names = (*_FIELDS, *extra)
    owner = np.fromiter((h[0] for h in hits), np.int64, len(hits))
    order = np.argsort(owner, kind="stable")
    hits = [hits[i] for i in order.tolist()]
    columns = list(zip(*hits, strict=True))[1:] if hits else [()] * len(names)
    made = pa.StructArray.from_arrays([pa.array(c, _ARROW.get(n, pa.string())) for n, c in zip(names, columns, strict=True)], list(names))
    offsets = np.zeros(docs + 1, np.int32)
    np.cumsum(np.bincount(owner, minlength=docs), out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), made)


def slices(contents: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of contents whose bytes stay below the bound; a longer content is a run of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(contents), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start, before = 0, 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield start, stop - start
        start, before = stop, int(ends[stop - 1])


def sliced(contents: pa.Array, run: Callable[[pa.Array, slice], pa.Array], kind: pa.DataType) -> pa.Array:
    """`run` over bounded parts of a batch, put together again."""
    if isinstance(contents, pa.ChunkedArray):
        contents = contents.combine_chunks()
    parts = [run(contents.slice(a, n), slice(a, a + n)) for a, n in slices(contents)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def only_if(condition: Column, content: Column, udf: Callable[[Column], Column]) -> Column:
    """Hands the UDF only contents that pass; Spark evaluates a UDF for every row, so the others go in as null."""
    return udf(F.when(condition, content))


def column(techniques: dict[int, Technique]) -> Callable[[Column], Column]:
    """The hits of some techniques in a content, with their technique's number: array of structs."""

    def part(contents: pa.Array, _: slice) -> pa.Array:
        texts = Texts(contents)
        return arrow_hits(len(texts), [(*h, t) for t, technique in techniques.items() for h in technique.find(texts)], ("technique_id",))

    def run(contents: pa.Array) -> pa.Array:
        from pyspark.sql.pandas.types import to_arrow_type

        return sliced(contents, part, to_arrow_type(kind))

    kind = ArrayType(StructType([*_HIT_FIELDS, StructField("technique_id", IntegerType())]))
    gates = [t.gate for t in techniques.values()]
    marks = tuple(dict.fromkeys(m for g in gates for m in g)) if all(gates) else ()

    def hits(content: Column) -> Column:
        found, valid = F.arrow_udf(run, kind), F.make_valid_utf8(content)
        return only_if(U.contains_any(content, marks), valid, found) if marks else found(valid)

    return hits
