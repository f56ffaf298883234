"""DuckDB SQL made from the same rules that the Spark expressions are made from."""

from __future__ import annotations

from weblode.functions import urls as U
from weblode.functions.scan import Rule
from weblode.operators.hosts import JS_HEADS


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _any(test: str, marks) -> str:
    return "(" + " OR ".join(test.format(quoted(m)) for m in marks) + ")"


def category_sql(url: str) -> str:
    has, heads = f"contains({url}, {{}})", f"starts_with({url}, {{}})"
    return f"""(CASE WHEN strlen({url}) >= 4 AND {_any(heads, ("ws:", "wss:"))} THEN 'websocket'
        WHEN ends_with({url}, '.map') AND strlen({url}) > 4 THEN 'source_map'
        WHEN starts_with({url}, 'data:') THEN 'data_uri' WHEN starts_with({url}, 'mailto:') THEN 'mailto'
        WHEN {_any(heads, U.APP_SCHEMES)} THEN 'custom_protocol' WHEN {_any(has, U.CLOUD_MARKS)} THEN 'cloud_resource'
        WHEN {_any(has, U.INTERNAL_MARKS)} THEN 'internal_infra' WHEN regexp_matches({url}, {quoted(U.API_PATTERN)}) THEN 'api_endpoint'
        WHEN {" OR ".join(f"(ends_with({url}, '.{e}') AND strlen({url}) > {len(e) + 1})" for e in U.STATIC_EXTENSIONS)} THEN 'static_asset'
        WHEN strlen({url}) >= 8 AND {_any(heads, ("http://", "https://"))} THEN 'external_service' ELSE 'page_route' END)"""


def valid_sql(url: str) -> str:
    heads = f"starts_with({url}, {{}})"
    rejects = [
        f"strlen({url}) < 2 OR (strlen({url}) > 2048 AND NOT starts_with({url}, 'data:'))",
        f"NOT starts_with({url}, 'data:') AND regexp_matches({url}, '[ \\t\\n\\r]')",
        f"regexp_matches({url}, '[\\x00-\\x1f\\x7f]')",
        f"{url} IN ({', '.join(map(quoted, (*U.BARE_MARKS, '/', *U.COMMON_TOKENS)))})",
        f"regexp_matches({url}, '(?i)^(?:{'|'.join(U.MIME_FAMILIES)})/') AND NOT contains({url}, '//') AND NOT contains({url}, '?')",
        f"regexp_full_match({url}, '[0-9.]+')",
        f"strlen({url}) >= 3 AND {_any(heads, U.ENCODED_HEADS)}",
        _any(heads, U.CODE_HEADS),
        f"contains({url}, '{U.DYNAMIC}') AND (contains({url}, '//') OR contains({url}, ';') OR strlen({url}) > 100)",
        f"contains({url}, '\\x') OR contains({url}, '\\u')",
        f"NOT ({_any(heads, U.KNOWN_HEADS)} OR (contains({url}, '.') AND regexp_matches({url}, '^[\\pL\\p{{Nd}}]')))",
    ]
    return "coalesce(NOT (" + " OR ".join(f"({r})" for r in rejects) + "), false)"


def scan_sql(doc: str, pattern: str, groups: tuple[int, ...]) -> str:
    """(doc_id, content, i, line, g0, g...) of every match; lines by the texts between matches."""
    p = quoted(pattern)
    breaks = "coalesce(list_sum(list_transform({}, lambda s: length(s) - length(replace(s, chr(10), '')))), 0)"
    columns = ", ".join(f"regexp_extract_all(content, {p}, {g}) AS a{g}" for g in dict.fromkeys((0, *groups)))
    picked = ", ".join(f"a{g}[i] AS g{g}" for g in dict.fromkeys((0, *groups)))
    return f"""SELECT doc_id, content, 0 AS o, i, 1 + {breaks.format("gaps[1:i]")} + {breaks.format("a0[1:i - 1]")} AS line, {picked}
        FROM (SELECT *, unnest(range(1, len(a0) + 1)) AS i FROM (SELECT doc_id, content, string_split_regex(content, {p}) AS gaps, {columns} FROM {doc}))"""


#: Conditions and changes that rules express as columns, by technique and rule number.
KEEP = {
    (1, 0): "url <> ''", (1, 1): "strlen(url) >= 5", (2, 0): "url NOT IN ('/', './', '../') AND NOT starts_with(url, '//')",
    (11, 2): "list_bool_and(list_transform(string_split(split_part(url, ':', 1), '.'), lambda n: CAST(n AS INTEGER) <= 255))",
    **{(14, i): "NOT (starts_with(url, '/^') OR ends_with(url, '$/') OR regexp_matches(url, '^(?:/[a-zA-Z]+|[a-zA-Z]+/[a-zA-Z0-9.+\\-]+|\\d{1,4}/\\d{1,2}/\\d{1,4}|\\d+/\\d+)$'))" for i in range(3)},
    **{(t, i): "contains(url, '/')" for t in (16, 19, 22, 23, 24, 25, 26) for i in range(2)},
    (48, 0): "length(url) - length(replace(url, '/', '')) >= 2", (50, 0): "length(url) - length(replace(url, '.', '')) >= 2",
    (50, 1): f"length(url) - length(replace(url, '.', '')) >= 2 AND NOT {_any('starts_with(lower(url), {})', JS_HEADS)}",
}
CHANGE = {
    (8, 0): "CASE WHEN strlen(raw) > 120 THEN substr(raw, 1, 120) || '...' ELSE raw END",
    **{(52, i): "regexp_replace(regexp_replace(raw, '^\"(.*)\"$', '\\1'), '^''(.*)''$', '\\1')" for i in range(4)},
}
CATEGORY = {
    (20, 1): "CASE WHEN {own} = 'page_route' THEN 'api_endpoint' ELSE {own} END",
    **{(37, i): "CASE WHEN starts_with(url, '/api/') THEN 'api_endpoint' ELSE 'page_route' END" for i in range(4)},
}
_ALL_NAMES = "regexp_extract_all(url, '[?&]([a-zA-Z_][a-zA-Z0-9_\\-.]*)=', 1)"
_NAMES = f"list_filter({_ALL_NAMES}, lambda n, i: list_position({_ALL_NAMES}, n) = i)"
_QUERY = "CASE WHEN contains(url, '?') THEN list_filter(list_transform(string_split(split_part(substr(url, instr(url, '?') + 1), '#', 1), '&'), lambda q: trim(split_part(q, '=', 1))), lambda q: q <> '') ELSE [] END"


def _rule_sql(rule: Rule, technique: int, number: int) -> str:
    groups = tuple(dict.fromkeys((rule.group, *([rule.method] if isinstance(rule.method, int) else []))))
    raw = f"g{rule.group}"
    raw = f"rtrim({raw}, '.,;:!?]}}>''\"`')" if rule.clean else raw
    url = CHANGE.get((technique, number), "raw")
    method = f"upper(g{rule.method})" if isinstance(rule.method, int) else quoted(rule.method)
    if technique == 38:
        method = f"CASE WHEN {method} = 'USE' THEN '' ELSE {method} END"
    params = {"": "''", "names": f"array_to_string({_NAMES}, ',')", "query": f"array_to_string({_QUERY}, ',')"}[rule.params]
    own = category_sql("url")
    category = CATEGORY.get((technique, number), own if rule.category is None or callable(rule.category) else quoted(rule.category)).replace("{own}", own)
    tests = [KEEP.get((technique, number), "true")]
    gates = []
    if rule.gate:
        gates.append(_any("contains(content, {})", rule.gate))
    if technique == 24:
        gates.append("contains(content, '.open(')")
    if technique == 48 and number == 0:
        gates.append("contains(content, '\"paths\"')")
    line = f"line + length(split_part(g0, g{rule.group}, 1)) - length(replace(split_part(g0, g{rule.group}, 1), chr(10), ''))" if rule.line_group else "line"
    source = f"(SELECT * FROM doc WHERE {' AND '.join(gates) or 'true'})"
    return f"""SELECT doc_id, {number} AS o, i, url, CAST(source_line AS INTEGER) AS source_line, http_method, coalesce({params}, '') AS params, {category} AS category, '{rule.confidence}' AS confidence
        FROM (SELECT *, {url} AS url FROM (SELECT doc_id, i, {line} AS source_line, {raw} AS raw, {method} AS http_method FROM ({scan_sql(source, rule.pattern, groups)}))) WHERE {" AND ".join(tests)}"""


def hits_sql(docs: str, rules: tuple[Rule, ...], technique: int, once: bool) -> str:
    """All hits of a technique's rules; with `once` the first of each URL in a document."""
    every = " UNION ALL ".join(_rule_sql(r, technique, i) for i, r in enumerate(rules))
    key = "lower(url)" if technique == 50 else "url"
    only = f"QUALIFY row_number() OVER (PARTITION BY doc_id, {key} ORDER BY o, i) = 1" if once or technique == 50 else ""
    return f"WITH doc AS ({docs}), found AS ({every}) SELECT doc_id, url, source_line, http_method, params, category, confidence FROM found {only}"
