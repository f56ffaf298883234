"""DuckDB SQL for the techniques that no pattern alone expresses: call arguments, decoders, nested scans.

Each reads the made documents' content with patterns and decoders of its own, not with the
operators' ones.
"""

from __future__ import annotations

from collections.abc import Callable

from weblode.plans.oracle import category_sql, quoted, scan_sql

_TRIM = "'.,;:!?)'"
_CLEAN = "'.,;:!?)]}>''\"`'"
_QUERY = (
    "CASE WHEN contains({0}, '?') THEN list_filter(list_transform(string_split(split_part(split_part({0}, '?', 2), '#', 1), '&'), lambda q: split_part(q, '=', 1)), lambda q: q <> '') ELSE [] END"
)
# One escape or one character at a time.
_TOKENS = r"\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|&#[0-9]+;|(?s:.)"
_UNESCAPED = """array_to_string(list_transform(regexp_extract_all({0}, %s), lambda t: CASE
    WHEN length(t) IN (4, 6) AND t[1] = '\\' THEN chr(CAST('0x' || substr(t, 3) AS INTEGER))
    WHEN length(t) > 2 AND starts_with(t, '&#') THEN chr(CAST(substr(t, 3, length(t) - 3) AS INTEGER)) ELSE t END), '')""" % quoted(_TOKENS)


def _unescaped(text: str) -> str:
    return _UNESCAPED.replace("{0}", text)


def names_sql(url: str) -> str:
    """Parameter names of a URL's query."""
    return _QUERY.format(url)


def found_urls_sql(text: str, itself: bool = False) -> str:
    """Distinct URLs and paths in decoded text; with `itself` also the text if it looks like one."""
    absolute = f"list_transform(regexp_extract_all({text}, '(?i)(?:https?|ftp|wss?)://[^\\s\"''<>`]+'), lambda u: rtrim(u, {_TRIM}))"
    paths = f"list_filter(regexp_extract_all({text}, '(?:^|[\\s\"''=])(/[\\w\\-][\\w\\-./]*[\\w\\-])', 1), lambda u: length(u) > 2)"
    own = f"CASE WHEN regexp_matches({text}, '^(?:(?:https?|ftp|wss?)://|//|/[^/]|[a-zA-Z0-9][a-zA-Z0-9.\\-]+\\.[a-zA-Z]{{2,}}(?:/|$))') THEN [{text}] ELSE [] END"
    both = f"list_concat({absolute}, {paths})"
    return f"list_distinct(list_concat({both}, {own}))" if itself else f"list_distinct({both})"


def special_sql(documents: Callable[[int], str], text_urls: Callable[[str], str]) -> dict[int, str]:
    """SQL by technique number."""

    def rows(technique: int, *parts: str, once: bool = False) -> str:
        """Parts select doc_id, u, line, method, params, confidence, category (null: the URL's own)."""
        every = " UNION ALL ".join(parts)
        first = f"SELECT doc_id, u, min(line) AS line, any_value(method) AS method, any_value(params) AS params, any_value(confidence) AS confidence, any_value(category) AS category FROM ({every}) GROUP BY doc_id, u"
        return f"""WITH doc AS ({documents(technique)})
            SELECT doc_id, u AS url, CAST(line AS INTEGER) AS source_line, method AS http_method, coalesce(array_to_string(params, ','), '') AS params,
                   coalesce(category, {category_sql("u")}) AS category, confidence
            FROM ({first if once else every})"""

    def part(pattern: str, url: str, confidence: str, method: str = "''", params: str = "[]", category: str = "NULL", where: str = "contains(u, '/')", groups: int = 1) -> str:
        found = scan_sql("doc", pattern, tuple(range(1, groups + 1)))
        return f"SELECT * FROM (SELECT doc_id, {url} AS u, line, {method} AS method, CAST({params} AS VARCHAR[]) AS params, '{confidence}' AS confidence, {category} AS category FROM ({found})) WHERE {where}"

    def each(pattern: str, urls: str, confidence: str = "low", category: str = "NULL", groups: int = 1) -> str:
        """A row for every URL in the list `urls`."""
        return part(pattern, f"unnest({urls})", confidence, category=category, where="true", groups=groups)

    literal, name = "(?:\"[^\"]*\"|'[^']*')", "[a-zA-Z_$][a-zA-Z0-9_$.]*"
    plus = r"\s*\+\s*"
    joined = "array_to_string(list_transform(list_filter(list_transform(string_split({0}, '+'), lambda p: trim(p)), lambda p: p <> ''), lambda p: CASE WHEN p[1] IN ('\"', '''') THEN p[2:-2] ELSE '{{{{DYNAMIC}}}}' END), '')"
    percent = "url_decode(url_decode({0}))"
    string = r"[\"']([^\"']+)[\"']"
    encoded = r"([A-Za-z0-9+/=_\-]+)"
    opened = r"\"([^\"]+)\""
    plain64 = "CASE WHEN length(g1) % 4 = 0 THEN decode(from_base64(g1)) END"
    chars = "array_to_string(list_transform(string_split(g1, ','), lambda n: chr(CAST(trim(n) AS INTEGER))), '')"
    mixed = f"rtrim({percent.format(_unescaped('url_decode(g1)'))}, {_CLEAN})"
    code = "list_filter({0}, lambda x: regexp_matches(x, '[=(;]'))"
    in_lines = lambda lines: f"flatten(list_transform({lines}, lambda x: {text_urls('x')}))"
    return {
        7: rows(
            7,
            part(f"{literal}(?:(?:{plus}{literal})+(?:(?:{plus}{name})+{plus}{literal})?|(?:{plus}{name})+{plus}{literal})", joined.format("g0"), "low"),
            part(rf"(?:^|[^a-zA-Z0-9_$.])({name}{plus}(?:{literal}\s*\+?\s*)+)", joined.format("g1"), "low"),
            once=True,
        ),
        12: rows(
            12,
            part(r"(?i)((?:https?(?:%3A|:)(?:%2F|/){2}|%2F)[^\s\"'`<>]*%[0-9A-F]{2}[^\s\"'`<>]*)", f"rtrim({percent.format('g1')}, {_CLEAN})", "medium"),
            *(part(p, f"rtrim({_unescaped('g0')}, {_CLEAN})", "medium", where="strlen(u) >= 3", groups=0) for p in (r"(?:\\u[0-9A-Fa-f]{4}){3,}", r"(?:\\x[0-9A-Fa-f]{2}){3,}", r"(?:&#[0-9]+;){3,}")),
            part(r"[\"'`]([^\"'`]*(?:%2[Ff]|\\u002[Ff]|\\x2[Ff]|&#47;)[^\"'`]*)[\"'`]", mixed, "medium", where="strlen(u) >= 3 QUALIFY row_number() OVER (PARTITION BY doc_id, u ORDER BY line) = 1"),
        ),
        15: rows(15, part(
            r"\bfetch\s*\([\"']([^\"']+)[\"'](?:, \{method: '([A-Z]+)', body: JSON\.stringify\(\{([^}]*)\}\)\})?\)", "g1", "high",
            "coalesce(g2, '')", f"list_concat({names_sql('g1')}, regexp_extract_all(coalesce(g3, ''), '(\\w+):', 1))", groups=3)),
        17: rows(
            17, part(r"\baxios\.(get|post)\('([^']+)'\)", "g2", "high", "upper(g1)", names_sql("g2"), groups=2),
            part(r"\baxios\(\{url: '([^']+)', method: '(\w+)'\}\)", "g1", "high", "upper(g2)", names_sql("g1"), groups=2),
        ),
        18: rows(
            18, part(rf"\$\.ajax\({opened}\)", "g1", "high", params=names_sql("g1")), part(rf"\$\.get\({opened}\)", "g1", "high", "'GET'", names_sql("g1")),
            part(rf"jQuery\.post\({opened}", "g1", "high", "'POST'", names_sql("g1")),
            part(rf"\$\.ajax\(\{{url: {opened}, type: \"([A-Z]+)\"\}}\)", "g1", "high", "g2", names_sql("g1"), groups=2),
        ),
        28: rows(28, part(rf"\.postMessage\((?:\{{[^}}]*\}}|\w+), {opened}\)", "g1", "medium")),
        29: rows(29, part(
            r"<form\b([^>]*)>", "regexp_extract(g1, '\\baction=\"([^\"]+)\"', 1)", "medium", "coalesce(nullif(upper(regexp_extract(g1, '(?i)\\bmethod=\"(get|post)\"', 1)), ''), 'GET')",
            names_sql("regexp_extract(g1, '\\baction=\"([^\"]+)\"', 1)"))),
        32: rows(
            32, part(r"\brequire\.ensure\(\[([^\]]*)\]", "unnest(regexp_extract_all(g1, '\"([^\"]+)\"', 1))", "medium"),
            part(rf"\brequire\.context\({opened}", "g1", "medium", where="true"), part(rf"\b__webpack_require__\({opened}\)", "g1", "medium"),
        ),
        33: rows(33, part(r"(?s)createElement\(\"script\"\).{0,500}?\.src = \"([^\"]+)\"", "g1", "high")),
        39: rows(
            39, part(r"(?:query|mutation|subscription)\s+(\w+)\s*(?:\([^)]*\)\s*)?\{", "'graphql:' || g1", "medium", category="'api_endpoint'", where="true"),
            part(r"(?:^|[^A-Za-z_])(query|mutation|subscription)\s*\{", "'graphql:' || g1", "medium", category="'api_endpoint'", where="true"),
            part(r"[\"']([^\"']*(?:/graphql|/gql)[^\"']*)[\"']", "g1", "medium", category="'api_endpoint'", where="true"),
            part(r"gql\s*`([^`]*)`", "'graphql:' || unnest(regexp_extract_all(g1, '(?:query|mutation|subscription)\\s+(\\w+)', 1))", "medium", category="'api_endpoint'", where="true"),
        ),
        57: rows(
            57, part(r"\{@link\s+([^\s}]+)\}", "g1", "low", where="true"), part(r"@link\s+(https?://[^\s}]+)", "g1", "low", where="true"),
            part(r"@see\s+(https?://\S+)", "g1", "low", where="true"), each(r"(?m)@example\s+(.*)$", text_urls("g1")), once=True,
        ),
        59: rows(
            59, each(r"(?m)//\s*(.+)$", in_lines(code.format("[g1]"))),
            each(r"(?s)/\*(.+?)\*/", in_lines(code.format("list_transform(string_split(g1, chr(10)), lambda x: ltrim(trim(x), '* '))"))), once=True,
        ),
        60: rows(60, each(r"[\"']([A-Za-z0-9+/=_\-]{20,})[\"']", found_urls_sql(f"({plain64})")), once=True),
        61: rows(61, each(r"(?:\\x[0-9a-fA-F]{2}){4,}", found_urls_sql(f"({_unescaped('g0')})"), groups=0), once=True),
        62: rows(62, each(r"(?:\\u[0-9a-fA-F]{4}){4,}", found_urls_sql(f"({_unescaped('g0')})"), groups=0), once=True),
        63: rows(63, each(r"(?:var|let|const)\s+\w+\s*=\s*\[([^\]]{10,})\]", f"flatten(list_transform(regexp_extract_all(g1, {quoted(string)}, 1), lambda x: {found_urls_sql('x', True)}))"), once=True),
        64: rows(64, each(r"String\.fromCharCode\(([0-9,\s]+)\)", found_urls_sql(f"({chars})")), once=True),
        65: rows(65, each(rf"atob\([\"']{encoded}[\"']\)", found_urls_sql(f"({plain64})", True), "medium"), once=True),
        66: rows(
            66, each(rf"{string}\.split\([\"'][\"']\)\.reverse\(\)\.join\([\"'][\"']\)", found_urls_sql("reverse(g1)", True)),
            each(r"[\"']([^\"']+)[\"']\.split\([\"']([^\"']*)[\"']\)\.join\([\"']([^\"']*)[\"']\)", found_urls_sql("replace(g1, g2, g3)", True), groups=3), once=True,
        ),
    }
