"""DuckDB SQL that the training-data queries are held against."""

from __future__ import annotations

from weblode.llm.license_scan import RULES, SENTENCES, rule_pattern
from weblode.llm.sharding import Node, Topology, uniform_topology

_HOST = "nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '')"
_SEGMENT = "coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)', 1), '')"
_KEYS = """list_distinct(list_concat(
    list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
    CASE WHEN segment <> '' THEN [host || '/' || segment] ELSE [] END))"""


def _uniform(path: str, key: str) -> str:
    return f"((('0x' || substr(md5('{path}:' || {key}), 1, 12))::BIGINT + 0.5) / 281474976710656.0)"


def _least(nodes: tuple[Node, ...]) -> str:
    """Index of the child with the least weighted draw."""
    draws = ", ".join(f"-ln({_uniform(n.path, 'key')}) / {n.weight!r}" for n in nodes)
    return f"(list_position([{draws}], list_min([{draws}])) - 1)"


def _shard(topology: Topology) -> str:
    """The shard of `key`: one CASE a level of the tree."""
    racks = []
    for region in topology.regions:
        leaves = [f"([{', '.join(str(s.shard) for s in rack.children)}])[{_least(rack.children)} + 1]" for rack in region.children]
        racks.append(f"CASE {_least(region.children)} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(leaves)) + " END")
    return f"CASE {_least(topology.regions)} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(racks)) + " END"


_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
# CRC-32 a byte at a time; the table of 256 follows from the polynomial.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda a, b: xor(a >> 8, crc_table[(xor(a, b) & 255) + 1])), 4294967295)"""

ORACLE_SQL: dict[str, str] = {
    "op1_sharding": f"""
        WITH made AS (
            SELECT list(list_reduce(list_prepend(n, [0, 1, 2, 3, 4, 5, 6, 7]), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY n) AS crc_table
            FROM (SELECT unnest(range(256))::BIGINT AS n)),
        sized AS (
            SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS key, CAST(coalesce(strlen(text), 0) + 1 AS BIGINT) AS size, CAST({_CRC} AS BIGINT) AS text_crc32
            FROM documents, made),
        placed AS (
            SELECT *, {_shard(uniform_topology())} AS shard, {_shard(uniform_topology().grown())} AS grown_shard,
                   {_uniform("slot", "(key || ':' || CAST(text_crc32 AS VARCHAR))")} AS draw
            FROM sized)
        SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
               row_number() OVER (PARTITION BY shard ORDER BY draw, doc_id NULLS LAST, text_crc32, size) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard
        FROM placed
    """,
    "op7_substring_dedup": f"""
        WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
        win AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM doc)),
        again AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
        gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM win SEMI JOIN again USING (s)),
        marks AS (SELECT r, count(*) AS n FROM gone GROUP BY r),
        word AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM doc),
        kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (r, p) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM doc LEFT JOIN marks USING (r) LEFT JOIN kept USING (r)
    """,
    "op2_decontamination": """
        WITH item AS (
            SELECT item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
            FROM benchmark),
        item_shingle AS (
            SELECT item_id, len(w) AS n, least(5, len(w)) AS k, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i, w FROM item WHERE len(w) > 0),
        item_count AS (
            SELECT item_id, n, k, array_to_string(w[i:i + k - 1], ' ') AS s, count(*) AS c FROM item_shingle GROUP BY ALL),
        doc AS (
            SELECT row_number() OVER () AS r, doc_id,
                   list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
            FROM documents WHERE text IS NOT NULL),
        place AS (
            SELECT r, doc_id, len(w) AS words, k, unnest(range(1, len(w) - k + 2)) AS i, w
            FROM doc, (SELECT DISTINCT k FROM item_count) WHERE len(w) >= k),
        doc_shingle AS (SELECT r, doc_id, words, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM place),
        hit AS (SELECT r, doc_id, words, item_id, n, k, i, s, c FROM doc_shingle JOIN item_count USING (k, s)),
        win AS (
            SELECT DISTINCT r, doc_id, item_id, n, k, unnest(range(greatest(1, i - (n - k)), least(i, words - n + 1) + 1)) AS start FROM hit WHERE words >= n),
        overlap AS (
            SELECT r, doc_id, item_id, n, k, start, s, least(count(*), any_value(c)) AS o
            FROM win JOIN hit USING (r, doc_id, item_id, n, k) WHERE i BETWEEN start AND start + n - k GROUP BY ALL),
        scored AS (
            SELECT r, doc_id, item_id, n, start, sum(o)::DOUBLE / (2 * (n - k + 1) - sum(o)) AS similarity FROM overlap GROUP BY r, doc_id, item_id, n, k, start)
        SELECT doc_id, item_id, max(similarity) AS similarity, CAST(arg_min(start, (-similarity, start)) - 1 AS INTEGER) AS start_word,
               CAST(n AS INTEGER) AS n_words, CAST(count(*) AS INTEGER) AS windows
        FROM scored WHERE similarity >= 0.8 GROUP BY r, doc_id, item_id, n
    """,
    "op8_url_filters": f"""
        WITH page AS (SELECT page_id, url, CAST(page_id * 37 % 366 AS INTEGER) AS fetch_day, {_HOST} AS host, {_SEGMENT} AS segment FROM pages),
        rules AS (SELECT DISTINCT unnest({_KEYS}) AS rule FROM page WHERE host IS NOT NULL),
        valued AS (SELECT rule, ('0x' || substr(md5(rule), 1, 7))::INTEGER AS v FROM rules),
        log AS (
            SELECT rule, 'block' AS action, v % 200 AS day FROM valued WHERE v % 4 < 3
            UNION ALL SELECT rule, 'remove', v % 200 + 30 + v % 90 FROM valued WHERE v % 4 = 1
            UNION ALL SELECT rule, 'remove', v % 200 + 20 FROM valued WHERE v % 4 = 2
            UNION ALL SELECT rule, 'allow', v % 200 + 20 + v % 50 FROM valued WHERE v % 4 = 2),
        last AS (SELECT rule, day, arg_max(action, CASE action WHEN 'remove' THEN 0 WHEN 'allow' THEN 1 ELSE 2 END) AS action FROM log GROUP BY rule, day),
        spans AS (SELECT rule, action, day AS since, coalesce(lead(day) OVER (PARTITION BY rule ORDER BY day), 1073741824) AS until FROM last),
        probe AS (SELECT page_id, url, fetch_day, unnest({_KEYS}) AS rule FROM page WHERE host IS NOT NULL),
        hit AS (
            SELECT page_id, url, fetch_day, arg_max({{'rule': rule, 'action': action, 'since': since}}, (length(rule), rule)) AS h
            FROM probe JOIN spans USING (rule) WHERE action <> 'remove' AND since <= fetch_day AND fetch_day < until GROUP BY ALL)
        SELECT page_id, url, fetch_day, host, coalesce(h.action, 'keep') AS decision, h.rule AS matched_rule, CAST(h.since AS INTEGER) AS listed_since
        FROM page LEFT JOIN hit USING (page_id, url, fetch_day)
    """,
    "op9_license_scan": f"""
        WITH known(s, i) AS (VALUES {", ".join(f"('{s}', {i})" for i, s in SENTENCES.items())}),
        lookup AS (SELECT map(list(s), list(i)) AS m FROM known),
        found AS (
            SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '[\\n\\r]+|[.!?;]+[ \\t]+'),
                   lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS f
            FROM documents),
        coded AS (SELECT doc_id, len(f) AS n, list_filter(list_transform(f, lambda x: m[x]), lambda i: i IS NOT NULL) AS ids FROM found, lookup),
        line AS (SELECT doc_id, n, len(ids) AS k, coalesce(array_to_string(ids, ','), '') AS sequence FROM coded)
        SELECT doc_id, CAST(n AS INTEGER) AS n_sentences, CAST(k AS INTEGER) AS n_known, sequence,
               concat_ws(',', {", ".join(f"CASE WHEN regexp_matches(',' || sequence || ',', '{rule_pattern(ids)}') THEN '{name}' END" for name, ids in RULES)}) AS licenses
        FROM line
    """,
}
