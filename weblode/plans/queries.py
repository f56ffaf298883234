"""Registered queries: each technique, parser and operator over the driver's tables, and the SQL they are held against.

The pages table carries few kinds of URLs, so the techniques run over documents made from the
orders table: a template with the order's and customer's keys put in, the same text in
Spark and in DuckDB. Patterns in the SQL are the rules' own, in the linear-time dialect.
"""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from weblode.functions import urls as U
from weblode.functions.scan import Rule
from weblode.operators import calls, comments, config, encoded, hosts, lexical, parsers, registry, relational, routers, sinks
from weblode.plans import engine
from weblode.plans.oracle import category_sql, hits_sql, quoted, scan_sql, valid_sql
from weblode.plans.oracle_special import special_sql
from weblode.sources import detect, files

Query = Callable[[SparkSession, str], DataFrame]

# One template a technique: hits, repeats and near misses; {k} and {c} are the order's and the customer's keys.
TEMPLATES = {
    1: 'x = "https://api{k}.example.com/v/{c}.";\ny="//cdn.example.org/lib{k}.js" z = "ftp://f.example.net/{c}"\nnot//here https:/{k}',
    2: 'a("/p/{k}/x.json?q={c}#top");\nb = \'../up/{c}\' c = `./here` "/" "//no{k}" /bare/{k}\n"/p/{k} spaced"',
    3: 'get("/api/v2/users/{k}?x={c}");\nu = /rest/orders/{c};\n"/graphql" "/rpc/call.{k}" \'/ws/feed\' "/v3/items/{k}" "/api/v2/users/{k}?x={c}"\n"/apix/{k}"',
    4: 'see https://q.example.com/s?page={k}&size={c}&page=2#frag, and\n"/search?term={c}" or "?tab={k}" and /none{k}',
    5: '<a href="#/home/{k}"> r = \'#/user/{c}?tab=1\'\n"#top{k}" "#/home/{k}"',
    6: 'u = `/t/${id}/{k}`;\nv = `plain/{k}`; w = `${a}{c}`; x = `/b/${f(1)}/${g}/{c}?q=1`',
    7: 'p = "/a/{k}/" + id + "/b";\nq = base + "/c/{c}"; r = "x" + "y{k}";',
    8: 'i = "data:image/png;base64,iVBORw0KGgo{k}==";\nj = data:text/plain,hello%20{c} data:broken{k}',
    9: 'b = "blob:https://x.example.com/{k}-{c}";\nc = \'javascript:open{k}\' blob:{k} javascript: {c}',
    10: 'm = "mailto:user{k}@example.com?subject=hi";\nmailto:bad{c} mailto:a.b+{c}@mail.example.org.',
    11: 'a = "http://10.1.2.3:8080/x{k}";\nb = "192.168.0.{k}" c = "https://[2001:db8::1]:443/{c}" d = "8.8.4.4" e = "999.1.1.1"',
    12: 'a = "%2Fenc%2F{k}";\nb = "\\u002f\\u0061\\u002f{c}" c = "\\x2f\\x61\\x2e" d="&#47;&#97;&#47;{k}"',
    13: 'a = "tg://resolve{k}";\nb = intent://scan{c}/#Intent;scheme=zxing;end c = "android-app://com.example/{k}" foo://{c}',
    14: 'a = "/lit/{k}/x.html"; b = \'/one{c}/two\'; c = `/three/{k}?a=1`;\nd = "/word" e = "/2024/01" f = "/lit/{k}/x.html" g = "/x{k}" h = "/^a{k}" i = "/re{k}$/" j = "/a/b"',
    15: "fetch('/api/orders/{k}', {method: 'POST', body: JSON.stringify({id: {k}, name: n})});\nfetch(\"/get/{c}?a=1&b=2\"); fetch(url{k}); prefetch('/no/{k}'",
    16: 'r.open("GET", "/xhr/{k}?a=1&b={c}");\ns.open( \'POST\' , \'/xhr/{c}\' ); f.open("{k}") g.open("get", "/low/{k}")',
    17: "axios.get('/ax/{k}?q=1');\naxios({url: '/axc/{c}', method: 'delete'}); axios.post(path{k});",
    18: '$.ajax("/jq/text{k}");\n$.get("/jq/get{k}?x=1"); jQuery.post("/jq/post{c}", d); $.ajax({url: "/jq/obj{k}", type: "PUT"});',
    19: 'navigator.sendBeacon("/beacon/{k}?e={c}");\nsendBeacon("/none/{k}");',
    20: 'w = new WebSocket("wss://ws{k}.example.com/s");\ne = new EventSource("/events/{c}?last=1"); new Socket("/no/{k}")',
    21: 'import("./chunk{k}.js");\nconst m = import( \'/mod/{c}.mjs\' ); x.import("/no/{k}"); reimport("/no/{c}")',
    22: 'a = require("lib/{k}");\nb = require(\'fs{k}\'); c = require( "./local{c}" ); xrequire("no/{k}")',
    23: 'window.location = "/go/{k}";\ndocument.location.href = \'/doc/{c}?r=1\'; location.replace("/rep/{k}"); mylocation = "/no/{c}"',
    24: 'window.open("/win/{k}?w=1");\nfile.open("/no/{c}"); window . open( \'https://w.example.com/{c}\' )',
    25: 'img.src = "/img/{k}.png";\na.href = \'/link/{c}?x=1\'; f.action="/act/{k}"; b.value = "/no/{k}"; c.src = "word{k}"',
    26: 'e.setAttribute("href", "/attr/{k}?q={c}");\ne.setAttribute(\'src\', "/s/{c}.js"); e.setAttribute("class", "/no/{k}")',
    27: "e.innerHTML = \"<a href=/x/{k}>\";\ne.outerHTML += '<img src=/y/{c}>';",
    28: 'w.postMessage({a: [1, {k}]}, "https://t{k}.example.com/");\nw.postMessage(m, "*"); p.postMessage(x)',
    29: '<form id=f action="/form/{k}" method="post">\n<form action="/plain/{c}?a=1"> <form method="get"> <formx action="/no/{k}">',
    30: 'navigator.serviceWorker.register("/sw{k}.js");\nserviceWorker.register("/no{c}.js")',
    31: 'new Worker("/worker{k}.js");\nnew SharedWorker( \'/shared/{c}.js\' ); new Workers("/no{k}")',
    32: 'require.ensure(["a/{k}", "b{k}"], cb);\nrequire.context("./ctx/{c}"); __webpack_require__("m/{k}"); __webpack_require__("{c}")',
    33: 's = document.createElement("script");\ns.src = "/dyn/{k}.js"; document.createElement("div").src = "/no/{c}"',
    34: '<Route exact path="/r/{k}"> <Link className="a" to="/l/{c}">\n<NavLink to=\'/n/{k}\'> navigate("/nav/{c}") { path: "/p/{k}" } <Route id="{c}">',
    35: 'routes: [ { path: "/v/{k}", name: 1 } ]\n<router-link to="/rl/{c}"> this.$router.push("/push/{k}") router.push({ path: "/obj/{c}" })',
    36: 'RouterModule.forRoot([ { path: "ng/{k}", component: A } ])\n<a routerLink="/link/{c}"> <a [routerLink]="[\'/arr/{k}\'"> this.router.navigate([\'/nav/{c}\'',
    37: '<Link prefetch href="/next/{k}">\nrouter.push("/push/{c}"); router.replace(\'/rep/{k}\'); "/api/next/{c}" "/api/n {k}"',
    38: 'app.get("/ex/{k}", h); router.post(\'/rt/{c}\', h);\napp.use("/mw/{k}"); app.listen("/no/{c}")',
    39: 'query Get{k}($id: ID) { a }\nmutation { b{c} } "/graphql?op={k}" gql`query Tag{c} { x }`',
    40: 'a = "/api/orders/{k}";\nb = "/api/orders/{c}/x" c = \'/api/users\' d = "/api/Data/{k}"',
    41: 'a = process.env.REACT_APP_API_{k} || "https://e{k}.example.com/";\nb = process.env.NODE_ENV; c = import.meta.env.VITE_KEY_{c}',
    42: 'baseURL: "https://b{k}.example.com/api",\n"endpoint": "/ep/{c}", timeout: "/no", host: \'/h/{k}\', url: "word{c}"',
    43: '__webpack_public_path__ = "/assets/{k}/";\npublicPath: \'/pub/{c}/\', __webpack_require__.p = "/wp/{k}"',
    44: '//# sourceMappingURL=app.{k}.js.map\n//@ sourceMappingURL = lib.{c}.map\n// sourceMapping={k}',
    45: '<base target="_top" href="/base/{k}/">\n<BASE href="/up/{c}/"> <basefont href="/no/{k}">',
    46: '{"start_url": "/start/{k}", "scope": "/scope/{c}/",\n"icons": [{"src": "/icon{k}.png"}], "url": "https://app{c}.example.com/"}',
    47: '"/sitemap-{k}.xml" \'robots.txt\'\nSitemap: https://s{c}.example.com/sitemap.xml\nDisallow: /private/{k}\n<loc> https://l.example.com/{c} </loc>',
    48: '{"openapi": "3.0", "paths": {"/pets/{k}": {"get": 1}, "/solo{c}": {}}}\n"/docs/swagger-ui/{k}.html" "/spec/{c}/openapi.yaml"',
    49: 'experiment_url: "/exp/{k}", "flag_endpoint" = "/flag/{c}"\nfeature_url: "on{k}" other_url: "/no/{c}"',
    50: 'u = "https://a{k}.b.example.com/x"; v = "c{c}.d.example.org";\nw = "window.location.href" w = "this.state.x{k}" w = "e.exports.{k}.default" x = "example{k}.com" y = "https://A{k}.B.example.com/"',
    51: 'a = "https://bucket{k}.s3.us-east-1.amazonaws.com/k/{c}";\nb = "http://d{c}.cloudfront.net/x" c = "https://storage.googleapis.com/b/{k}" d = "https://cdn{k}.example.com/"',
    52: 'a = "http://svc{k}.internal/api"; b = \'db{c}.local\';\nc = "https://192.168.1.9:80{c}/x" d = "localhost:3000" e = "http://pub{k}.example.com/"',
    53: 'a = "ws://s{k}.example.com/a"; b = \'wss://t.example.com/{c}?x=1\';\nc = "ws://s{k}.example.com/a" d = ws:/{c}',
    54: 'x = 1; // see https://c{k}.example.com/doc.\nu = "https://no{c}.example.com/"; // path /in/comment/{c}',
    55: '/* block https://b{k}.example.com/x\n second /path/{c} */ y = "/no/{k}"; /* none */',
    56: '<!-- old: http://h{k}.example.com/y, -->\n<p> <!-- <a href="/gone/{c}"> --> <!-- {k} -->',
    57: '/** {@link https://l{k}.example.com/a} @see https://s{c}.example.com/b\n@link https://k{k}.example.com/c\n@example go("/ex/{c}") */',
    58: '// API: https://a{k}.example.com/v1\n// TODO fix /todo/{c}\n// note: https://no{k}.example.com/',
    59: '// call("/old/{k}");\n// just /text/{c}\n/* a\n * b = "/blk/{c}";\n */',
    60: 'a = "aHR0cHM6Ly9iNjQuZXhhbXBsZS5jb20vcGF0aA=="; // {k}\nb = "notbase64atall{c}"',
    61: 'a = "\\x2f\\x61\\x2f\\x62{k}";\nb = "\\x2f{c}"',
    62: 'a = "\\u002f\\u0061\\u002f\\u0062{k}";\nb = "\\u002f{c}"',
    63: 'var arr = ["/arr/{k}", "https://z{c}.example.com/q", "word"];\nlet b = [1];',
    64: 'String.fromCharCode(47,97,47,98); // {k}\nString.fromCharCode(72, 105) + {c}',
    65: 'atob("L2F0b2IvMQ=="); // {k}\natob("aGVsbG8="); {c}',
    66: '"{k}/esrever/".split("").reverse().join("");\n"*x*{c}".split("*").join("/");',
    67: 'new URL("/rel/{k}", "https://u.example.com/base/");\nnew URL("https://one{c}.example.com/x"); new URL("sub{k}", \'https://v.example.com/a/\')',
}


def made_documents(spark: SparkSession, sf_dir: str, technique: int) -> DataFrame:
    """(doc_id, content): the technique's template for every order."""
    keys = engine.spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey"))
    text = F.replace(F.replace(F.lit(TEMPLATES[technique]), F.lit("{k}"), F.col("o_orderkey").cast("string")), F.lit("{c}"), F.col("o_custkey").cast("string"))
    return keys.select(F.col("o_orderkey").alias("doc_id"), text.alias("content"))


def documents_sql(technique: int) -> str:
    return f"SELECT o_orderkey AS doc_id, replace(replace({quoted(TEMPLATES[technique])}, '{{k}}', CAST(o_orderkey AS VARCHAR)), '{{c}}', CAST(o_custkey AS VARCHAR)) AS content FROM orders"


def shown(hits: DataFrame) -> DataFrame:
    """The columns that both engines are compared on."""
    full = relational.with_category(hits)
    return full.select("doc_id", "url", "source_line", "http_method", F.array_join(F.concat("query_params", "body_params"), ",").alias("params"), "category", "confidence")


def technique_query(technique: int) -> Query:
    return lambda spark, sf_dir: shown(registry.apply(made_documents(spark, sf_dir, technique), technique))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.documents(engine.spread(spark.read.parquet(f"{sf_dir}/pages.parquet")), "page_id", "url", "html")


def pages_relative_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = engine.spread(spark.read.parquet(f"{sf_dir}/pages.parquet")).select(F.col("page_id").alias("doc_id"), F.col("html").alias("content"))
    return shown(registry.apply(docs, 2))


def categorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return urls.select("page_id", "url", U.categorize_url(F.col("url")).alias("category"))


def validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents' first lines as candidate URLs: most are rejected."""
    return candidates(spark, sf_dir).select("url", U.is_valid_url(F.col("url")).alias("valid"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = engine.spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")).select(F.explode(F.split("text", "[ \n]")).alias("url"))
    links = spark.read.parquet(f"{sf_dir}/pages.parquet").select("url")
    return text.unionByName(links).distinct()


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: pages through the HTML parser and all techniques, validated, first wins, counted by category."""
    results = engine.extract(pages(spark, sf_dir), sort=False)
    return relational.category_summary(results)


def extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.extract(pages(spark, sf_dir)).select("url", "source_file", "source_line", "detection_method", "http_method", "category", "confidence", "technique_id")


def technique_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtotals are named: technique -1 and confidence `all`."""
    found = relational.technique_summary(engine.extract(pages(spark, sf_dir), sort=False))
    return found.select(F.coalesce("technique_id", F.lit(-1)).alias("technique_id"), F.coalesce("confidence", F.lit("all")).alias("confidence"), "urls", "distinct_urls")


def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first customer of each (status, priority) in key order: the dedup operator on plain columns."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = orders.select(F.col("o_orderstatus").alias("http_method"), F.concat(F.lit("/p/"), F.col("o_custkey").cast("string")).alias("url"), "o_orderkey")
    return relational.first_wins(rows, ("o_orderkey",))


def filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return relational.filtered(urls, scope="example", exclude=r"\?", include=r"/(?:en|fr)/")


def text_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = registry.apply(made_documents(spark, sf_dir, 16), 16).withColumn("source_file", F.lit("app.js"))
    return sinks.as_text(hits, methods=True, params=True, source=True, debug=True)


def csv_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = relational.with_category(registry.apply(made_documents(spark, sf_dir, 16), 16)).withColumn("source_file", F.concat(F.col("doc_id").cast("string"), F.lit(".js")))
    return sinks.as_csv(hits)


def unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = registry.apply(made_documents(spark, sf_dir, 25), 25).select("url", "http_method").distinct()
    return relational.unseen(found, found.where(F.col("url").startswith("/img/")))


def _rules(technique: int) -> tuple[Rule, ...] | None:
    tables = {
        1: (lexical.ABSOLUTE, lexical.PROTOCOL_RELATIVE), 2: (lexical.RELATIVE,), 3: lexical.API, 4: (lexical.QUERY, lexical.BARE_QUERY), 5: lexical.HASH, 8: (lexical.DATA_URI,),
        9: lexical.BLOB, 10: (lexical.MAILTO,), 11: lexical.IP, 13: lexical.SCHEMES, 14: lexical.LITERALS, 16: (calls.XHR,), 19: (calls.BEACON,), 20: (calls.SOCKET, calls.EVENTS),
        21: (calls.IMPORT,), 22: (calls.REQUIRE,), 23: calls.LOCATION, 24: (calls.WINDOW,), 25: (calls.PROPERTY,), 26: (calls.ATTRIBUTE,), 30: (calls.SERVICE_WORKER,),
        31: (calls.WORKER,), 34: routers.REACT, 35: routers.VUE, 36: routers.ANGULAR, 37: routers.NEXT, 38: (routers.EXPRESS,), 42: config.CONFIG, 43: config.PUBLIC_PATH,
        44: (config.SOURCE_MAP,), 45: (config.BASE,), 46: config.MANIFEST, 47: config.SITEMAP, 48: (config.OPENAPI_PATH, config.SWAGGER_UI, config.SPEC_FILE), 49: config.FLAGS,
        50: hosts.SUBDOMAIN, 51: (hosts.CDN,), 52: hosts.INTERNAL, 53: (hosts.WEBSOCKET,), 40: (routers.REST,), 41: (), 67: (),
    }
    return tables.get(technique)


ONCE = {3, 4, 14, 51, 52, 53}


def _results_sql() -> str:
    """The whole plan over the pages: links of tags, then all techniques over inline scripts and whole pages, valid ones, first wins.

    Technique 27 is left out: its pattern looks for a quoted attribute in a text that ends at the first quote, so it finds nothing.
    """
    whole = "SELECT page_id AS doc_id, html AS content FROM pages"
    scripts = "SELECT page_id AS doc_id, unnest(regexp_extract_all(html, '(?s)<script>(.*?)</script>', 1)) AS content FROM pages"
    links = scan_sql(f"({whole})", r'<a[ \t\n][^>]*?\bhref="([^"]*)"', (1,))
    parts = [f"SELECT doc_id, 0 AS stage, 0 AS technique_id, 'html_a_href' AS detection_method, trim(g1) AS url, line AS source_line, '' AS http_method, {category_sql('trim(g1)')} AS category, 'high' AS confidence FROM ({links}) WHERE trim(g1) NOT IN ('', '#', '?')"]
    for stage, docs in ((1, scripts), (2, whole)):
        special = SPECIAL_SQL(lambda t: docs) | special_sql(lambda t: docs, text_urls_sql)  # noqa: B023
        for t, name in enumerate(registry.NAMES, 1):
            sql = special.get(t) or (hits_sql(docs, _rules(t), t, t in ONCE) if _rules(t) else None)
            if sql:
                parts.append(f"SELECT doc_id, {stage}, {t}, '{name}', url, source_line, http_method, category, confidence FROM ({sql})")
    return f"""SELECT * FROM (SELECT r.*, p.url AS source_file FROM ({" UNION ALL ".join(parts)}) r JOIN pages p ON p.page_id = r.doc_id) WHERE {valid_sql("url")}
        QUALIFY row_number() OVER (PARTITION BY http_method, url ORDER BY doc_id, stage, technique_id, source_line) = 1"""


def _oracle() -> dict[str, str]:
    found = {}
    for t, name in enumerate(registry.NAMES, 1):
        rules = _rules(t)
        if rules:
            found[f"t{t:02d}_{name}"] = hits_sql(documents_sql(t), rules, t, t in ONCE)
    special = SPECIAL_SQL(documents_sql) | special_sql(documents_sql, text_urls_sql)
    found |= {f"t{t:02d}_{registry.NAMES[t - 1]}": sql for t, sql in special.items()}
    page_docs = "SELECT page_id AS doc_id, html AS content FROM pages"
    found["pages_relative_paths"] = hits_sql(page_docs, (lexical.RELATIVE,), 2, False)
    found["categorize"] = f"SELECT page_id, url, {category_sql('url')} AS category FROM pages"
    found["validate"] = f"""
        WITH c AS (SELECT unnest(string_split_regex(text, '[ \\n]')) AS url FROM documents UNION ALL SELECT url FROM pages)
        SELECT url, {valid_sql('url')} AS valid FROM (SELECT DISTINCT url FROM c)"""
    found["dedup_first_wins"] = "SELECT o_orderstatus AS http_method, '/p/' || CAST(o_custkey AS VARCHAR) AS url, min(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL"
    found["scope_include_exclude"] = "SELECT page_id, url FROM pages WHERE contains(url, 'example') AND NOT regexp_matches(url, '\\?') AND regexp_matches(url, '/(?:en|fr)/')"
    results = _results_sql()
    found["extract_pages"] = f"""
        SELECT url, source_file, CAST(source_line AS INTEGER) AS source_line, detection_method, http_method, category, confidence, CAST(technique_id AS INTEGER) AS technique_id FROM ({results})"""
    found["category_summary"] = f"SELECT category, count(*) AS urls FROM ({results}) GROUP BY category"
    found["technique_confidence_rollup"] = f"""
        SELECT CAST(coalesce(technique_id, -1) AS INTEGER) AS technique_id, coalesce(confidence, 'all') AS confidence, count(*) AS urls, count(DISTINCT url) AS distinct_urls FROM ({results}) GROUP BY ROLLUP (technique_id, confidence)"""
    hits16 = hits_sql(documents_sql(16), (calls.XHR,), 16, False)
    found["text_format"] = f"""
        SELECT concat_ws(' ', nullif(http_method, ''), url, CASE WHEN params <> '' THEN '[' || params || ']' END,
               '(app.js:' || CAST(source_line AS VARCHAR) || ')', '{{xmlhttprequest #16}}') AS value FROM ({hits16})"""
    found["csv_format"] = f"""
        SELECT url, CAST(doc_id AS VARCHAR) || '.js' AS source_file, source_line, 'xmlhttprequest' AS detection_method, http_method, category, confidence FROM ({hits16})"""
    found["unseen"] = f"SELECT DISTINCT url, http_method FROM ({hits_sql(documents_sql(25), (calls.PROPERTY,), 25, False)}) WHERE NOT starts_with(url, '/img/')"
    return found


def SPECIAL_SQL(documents: Callable[[int], str]) -> dict[int, str]:  # noqa: N802
    """Techniques that are more than one scan; texts as of the templates."""
    def head(doc):
        return f"WITH doc AS ({documents(doc)})"

    def row(url, line, method="''", params="''", category=None, confidence="medium"):
        kind = category_sql(url) if category is None else f"'{category}'"
        return f"doc_id, {url} AS url, CAST({line} AS INTEGER) AS source_line, {method} AS http_method, {params} AS params, {kind} AS category, '{confidence}' AS confidence"

    def matched(pattern: str, groups: tuple[int, ...] = (1,)) -> str:
        return scan_sql("doc", pattern, groups)

    text = lambda found: f"SELECT doc_id, line, u FROM (SELECT doc_id, o, line, i, unnest({text_urls_sql('g1')}) AS u FROM ({found}))"

    def first(found: str) -> str:
        return f"SELECT {row('u', 'min(line)', confidence='low')} FROM ({found}) GROUP BY doc_id, u"

    sql = {
        6: f"{head(6)} SELECT {row('u', 'line')} FROM (SELECT doc_id, line, regexp_replace(g1, '\\$\\{{[^}}]*\\}}', '{{{{DYNAMIC}}}}', 'g') AS u FROM ({matched(lexical.TEMPLATE.pattern)}) WHERE contains(regexp_replace(g1, '\\$\\{{[^}}]*\\}}', '', 'g'), '/'))",
        41: f"{head(41)} " + " UNION ALL ".join(
            f"SELECT {row('coalesce(nullif(g2, {0}), g1)'.format(chr(39) * 2), 'line')} FROM ({matched('(' + n + ')(?:' + config.W + '(?:=|:|\\|\\|)' + config.W + config.V + ')?', (1, 2))})" for n in config.ENV_NAMES),
        54: f"{head(54)} {first(text(matched(comments.LINE_COMMENT)))}",
        55: f"{head(55)} {first(text(matched(comments.BLOCK_COMMENT)))}",
        56: f"{head(56)} {first(text(matched(comments.HTML_COMMENT)))}",
        58: f"{head(58)} {first(text(matched(comments.ANNOTATION)))}",
        67: f"""{head(67)} SELECT {row('u', 'line', confidence='high')} FROM (
            SELECT doc_id, line, CASE WHEN starts_with(g1, '/') THEN regexp_extract(g2, '^.*?://[^/]*') || g1 ELSE rtrim(g2, '/') || '/' || g1 END AS u FROM ({matched(encoded.URL_PAIR, (1, 2))})
            UNION ALL SELECT doc_id, line, g1 FROM ({matched(encoded.URL_ONE.pattern)}))""",
    }
    sql[40] = f"{head(40)} SELECT {row('u', 'line', category='inferred', confidence='low')} FROM (SELECT doc_id, line, g1 || unnest(['', '/{{id}}', '/create', '/update', '/delete']) AS u FROM (SELECT doc_id, g1, min(line) AS line FROM ({matched(routers.REST.pattern)}) GROUP BY doc_id, g1))"
    return sql


def text_urls_sql(text: str) -> str:
    trim = lambda p: f"list_transform(regexp_extract_all({text}, {quoted(p)}), lambda u: rtrim(u, '.,;:!?)'))"
    path = f"list_filter(regexp_extract_all({text}, {quoted(U.TEXT_PATH)}, 1), lambda u: length(u) > 2)"
    return f"list_distinct(list_concat(list_concat({trim(U.TEXT_ABSOLUTE)}, {trim(U.TEXT_PROTOCOL_RELATIVE)}), list_concat({path}, {trim(U.TEXT_DOMAIN)})))"


def parser_query(kind: str, content: str) -> Query:
    """A file-type parser over a made document for each order."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        keys = engine.spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"))
        text = F.replace(F.lit(content), F.lit("{k}"), F.col("o_orderkey").cast("string"))
        hits = keys.select(F.col("o_orderkey").alias("doc_id"), text.alias("content")).select("doc_id", F.inline(parsers.PARSERS[kind](F.col("content"))))
        return relational.with_category(hits).select("doc_id", "url", "source_line", "detection_method", "category", "confidence", "technique_id")

    return run


PARSED = {
    "html": '<a href="/h/{k}">x</a>\n<img srcset="/s{k}.png 1x, /t.png 2x" data-u="/d/{k}" onclick="go(\'/ev/{k}\')"><a href="#"></a>\n'
    '<title><a href="/no/{k}"></title><video src="/v{k}.mp4" poster=" /p.png "><META http-equiv="Refresh" content="5; URL=\'/next/{k}\'"><div data-n="no{k}">',
    "css": 'a { background: url( "/c/{k}.png" ) }\n@import "/i{k}.css"; b { x: url(data:image/png;base64,AA) } c { y: url(\'rel{k}.gif\') }',
    "json": '{"url": "/j/{k}", "list": ["/l/{k}", "word", 3, "/with space"], "name": "x{k}", "Host": "h{k}", "deep": {"a": [{"href": "d{k}"}]}}',
    "json_manifest": '{"start_url": "/s/{k}", "scope": "/", "icons": [{"src": "i{k}.png"}, {"sizes": "1"}]}',
    "json_broken": '{"a": "/f/{k}",\n "b": "https://x.example.com/{k}", "c": "no{k}", }',
    "sourcemap": '{"version": 3, "file": "o{k}.js", "sourceRoot": "src/", "sources": ["a{k}.ts", "/b.ts"], "sourcesContent": ["x = \'/sc/{k}\'"], "mappings": ""}',
    "xml": '<r xmlns="http://ns{k}.example.com/x" href="/x/{k}">\n<i src="/src/{k}"/><script>go("/es/{k}")</script><use xlink:href="/u/{k}"/><f action=\'/a/{k}\'/></r>',
    "svg": '<svg xmlns:x="https://ns.example.com/{k}"><image href="/im/{k}.png"/>\n<a xlink:href="/l/{k}"/></svg>',
    "vue": '<template><a href="/v/{k}">x</a></template>\n<script>x = "/vs/{k}"</script><style>a { b: url(/vc/{k}) }</style>',
    "svelte": "<script>\nlet a = '/sv/{k}'; let b = 'no{k}'</script>\n<style>@import '/si/{k}.css';</style>",
}


def _parsed_sql() -> dict[str, str]:
    """SQL that reads the made contents with patterns of its own."""

    def rows(kind: str, *parts: tuple) -> str:
        """Parts: pattern, URL in terms of g1, detection, confidence, and, if not usual, category, technique, line."""
        doc = f"(SELECT o_orderkey AS doc_id, replace({quoted(PARSED[kind])}, '{{k}}', CAST(o_orderkey AS VARCHAR)) AS content FROM orders)"
        made = []
        for pattern, url, detection, confidence, *more in parts:
            category, technique, line = (*more, *(None, 0, "line")[len(more) :])
            fixed = quoted(category) if category else "CAST(NULL AS VARCHAR)"
            made.append(f"SELECT doc_id, {url} AS url, {line} AS line, '{detection}' AS detection_method, {fixed} AS fixed, '{confidence}' AS confidence, {technique} AS technique_id FROM ({scan_sql(doc, pattern, (1,))})")
        return f"""SELECT doc_id, url, CAST(line AS INTEGER) AS source_line, detection_method, coalesce(fixed, {category_sql("url")}) AS category, confidence, CAST(technique_id AS INTEGER) AS technique_id
            FROM ({" UNION ALL ".join(made)}) WHERE url NOT IN ('', '#')"""

    quoted_name = r"\"([^\"]+)\""
    rooted = "unnest(list_transform(regexp_extract_all(g1, '" + r"\"([^\"]+)\"" + "', 1), lambda x: CASE WHEN x[1] = '/' THEN x ELSE 'src/' || x END))"
    return {
        "html": rows(
            "html", (r'<a href="([^"]*)">(?:x</a>|</a>\n)', "g1", "html_a_href", "high"),
            (r'srcset="([^"]*)"', "unnest(list_transform(string_split(g1, ','), lambda x: split_part(trim(x), ' ', 1)))", "html_srcset", "high"),
            (r'data-\w+="(/[^"]+)"', "g1", "html_data_attr", "medium"), (r"onclick=\"[^\"]*'(/[^']*)'", "g1", "html_event_handler", "medium"),
            (r'<video src="([^"]*)"', "g1", "html_video_src", "high"), (r'poster="([^"]*)"', "trim(g1)", "html_video_poster", "high"),
            (r"(?i)content=\"\d+; url='([^']*)'", "g1", "html_meta_refresh", "high"),
        ),
        "css": rows("css", (r"url\(\s*[\"']?([^\"')]+?)[\"']?\s*\)", "CASE WHEN starts_with(g1, 'data:') THEN '' ELSE g1 END", "css_url", "high"), (rf"@import\s+{quoted_name}", "g1", "css_import", "high")),
        "json": rows("json", (r'"(?:url|Host|href)": "([^"]*)"', "g1", "json_url_key", "high"), (r'[\[,] ?"(/[^" ]+)"', "g1", "json_value", "medium")),
        "json_manifest": rows(
            "json_manifest", (r'"start_url": "([^"]*)"', "g1", "manifest_start_url", "high", "page_route", 46), (r'"scope": "([^"]*)"', "g1", "manifest_scope", "high", "page_route", 46),
            (r'"src": "([^"]*)"', "g1", "manifest_icon", "high", "static_asset", 46), (r'"src": "([^"]*)"', "g1", "json_url_key", "high"), (r'"start_url": "([^"]*)"', "g1", "json_value", "medium"),
        ),
        "json_broken": rows("json_broken", (r'"((?:https?://|/)[^"]+)"', "g1", "json_regex_fallback", "low")),
        "sourcemap": rows(
            "sourcemap", (r'"file": "([^"]*)"', "g1", "sourcemap_file", "high", "source_map", 44), (r'"sourceRoot": "([^"]*)"', "g1", "sourcemap_sourceRoot", "high", "source_map", 44),
            (r'"sources": \[([^\]]*)\]', rooted, "sourcemap_source", "high", "source_map", 44),
            (r'"sourcesContent": \[([^\]]*)\]', "unnest(regexp_extract_all(g1, '''(/[^'']+)''', 1))", "sourcemap_content", "medium", None, 44, "1"),
        ),
        "xml": rows(
            "xml", (r'[ :]href="([^"]*)"', "g1", "xml_href", "high"), (r'xlink:href="([^"]*)"', "g1", "xml_xlink_href", "high"), (r'\bsrc="([^"]*)"', "g1", "xml_src", "high"),
            (r"\baction='([^']*)'", "g1", "xml_action", "medium"), (r'xmlns="([^"]*)"', "g1", "xml_namespace", "low", "external_service"),
            (r'<script>[^<]*"([^"]*)"[^<]*</script>', "g1", "xml_embedded_script", "medium"),
        ),
        "svg": rows("svg", (r'[ :]href="([^"]*)"', "g1", "xml_href", "high"), (r'xlink:href="([^"]*)"', "g1", "xml_xlink_href", "high"), (r'xmlns:x="([^"]*)"', "g1", "xml_namespace", "low", "external_service")),
        "vue": rows(
            "vue", (r'<a href="([^"]*)"', "g1", "html_a_href", "high", None, 0, "line + 1"), (r'<script>[^<]*"([^"]*)"', "g1", "vue_svelte_script", "high", None, 0, "line + 1"),
            (r"url\(([^)]*)\)", "g1", "css_url", "high", None, 0, "line + 1"),
        ),
        "svelte": rows("svelte", (r"'(/[^']*)'; let", "g1", "vue_svelte_script", "high", None, 0, "line + 1"), (r"@import '([^']*)'", "g1", "css_import", "high", None, 0, "line + 1")),
    }


PARSED_SQL = _parsed_sql()


# ---- inputs and outputs -------------------------------------------------------------------

WRITTEN = 40
# Contents and names that the readers are to tell apart.
NAMES_MADE = ("a.js", "b.MJS", "c.tsx", "page", "d.htm", "e.json?x=1", "f.map", "g.SVG", "h.vue", "x.txt", "dir.js/y")
MIMES_MADE = ("", "text/html", "application/javascript", "image/svg+xml", "application/xml", "text/css", "application/json", "text/plain")
HEADS_MADE = ("", "  <!DOCTYPE html><p>", '{"a": 1}', "[1]", "<?xml version='1.0'?>", "<svg>", "plain", "a\0b")


def _written(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a file for each of the first orders, and some that a run must leave out; through the reader's own file system."""
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey").orderBy("o_orderkey").limit(WRITTEN).collect()
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = f"{shared or tempfile.gettempdir()}/weblode-files-{uuid.uuid4().hex}"
    contents = {f"{'ab'[k % 2]}{'-x' if k % 3 else ''}/f{k}.js": f'x("/shared/{k % 5}"); y("/own/{k}");\nz("/customer/{c}")' for k, c in keys}
    contents |= {"node_modules/no.js": '"/no/1"', ".hidden/no.js": '"/no/2"', "a/no.exe": '"/no/3"', "a/binary.js": '"/no/4"\0', "a/empty.js": "", "list.txt": "# urls\n\n http://x.example.com/1 \n//no\nftp://y\n"}
    for name, content in contents.items():
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(content, "utf-8"))
        out.close()
    return root


def _name(column: str) -> Column:
    return F.regexp_replace(column, "^.*/weblode-files-[^/]*/", "")


def collect_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over a folder: which file is the first to have each URL."""
    docs = files.collect(spark, folders=[_written(spark, sf_dir)])
    return engine.extract(docs, techniques=(2,), with_parsers=False).select("url", _name("source_file").alias("name"), "source_line")


def collect_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over single files, named from the last order to the first, each twice."""
    root = _written(spark, sf_dir)
    names = [r["file_name"] for r in files.folder(spark, root).select("file_name").collect()]
    numbered = [n for _, n in sorted(((int(n.rsplit("/f", 1)[1].removesuffix(".js")), n) for n in names if not n.endswith("/empty.js")), reverse=True)]
    docs = files.collect(spark, paths=numbered + numbered[::-1])
    return engine.extract(docs, techniques=(2,), with_parsers=False).select("url", _name("source_file").alias("name"), "source_line")


def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a run in which a file, a folder and a list are missing and one file is binary."""
    root = _written(spark, sf_dir)
    inputs = files.read_inputs(spark, lists=[f"{root}/gone.txt"], paths=[f"{root}/gone.js"], folders=[root, f"{root}/gone"])
    return relational.totals(inputs.docs, engine.extract(inputs.docs, techniques=(2,), with_parsers=False, sort=False), inputs.rejected)


def rejected_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _written(spark, sf_dir)
    found = files.rejected(spark, [f"{root}/a/binary.js", f"{root}/gone.js", f"{root}/a/empty.js"], folders=[root])
    return found.select(F.regexp_replace("file_name", "^.*/weblode-files-[^/]*/", "").alias("name"), "reason")


def url_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.url_list(spark, f"{_written(spark, sf_dir)}/list.txt").select("url")


def file_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types by name, MIME type and first characters for made names and contents."""
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    pick = lambda by, values: F.element_at(F.array(*map(F.lit, values)), (F.floor(F.col("o_orderkey") / by) % len(values) + 1).cast("int"))
    made = keys.select("o_orderkey", pick(1, NAMES_MADE).alias("name"), pick(7, MIMES_MADE).alias("mime"), pick(3, HEADS_MADE).alias("content"))
    return made.select("o_orderkey", detect.file_type(F.col("name"), F.nullif("mime", F.lit("")), F.col("content")).alias("file_type"), detect.is_binary(F.encode("content", "UTF-8")).alias("is_binary"))


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = relational.with_category(registry.apply(made_documents(spark, sf_dir, 16), 16))
    named = hits.withColumn("source_file", F.concat(F.col("doc_id").cast("string"), F.lit(".js"))).withColumn("headers", F.create_map().cast("map<string,string>"))
    return named.select(sinks.full_json().alias("value"))


def _mixed_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, (relational.with_category(registry.apply(made_documents(spark, sf_dir, t), t)) for t in (10, 13, 16, 20)))


def category_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each category's list: the hits of four techniques."""
    return _mixed_hits(spark, sf_dir).select(sinks.category_file().alias("file"), sinks.text_line(methods=True).alias("line"))


def summary_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.summary_lines(_mixed_hits(spark, sf_dir))


def sorted_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each URL in the order of results, from where rows stand in the sorted partitions."""
    urls = relational.with_category(spark.read.parquet(f"{sf_dir}/pages.parquet").select("url", F.lit("").alias("http_method"), F.lit(None).cast("string").alias("category")).distinct())
    placed = relational.ordered(urls).select("url", F.monotonically_increasing_id().alias("at"))
    return placed.select("url", F.row_number().over(Window.orderBy("at")).cast("long").alias("place"))


def _io_sql() -> dict[str, str]:
    key = "o_orderkey"
    names = f"""SELECT {key} AS k, o_custkey AS c, CASE {key} % 2 WHEN 0 THEN 'a' ELSE 'b' END || CASE WHEN {key} % 3 <> 0 THEN '-x' ELSE '' END || '/f' || {key} || '.js' AS name
        FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT {WRITTEN})"""
    found = "SELECT name, k, '/shared/' || k % 5 AS url, 1 AS line FROM written UNION ALL SELECT name, k, '/own/' || k, 1 FROM written UNION ALL SELECT name, k, '/customer/' || c, 2 FROM written"
    first = "SELECT url, name, CAST(line AS INTEGER) AS source_line FROM found QUALIFY row_number() OVER (PARTITION BY url ORDER BY {}) = 1"
    head = f"WITH written AS ({names}), found AS ({found})"
    picked = lambda by, values: f"([{', '.join(map(quoted, values))}])[CAST(floor({key} / {by}) AS BIGINT) % {len(values)} + 1]"
    heads = tuple(h.replace("\0", "#") for h in HEADS_MADE)
    by_mime = """CASE WHEN contains(mime, 'html') THEN 'html' WHEN contains(mime, 'javascript') THEN 'js' WHEN contains(mime, 'json') THEN 'json' WHEN contains(mime, 'svg') THEN 'svg'
        WHEN contains(mime, 'xml') THEN 'xml' WHEN contains(mime, 'css') THEN 'css' END"""
    by_head = """CASE WHEN starts_with(head, '<!doctype html') THEN 'html' WHEN head[1] IN ('{', '[') THEN 'json' WHEN starts_with(head, '<?xml') OR starts_with(head, '<svg') THEN 'xml'
        ELSE 'unknown' END"""
    every = " UNION ALL ".join(f"SELECT url, http_method, category FROM ({hits_sql(documents_sql(t), _rules(t), t, False)})" for t in (10, 13, 16, 20))
    lists = " ".join(f"WHEN '{c}' THEN '{f}'" for c, f in U.CATEGORY_FILES.items())
    shown = ", ".join(map(quoted, relational.SHOWN))
    json_of = """'{"url":"' || url || '","source_file":"' || doc_id || '.js","source_line":' || source_line || ',"detection_method":"xmlhttprequest","http_method":"' || http_method || '",'
        || CASE WHEN params <> '' THEN '"query_params":["' || replace(params, ',', '","') || '"],' ELSE '' END || '"category":"' || category || '","confidence":"high","technique_id":16}'"""
    return {
        "collect_files": f"{head} {first.format('translate(name, chr(47), chr(1))')}",
        "collect_arguments": f"{head} {first.format('k DESC')}",
        "run_totals": f"{head} SELECT CAST((SELECT count(*) FROM written) + 4 AS BIGINT) AS processed, count(DISTINCT url) AS urls, CAST(4 AS BIGINT) AS errors FROM found",
        "rejected_inputs": "SELECT * FROM (VALUES ('a/binary.js', 'binary'), ('gone.js', 'not found'), ('a/binary.js', 'binary')) AS r(name, reason)",
        "url_list": "SELECT * FROM (VALUES ('http://x.example.com/1'), ('ftp://y')) AS l(url)",
        "file_types": f"""SELECT o_orderkey, coalesce(by_name, {by_mime}, {by_head}) AS file_type, contains(head, '#') AS is_binary FROM (
            SELECT o_orderkey, {picked(7, MIMES_MADE)} AS mime, lower(ltrim({picked(3, heads)})) AS head,
                   CASE lower(regexp_extract({picked(1, NAMES_MADE)}, '\\.([^./]*)$', 1)) WHEN 'js' THEN 'js' WHEN 'mjs' THEN 'js' WHEN 'tsx' THEN 'ts' WHEN 'htm' THEN 'html'
                   WHEN 'map' THEN 'sourcemap' WHEN 'svg' THEN 'svg' WHEN 'vue' THEN 'vue' END AS by_name
            FROM orders)""",
        "json_lines": f"SELECT {json_of} AS value FROM ({hits_sql(documents_sql(16), (calls.XHR,), 16, False)})",
        "category_files": f"SELECT CASE category {lists} END AS file, concat_ws(' ', nullif(http_method, ''), url) AS line FROM ({every})",
        "summary_in_order": f"""SELECT CAST(coalesce(list_position([{shown}], category), {len(relational.SHOWN) + 1}) AS INTEGER) AS place,
            CASE WHEN category IN ({shown}) THEN category ELSE 'other' END AS category, count(*) AS urls FROM ({every}) GROUP BY ALL""",
        "sorted_results": f"SELECT url, row_number() OVER (ORDER BY {category_sql('url')}, url) AS place FROM (SELECT DISTINCT url FROM pages)",
    }


IO_QUERIES: dict[str, Query] = {
    "collect_files": collect_files, "collect_arguments": collect_arguments, "run_totals": run_totals, "rejected_inputs": rejected_inputs, "url_list": url_list, "file_types": file_types,
    "json_lines": json_lines, "category_files": category_files, "summary_in_order": summary_in_order, "sorted_results": sorted_results,
}

QUERIES: dict[str, Query] = (
    {f"t{t:02d}_{name}": technique_query(t) for t, name in enumerate(registry.NAMES, 1)}
    | {f"parse_{kind}": parser_query(kind.split("_")[0], content) for kind, content in PARSED.items()}
    | IO_QUERIES
    | {
        "pages_relative_paths": pages_relative_paths,
        "categorize": categorize,
        "validate": validate,
        "dedup_first_wins": dedup_first_wins,
        "scope_include_exclude": filters,
        "category_summary": summary,
        "extract_pages": extract_pages,
        "technique_confidence_rollup": technique_rollup,
        "text_format": text_format,
        "csv_format": csv_format,
        "unseen": unseen,
    }
)
ORACLE_SQL: dict[str, str] = _oracle() | _io_sql() | {f"parse_{kind}": sql for kind, sql in PARSED_SQL.items()}
