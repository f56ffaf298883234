import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from weblode.operators import registry
from weblode.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


def test_registry(spark):
    assert len(registry.NAMES) == 67 and set(registry.EXPRESSIONS) == set(range(1, 68)) == set(queries.TEMPLATES)
    table = registry.techniques(spark)
    assert table.count() == 67 and table.where("enabled").count() == 67
    assert [registry.layer_of(t) for t in (1, 14, 15, 33, 40, 41, 50, 54, 67)] == [1, 1, 2, 2, 3, 4, 5, 6, 7]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """The smallest tables with thirty orders and pages: enough for each comparison."""
    folder = tmp_path_factory.mktemp("tables")
    for name in TABLES:
        table = spark.read.parquet(f"{DATA}/{name}.parquet")
        pq.write_table((table.limit(30) if name in ("orders", "pages", "documents") else table.limit(5)).toArrow(), folder / f"{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, small, name):
    frame = queries.QUERIES[name](spark, small)
    columns = sorted(frame.columns)
    with duckdb.connect() as con:
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
        relation = con.execute(queries.ORACLE_SQL[name])
        names = [c[0] for c in relation.description]
        expected = sorted(tuple(r[names.index(c)] for c in columns) for r in relation.fetchall())
    assert sorted(names) == columns
    assert sorted(tuple(r) for r in frame.select(*columns).collect()) == expected
    assert expected


# What the techniques without SQL find in their templates, with keys 7 and 9.
FOUND = {
    7: ["/a/7/{{DYNAMIC}}/b", "{{DYNAMIC}}/b", "{{DYNAMIC}}/c/9"],
    12: ["/enc/7", "/a/", "/a/", "/enc/7", "/a/9", "/a/7"],
    15: ["/api/orders/7", "/get/9?a=1&b=2"],
    17: ["/ax/7?q=1", "/axc/9"],
    18: ["/jq/obj7", "/jq/text7", "/jq/get7?x=1", "/jq/post9"],
    27: [],
    28: ["https://t7.example.com/"],
    29: ["/form/7", "/plain/9?a=1"],
    32: ["a/7", "./ctx/9", "m/7"],
    33: ["/dyn/7.js"],
    39: ["graphql:Get7", "graphql:Tag9", "graphql:mutation", "/graphql?op=7", "graphql:Tag9"],
    57: ["https://l7.example.com/a", "https://k7.example.com/c", "https://s9.example.com/b", "/ex/9"],
    59: ["/old/7", "/blk/9"],
    60: ["https://b64.example.com/path"],
    61: ["/a/b"],
    62: ["/a/b"],
    63: ["/arr/7", "https://z9.example.com/q"],
    64: ["/a/b"],
    65: ["/atob/1"],
    66: ["/reverse/7", "/x/9"],
}


@pytest.mark.parametrize("technique", sorted(FOUND))
def test_found(spark, technique):
    text = queries.TEMPLATES[technique].replace("{k}", "7").replace("{c}", "9")
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "plain words")], "doc_id long, content string")
    found = registry.apply(docs, technique).collect()
    assert {r.doc_id for r in found} <= {1}
    assert [r.url for r in found] == FOUND[technique]


HOSTILE = [
    "\x00" * 1000,
    "0" * 100_000,
    "{" * 5000,
    "(" * 5000,
    "`" * 5000,
    '"' * 5000,
    '"data:image/png;base64,' + "A" * 300_000 + '"',
    '"' + "/seg" * 50_000 + '"',
    "a" * 100_000 + ' + "/x"',
    "1" * 50_000 + "a + '/y'",
    '"a" + ' * 5000 + '"/b"',
    "/*" * 3000,
    "<!--" * 3000,
    "https://" + "a." * 20_000,
    "fetch(" * 2000,
    "\\u0041" * 20_000,
    "to" * 20_000 + " " * 20_000,
]


def test_hostile_contents_end(spark):
    """No pattern overflows the stack or backtracks without end."""
    docs = spark.createDataFrame(list(enumerate(HOSTILE)), "doc_id long, content string")
    for technique in range(1, 68):
        assert registry.apply(docs, technique).agg(F.count("*")).first()[0] >= 0


def test_one_scan_for_all_techniques(spark, small):
    from weblode.plans import engine

    docs = engine.documents(spark.read.parquet(f"{small}/pages.parquet"), "page_id", "url", "html")
    plan = engine.all_hits(docs, with_parsers=False)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


def test_lines_count_from_the_match(spark):
    docs = spark.createDataFrame([(1, '\n"/a/1"\n\n"/b/1" "/c/1"\n')], "doc_id long, content string")
    assert [(r.url, r.source_line) for r in registry.apply(docs, 2).collect()] == [("/a/1", 2), ("/b/1", 4), ("/c/1", 4)]


@pytest.mark.parametrize(("text", "technique"), [("file.open('/a/b')", 24), ("mylocation = '/a/b'", 23), ("fetch('/never/closed'", 15), ("u = 'https://x.example.com/a'", 54)])
def test_near_misses(spark, text, technique):
    docs = spark.createDataFrame([(1, text)], "doc_id long, content string")
    assert registry.apply(docs, technique).count() == 0
