import pytest
from pyspark.sql import functions as F

from weblode.functions import decode, urls as U


def evaluate(spark, function, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, u string")
    return [r.x for r in rows.select("i", function(F.col("u")).alias("x")).orderBy("i").collect()]


CATEGORIES = {
    "wss://a.example.com/s": "websocket",
    "ws:x": "websocket",
    "app.js.map": "source_map",
    "data:text/plain,x": "data_uri",
    "mailto:a@b.co": "mailto",
    "intent://x": "custom_protocol",
    "https://b.s3.amazonaws.com/k": "cloud_resource",
    "http://svc.internal/a": "internal_infra",
    "http://172.16.0.1/": "internal_infra",
    "http://172.31.9.9/": "internal_infra",
    "/v10.2/x": "internal_infra",
    "/API/users": "api_endpoint",
    "/v2/x": "api_endpoint",
    "/graphql": "api_endpoint",
    "/a/b.png": "static_asset",
    ".js": "page_route",
    "/a/b.PNG": "page_route",
    "https://example.com/": "external_service",
    "http://172.32.0.1/": "external_service",
    "/about": "page_route",
}


def test_categories(spark):
    assert dict(zip(CATEGORIES, evaluate(spark, U.categorize_url, CATEGORIES), strict=True)) == CATEGORIES


REJECTED = [
    "", "x", "/", "//", "*", "..", "/a b", "/a\tb", "a\x01/b", "text/html", "image/x.png", "1.2.3", "2Fpath", "253Ax", "function(x)", "null.example.com",
    "{{DYNAMIC}}//x", "/a\\x2f", "n/a", "true/false", "lodash/fp", "@scope/x.js", "?a=1", "tg://resolve", "/" + "a" * 2048,
]
KEPT = [
    "/a", "./a", "../a", "#/route", "//cdn.example.com", "https://example.com", "data:text/plain,a b", "graphql:Op", "process.env.X", "example.com",
    "1a.example", "é.example", "/t/{{DYNAMIC}}/x", "tg://a.b", "application/x.y?z", "data:" + "a" * 3000,
]


def test_validity(spark):
    assert not any(evaluate(spark, U.is_valid_url, REJECTED))
    assert all(evaluate(spark, U.is_valid_url, KEPT))


def test_null_is_no_url(spark):
    assert evaluate(spark, U.is_valid_url, [None]) == [False]


CLEANED = {"a.": "a", "a).": "a", "f(x)": "f(x)", "f(x)).": "f(x)", "a;:!?": "a", "((a)": "((a)", "": "", "...": "", "a'\"`": "a", "f(x),": "f(x)"}


def test_clean_url_agrees_with_its_twin(spark):
    assert dict(zip(CLEANED, evaluate(spark, U.clean_url, CLEANED), strict=True)) == CLEANED
    assert {k: decode.clean(k) for k in CLEANED} == CLEANED


def test_query_params(spark):
    values = ["/a", "/a?x=1&y&x=2#z?w=1", "/a?", "/a?=1& b =2"]
    expected = [[], ["x", "y", "x"], [], ["b"]]
    assert evaluate(spark, U.query_params, values) == expected
    assert [decode.names_in_query(v) for v in values] == expected


def test_text_urls(spark):
    found = evaluate(spark, U.text_urls, ["see https://a.example.com/x, or (/p/q) and d.e.fr!"])[0]
    assert found == ["https://a.example.com/x", "//a.example.com/x", "/p/q", "a.example.com/x", "d.e.fr"]


@pytest.mark.parametrize(
    ("text", "plain"),
    [("L2EvYg==", "/a/b"), ("L2EvYg", "/a/b"), ("L2Ev-_==", None), ("_-", None), ("aGk", "hi"), ("a", None), ("AAAA", None), ("L2E_L2I", None)],
)
def test_base64(text, plain):
    assert decode.from_base64(text) == plain or plain is None


def test_call_arguments():
    text = """f(a, "x,)(", {b: [1, 2]}, g(')'))"""
    call = decode.call_text(text, 1)
    assert [decode.argument(call, i) for i in range(5)] == ["a", '"x,)("', "{b: [1, 2]}", "g(')')", ""]
    assert decode.call_text("f(never closed", 1) == ""
    assert decode.literal("`x`") == "x" and decode.literal("x") == "" and decode.literal("'a' + b") == "a"


def test_lines():
    line = decode.Lines("a\nb\n\nc")
    assert [line(i) for i in (0, 1, 2, 3, 4, 5)] == [1, 1, 2, 2, 3, 4]
