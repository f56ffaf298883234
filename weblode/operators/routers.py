"""Layer 3: techniques 34-40, framework routes and API operations."""

from __future__ import annotations

import re
from collections.abc import Iterator

from weblode.functions.scan import MIB, Hit, Rule, Technique, Texts, first_of_each, hit, ruled, scan, scan_all

# The patterns of the detection rules.
W = r"[\t\n\f\r ]*"
S = r"[\t\n\f\r ]+"
V = "[\"']([^\"']+)[\"']"


def _route(pattern: str, gate: str, **more) -> Rule:
    return Rule(pattern, category=more.pop("category", "page_route"), confidence="high", gate=(gate,), cap=MIB, **more)


REACT = (
    _route(rf"<Route{S}(?:exact{S})?path{W}={W}{V}", "<Route"),
    _route(rf"<Link{S}[^>]*to{W}={W}{V}", "<Link"),
    _route(rf"<NavLink{S}[^>]*to{W}={W}{V}", "<NavLink"),
    _route(rf"{S}to{W}={W}[\"'](/[^\"']+)[\"']", "to"),
    _route(rf"(?:useNavigate|navigate){W}\({W}{V}", "avigate"),
    _route(rf"\{{{W}path{W}:{W}{V}", "path"),
)
VUE = (
    _route(rf"(?s)(?:routes{W}:{W}\[.*?)?\{{{W}path{W}:{W}{V}", "path"),
    _route(rf"<router-link{S}[^>]*to{W}={W}{V}", "<router-link"),
    _route(rf"<router-link{S}[^>]*:to{W}={W}{V}", "<router-link"),
    _route(rf"this\.\$router\.push{W}\({W}{V}", "$router"),
    _route(rf"router\.push{W}\({W}\{{{W}path{W}:{W}{V}", "router.push"),
)
ANGULAR = (
    _route(rf"(?s)RouterModule\.for(?:Root|Child){W}\({W}\[.*?\{{{W}path{W}:{W}{V}", "RouterModule"),
    _route(rf"routerLink{W}={W}{V}", "routerLink"),
    _route(rf"\[routerLink\]{W}={W}[\"']{W}\[{W}{V}", "[routerLink]"),
    _route(rf"this\.router\.navigate{W}\({W}\[{W}{V}", "router.navigate"),
    _route(rf"\{{{W}path{W}:{W}{V}{W},{W}component{W}:", "component"),
)


def api_or_page(u: str) -> str:
    return "api_endpoint" if u.startswith("/api/") else "page_route"


NEXT = (
    _route(rf"<Link{S}[^>]*href{W}={W}{V}", "<Link", category=api_or_page),
    _route(rf"(?:useRouter\(\)\.push|router\.push){W}\({W}{V}", ".push", category=api_or_page),
    _route(rf"router\.replace{W}\({W}{V}", "router.replace", category=api_or_page),
    _route(r"[\"'](/api/[a-zA-Z0-9/_\-\[\]]+)[\"']", "/api/", category=api_or_page),
)
EXPRESS = Rule(
    rf"(?:app|router)\.(get|post|put|delete|patch|options|head|use){W}\({W}{V}",
    group=2, method=1, category="api_endpoint", confidence="high", gate=("app.", "router."),
)


def _named(u: str) -> str:
    return "graphql:" + u


GRAPHQL = (
    Rule(rf"(?:query|mutation|subscription){S}([A-Za-z_][A-Za-z0-9_]*){W}(?:\([^)]*\){W})?\{{", category="api_endpoint", cap=MIB, gate=("query", "mutation", "subscription"), change=_named),
    Rule(rf"(?:^|[^A-Za-z_])(query|mutation|subscription){W}\{{", category="api_endpoint", cap=MIB, gate=("query", "mutation", "subscription"), change=_named),
    Rule(r"[\"']([^\"']*(?:/graphql|/gql)[^\"']*)[\"']", category="api_endpoint", gate=("/graphql", "/gql")),
)
GQL_TAG = rf"gql{W}`([^`]*)`"
GQL_NAME = re.compile(rf"(?:query|mutation|subscription){S}([A-Za-z_][A-Za-z0-9_]*)")
REST = Rule(r"[\"'](/api/[a-z][a-z0-9_-]*s)(?:/[^\"']*)?[\"']", gate=("/api/",))
REST_ACTIONS = ("", "/{id}", "/create", "/update", "/delete")


def _express(texts: Texts) -> Iterator[Hit]:
    """`use` mounts middleware for no method in particular."""
    for h in scan(texts, EXPRESS, "express_routes"):
        yield (*h[:3], "" if h[3] == "USE" else h[3], *h[4:])


def _graphql(texts: Texts) -> Iterator[Hit]:
    yield from scan_all(texts, GRAPHQL, "graphql_ops")
    for doc, line, (_, body) in texts.matches(GQL_TAG, (1,), texts.having(("gql`", "gql `"))):
        for name in GQL_NAME.findall(body):
            yield hit(doc, _named(name), line, "medium", "graphql_ops", "api_endpoint")


def _rest(texts: Texts) -> Iterator[Hit]:
    """Each collection path once, with the endpoints that such a collection usually has."""
    for base in first_of_each(scan(texts, REST, "rest_inference")):
        for action in REST_ACTIONS:
            yield hit(base[0], base[1] + action, base[2], "low", "rest_inference", "inferred")


TECHNIQUES = {
    34: ruled("react_router", REACT),
    35: ruled("vue_router", VUE),
    36: ruled("angular_router", ANGULAR),
    37: ruled("nextjs", NEXT),
    38: Technique("express_routes", _express, EXPRESS.gate),
    39: Technique("graphql_ops", _graphql, ("query", "mutation", "subscription", "/graphql", "/gql", "gql")),
    40: Technique("rest_inference", _rest, REST.gate),
}
