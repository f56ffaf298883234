"""Layer 4: techniques 41-49, configuration and metadata."""

from __future__ import annotations

from collections.abc import Iterator

from weblode.functions.scan import Hit, Rule, Technique, Texts, hit, ruled, scan, scan_all

# The patterns of the detection rules.
W = r"[\t\n\f\r ]*"
V = "[\"']([^\"']+)[\"']"
ENV_GATE = ("process.env", "import.meta.env")
ENV_NAMES = (
    r"process\.env\.REACT_APP_[A-Z_][A-Z0-9_]*",
    r"process\.env\.NEXT_PUBLIC_[A-Z_][A-Z0-9_]*",
    r"process\.env\.VITE_[A-Z_][A-Z0-9_]*",
    r"process\.env\.VUE_APP_[A-Z_][A-Z0-9_]*",
    r"process\.env\.API_URL",
    r"process\.env\.[A-Z_][A-Z0-9_]*",
    r"import\.meta\.env\.VITE_[A-Z_][A-Z0-9_]*",
)
SPECIFIC_KEYS = ("baseURL", "baseUrl", "apiUrl", "apiURL", "serverUrl", "backendUrl", "webhookUrl", "serviceUrl", "hostname")
GENERIC_KEYS = ("endpoint", "host", "origin", "server", "backend", "gateway", "proxy", "webhook", "url")
FLAG_KEYS = ("experiment_url", "variant_url", "flag_endpoint", "feature_url", "ab_test_url", "toggle_endpoint")


def _value(keys: str) -> str:
    return rf"[\"']?(?:{keys})[\"']?{W}:{W}[\"']((?:https?://|/)[^\"']+)[\"']"


CONFIG = (*(Rule(_value(k), gate=(k,)) for k in SPECIFIC_KEYS), Rule(_value("|".join(GENERIC_KEYS)), gate=GENERIC_KEYS))
_PACK = ("publicPath", "__webpack")
PUBLIC_PATH = tuple(Rule(p + V, gate=_PACK) for p in (rf"__webpack_public_path__{W}={W}", rf"publicPath{W}:{W}", rf"__webpack_require__\.p{W}={W}"))
SOURCE_MAP = Rule(rf"//[#@]{W}sourceMappingURL{W}={W}([^\t\n\f\r ]+)", category="source_map", confidence="high", gate=("sourceMappingURL",))
BASE = Rule(rf"(?i)<base[\t\n\f\r ]+[^>]*href{W}={W}{V}", confidence="high", gate=("<base",))
_MANIFEST = ("start_url", '"scope"', '"short_name"')
MANIFEST = tuple(
    Rule(rf'"{key}"{W}:{W}"([^"]+)"', category=kind, confidence="high", gate=_MANIFEST)
    for key, kind in (("start_url", "page_route"), ("scope", "page_route"), ("src", "static_asset"), ("url", None))
)
SITEMAP = (
    Rule(r"[\"']((?:https?://)?[^\"'\t\n\f\r ]*(?:sitemap[^\"'\t\n\f\r ]*\.xml|robots\.txt))[\"']", gate=("sitemap", "Sitemap", "robots")),
    Rule(rf"<loc>{W}(https?://[^<\t\n\f\r ]+){W}</loc>", gate=("<loc>",)),
    Rule(rf"(?im)^Sitemap:{W}(https?://[^\t\n\f\r ]+)", gate=("sitemap", "Sitemap")),
    Rule(rf"(?i)(?:Disallow|Allow):{W}(/[^\t\n\f\r ]+)", category="page_route", gate=("Disallow", "Allow:")),
)
_OPENAPI = ('"openapi"', '"swagger"', "'openapi'", "'swagger'", "openapi:", "swagger:")
OPENAPI_PATH = Rule(
    rf'"(/[a-zA-Z0-9_\-{{}}/.]+)"{W}:{W}\{{', category="api_endpoint", confidence="high", gate=_OPENAPI,
    keep=lambda u: u.count("/") >= 2,
)
SWAGGER_UI = Rule(r"[\"']((?:https?://)?[^\"'\t\n\f\r ]*swagger-ui[^\"'\t\n\f\r ]*)[\"']", category="api_endpoint", confidence="high", gate=("swagger-ui",))
SPEC_FILE = Rule(r"[\"']((?:https?://)?[^\"'\t\n\f\r ]*(?:swagger|openapi)\.(?:json|yaml|yml))[\"']", category="api_endpoint", confidence="high", gate=_OPENAPI)
FLAGS = tuple(Rule(rf"[\"']?{k}[\"']?{W}[:=]{W}{V}", confidence="low", gate=(k,)) for k in FLAG_KEYS)


def _env(texts: Texts) -> Iterator[Hit]:
    """A variable's default where one follows, else its name."""
    for name in ENV_NAMES:
        for doc, line, (_, variable, default) in texts.matches(rf"({name})(?:{W}(?:=|:|\|\|){W}{V})?", (1, 2), texts.having(ENV_GATE)):
            yield hit(doc, default or variable, line, "medium", "env_variables")


def _openapi(texts: Texts) -> Iterator[Hit]:
    specified = texts.having(('"paths"',))
    yield from (h for h in scan(texts, OPENAPI_PATH, "openapi_swagger") if specified[h[0]])
    yield from scan_all(texts, (SWAGGER_UI, SPEC_FILE), "openapi_swagger")


TECHNIQUES = {
    41: Technique("env_variables", _env, ENV_GATE),
    42: ruled("config_objects", CONFIG),
    43: ruled("webpack_public_path", PUBLIC_PATH),
    44: ruled("sourcemap_refs", (SOURCE_MAP,)),
    45: ruled("base_tags", (BASE,)),
    46: ruled("manifest_files", MANIFEST),
    47: ruled("sitemap_robots", SITEMAP),
    48: Technique("openapi_swagger", _openapi, (*_OPENAPI, "swagger-ui")),
    49: ruled("feature_flags", FLAGS),
}
