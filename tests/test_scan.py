"""Scans grow with text plus matches, and take any character as text."""

import time

import pyarrow as pa
import pytest

from weblode.functions.scan import SLICE_BYTES, Rule, Texts, scan, slices
from weblode.operators import registry
from weblode.plans import queries

ROWS = {
    2: 'a("/p/{}/x.json?q=1#top");\n',
    14: "c = '/three/{}/four?a=1';\n",
    15: "fetch('/f/{}'); fetch(u, [\n",
    50: 'u = "https://a{}.b.example.com/x"\n',
    55: "/* see https://b{}.example.com/x */\n",
    63: 'var a = ["/arr/{}", "word"]; var b = [\n',
}


def seconds(technique, times):
    text = "".join(ROWS[technique].format(n) for n in range(times))
    began = time.perf_counter()
    found = sum(1 for _ in registry.TECHNIQUES[technique].find(Texts(pa.array([text]))))
    return time.perf_counter() - began, found


@pytest.mark.parametrize("technique", sorted(ROWS))
def test_twice_the_matches_take_about_twice_the_time(technique):
    """Over three doublings, the last a text of a megabyte: at most 2.5 times the time for each."""
    seconds(technique, 1000)
    few, many = (min((seconds(technique, n) for _ in range(3)), key=lambda s: s[0]) for n in (5_000, 40_000))
    assert many[0] < 2.5**3 * few[0] + 0.1 and many[0] < 10
    assert few[1] < many[1]


def test_unclosed_calls_are_read_once():
    began = time.perf_counter()
    assert not list(registry.TECHNIQUES[15].find(Texts(pa.array(["fetch(" * 50_000]))))
    assert time.perf_counter() - began < 5


def test_private_characters_are_text():
    """Marks are characters that no content of the batch has, whatever it has."""
    odd = "".join(map(chr, range(0xE000, 0xE010))) + '"/a/b"' + chr(0xE000) + "\n" + '"/c/d"'
    texts = Texts(pa.array([odd, None, '"/e\\0/f"', '"/e/f"']))
    assert [(h[0], h[1], h[2]) for h in scan(texts, Rule("\"(/[a-z]/[a-z])\""), "x")] == [(0, "/a/b", 1), (0, "/c/d", 2), (3, "/e/f", 1)]


def test_slices_are_bounded():
    contents = pa.array(["x" * (SLICE_BYTES // 2)] * 3 + ["y" * (SLICE_BYTES * 2)] + [None, "z"])
    assert list(slices(contents)) == [(0, 2), (2, 1), (3, 1), (4, 2)]
    assert list(slices(pa.array([], pa.string()))) == []


def test_each_gate_holds_wherever_its_technique_hits():
    """What the native gate lets through is all that the technique can hit."""
    for number, technique in registry.TECHNIQUES.items():
        for text in (queries.TEMPLATES[number].replace("{k}", "7").replace("{c}", "9"), *queries.TEMPLATES.values()):
            if technique.gate and not any(m in text for m in technique.gate):
                assert not list(technique.find(Texts(pa.array([text])))), (number, text)


def test_hits_do_not_depend_on_the_batch():
    texts = [t.replace("{k}", "7").replace("{c}", "9") for t in queries.TEMPLATES.values()]
    for technique in registry.TECHNIQUES.values():
        together = list(technique.find(Texts(pa.array(texts))))
        alone = [(i, *h[1:]) for i, t in enumerate(texts) for h in technique.find(Texts(pa.array([t])))]
        assert sorted(together, key=lambda h: h[0]) == alone, technique.name
