"""Seconds and hits of each layer over one file: `python -m weblode.plans.layers FILE`. Needs no session."""

from __future__ import annotations

import sys
import time

import pyarrow as pa

from weblode.functions.scan import Texts
from weblode.operators import registry


def layer_times(content: str) -> list[tuple[int, float, int]]:
    """(layer, seconds, hits) of all techniques of each layer, without parsers, dedup or validation."""
    found = []
    for layer, (first, last) in registry.LAYERS.items():
        texts, began = Texts(pa.array([content])), time.perf_counter()
        hits = sum(1 for t in range(first, last + 1) for _ in registry.TECHNIQUES[t].find(texts))
        found.append((layer, time.perf_counter() - began, hits))
    return found


def main(argv: list[str]) -> int:
    if len(argv) != 1:
        print("one file, please", file=sys.stderr)
        return 1
    with open(argv[0], encoding="utf-8", errors="replace") as file:
        times = layer_times(file.read())
    for layer, seconds, hits in times:
        print(f"layer {layer}  {seconds:8.2f} s  {hits:7} hits")
    print(f"total    {sum(s for _, s, _ in times):8.2f} s  {sum(n for *_, n in times):7} hits")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
