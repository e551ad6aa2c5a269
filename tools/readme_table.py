"""Regenerate the registered-query table at the end of README.md from the registry."""

from __future__ import annotations

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from retentia.plans.catalog import REGISTRY  # noqa: E402

MARK = "## Registered queries\n"


def main() -> None:
    path = os.path.join(ROOT, "README.md")
    text = open(path).read()
    head = text[: text.index(MARK) + len(MARK)]
    rows = ["", "| Query | Inventory ids | Check | What it computes |", "| --- | --- | --- | --- |"]
    for name, e in REGISTRY.items():
        doc = (e.build.__doc__ or "").strip().splitlines()[0]
        rows.append(f"| `{name}` | {e.ids} | {'SQL twin' if e.sql else 'rows only'} | {doc} |")
    open(path, "w").write(head + "\n".join(rows) + "\n")
    n, k = len(REGISTRY), sum(1 for e in REGISTRY.values() if e.sql)
    print(f"{n} queries, {k} with SQL twins")


if __name__ == "__main__":
    main()
