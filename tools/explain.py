"""Print the formatted physical plan of registered queries (for review of
pushdown, pruning, exchanges and codegen spans)."""

from __future__ import annotations

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def main() -> None:
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    names = sys.argv[1:]
    from tabaudit.session import local_session
    from tabaudit.plans.catalog import REGISTRY
    spark = local_session()
    for n in names or list(REGISTRY):
        print("=" * 30, n)
        REGISTRY[n](spark, sf).explain("formatted")


if __name__ == "__main__":
    main()
