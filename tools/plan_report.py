"""Per-query physical plan summary: shuffles, single-partition exchanges,
broadcasts, sort-merge joins, Python stages, group limits, forbidden operators.

Usage: python tools/plan_report.py [sf_dir]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rosterlake.catalog import QUERIES  # noqa: E402
from rosterlake.plans.checks import summary  # noqa: E402
from rosterlake.session import get_session  # noqa: E402


def main(argv):
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = get_session()
    keys = None
    for name, fn in sorted(QUERIES.items()):
        df = fn(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        s = summary(df)
        if keys is None:
            keys = list(s)
            print(f"{'query':26s} " + " ".join(f"{k[:10]:>10s}" for k in keys))
        print(f"{name:26s} " + " ".join(f"{s[k]:10d}" for k in keys))


if __name__ == "__main__":
    main(sys.argv[1:])
