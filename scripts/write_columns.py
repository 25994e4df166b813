"""Record the output column names of every registered query in
ticketlens/plans/columns.json (used by ``oracle_sql`` to align the pandas
representation of timestamps and nullable integers; checked by the tests)."""

import json
import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from ticketlens.plans import QUERIES  # noqa: E402
from ticketlens.session import get_session  # noqa: E402

spark = get_session("local[4]", shuffle_partitions=4)
cols = {name: fn(spark, "/root/testdata/sf0.001").columns for name, fn in QUERIES.items()}
with open(os.path.join(ROOT, "ticketlens", "plans", "columns.json"), "w", encoding="utf-8") as f:
    json.dump(cols, f, ensure_ascii=False, indent=1, sort_keys=True)
print(len(cols))
