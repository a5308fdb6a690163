"""Coverage table: python -m ridewave.queries.coverage > COVERAGE.md"""

from __future__ import annotations

import re
from collections import defaultdict

from ridewave.queries import load


def main() -> None:
    by_id = defaultdict(list)
    for q in load().values():
        for i in q.ids:
            by_id[i].append(q)
    order = sorted(by_id, key=lambda i: ("SPJAWTUFMGXE".index(i[0]), int(re.sub(r"\D", "", i))))
    print("# Coverage\n\nInventory id, registered queries, and how each is checked (SQL: compared value by value; rows: rows only,")
    print("rules in `tests/test_rules.py`).\n\n| id | queries | check |\n| --- | --- | --- |")
    for i in order:
        names = ", ".join(f"`{q.name}`" for q in by_id[i])
        kinds = {"SQL" if q.sql else "rows" for q in by_id[i]}
        print(f"| {i} | {names} | {' + '.join(sorted(kinds))} |")


if __name__ == "__main__":
    main()
