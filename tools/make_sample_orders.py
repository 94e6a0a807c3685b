"""Write the sample order files of the tests: three months of one seller, with
the statuses, empty reasons, ties, line ends and column set that uploads have.

usage: python tools/make_sample_orders.py [folder]
"""

from __future__ import annotations

import os
import random
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from orderlens.schema import CATALOGUE_CATEGORIES  # noqa: E402

HEADER = "order_id,order_date,catalogue_id,sku_description,item_price,quantity,order_price,order_status,return_type,return_cost,return_reason"
REASONS = ["Wrong product", "Size issue", "Late delivery", "Damaged item", "Not as described"]
#: name, first id, month, (delivered, cancelled, returned), days with orders, colours, line end, reasons
FILES = [
    ("orders_a_2025_01.csv", 510001, 1, (60, 7, 13), 21, ["Amber", "Coral", "Ivory", "Olive", "Slate"], "\r\n", REASONS),
    ("orders_b_2025_02.csv", 620001, 2, (6, 9, 5), 11, ["Amber", "Coral", "Ivory", "Midnight Teal", "Pearl"], "\n", REASONS[:3]),
    ("orders_c_2025_03.csv", 730001, 3, (10, 9, 6), 17, ["Amber", "Coral", "Ivory", "Midnight Teal", "Pearl"], "\n", REASONS[1:4]),
]


def rows(first: int, month: int, counts, days: int, colours, reasons, rnd: random.Random) -> list[list]:
    n = sum(counts)
    status = [s for s, k in zip(("delivered", "cancelled", "returned"), counts, strict=True) for _ in range(k)]
    rnd.shuffle(status)
    chosen = rnd.sample(range(1, 29), days)
    day = chosen + [rnd.choice(chosen) for _ in range(n - days)]
    rnd.shuffle(day)
    known = [c for c, _ in CATALOGUE_CATEGORIES] if month == 1 else []
    ids = known + rnd.sample(range(100_000_000, 999_999_999), n - len(known))
    out = []
    for i in range(n):
        price, quantity = rnd.randint(150, 1950), rnd.randint(1, 4)
        back = status[i] == "returned"
        by = rnd.choice(["rto", "customer"]) if back else ""
        out.append([first + i, f"{day[i]:02d}-{month:02d}-2025", ids[i], f"Reading Lamp {rnd.choice(colours)}", price, quantity, price * quantity, status[i], by,
                    rnd.randint(40, 260) if by == "customer" else 0, rnd.choice(reasons) if back else ""])
    return out


def main(folder: str) -> None:
    rnd = random.Random(4025)
    for name, first, month, counts, days, colours, end, reasons in FILES:
        with open(os.path.join(folder, name), "w", newline="") as f:
            f.write(end.join([HEADER, *(",".join(map(str, r)) for r in rows(first, month, counts, days, colours, reasons, rnd))]) + end)


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "tests/data")
