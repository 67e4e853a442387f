"""Label queries over every frame."""

import os
from collections import defaultdict

from loomspan.plans import layout_queries, registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def placed(rows: list) -> dict:
    """Labels of one frame moved up by hand: {idx: (y, unresolved)}."""
    boxes, out = [], {}
    for r in sorted(rows, key=lambda r: (-r["priority"], r["idx"])):
        x0, x1, step = r["cx"] - r["w"] / 2, r["cx"] + r["w"] / 2, max(1.0, r["h"] * 0.75)
        for k in range(6):
            y = r["top"] - k * step
            free = all(x1 <= a or x0 >= b or y + r["h"] <= c or y >= d for a, b, c, d in boxes)
            if free or k == 5:
                break
        boxes.append((x0, x1, y, y + r["h"]))
        out[r["idx"]] = round(y, 4), k == 5
    return out


def test_label_queries_take_every_frame(spark):
    frames = defaultdict(list)
    for r in layout_queries.views.det(spark, SF).selectExpr("clip", "frame", "idx", "(x + w / 2) * 1280 AS cx", "(y - h) * 720 - 20 AS top", "30.0e0 + idx % 3 * 10 AS w", "14.0e0 AS h", "h * 720 AS priority").collect():
        frames[r["clip"], r["frame"]].append(r)
    assert any(f % 4 for _, f in frames)
    expected = {(*k, i): v for k, rows in frames.items() for i, v in placed(rows).items()}
    got = registry.queries()["label_collisions_whole"](spark, SF).collect()
    assert len(got) == len(expected)
    for r in got:
        y, unresolved = expected[r["clip"], r["frame"], r["idx"]]
        assert abs(r["y"] - y) < 2e-4 and r["unresolved"] == unresolved
    for name in ("overlap_alpha_whole", "density_alpha_whole"):
        assert {(r["clip"], r["frame"], r["idx"]) for r in registry.queries()[name](spark, SF).collect()} == set(expected)
