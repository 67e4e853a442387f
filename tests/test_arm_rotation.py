"""Arms are rotated over the frames of every clip."""

import os

from loomspan.plans import registry, views

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_every_arm_sees_every_frame(spark):
    frames = sorted((r["clip"], r["frame"]) for r in views.det(spark, SF).select("clip", "frame").distinct().collect())
    assert len({c for c, _ in frames}) > 1
    got = {(r["clip"], r["frame"], r["slot"]): r["arm"] for r in registry.queries()["arm_rotation_clips"](spark, SF).collect()}
    expected, at = {}, {}
    for c, f in frames:
        i = at[c] = at.get(c, -1) + 1
        expected |= {(c, f, (j - i) % 3): arm for j, arm in enumerate("ABC")}
    assert got == expected
