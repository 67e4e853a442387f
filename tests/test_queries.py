"""Every query with SQL agrees with it; the others return rows of a fixed shape."""

import os

import numpy as np
import pandas as pd
import pytest

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

from loomspan.plans import registry  # noqa: E402

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="session")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    def one(v):
        if isinstance(v, (list, np.ndarray)):
            return str([str(x) for x in v])
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "~"
        return repr(round(float(v), 6) + 0.0) if isinstance(v, (float, np.floating)) else str(v)

    cols = sorted(frame.columns)
    out = pd.DataFrame({c: pd.Series([one(v) for v in frame[c].astype(object)], dtype=str) for c in cols})
    for c in cols:  # a nullable integer column may come as floats
        if out[c].str.fullmatch(r"-?\d+\.0|~").all():
            out[c] = out[c].str.replace(r"\.0$", "", regex=True)
    return out.sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_agrees_with_sql(spark, db, name):
    got, expected = QUERIES[name](spark, SF).toPandas(), db.sql(ORACLE[name]).df()
    pd.testing.assert_frame_equal(normal(got), normal(expected))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_returns_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_tracks_keep_their_rules(spark):
    """One detection a track and frame, one track a detection, enough hits, and no step beyond the gate."""
    got = QUERIES["track_clip"](spark, SF).toPandas()
    assert not got.duplicated(["clip", "trk", "frame"]).any()
    assert not got.duplicated(["clip", "frame", "x", "y", "w", "h", "kit"]).any()
    assert (got.groupby(["clip", "trk"]).size() >= 3).all()
    assert (got.groupby(["clip", "trk"])["kit"].nunique() == 1).all()
    s = got.sort_values(["clip", "trk", "frame"])
    s["before"] = s.groupby(["clip", "trk"])["frame"].shift()
    seen = {c: np.unique(f) for c, f in s.groupby("clip")["frame"]}
    for r in s[s["frame"] - s["before"] > 7].itertuples():  # a track ends at the first frame that comes over 0.6 s after its last detection
        between = seen[r.clip][(seen[r.clip] > r.before + 6) & (seen[r.clip] < r.frame)]
        assert not len(between)
    drawn = QUERIES["track_pipeline"](spark, SF).toPandas()
    assert not drawn.duplicated(["clip", "trk", "seg", "frame"]).any()
    runs = drawn.groupby(["clip", "trk", "seg"])["frame"].agg(["min", "max", "size"])
    assert (runs["max"] - runs["min"] + 1 == runs["size"]).all()  # every frame of a stretch is there
    named = QUERIES["identity_labels"](spark, SF).toPandas()
    assert not named.duplicated(["clip", "trk"]).any() and named["label"].notna().all()
    first = named[named["number_source"] == "read"]
    lives = got.groupby(["clip", "trk"])["frame"].agg(["min", "max"]).reset_index().merge(first, on=["clip", "trk"])
    for _, g in lives.sort_values("min").groupby(["clip", "identity"]):
        assert (g["min"].to_numpy()[1:] > g["max"].to_numpy()[:-1]).all()  # of one identity no two at once


def test_flagship(spark):
    assert registry.flagship(spark, SF).count() > 0
