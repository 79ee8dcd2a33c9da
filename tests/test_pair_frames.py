"""Array frames of pair counting have a bound of their own, below that of windows."""

import numpy as np
import pandas as pd
import pytest

from cohortry.operators import pairs


def test_frames_are_bounded_below_the_windows(spark, monkeypatch):
    monkeypatch.setattr(pairs, "FRAME_ROWS", 25)
    monkeypatch.setattr(pairs, "chunk_count", lambda rows: 2)
    count_small, seen = pairs._count_small, []

    def watched(parts, keys, limit):
        seen.append((limit, parts.groupBy(*keys, "_case", "_part").count().agg({"count": "max"}).first()[0] or 0))
        return count_small(parts, keys, limit)

    monkeypatch.setattr(pairs, "_count_small", watched)
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"duration": rng.integers(1, 90, 240).astype(float), "event": rng.integers(0, 2, 240),
                        "score": rng.integers(0, 200, 240) / 8})
    row = pairs.concordance(spark.createDataFrame(pdf), []).first()
    assert seen and all(limit == 25 and largest <= 25 for limit, largest in seen)
    t, e, r = (pdf[c].to_numpy() for c in ("duration", "event", "score"))
    ok = (t[:, None] < t) & (e[:, None] == 1)
    assert (row.pairs, row.concordant, row.tied) == pytest.approx(
        (ok.sum(), (ok & (r[:, None] > r)).sum(), (ok & (r[:, None] == r)).sum()))


@pytest.mark.parametrize("frame", [25, 1000])
def test_frames_hold_numbers_only(spark, monkeypatch, frame):
    """Text keys stay outside the array frames, whose size they would multiply; NULL is a group like any other."""
    monkeypatch.setattr(pairs, "FRAME_ROWS", frame)
    monkeypatch.setattr(pairs, "chunk_count", lambda rows: 2)
    seen = []
    for name in ("_count_small", "_whole_groups"):
        def watched(parts, *rest, count=getattr(pairs, name)):
            seen.append({kind for _, kind in parts.dtypes})
            return count(parts, *rest)

        monkeypatch.setattr(pairs, name, watched)
    rng = np.random.default_rng(6)
    rows = [(m, "s" * 40, float(rng.integers(1, 50)), int(rng.integers(0, 2)), float(rng.integers(0, 30))) for m in ("a", None) for _ in range(150)]
    df = spark.createDataFrame(rows, "model string, stratum string, duration double, event int, score double")
    out = {r.model: r for r in pairs.concordance(df, ["model", "stratum"]).collect()}
    assert seen and all(not any("string" in kind for kind in kinds) for kinds in seen)
    for m in ("a", None):
        t, e, r = (np.array(x) for x in list(zip(*[row for row in rows if row[0] == m]))[2:])
        ok = (t[:, None] < t) & (e[:, None] == 1)
        assert out[m].stratum == "s" * 40
        assert (out[m].pairs, out[m].concordant, out[m].tied) == pytest.approx(
            (ok.sum(), (ok & (r[:, None] > r)).sum(), (ok & (r[:, None] == r)).sum()))
