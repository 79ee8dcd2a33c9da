"""Concordance: known values, brute force, chunked paths, hot values, weights."""

import numpy as np
import pandas as pd
import pytest

from cohortry.operators.metrics_surv import grouped_concordance, pool_components
from cohortry.operators.pairs import concordance


def frame(spark, duration, event, risk, **extra):
    pdf = pd.DataFrame({"duration": duration, "event": event, "score": risk, **extra})
    return spark.createDataFrame(pdf.astype({"duration": float, "score": float}))


def one(df, keys=(), **options):
    return concordance(df, list(keys), **options).toPandas().iloc[0]


def brute(pdf, tied):
    pairs = conc = ties = 0.0
    t, e, r, w = (pdf[c].to_numpy(float) for c in ("duration", "event", "score", "w"))
    for i in range(len(t)):
        if e[i] != 1:
            continue
        later = (t > t[i]) | ((t == t[i]) & (e == 0)) if tied else t > t[i]
        pairs += w[i] * w[later].sum()
        conc += w[i] * w[later & (r < r[i])].sum()
        ties += w[i] * w[later & (r == r[i])].sum()
    return pairs, conc, ties


def test_perfect_order(spark):
    row = one(frame(spark, [1, 2, 3, 4], [1, 1, 1, 1], [4, 3, 2, 1]))
    assert (row.pairs, row.c_index) == (6, 1.0)


def test_tied_event_and_censoring(spark):
    df = frame(spark, [1, 1, 2, 3], [1, 0, 1, 0], [3, 2, 1.5, 1])
    assert one(df, tied_censoring=True).pairs == 4
    assert one(df).pairs == 3


def test_strict_rule(spark):
    assert one(frame(spark, [1, 1, 2], [1, 0, 1], [3, 1, 2])).c_index == 1.0


def test_constant_risk_is_half(spark):
    row = one(frame(spark, [1, 2, 3], [1, 1, 0], [0, 0, 0]), tied_censoring=True)
    assert row.c_index == 0.5 and row.tied == row.pairs


def test_no_pairs_gives_null(spark):
    row = one(frame(spark, [1, 2], [0, 0], [1, 2]))
    assert row.pairs == 0 and pd.isna(row.c_index)


def test_components_are_pooled_before_division(spark):
    df = frame(
        spark, [1, 2, 1, 2, 3, 4], [1] * 6, [2, 1, 1, 2, 3, 4], g=["a", "a", "b", "b", "b", "b"]
    )
    pooled = grouped_concordance(df, [], ["g"]).toPandas().iloc[0]
    assert pooled.c_index == pytest.approx(1 / 7)


def test_fold_scope(spark):
    df = frame(spark, [1, 2, 3, 4], [1] * 4, [2, 1, 12, 11], fold=[1, 1, 2, 2])
    assert grouped_concordance(df, [], ["fold"]).toPandas().iloc[0].c_index == 1.0
    assert one(df).c_index != 1.0


@pytest.mark.parametrize("tied", [False, True])
@pytest.mark.parametrize("hot", [None, "time", "risk", "both"])
def test_chunked_equals_brute_force(spark, tiny_tasks, tied, hot):
    rng = np.random.default_rng(7)
    n = 260
    pdf = pd.DataFrame({
        "g": rng.choice(["x", "y"], n, p=[0.8, 0.2]),
        "duration": rng.integers(1, 60, n).astype(float), "event": rng.integers(0, 2, n),
        "score": rng.integers(0, 40, n) / 8, "w": rng.integers(1, 4, n).astype(float),
    })
    if hot in ("time", "both"):
        pdf.loc[rng.random(n) < 0.4, "duration"] = 17.0
    if hot in ("risk", "both"):
        pdf.loc[rng.random(n) < 0.4, "score"] = 2.5
    got = concordance(spark.createDataFrame(pdf), ["g"], weight="w", tied_censoring=tied).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        want = brute(part, tied)
        assert tuple(got.loc[g, ["pairs", "concordant", "tied"]]) == pytest.approx(want)


def test_whole_group_path_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({
        "g": rng.choice(list("abc"), 120), "duration": rng.integers(1, 9, 120).astype(float),
        "event": rng.integers(0, 2, 120), "score": rng.integers(0, 6, 120) / 10, "w": 1.0,
    })
    for tied in (False, True):
        got = concordance(spark.createDataFrame(pdf), ["g"], tied_censoring=tied).toPandas().set_index("g")
        for g, part in pdf.groupby("g"):
            assert tuple(got.loc[g, ["pairs", "concordant", "tied"]]) == pytest.approx(brute(part, tied))


def test_stratum_sentinel(spark):
    rows = [
        (s, f, float(o), 1, float(shift + f))
        for shift, s in ((0, "A"), (100, "B")) for f in range(1, 6) for o in range(10)
    ]
    df = spark.createDataFrame(rows, "stratum string, fold int, duration double, event int, score double")
    parts = concordance(df, ["stratum", "fold"], tied_censoring=True)
    assert set(pool_components(parts, ["stratum"]).toPandas().c_index) == {0.5}


@pytest.mark.parametrize("tied", [False, True])
@pytest.mark.parametrize("hot", ["time", "risk", "both"])
def test_parts_above_the_bound_are_cut_again(spark, monkeypatch, tied, hot):
    """Few chunks and a small bound: most parts are too large, frames stay bounded, counts stay exact."""
    from cohortry.operators import ordered, pairs

    bound = 20
    monkeypatch.setattr(ordered, "TASK_ROWS", bound)
    monkeypatch.setattr(pairs, "chunk_count", lambda rows: 2)
    count_small = pairs._count_small

    def checked(parts, keys, limit):
        sizes = parts.groupBy(*keys, "_case", "_part").count().toPandas()["count"]
        assert limit == bound and (sizes <= bound).all()
        return count_small(parts, keys, limit)

    monkeypatch.setattr(pairs, "_count_small", checked)
    rng = np.random.default_rng(11)
    n = 300
    pdf = pd.DataFrame({
        "g": rng.choice(["x", None], n, p=[0.8, 0.2]),
        "duration": rng.integers(1, 90, n).astype(float), "event": rng.integers(0, 2, n),
        "score": rng.integers(0, 200, n) / 8, "w": rng.integers(1, 4, n).astype(float),
    })
    if hot in ("time", "both"):
        pdf.loc[rng.random(n) < 0.5, "duration"] = 17.0
    if hot in ("risk", "both"):
        pdf.loc[rng.random(n) < 0.5, "score"] = 2.5
    df = spark.createDataFrame(pdf, "g string, duration double, event int, score double, w double")
    got = concordance(df, ["g"], weight="w", tied_censoring=tied).toPandas()
    for g, part in pdf.groupby("g", dropna=False):
        row = got[got["g"].isna() if pd.isna(g) else got["g"] == g].iloc[0]
        assert (row.pairs, row.concordant, row.tied) == pytest.approx(brute(part, tied))


def test_across_levels_equal_brute_force(spark):
    from cohortry.operators.pairs import across

    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": rng.integers(0, 2, 150), "x": rng.integers(0, 64, 150), "y": rng.integers(0, 30, 150),
                        "_e": rng.integers(0, 2, 150).astype(float), "_w": rng.integers(1, 5, 150).astype(float)})
    got = across(spark.createDataFrame(pdf), ["k"], "x", "y", 6).toPandas().set_index("k")["concordant"]
    for k, part in pdf.groupby("k"):
        a, b = part.to_dict("records"), part.to_dict("records")
        assert got[k] == sum(i["_e"] * j["_w"] for i in a for j in b if i["x"] < j["x"] and j["y"] < i["y"])


def test_frames_of_parts_stay_bounded(monkeypatch):
    """Parts of at most the bound arrive in small batches: no frame above two bounds and a batch, none counted twice."""
    from cohortry.operators import pairs

    bound, batch, inner, seen = 20, 7, pairs.later_and_lower, []

    def watched(group, x, y, w):
        seen.append(len(x))
        return inner(group, x, y, w)

    monkeypatch.setattr(pairs, "later_and_lower", watched)
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, bound + 1, 60)
    part = np.repeat(np.arange(60), sizes)
    n = len(part)
    pdf = pd.DataFrame({"g": np.where(part < 30, "a", None), "_case": 0, "_part": part.astype(str),
                        "_x": rng.integers(0, 9, n).astype(float), "_late": 0, "_y": rng.integers(0, 9, n).astype(float),
                        "_e": 1.0, "_w": rng.integers(1, 4, n).astype(float)})
    batches = (pdf.iloc[i:i + batch] for i in range(0, n, batch))
    got = pd.concat(list(pairs._count_parts(["g"], bound)(batches)))
    assert max(seen) <= 2 * bound + batch and sum(seen) == n
    want = sum(
        p._w.to_numpy()[(p._x.to_numpy() > x) & (p._y.to_numpy() < y)].sum()
        for _, p in pdf.groupby("_part") for x, y in zip(p._x, p._y)
    )
    assert got.concordant.sum() == want
