"""Windows are counted in arrays, not as rows; top shares need no order of the motifs."""

import collections
import math

from cohortry.functions.fixed_values import AMINO_ACIDS
from cohortry.operators import features as ft

WORDS = [("a", " cassl "), ("a", "CASSL"), ("a", "CAÉSLQ"), ("a", "AAA"), ("a", "ßcas"), ("a", None), ("a", "ca😀slf"), ("b", "AAAAA"),
         (None, "CASS"), ("c", "BBBBB"), ("b", ""), ("a", "CASSL")]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_triplets_are_not_exploded(spark):
    counts = ft.triplet_counts(spark.createDataFrame(WORDS, "sample_id string, seq string").coalesce(1))
    wanted = collections.Counter()
    for sample, seq in WORDS:
        seq = (seq or "").strip(" ").upper()
        if len(seq) > 3:
            wanted.update((sample, seq[i: i + 3]) for i in range(len(seq) - 2) if set(seq[i: i + 3]) <= set(AMINO_ACIDS))
    assert {(r.sample_id, r.triplet): r["count"] for r in counts.collect()} == wanted
    assert "Generate" not in _plan(counts)


def test_shares_without_an_order_of_motifs(spark):
    rows = [("a", f"t{i}", n) for i, n in enumerate([5, 5, 3, 3, 3, 1, 1])] + [("b", "t0", 4)]
    shape = ft.repertoire_shape(spark.createDataFrame(rows, "sample_id string, triplet string, count bigint"))
    a, b = shape.orderBy("sample_id").collect()
    assert (a.total, a.active, a.top1_share, a.top3_share, a.top5_share) == (21, 7, 5 / 21, 13 / 21, 19 / 21)
    entropy = -sum(n / 21 * math.log(n / 21) for _, _, n in rows[:7]) / math.log(7)
    assert abs(a.normalized_entropy - entropy) < 1e-12
    assert (b.total, b.active, b.top5_share, b.normalized_entropy, b.total_percentile) == (4, 1, 1.0, 0.0, 0.5)
    assert "triplet" not in _plan(shape)
