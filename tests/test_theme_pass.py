"""Themes of a row come from one pass over it, however many prefixes there are."""

from cohortry.operators import features as ft


def test_theme_tags_read_their_input_once(spark):
    themes, prefixes = {"t1": ["AB1", "CD2"], "t2": ["AB1"], "p1": ["AB9"]}, {"AB": "p1", "CD": "p2", "X": "p3"}
    rows = [("u", "AB1", 2.0), ("u", "AB1", 2.0), ("u", "CD2", 1.0), ("v", "AB9", 1.0), ("v", "Q", 4.0), (None, "X7", 1.0), ("w", None, 1.0)]
    profile = spark.createDataFrame(rows, "unit_id string, gene string, value double")
    top = ft.top_features(profile, 12).select("unit_id", "gene", "value")
    tagged = ft.theme_tags(top, themes, prefixes)
    assert tagged._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
    wanted = {(g, u, v, t) for u, g, v in rows if g for t in
              [t for t, genes in themes.items() if g in genes] + [t for p, t in prefixes.items() if g.startswith(p)]}
    found = [tuple(r) for r in tagged.collect()]
    assert tagged.columns == ["gene", "unit_id", "value", "theme"] and len(found) == len(wanted) and set(found) == wanted
