"""Bands and centres per file against trying every one."""

import random

from orderflow.operators import sheets

WORDS = "file string, page long, top double, x0 double, x1 double, text string"


def test_bands_and_centres_are_those_of_trying_all(spark):
    rng = random.Random(4)
    words = [(rng.choice("abc"), 1, float(i), x := rng.randint(-20, 400) / 2, x + 10, str(i)) for i in range(300)]
    bands = [(f, f"{f}{i}", 40.0 * i + s, 40.0 * i + s + 25) for f, s in (("a", 0), ("b", 13)) for i in range(5)]
    centres = [(f, f"{f}{i}", 45.0 * i + s) for f, s in (("a", 0), ("c", 7)) for i in range(4)]
    df = spark.createDataFrame(words, WORDS)
    got = sheets.assign_bands(df, spark.createDataFrame(bands, "file string, nome string, lo double, hi double"))
    assert {r.text: r.faixa for r in got.collect()} == {w[5]: next((n for f, n, lo, hi in bands if f == w[0] and lo <= w[3] < hi), None) for w in words}
    near = sheets.assign_nearest(df, spark.createDataFrame(centres, "file string, nome string, x double"), 20.0)
    want = {w[5]: min(((abs(w[3] + 5 - x), x, n) for f, n, x in centres if f == w[0]), default=(99, 0, None)) for w in words}
    assert {r.text: r.alvo for r in near.collect()} == {k: n if d <= 20 else None for k, (d, _, n) in want.items()}
    for x in (got, near):
        assert "NestedLoop" not in x._jdf.queryExecution().toString()
