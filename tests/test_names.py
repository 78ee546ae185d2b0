"""Names that meet through postings, against crossing them."""

import random

from orderflow.operators import detection


def test_pairs_of_names_are_those_of_crossing(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("ABC", k=rng.randint(1, 5)))
    names = lambda n: sorted({(rng.choice(["PDF", "EXCEL"]), " ".join(rng.choice([word(), word(), "REDE", "PDF"]) for _ in range(rng.randint(1, 3)))) for _ in range(n)})
    left, right = names(60), names(60)
    got = detection.name_pairs(spark.createDataFrame(left, "tipo string, a string"), spark.createDataFrame(right, "tipo string, b string")).collect()
    words = lambda t: set(t.split()) - {"PDF", "EXCEL", "LAYOUT"}
    want = {(t, a, b) for t, a in left for u, b in right if t == u and (a in b or b in a or words(a) & words(b))}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_plan_crosses_nothing(spark):
    empty = spark.createDataFrame([], "row_id long, rede string, tipo string")
    layouts = spark.createDataFrame([], "row_id long, nome_layout string, tipo_arquivo string, ativo string, observacoes string, regra_data_entrega string")
    plan = detection.layout_for_network(empty, layouts)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert detection.layout_for_network(empty, layouts).collect() == []
