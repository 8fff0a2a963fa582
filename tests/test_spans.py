import random

import pytest

from quarry.operators.spans import span_matches
from quarry.plans.numbering import numbered


def norm(text):
    return " ".join((text or "").split()).lower()


def test_spans_of_any_length_equal_brute_force(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 5)))
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 40))) + rng.choice(["", "\n  End."])) for i in range(60)] + [(60, None), (61, ""), (62, "x" * 40_000 + " y")]
    spans = []
    for i in range(300):
        text = norm(rng.choice(docs)[1])
        a = rng.randint(0, max(0, len(text) - 1))
        spans.append((i, text[a : a + rng.choice([1, 2, 3, 5, 9, 20, 60, 90])] if rng.random() < 0.8 else " ".join(word() for _ in range(rng.randint(1, 4)))))
    spans += [(300, None), (301, " "), (302, "X" * 50), (303, "absent everywhere"), (304, "END."), (305, spans[0][1])]
    df = spark.createDataFrame([(*d, "c") for d in docs], "doc_id int, text string, span string")
    found = span_matches(df, spark.createDataFrame(spans, "item_id int, span string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = [tuple(r) for r in found.collect()]
    wanted = {(i, d) for i, s in spans for d, t in docs if norm(s) and norm(s) in norm(t)}
    assert set(got) == wanted and len(got) == len(wanted)


@pytest.mark.parametrize("rows", [0, 1, 1000])
def test_numbers_follow_the_order(spark, rows):
    values = [random.Random(k).randrange(rows) for k in range(rows)]
    df = spark.createDataFrame([(v, str(v)) for v in values], "v int, n string")
    found = numbered(df, "v", name="place")
    got = sorted((r["place"], r["v"]) for r in found.collect())
    assert found.columns == ["v", "n", "place"] and [p for p, _ in got] == list(range(1, rows + 1)) and [v for _, v in got] == sorted(values)
    windows = [line for line in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Window" in line]
    assert not windows or all("_part" in line for line in windows)


def test_texts_are_read_three_times_at_most(spark):
    from quarry import queries
    from tests.conftest import SMALL

    plan = queries.golden_terms(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [doc_id") <= 3
