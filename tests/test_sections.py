import random

from quarry.operators import chunk
from quarry.operators.htmldoc import block
from quarry.operators.parse import BLOCK_ARRAY
from quarry.operators.sections import section_rows


def plain(title, blocks):
    seen, out = {}, []
    for crumbs, body in chunk.sections(title or "", blocks or []):
        crumb = " > ".join(crumbs)
        seen[crumb] = seen.get(crumb, 0) + 1
        out.append((crumb, seen[crumb], [b["text"] for b in body]))
    return out


def test_sections_equal_the_fold(spark):
    rng, docs = random.Random(4), []
    for _ in range(150):
        blocks = [block("heading", rng.choice("ABCT"), rng.choice([None, 0, 1, 2, 3, 6])) if rng.random() < 0.5 else block("paragraph", f"p{rng.random()}") for _ in range(rng.randint(0, 14))]
        docs.append((rng.choice(["T", " T ", "", None]), blocks))
    docs += [("T", None), (None, []), ("T", [block("heading", "A", 1)] * 3), ("T", [block("heading", f"H{k % 7}", k % 5 + 1) if k % 2 else block("paragraph", str(k)) for k in range(3000)])]
    df = spark.createDataFrame([(str(i), t, b) for i, (t, b) in enumerate(docs)], f"doc_id string, title string, blocks {BLOCK_ARRAY}")
    found = {}
    for r in sorted(section_rows(df).collect(), key=lambda r: (r["doc_id"], r["section"])):
        found.setdefault(r["doc_id"], []).append((r["breadcrumb"], r["occurrence"], [b["text"] for b in r["blocks"]]))
        assert r["section"] == len(found[r["doc_id"]])
    for i, (title, blocks) in enumerate(docs):
        assert found.get(str(i), []) == plain(title, blocks), (title, blocks)


def test_no_shuffle(spark):
    df = spark.createDataFrame([("a", "T", [])], f"doc_id string, title string, blocks {BLOCK_ARRAY}")
    plan = section_rows(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
