"""Quality rules, mixing, decontamination and personal data: against brute force, in edge cases, and without Python in their plans."""

import itertools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import brute
from quarry.llm import common, decontam, mixing, pii, quality, queries, sql
from tests.conftest import SMALL

PLAIN = ["op3_quality_rules", "op5_mixing", "op6_decontamination", "op9_personal_data"]


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_query_equals_its_sql(name, same):
    same(queries.QUERIES[name], sql.ORACLES[name])


@pytest.mark.parametrize("name", PLAIN)
def test_no_python_in_the_plan(name, spark):
    plan = queries.QUERIES[name](spark, SMALL)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def docs_of(spark, texts, **more):
    rows = [(k, t, *[v[k] for v in more.values()]) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string" + "".join(f", {c} string" for c in more))


ODD = [None, "", " \n\t", "a", "a b c d e f g h " * 2, "x " * 9, "é😀 <b> # $\nline\nline\n line\nline", "one two\r\nthree\x0bfour\x0cfive", "w " * 30_000, "abc" * 50_000]


def test_quality_measures(spark):
    rng = random.Random(3)
    texts = ODD + [" ".join(rng.choice("a b c".split()) for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["\n".join(rng.choice(["x y", "#", "", "z"]) for _ in range(12)) for _ in range(20)]
    found = {r["id"]: r for r in quality.judge(docs_of(spark, texts, n_words=["1"] * len(texts), w=texts)).collect()}
    for k, text in enumerate(texts):
        r, e = found[k], brute.measures(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == e, k
        assert r["base_failed"] == (e[0] < 20 or 100 * e[4] > 30 * e[0]) and (not r["kept"] or not r["base_failed"])
    assert quality.judge(docs_of(spark, ["x"]).where("false")).count() == 0


def test_quality_keeps_prose_and_drops_junk(spark):
    prose = spark.read.parquet(f"{SMALL}/documents.parquet").join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id")
    judged = quality.judge(prose).join(prose.select(F.col("doc_id").alias("id"), "quality"), "id").where("NOT base_failed")
    good, bad = judged.where("quality = 1"), judged.where("quality = 0")
    assert good.where("kept").count() >= 0.97 * good.count() and bad.where("kept").count() <= 0.1 * bad.count()


def mixed(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("rate", F.lit("clash"))
    return df, mixing.mix(df, **how)


def test_mixing_targets_and_copies(spark):
    rng = random.Random(5)
    names = ["a", "b", "Z", "é", None, "tiny"]
    rows = [(k, "w " * int(rng.paretovariate(1.1) * 8) if s != "tiny" else "w", s) for k in range(3000) for s in [rng.choices(names, [50, 20, 10, 10, 10, 0.3])[0]]]
    rows += [(9001, None, "a"), (9002, "", "empty"), (None, "x y", "b"), rows[0], rows[0]]
    df, found = mixed(spark, rows)
    out = found.collect()
    totals, taken, goal = defaultdict(int), defaultdict(int), {}
    for r in out:
        totals[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        goal[r["source"]] = r["target"]
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
    wanted = brute.targets(totals)
    assert len(out) == len(rows) and goal == pytest.approx(wanted)
    largest = max(r["size"] for r in out)
    for s in totals:
        assert abs(taken[s] - wanted[s]) <= max(largest, 0.01 * wanted[s]), s
    assert all(r["source_size"] == totals[r["source"]] for r in out)
    again = {(r["id"], r["source"], r["size"]): r["copies"] for r in found.collect()}
    assert all(again[r["id"], r["source"], r["size"]] == r["copies"] for r in out)
    copies = mixing.mixed(df)
    assert copies.columns == [*df.columns, "copy"] and copies.count() == sum(r["copies"] for r in out)


def test_mixing_does_not_depend_on_the_partitioning(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    columns = ["id", "target", "rate", "copies", "taken"]
    first, second = (sorted(map(tuple, mixing.mix(docs.repartition(n)).select(*columns).collect())) for n in (3, 11))
    assert first == second


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "a b", "x")], [(1, "", "x"), (2, "a", None)]])
def test_mixing_of_little(spark, rows):
    _, found = mixed(spark, rows)
    out = found.collect()
    assert len(out) == len(rows) and sum(r["taken"] for r in out) <= 3 * sum(r["size"] for r in out)


def test_water_level(spark):
    for sizes in ({"a": 1, "b": 100, "c": 1000}, {"a": 10, "b": 10, "c": 10, "d": 0}, {"a": 1000, "b": 1, "c": 1, "d": 1, "e": 500}):
        df = spark.createDataFrame([(s, float(n)) for s, n in sizes.items()], "source string, total double")
        assert {r["source"]: r["target"] for r in mixing.targets(df, (5, 2, 1), 3).collect()} == pytest.approx(brute.targets(sizes))


LETTERS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi".split()


def test_decontamination(spark):
    rng = random.Random(7)
    words = lambda n: [rng.choice(LETTERS) + str(rng.randint(0, 99)) for _ in range(n)]
    items = [(k, " ".join(words(n))) for k, n in enumerate([30, 10, 11, 25, 9, 3, 1, 40])]
    items += [(100, items[0][1].upper()), (101, None), (102, "..."), (103, " ".join(["same"] * 14)), (None, " ".join(words(12)))]
    texts = [None, "", "short", " ".join(words(300)), items[5][1].title(), f"x {items[6][1]}-y"]
    for own, item in items:
        if item:
            w = item.split()
            texts += [" ".join([*words(5), item, *words(5)]), ", ".join(w[: len(w) - 1]), " ".join([*w[:9], "other", *w[9:]]), f"{item}\n{item}", " ".join(w[5:20])]
    texts += [" ".join(["same"] * 40), " ".join([items[0][1], *words(20_000), items[3][1]])]
    docs = docs_of(spark, texts, words=["x"] * len(texts), key=["x"] * len(texts))
    docs = docs.union(docs.where("doc_id = 6")).union(docs.where("doc_id = 6").withColumn("doc_id", F.lit(None).cast("long")))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for how in ({}, {"most_broadcast": 0}):
        found = decontam.contamination(docs, bench, **how).collect()
        assert len(found) == len(texts) + 2
        for r in found:
            n, hit, met = brute.contamination(texts[6 if r["id"] is None else r["id"]], items)
            assert (r["n_words"], r["n_hit"], r["contaminated"]) == (n, hit, hit > 0), r["id"]
            assert r["items"] == sorted(str(x) for x in met if x is not None), r["id"]
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [k for k, t in enumerate(texts) if not brute.contamination(t, items)[1]]


@pytest.mark.parametrize("lengths", [[7], [5, 8], [9], [6], [2, 4]])
def test_decontamination_by_short_items(spark, lengths):
    rng = random.Random(13)
    words = lambda n: [rng.choice("abcdefgh") for _ in range(n)]
    items = [(k, " ".join(words(n))) for k, n in enumerate([*lengths, 12])]
    texts = [" ".join(words(rng.randint(0, 200))) for _ in range(40)] + [f"x {t} y" for _, t in items]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for r in decontam.contamination(docs_of(spark, texts), bench).collect():
        n, hit, met = brute.contamination(texts[r["id"]], items)
        assert (r["n_words"], r["n_hit"], r["items"]) == (n, hit, sorted(map(str, met)))


def test_decontamination_of_nothing(spark):
    docs, none = docs_of(spark, ["a b c"]), spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(docs, none).first()["n_hit"] == 0 and decontam.clean(docs, none).count() == 1
    assert decontam.contamination(docs.where("false"), spark.createDataFrame([(1, "a b c")], none.schema)).count() == 0


def test_personal_data_patterns(spark):
    rng = random.Random(9)
    parts = "a b . @ @x. 1 2 55 255 - + +1 ( ) _ % é \n 😀".split(" ") + [" ", "4111 1111 1111 1111", "4111111111111111", "a@b.co", "1.2.3.4", "+44 20 7946 0018"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += [None, "", "x@y.z_q@w.e", "4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.255 0000255.0.0.1 1.1.1.00256", "1 " * 5000, "9" * 20_000, "+1" + "(" * 5000 + "2", "a@" + "b." * 5000 + "c"]
    docs = docs_of(spark, texts, base=["x"] * len(texts), t=["y"] * len(texts))
    for r in pii.find(docs.union(docs.where("doc_id = 0"))).select("id", pii.listed(F.col("base")).alias("b"), *[pii.count(F.col("base"), k).alias(k) for k in pii.BASE]).collect():
        spans = brute.personal(texts[r["id"]])
        assert r["b"] == brute.listed(spans), texts[r["id"]]
        assert [r[k] for k in pii.BASE] == [sum(s[1] == k for s in spans) for k in range(4)]
    assert pii.find(docs.where("false")).count() == 0


def test_terms_that_reveal_an_entity(spark):
    rng = random.Random(11)
    common = [f"word{k}" for k in range(40)]
    text = lambda *more: " ".join([*rng.choices(common, k=20), *more, *rng.choices(common, k=20)])
    texts = [text("Zanzibarov", "anna@corp.example,", "street9") for _ in range(5)] + [text("hello", "bob@corp.example") for _ in range(5)] + [text() for _ in range(60)] + [text("hello") for _ in range(10)]
    texts += [text("Once", "single@corp.example")] * 6  # copies are one text
    docs = docs_of(spark, texts, n_chars=[None] * len(texts))
    for how in ({}, {"most_broadcast": 0}):
        found = {r["id"]: r for r in pii.find(docs, **how).collect()}
        term = pii.KINDS.index("term")
        for k, t in enumerate(texts):
            words = {s["found"] for s in found[k]["spans"] if s["kind"] == term}
            assert words == ({"zanzibarov", "street9"} if k < 5 else set())
            assert {tuple(s) for s in found[k]["base"]} <= {tuple(s) for s in found[k]["spans"]}
            assert all(t[s["start"] : s["end"]].lower() == s["found"].lower() for s in found[k]["spans"])
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs.drop("n_chars").withColumn("n_chars", F.length("text").cast("long"))).collect()}
    assert "[TERM] [EMAIL], [TERM]" in clean[0] and "hello [EMAIL]" in clean[5] and clean[20] == texts[20]


def test_terms_that_reveal_a_rare_entity(spark):
    rng = random.Random(12)
    common = [f"word{k}" for k in range(40)]
    filler = lambda n: " ".join(rng.choices(common, k=n))
    texts = [f"page of Quillfeather {filler(60)} write to: anna.quillfeather@corp.example now {filler(5)}"]  # more than 80 characters away
    texts += [f"{filler(9)} jvanterpool@corp.example {filler(50)} vanterpool {filler(5)}"]
    texts += [f"{filler(9)} ring +44 20 7946 0018, ask for Oddfellow {filler(9)} seldom {filler(20 + k)}" for k in range(2)]
    texts += [f"host 10.1.2.3 {filler(60)} zanzibarov {filler(k)}" for k in range(4)] + [f"elsewhere zanzibarov {filler(9)}"]
    texts += [f"{filler(9)} info@corp.example {filler(9)} info"] + [f"info host {filler(9 + k % 3)} Word1" for k in range(300)] + [f"only rare{k} words" for k in range(20)]
    wanted = {0: {"quillfeather"}, 1: {"vanterpool"}, 2: {"oddfellow"}, 3: {"oddfellow"}} | dict.fromkeys(range(4, 9), {"zanzibarov"})
    docs = docs_of(spark, texts)
    for how in ({}, {"most_broadcast": 0}):
        for r in pii.find(docs, **how).collect():
            assert {s["found"] for s in r["spans"] if s["kind"] == pii.KINDS.index("term")} == wanted.get(r["id"], set()), texts[r["id"]]


def test_keys_that_disclose_secrets(spark):
    rng = random.Random(15)
    hexed = lambda: "".join(rng.choice("0a1b2c3d4e5f") for _ in range(24))
    texts = [f'line {k}\ntoken = "{hexed()}" and more' for k in range(8)] + [f"TOKEN: none{k}; é😀 a token here" for k in range(2)]
    texts += [f"commit: {hexed()}" for _ in range(5)] + [f"commit: fixed{k}" for k in range(10)]
    texts += [f"api_key={hexed()} and {hexed()}", f"mail: a@b.co token: x@y.co id={hexed()}", "title: A\nname: b", None, "", "=: = a:b=c", "key = " + "ab1" * 20_000, "k:v " * 20_000]
    texts += [texts[0], texts[0]] + [f"plain words {k}" for k in range(900)]
    docs = docs_of(spark, texts, keys=["x"] * len(texts))
    wanted = brute.disclosing_keys(texts)
    assert {"token", "api_key", "id", "key"} == wanted.keys()
    met = pii.owners(pii.with_base(docs.select(F.coalesce("text", F.lit("")).alias("t"))))
    found = sorted(r["share"] for r in pii.disclosing_keys(met, len(set(t or "" for t in texts))).collect())
    assert found == pytest.approx(sorted(wanted.values()))
    for how in ({}, {"most_broadcast": 0}):
        for r in pii.find(docs, **how).collect():
            assert [(x["start"], x["end"]) for x in r["spans"] if x["kind"] == pii.KINDS.index("secret")] == brute.secrets(texts[r["id"]], wanted), texts[r["id"]]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert clean[0] == 'line 0\ntoken = "[SECRET]" and more' and clean[10] == texts[10] and clean[8] == "TOKEN: [SECRET]; é😀 a token here"


def test_running_results(spark):
    rng = random.Random(16)
    rows = [([rng.randint(-5, 9) for _ in range(n)],) for n in (0, 1, 2, 255, 256, 257, 1000, 3000)]
    df = spark.createDataFrame(rows, "x array<int>")
    for r in df.select("x", common.running(F.col("x"), F.lit(0), lambda s, x: s + x).alias("s"), common.running(F.col("x"), F.lit(0), F.greatest).alias("m")).collect():
        assert r["s"] == list(itertools.accumulate(r["x"])) and r["m"] == list(itertools.accumulate([0, *r["x"]], max))[1:]


def test_united_spans(spark):
    rng = random.Random(17)
    rows = [(k, sorted((a, a + rng.randint(1, 9), k) for a in [rng.randint(0, 400) for _ in range(rng.randint(0, 60))])) for k in range(60)]
    df = spark.createDataFrame(rows, "k int, spans array<struct<start:int,end:int,kind:int>>")
    for apart, gap in ((lambda e, s: s >= e, 0), (lambda e, s: s > e, 1)):
        for r in df.select("spans", common.united(F.col("spans"), apart).alias("u")).collect():
            wanted = []
            for x in r["spans"]:
                if wanted and x["start"] < wanted[-1][1] + gap:
                    wanted[-1][1] = max(wanted[-1][1], x["end"])
                else:
                    wanted.append([x["start"], x["end"], x["kind"]])
            assert [list(x) for x in r["u"]] == wanted


def test_sanitising(spark):
    texts = [None, "", "none", "a@b.co", "x a@b.co y 1.2.3.4", "é😀 +1 (017) 555-7713 z 4111111111111111", "+4111111111111111"]
    docs = spark.createDataFrame([(k, t, len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, n_chars int")
    out = {r["doc_id"]: r for r in pii.sanitise(docs).collect()}
    assert [out[k]["text"] for k in range(6)] == [None, "", "none", "[EMAIL]", "x [EMAIL] y [IP]", "é😀 [PHONE] z [CARD]"]
    assert out[6]["text"] == "+[CARD]" and pii.sanitise(docs).schema == docs.schema
    assert all(out[k]["n_chars"] == len(out[k]["text"] or "") for k in out)
