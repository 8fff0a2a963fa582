"""Divergence of sources: exact against a plain version, and in edge cases."""

import random
import re
from collections import Counter, defaultdict

import pytest

from quarry.llm import divergence

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least_docs, k):
    docs, n = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source, found = lang or "", source or "", TERM.findall((text or "").translate(UPPER))
        docs[lang].update(set(found))
        n[lang, source].update(found)
    out = set()
    for lang in docs:
        kept = [t for t, c in docs[lang].items() if c >= least_docs]
        whole = Counter()
        for (of, _), c in n.items():
            if of == lang:
                whole.update(c)

        def p(c):
            total = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // total for t in kept}

        q, own = p(whole), {s: p(c) for (of, s), c in n.items() if of == lang}
        for s in own:
            pairs = [(-sum(abs(own[s][t] - own[o][t]) for t in kept), o.encode()) for o in own if o != s]
            marks = [(-(own[s][t] - q[t]), t.encode()) for t in kept if n[lang, s][t] and own[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(marks)[:k])):
                out |= {(lang, s, part, item.decode(), -v, rank) for rank, (v, item) in enumerate(found, 1)}
    return out


def made(rng, n, langs=("en", "de", None), sources=("a", "b", "c", "", None, "é")):
    words = [f"{a}{b}" for a in "xyzé" for b in "abcdefghij"]
    rows = []
    for _ in range(n):
        source = rng.choice(sources)
        weights = [1 + (hash((w, source)) % 7) ** 2 for w in words]
        rows.append((" ".join(rng.choices(words, weights, k=rng.randint(0, 40))), rng.choice(langs), source))
    return rows


@pytest.mark.parametrize("k, least_docs", [(50, 3), (2, 3), (5, 1), (3, 100_000)])
def test_equals_the_plain_version(spark, k, least_docs):
    rows = made(random.Random(k), 200) + [(None, "en", "only null"), ("", None, None), ("1 2 3 --", "en", "no terms"), ("UPPER Upper ÀÉ àé", "en", "a"), ("x" * 3_000_000, "en", "long"), ("xa " * 800_000, "de", "long"), ("xa", "xx", "alone")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "text string, lang string, source string, term string, n int")
    found = {tuple(r) for r in divergence.divergence(df, k=k, least_docs=least_docs).collect()}
    assert found == plain(rows, least_docs, k)


def test_memory_in_a_task_is_bounded(spark, monkeypatch):
    rows = made(random.Random(3), 150)
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    whole = {tuple(r) for r in divergence.divergence(df, least_docs=2).collect()}
    pieces = list(divergence.terms(b"ab cd " * 10 + b"Efg"))
    monkeypatch.setattr(divergence, "PIECE", 4)
    assert [t for p in divergence.terms(b"ab cd " * 10 + b"Efg") for t in p] == [t for p in pieces for t in p]
    assert whole == plain(rows, 2, 50)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.divergence(df).count() == 0


def test_search_leaves_buckets_unseen(spark):
    """Many terms of small counts can't reach the k-th value, so their buckets aren't joined."""
    rng = random.Random(9)
    rare = [f"r{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400)]
    rows = [(" ".join([f"m{'abcdefghij'[s]}"] * 50 + rng.sample(rare, 40)), "en", f"s{s}") for s in range(10) for _ in range(10)]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    index = divergence._index(df, "text", "lang", "source", 1)
    groups = divergence._groups(index)
    found = divergence.marking_terms(index, groups, 1)
    assert {(r["source"], r["item"]) for r in found.collect()} == {(f"s{s}", f"m{'abcdefghij'[s]}") for s in range(10)}
