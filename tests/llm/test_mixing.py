import random

import numpy as np
import pytest

from leafmill.llm import mixing


def own_words(source, n, rng):
    return " ".join(f"{source}{rng.randrange(20)}" for _ in range(n))


def test_small_sources_reach_their_goals_beside_a_hot_one(spark):
    rng = random.Random(1)
    rows = [(i, own_words("hot", 2500, rng), "hot", "en") for i in range(400)]
    rows += [(1000 + 2 * j + i, own_words(f"s{j}x", 10, rng), f"s{j}", "en") for j in range(8) for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").coalesce(4)
    plan, misses = mixing.mix_and_misses(docs, docs.selectExpr("doc_id", "source AS domain"))
    for r in misses.collect():
        assert r.optimal and abs(r.miss) <= 1e-3
    sums = {}
    for r in plan.join(docs.select("doc_id", "source"), "doc_id").collect():
        sums[r.source] = sums.get(r.source, 0) + r.rate * r.tokens
    assert min(sums[f"s{j}"] for j in range(8)) > 3 * 20


@pytest.mark.parametrize("k", [6, 66])
def test_rates_are_optimal_or_meet_each_goal(spark, k):
    rng = np.random.default_rng(k)
    p = rng.dirichlet(np.full(k, 0.02), 150)
    mass = rng.integers(1, 500, 150).astype(float)
    cells = spark.createDataFrame([(float(m), [float(x) for x in q]) for m, q in zip(mass, p, strict=True)], "mass double, p array<double>").coalesce(1).cache()
    for least, goal in ((0.0, (mass @ p) * rng.uniform(0.5, 3, k)), (1.0, np.full(k, mass.sum() / k))):
        w, reached, optimal = mixing._fit(cells, list(goal), 200, least)
        r = np.maximum(least, 1 + p @ np.array(w))
        assert optimal and np.allclose((r * mass) @ p, reached, rtol=1e-6)
        miss = goal - (r * mass) @ p
        if (np.abs(miss) > 1.1e-3 * goal).any():  # out of reach: no rate can move to lower the squares
            pull = p @ miss
            free = r > least + 1e-9
            assert np.abs(pull[free]).max(initial=0) < 1e-3 * goal.mean() and pull[~free].max(initial=-1) < 1e-3 * goal.mean()
    cells.unpersist()


def test_domains_come_from_the_text_and_not_from_the_source_column(spark):
    rng = random.Random(2)
    rows = [(i, own_words("ab"[i % 2], 30, rng), "ab"[i % 2], "en") for i in range(200)]
    rows += [(1000, own_words("a", 30, rng), "b", "en"), (1001, own_words("b", 30, rng), None, "en"), (1002, own_words("a", 15, rng) + " " + own_words("b", 15, rng), "a", "en"), (None, "", "b", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").coalesce(2)
    labels = docs.where("doc_id < 200").selectExpr("doc_id", "source AS domain")
    got = {r.doc_id: r for r in mixing.mix(docs, labels).collect()}
    assert len(got) == 204 and got[1000].domain == "a" and got[1001].domain == "b" and got[None].rate == 1.0
    assert [r.tokens for r in mixing.mix(docs.where("doc_id = 1002"), labels.limit(0)).collect()] == [30]


def test_corpus_with_clashing_columns_repeats_and_empty_tables(spark):
    rng = random.Random(3)
    rows = [(i, own_words("ab"[i % 2], 20, rng), "ab"[i % 2], "en", 1.0, 2, 3, "x", 4) for i in range(40)]
    rows += [(0, "other words", "a", "en", 1.0, 2, 3, "x", 4), (None, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, rate double, copies int, _id int, domain string, copy int")
    labels = mixing.source_labels(docs, docs.select("doc_id"))
    out = mixing.mixed_corpus(docs, labels, least_rate=1.0)
    assert out.columns == ["doc_id", "text", "source", "lang", "copies", "_id", "domain", "rate", "copy"]
    got = out.collect()
    assert {r.doc_id for r in got} == {*range(40), None} and {r.domain for r in got if r.doc_id is not None} == {"a", "b"}
    assert all(r.copies in (2, None) for r in got)
    assert mixing.mixed_corpus(docs.limit(0), labels.limit(0)).count() == 0
