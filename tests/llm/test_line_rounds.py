"""Lines meet in rounds over the words of their prefixes: no round has most of them, and together they find every pair."""

import random

import pytest
from barloom.llm import line_dedup
from pyspark.sql import functions as F
from test_operators import plain_removed


@pytest.fixture(scope="module")
def texts():
    rng, words = random.Random(11), [f"w{k}" for k in range(400)]
    lines = [rng.sample(words, rng.randint(4, 14)) for _ in range(60)]
    near = [[*x[:-1], rng.choice(words)] if rng.random() < 0.7 else x for x in (rng.choice(lines) for _ in range(200))]
    return {i: "\n".join(" ".join(rng.sample(x, len(x))) for x in near[i * 5 : i * 5 + 5]) for i in range(40)}


@pytest.mark.parametrize("rounds", [1, 2, 3, 7])
def test_any_number_of_rounds_finds_all(spark, texts, monkeypatch, rounds):
    monkeypatch.setattr(line_dedup, "ROUNDS", rounds)
    found = line_dedup.line_report(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {(r["doc_id"], k) for r in found for k in r["removed"]} == set(plain_removed(texts))


def test_rounds_share_the_words(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc long, text string")
    sets = line_dedup._sets(line_dedup._lines(docs), line_dedup.word_classes(docs), 0.8).withColumn("done", F.lit(False))
    sizes = [line_dedup._prefix_words(sets, turn).count() for turn in range(line_dedup.ROUNDS)]
    assert sum(sizes) == sets.agg(F.sum(F.size("prefix"))).first()[0] and max(sizes) < 0.5 * sum(sizes)
