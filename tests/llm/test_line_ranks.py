"""Rare words stand before frequent ones, and the arrays of a line are made by compiled code."""

from barloom.llm import line_dedup
from pyspark.sql import functions as F
from test_operators import plain_removed


def test_few_rare_words_share_a_counter_with_frequent_ones(spark):
    frequent = " ".join(f"often{k}" for k in range(1000))
    rows = [(i, frequent + " " + " ".join(f"rare{k}" for k in range(i * 400, i * 400 + 400))) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc long, text string")
    classes = line_dedup.word_classes(docs)
    words = docs.select(F.explode(F.split("text", " ")).alias("w")).distinct().select("w", line_dedup._counter(F.xxhash64("w")).alias("c"))
    ranks = {r["w"]: classes[r["c"]] for r in words.collect()}
    least = min(v for w, v in ranks.items() if w.startswith("often"))
    misplaced = sum(v >= least for w, v in ranks.items() if w.startswith("rare"))
    assert least == 11 and len(ranks) == 21000 and misplaced < 0.03 * 20000


def test_lambdas_read_columns(spark):
    """A slice inside a function with a lambda is not compiled and boxes the whole line's words."""
    docs = spark.createDataFrame([(0, "b a\nc a b b")], "doc long, text string")
    sets = line_dedup._sets(line_dedup._lines(docs), line_dedup.word_classes(docs), 0.8)
    plan = sets._jdf.queryExecution().optimizedPlan().toString()
    calls = [part[:14] for name in ("aggregate(", "transform(") for part in plan.split(name)[1:]]
    assert len(calls) == 5 and not any(c.startswith(("slice", "array_")) for c in calls)
    assert {(r["line_no"], r["n"], len(r["prefix"])) for r in sets.collect()} == {(0, 2, 1), (1, 3, 1)}


def test_equal_single_and_similar_lines(spark):
    """Equal lines, similar ones and lines that are neither, several of them in one document."""
    base = [" ".join(f"w{k}x{j}" for j in range(12)) for k in range(30)]
    near = [" ".join(x.split()[:-1]) for x in base[::2]]
    texts = {i: "\n".join([base[i], "", base[(i * 7) % 30], *(near[:2] if i % 5 == 0 else [near[i // 2]]), f"own{i} line{i}"]) for i in range(30)}
    found = line_dedup.line_report(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {(r["doc_id"], k) for r in found for k in r["removed"]} == plain_removed(texts)
