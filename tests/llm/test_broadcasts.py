"""What Spark sizes too low before it runs is not broadcast."""

import itertools
import random

from barloom.llm import shingle_dedup
from barloom.llm.scratch import keep
from barloom.llm.simhash import close_pairs


def test_grid_cells_are_not_broadcast(spark):
    """Cells are 33 times the prints that Spark sizes them by; with its own limit for broadcasts they are shuffled."""
    rng = random.Random(5)
    prints = [rng.getrandbits(62) for _ in range(300)]
    prints += [p ^ (1 << rng.randrange(60)) for p in prints[:40]]
    pairs = close_pairs(keep(spark.createDataFrame([(p,) for p in prints], "fp long")))
    plan = pairs._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    near = {(a, b) for a, b in itertools.combinations(sorted(prints), 2) if (a ^ b).bit_count() <= 2}
    assert {(r["a"], r["b"]) for r in pairs.collect()} == near and len(near) >= 40


def test_near_dedup_does_not_broadcast_pairs_or_prefixes(spark, monkeypatch):
    """Cells, pairs and elements of prefixes, which Spark sizes by their files, are shuffled in near-dedup."""
    plans, kept = [], shingle_dedup.keep

    def watched(df):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return kept(df)

    monkeypatch.setattr(shingle_dedup, "keep", watched)
    rng = random.Random(8)
    base = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(400)]
    texts = [(k, " ".join([*base[:300], f"w{k}", *base[300:]])) for k in range(6)] + [(k, f"other text {k}") for k in range(6, 12)]
    groups = {r["key"]: r["component"] for r in shingle_dedup.similar_groups(spark.createDataFrame(texts, "key long, text string")).collect()}
    assert groups == {k: 0 if k < 6 else k for k in range(12)}
    risky = [p for p in plans if "array_intersect" in p or "array_position" in p or "explode(transform" in p]
    assert len(risky) >= 3 and not any("Broadcast" in p for p in risky if "array_" in p)
    assert not any("BroadcastHashJoin [cell" in p for p in risky)
