"""Passages that many documents share: what meets under them, and what is linked."""

import itertools
import random

import pytest
from barloom.llm import shingle_dedup
from barloom.llm.shingle_dedup import similar_groups
from barloom.llm.simhash import shingles_of


def words(rng, n):
    return ["".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(n)]


def brute_groups(texts):
    sets = {k: set(shingles_of(t.encode(), 5)) for k, t in texts.items()}
    group = {k: k for k in texts}
    for a, b in itertools.combinations(sorted(texts), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and group[a] != group[b]:
            low, high = sorted((group[a], group[b]))
            group = {k: low if g == high else g for k, g in group.items()}
    return group


@pytest.fixture
def met(monkeypatch):
    """The number of elements of prefixes that several documents have, as the code writes them."""
    found, keep = [], shingle_dedup.keep

    def kept(df):
        table = keep(df)
        if {"node", "place", "last"} <= set(table.columns) and "group" not in table.columns:
            found.append(table.count())
        return table

    monkeypatch.setattr(shingle_dedup, "keep", kept)
    return found


def test_documents_do_not_meet_under_a_common_passage(spark, met):
    """100 documents with one passage of 40 words and 160 words of their own: only the two that are alike meet."""
    rng = random.Random(3)
    passage = words(rng, 40)
    own = [words(rng, 160) for _ in range(100)]
    own[77] = own[5][:150] + words(rng, 10)
    texts = {k: " ".join(o[:80] + passage + o[80:]) for k, o in enumerate(own)}
    rows = spark.createDataFrame(list(texts.items()), "key long, text string")
    got = {r["key"]: r["component"] for r in similar_groups(rows).collect()}
    assert got == {k: 5 if k == 77 else k for k in texts}
    assert len(met) == 1 and 2 <= met[0] <= 2 * 41  # two prefixes at most, 600 elements and more before


@pytest.mark.parametrize("seed", range(3))
def test_links_near_the_threshold_with_common_passages(spark, seed):
    """Families around similarity 0.8 among passages of every frequency: as brute force."""
    rng = random.Random(seed)
    passages = [words(rng, rng.choice([6, 15, 40])) for _ in range(8)]
    texts = {}
    for _ in range(25):
        base = words(rng, rng.choice([8, 30, 90]))
        for p in rng.sample(passages, rng.randint(0, 3)):
            at = rng.randrange(len(base))
            base[at:at] = p
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = words(rng, 1)[0]
            texts[len(texts)] = " ".join(copy)
    rows = spark.createDataFrame(list(texts.items()), "key long, text string")
    got = {r["key"]: r["component"] for r in similar_groups(rows).collect()}
    want = brute_groups(texts)
    assert got == want and 5 < len(set(want.values())) < len(want)
