"""Lines meet only where their sizes let them be similar."""

import random

import pytest
from barloom.llm import line_dedup
from test_operators import plain_removed


def lines_of_all_sizes():
    rng, words = random.Random(5), [f"w{k}" for k in range(300)]
    lines = [rng.sample(words, n) for n in (1, 2, 3, 5, 8, 9, 12, 16, 17, 24, 32, 33, 45, 64, 90, 128) for _ in range(3)]
    shorter = [x[: -max(1, len(x) // rng.choice((5, 6, 9)))] for x in lines if len(x) > 4]
    return {i: " ".join(x) for i, x in enumerate(rng.sample(lines + shorter, len(lines) + len(shorter)))}


@pytest.mark.parametrize("t", [0.4, 0.8, 0.95])
def test_all_sizes_at_any_threshold(spark, t):
    texts = lines_of_all_sizes()
    found = line_dedup.line_report(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), threshold=t).collect()
    assert {(r["doc_id"], k) for r in found for k in r["removed"]} == plain_removed(texts, t)


def test_far_sizes_do_not_meet(spark):
    sizes = [4, 5, 6, 20, 24, 100, 120, 500]
    rows = [(i, 0, n, 0, 0, False, [7]) for i, n in enumerate(sizes)]
    firsts = spark.createDataFrame(rows, "doc long, line_no int, n int, sig long, sig2 long, done boolean, prefix array<int>")
    a, b = line_dedup._sides(firsts, 7 % line_dedup.ROUNDS, 0.8)
    met = [(r["a_n"], r["b_n"]) for r in a.join(b, "key").select("a_n", "b_n").collect()]
    similar = {(x, y) for x in sizes for y in sizes if 0.8 * x <= y <= x}
    assert len(met) == len(set(met)) and similar <= set(met)
    assert all(y >= 0.8 * x / 2**0.5 and y <= x * 2**0.5 for x, y in met)


def test_signatures_bound_what_differs(spark):
    """Two lines differ by at least as many words as their signatures by bits."""
    texts = lines_of_all_sizes()
    docs = spark.createDataFrame(list(texts.items()), "doc long, text string")
    sets = line_dedup._sets(line_dedup._lines(docs), line_dedup.word_classes(docs), 0.8)
    rows = {r["doc"]: r for r in sets.collect()}
    for i, text in texts.items():
        n = len(set(text.split()))
        assert rows[i]["n"] == n and len(rows[i]["prefix"]) == n - -(-8 * n // 10) + 1
        assert (bin(rows[i]["sig"] % 2**64).count("1") + bin(rows[i]["sig2"] % 2**64).count("1") - n) % 2 == 0
        for j, other in texts.items():
            odd = sum(bin((rows[i][c] ^ rows[j][c]) % 2**64).count("1") for c in ("sig", "sig2"))
            assert odd <= len(set(text.split()) ^ set(other.split()))


def test_lines_with_other_spaces(spark):
    texts = {0: "a b c d e", 1: "e\td\x0bc b\x0ca", 2: "A\rB  C\td e", 3: " \t ", 4: "", 5: "a bc de"}
    found = line_dedup.line_report(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in found if r["removed"]} == {1, 2} and all(r["n_lines"] == 1 for r in found)
