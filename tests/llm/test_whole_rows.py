"""Results over all rows, where an earlier version covered a part."""

import random
from itertools import combinations

import corpus_pipeline
from barloom.llm import suffix_dedup
from barloom.llm.line_dedup import dedup_lines, line_report
from barloom.llm.suffix_dedup import remove_repeats
from test_operators import DOCS, components, plain_spans


def plain_shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_dedup_links_at_similarity(spark):
    rng = random.Random(4)
    texts = {}
    for base in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 8, 40, 120, 300]))]
        for edits in (0, 0, 1, 1, 2, 3, 5, 9):
            copy = list(words)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            texts[len(texts)] = " ".join(copy)
    # the middle one of a chain links two that are not similar themselves
    line = [f"c{i}" for i in range(100)]
    for cut in (0, 9, 18, 27):
        texts[len(texts)] = " ".join(line[cut : cut + 70])
    texts |= {len(texts) + i: t for i, t in enumerate(["", " ", "A b"])}
    sets = {i: plain_shingles(t) for i, t in texts.items()}
    linked = [(i, k) for i, k in combinations(texts, 2) if len(sets[i] & sets[k]) >= 0.8 * len(sets[i] | sets[k])]
    group = components(texts, linked)
    rows = [(i, t, "en", "a", len(t)) for i, t in texts.items()] + [(None, texts[0], "en", "a", 1), (5, "another text of the same id", "en", "a", 1)]
    rows += [(None, "lonely words without any id", "en", "a", 1)] * 2
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCS), "").collect()
    want = [(i, t) for i, t in texts.items() if group[i] == i] + [(None, "lonely words without any id"), (5, "another text of the same id")]
    key = lambda r: (r[0] is None, r)
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=key) == sorted(want, key=key)


def test_grams_that_grow_to_whole_strings(spark, monkeypatch):
    """Two contexts of a gram are too many here, so grams grow until a string is a gram."""
    monkeypatch.setattr(suffix_dedup, "SPLIT", 1)
    rng = random.Random(12)
    passage = "".join(rng.choice("abcd") for _ in range(70))
    texts = {i: "".join(rng.choice("efgh") for _ in range(rng.randint(0, 50))) + passage[rng.randint(0, 9) : rng.randint(40, 70)] + "".join(rng.choice("efgh") for _ in range(20)) for i in range(40)}
    texts |= {100 + i: "abababab" * 9 + "x" * i for i in range(3)} | {200: "z" * 90}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    spans = plain_spans({i: t.encode() for i, t in texts.items()}, 40)
    for r in remove_repeats(df, length=40, gram=12).collect():
        assert bytes(r["kept"]) == bytes(c for c, gone in zip(texts[r["doc_id"]].encode(), spans[r["doc_id"]], strict=True) if not gone), r["doc_id"]


def rows_without_own_id(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    shared, lines = " ".join(word() for _ in range(12)), [" ".join(word() for _ in range(12)) for _ in range(12)]
    texts = [
        (None, "\n".join([lines[0], shared, lines[1]])), (None, "\n".join([lines[2], shared, lines[3]])), (None, "\n".join([lines[4], lines[5], lines[6]])),
        (3, "\n".join([lines[7], shared, lines[8]])), (3, "\n".join([lines[9], lines[10]])), (4, lines[11]), (None, lines[11] + " tail"), (None, lines[11] + " tail"),
    ]
    return texts, spark.createDataFrame([(i, t, "en", "a", 1) for i, t in texts], DOCS), shared


def test_repeats_in_rows_without_own_id(spark):
    texts, df, _ = rows_without_own_id(spark)
    number = {t: k for k, (_, t) in enumerate(texts)}
    spans = plain_spans({k: t.encode() for k, (_, t) in enumerate(texts)}, 40)
    want = sorted((str(i), bytes(c for c, g in zip(t.encode(), spans[number[t]], strict=True) if not g)) for i, t in texts)
    found = remove_repeats(df, length=40, gram=12).collect()
    assert sorted((str(r["doc_id"]), bytes(r["kept"])) for r in found) == want


def test_lines_in_rows_without_own_id(spark):
    texts, df, shared = rows_without_own_id(spark)
    kept = [r["text"] for r in dedup_lines(df).collect()]
    lines = sorted(x for t in kept for x in t.split("\n") if x)
    assert lines == sorted({x for _, t in texts[:5] for x in t.split("\n")} | {texts[6][1]}) and len(kept) == len(texts)
    report = line_report(df).collect()
    assert sorted((str(r["doc_id"]), r["n_lines"], r["n_removed"]) for r in report) == sorted(
        [("None", 3, 0), ("None", 3, 1), ("None", 3, 0), ("3", 3, 1), ("3", 2, 0), ("4", 1, 1), ("None", 1, 0), ("None", 1, 1)]
    )


def test_many_lines_of_one_text(spark):
    """A text of very many lines, half of them removed, keeps the others in order; time is in proportion to its lines."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(8))
    seen = [" ".join(word() for _ in range(6)) for _ in range(20_000)]
    fresh = [" ".join(word() for _ in range(6)) for _ in range(20_000)]
    mixed = [x for pair in zip(seen, fresh, strict=True) for x in pair]
    rows = [(1, "\n".join(seen), "en", "a", 1), (2, "\n".join(["", *mixed, "", mixed[0]]), "en", "a", 1), (3, seen[5], "en", "a", 1), (4, None, "en", "a", 1)]
    found = {r["doc_id"]: r["text"] for r in dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert found == {1: rows[0][1], 2: "\n".join(["", *fresh, ""]), 3: "", 4: None}
