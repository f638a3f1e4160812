"""The ten operators against plain versions, on the smallest tables and on edge cases."""

import collections
import hashlib
import itertools
import os
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F, types as T

from barloom.llm import queries as Q
from barloom.llm.components import connected_components
from barloom.llm.ctph import fingerprint, likeness, with_next_row
from barloom.llm.embedding_dedup import near_embeddings
from barloom.llm.hash_ring import assign_shards, place_counts
from barloom.llm.line_dedup import dedup_lines, line_report
from barloom.llm.mixing import fit_counts, mix_sources, mixed_documents
from barloom.llm.pieces import load_pieces
from barloom.llm.sentencepiece_codec import decode_documents, decode_ids, encode_documents, load_lattice, nbest_segmentations
from barloom.llm.simhash import keep_representatives, near_duplicates
from barloom.llm.suffix_dedup import anchors, columnwise_order, remove_repeats
from barloom.llm.token_counts import count_tokens, load_counter, prefix_tables
from barloom.llm.toxicity import drop_toxic, score_documents

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])
LONG = "word%d " * 3000


@pytest.fixture(scope="session")
def larger_dir(sf_dir):
    """A table size with labels enough to fit and calibrate."""
    return os.path.join(os.path.dirname(sf_dir), "sf0.01")


@pytest.fixture(scope="module")
def texts(sf_dir):
    rows = pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()
    return {r["doc_id"]: r["text"] or "" for r in rows}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, a repeated row, columns with clashing names."""
    long = LONG % tuple(range(3000))
    rows = [
        (1, None, "en", "a", 0), (2, "", None, "b", None), (3, long, "en", None, 9), (4, long, "en", "a", 9), (5, "one two three", "en", "a", 1),
        (5, "one two three", "en", "a", 1), (6, " \t\n ", "en", "b", 1), (None, "no id here at all", "en", "b", 1), (7, "ünï ① \x00 zero\nsecond line", None, None, None),
    ]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit(1) for c in ("shard", "slot", "size", "fp", "line", "cell", "_rank", "score", "copies", "x")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def components(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    found = {r[0]: r[1] for r in connected_components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    want = components({x for e in edges for x in e}, edges)
    assert found == {k: v for k, v in want.items() if any(k in e for e in edges if e[0] != e[1])}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1 -----------------------------------------------------------------------


def test_mixing_targets_and_sums(spark, sf_dir):
    docs = pq.read_table(f"{sf_dir}/documents.parquet").to_pandas()
    found = Q.op1_mixing(spark, sf_dir).toPandas().merge(docs[["doc_id", "source"]], on="doc_id")
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in zip(docs.doc_id, docs.text)}
    assert (found["size"] == found.doc_id.map(sizes)).all()
    by = found.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    names = sorted(by.index, key=lambda s: s.encode())
    size = np.array([by["size"][n] for n in names], float)
    weight = np.array([(5, 2, 1)[i % 3] for i in range(len(names))], float)
    target, free, budget = np.zeros(len(names)), np.ones(len(names), bool), 1.5 * size.sum()
    while True:
        level = (budget - target[~free].sum()) / weight[free].sum()
        over = free & (weight * level > 2 * size)
        if not over.any():
            target[free] = (weight * level)[free]
            break
        target[over] = 2 * size[over]
        free &= ~over
    assert np.allclose([by["target"][n] for n in names], target)
    assert (by.taken - by.target).abs().max() <= 64  # ten documents a source: few sums
    assert (found.taken <= 2 * found["size"]).all()
    again = Q.op1_mixing(spark, sf_dir).toPandas()
    assert found[["doc_id", "taken"]].sort_values("doc_id").values.tolist() == again[["doc_id", "taken"]].sort_values("doc_id").values.tolist()


def test_fit_counts_reaches_what_can_be_reached():
    rng = np.random.default_rng(0)
    for _ in range(60):
        lengths = np.unique(rng.integers(1, 40, rng.integers(1, 7)))
        counts = rng.integers(0, 5, len(lengths))
        budget = int(rng.integers(0, max(1, (lengths * counts).sum()) + 3))
        taken = fit_counts(lengths, counts, budget)
        assert ((taken >= 0) & (taken <= counts)).all()
        got = int((taken * lengths).sum())
        sums = {sum(n * s for n, s in zip(c, lengths, strict=True)) for c in itertools.product(*(range(n + 1) for n in counts))}
        assert got == max(s for s in sums if s <= budget)


def test_fit_counts_of_large_budgets():
    rng = np.random.default_rng(1)
    lengths, counts = np.arange(1, 3000), rng.integers(0, 50, 2999)
    for budget in (10**5, 10**7, 6 * 10**7):
        taken = fit_counts(lengths, counts, budget)
        assert ((taken >= 0) & (taken <= counts)).all() and (taken * lengths).sum() == budget


def test_mixing_odd_rows(spark, odd, empty):
    found = mix_sources(odd).collect()
    assert len(found) == odd.count()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in found)
    assert {r["source"] for r in found} == {"a", "b", None}
    assert mix_sources(empty).count() == 0
    mixed = mixed_documents(odd)
    assert mixed.columns == odd.columns


def test_fit_counts_of_very_long_documents():
    lengths, counts = np.array([3, 1 << 26, (1 << 26) + 7, 1 << 27]), np.array([0, 1, 1, 1])
    assert fit_counts(lengths, counts, (1 << 26) + 10**6).tolist() == [0, 0, 1, 0]
    assert fit_counts(lengths, counts, 10**6).tolist() == [0, 0, 0, 0]


def test_mix_of_rows_without_own_id(spark):
    """Rows that share an id or have none are taken one by one, and columns keep their names and values."""
    rows = [(None, " ".join(["w"] * (3 + k)), "en", "a", k) for k in range(40)] + [(7, " ".join(["v"] * (4 + k)), "en", "b", k) for k in range(40)]
    df = spark.createDataFrame(rows, DOCS).withColumns({"_copies": F.col("n_chars") + 100, "key": F.col("n_chars") + 200, "row": F.col("n_chars") + 300, "copy": F.lit(5)})
    reported = collections.Counter()
    for r in mix_sources(df).collect():
        reported[r["source"]] += r["taken"]
    mixed = mixed_documents(df).collect()
    got = collections.Counter()
    for r in mixed:
        got[r["source"]] += len(r["text"].split())
        assert (r["_copies"], r["key"], r["row"], r["copy"]) == (r["n_chars"] + 100, r["n_chars"] + 200, r["n_chars"] + 300, 5)
    assert abs(got["a"] - reported["a"]) <= 2 * 43 and abs(sum(got.values()) - sum(reported.values())) <= 2 * 43
    assert max(collections.Counter((r["source"], r["n_chars"]) for r in mixed).values()) <= 2


# 2, 7 --------------------------------------------------------------------


def test_counts_equal_the_library(spark, sf_dir, texts):
    model = sentencepiece.SentencePieceProcessor(model_file=Q.piece_model())
    found = rows_of(Q.op7_token_counts(spark, sf_dir))
    for i, text in texts.items():
        n = len(model.encode(text))
        assert (found[i]["n_tokens"], found[i]["n_bytes"], found[i]["over_limit"]) == (n, len(text.encode()), n > 4096)


def test_prefix_tables(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=Q.piece_model())
    rng = random.Random(1)
    parts = ["a", "b", " ", "the", "ing", "é", "ß", "\n", "$", "ﬁ", "①", "日本", "▁", "   ", "tion", "<s>", "\x00", "😀", "ا", "́"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 15)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counter = load_counter(Q.piece_model())
    for r, (_, text) in zip(sorted(prefix_tables(df, Q.piece_model()).collect()), rows, strict=True):
        table = [len(model.encode(text[:k])) for k in range(len(text) + 1)]
        assert r["prefix_tokens"] == table
        for budget in (0, 1, 3, 8):
            assert counter.longest_fit(text, budget) == max(k for k, n in enumerate(table) if n <= budget)


def test_best_segmentations_against_all(spark):
    lattice, rng = load_lattice(Q.piece_model(), 4), random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice(["a", " the", "ing", "é", "$", "①", "tion", "in"]) for _ in range(rng.randint(1, 5)))
        chunk = "▁" + text.replace(" ", "▁")
        edges = lattice._scan(chunk)[0]
        scores = []

        def walk(at, score, edges=edges, scores=scores, size=len(chunk)):
            if at == size:
                scores.append(score)
            for start, end, w, _ in edges:
                if start == at:
                    walk(end, score + w)

        walk(0, 0.0)
        ids, best = lattice.best(text)
        assert np.allclose([s for s, _ in best], sorted(scores, reverse=True)[:4])
        assert all(decode_ids(lattice.pieces, lattice.apply(ids, c)) == text for _, c in best)


@pytest.mark.parametrize("text", ["the" * 67_000, "a" * 200_000, "".join(random.Random(5).choices("abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/", k=200_000)), "日本" * 50_000])
def test_long_texts_without_spaces(text):
    """Time and memory in proportion to the text, and N segmentations by falling score."""
    lattice = load_lattice(Q.piece_model(), 4)
    began = time.process_time()
    ids, best = lattice.best(text)
    assert time.process_time() - began < 60
    tracemalloc.start()
    lattice.best(text[: len(text) // 10])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6  # 300 MB for the whole text
    assert [s for s, _ in best] == sorted((s for s, _ in best), reverse=True)
    tried = [lattice.apply(ids, c) for _, c in best]
    assert len({tuple(x) for x in tried}) == len(best) and all(decode_ids(lattice.pieces, x) == text for x in tried)
    score = lattice.pieces.score
    if not any(i in lattice.pieces.byte_id for i in ids):
        assert np.allclose([sum(score[i] for i in x) for x in tried], [s for s, _ in best])


def test_codec_round_trip(spark, sf_dir, texts, odd, empty):
    found = Q.op2_sentencepiece(spark, sf_dir)
    back = {r["doc_id"]: r["text"] for r in decode_documents(found, Q.piece_model()).collect()}
    assert back == texts
    assert found.where("not round_trip or n_tokens <> size(token_ids)").count() == 0
    assert found.where("array_sort(nbest_scores, (x, y) -> case when x > y then -1 when x < y then 1 else 0 end) <> nbest_scores").count() == 0
    strange = encode_documents(odd, Q.piece_model())
    assert strange.count() == odd.count() and strange.where("not round_trip").count() == 0
    assert strange.where("doc_id = 1").first()["n_tokens"] == 0
    assert encode_documents(empty, Q.piece_model()).count() == 0
    rows = nbest_segmentations(odd.where("doc_id = 5").limit(1), Q.piece_model()).collect()
    assert [r["place"] for r in rows] == [1, 2, 3, 4]
    assert len({tuple(r["token_ids"]) for r in rows}) == 4


def test_counts_of_odd_rows(odd, empty):
    found = count_tokens(odd, Q.piece_model(), limit=3).collect()
    assert len(found) == odd.count()
    assert {r["doc_id"]: r["n_tokens"] for r in found}[1] == 0
    assert count_tokens(empty, Q.piece_model()).count() == 0


def test_pieces_reject_models_that_normalise():
    assert load_pieces(Q.piece_model()).words("") == []


# 3 -----------------------------------------------------------------------


def test_fingerprints_of_edited_texts(spark, sf_dir, texts):
    found, ids = rows_of(Q.op3_ctph(spark, sf_dir)), sorted(texts)
    assert set(found) == set(ids)
    for k, i in enumerate(ids):
        text, after = texts[i], texts[ids[(k + 1) % len(ids)]]
        m = len(text) // 4
        edited = text[: len(text) - m] + after[:m]
        r = found[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fingerprint(text.encode()), fingerprint(edited.encode()))
        assert r["near_next"] == pytest.approx(likeness([r["fingerprint"]], [found[ids[(k + 1) % len(ids)]]["fingerprint"]])[0])
    assert np.mean([r["near_edited"] for r in found.values()]) > 0.6 > 0.3 > np.mean([r["near_next"] for r in found.values()])


def test_signatures_chunk_by_chunk():
    """Boundaries and characters from a byte-by-byte reading of the definition."""

    def rolled(data, at):
        window = [data[i] if i >= 0 else 0 for i in range(at - 6, at + 1)]
        h = 0
        for i, c in enumerate(window):
            h = (h + (c + 1) * pow(0x01000193, 6 - i, 1 << 32)) % (1 << 32)
        h = (h ^ h >> 15) * 0x9E3779B1 % (1 << 32)
        return h ^ h >> 13

    def signature(data, block):
        chunks, open_ = [0], False
        for i in range(len(data)):
            h = rolled(data, i)
            chunks[-1], open_ = (chunks[-1] + h) % (1 << 32), True
            if h % block == block - 1:
                chunks.append(0)
                open_ = False
        chunks = chunks if open_ else chunks[:-1]
        run = -(-len(chunks) // 64)
        return "".join(char(sum(chunks[k : k + run]) % (1 << 32)) for k in range(0, len(chunks), run)), len(chunks)

    def char(total):
        return "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"[(total ^ total >> 16) * 0x9E3779B1 % (1 << 32) >> 26]

    rng = random.Random(8)
    for n in (1, 5, 40, 300, 2000):
        data = bytes(rng.randrange(97, 123) for _ in range(n))
        block, first, second = fingerprint(data).split(":")
        assert (first, second) == (signature(data, int(block))[0], signature(data, 2 * int(block))[0])
        assert signature(data, int(block))[1] <= 64 and (int(block) == 3 or len(first) >= 8)


def test_signatures_cover_texts_of_short_period():
    """A quarter of the text changed is a quarter of the characters, however many chunks there are."""
    rng = random.Random(3)
    for period in (9, 30, 41, 200, 1500):
        unit = bytes(rng.randrange(97, 123) for _ in range(period))
        text = unit * (60_000 // period)
        edited = text[: len(text) * 3 // 4] + bytes(rng.randrange(97, 123) for _ in range(len(text) // 4))
        for t in (text, edited):
            block, first, second = fingerprint(t).split(":")
            assert len(first) <= 64 and len(second) <= 64
        near = likeness([fingerprint(text)], [fingerprint(edited)])[0]
        assert fingerprint(text) != fingerprint(edited) and near < 0.9, (period, near)


def test_likeness_is_the_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (0 if x == y else 2)))
            row = new
        return row[-1]

    rng = random.Random(6)
    pairs = [("".join(rng.choice("abc") for _ in range(rng.randint(0, 64))), "".join(rng.choice("abc") for _ in range(rng.randint(0, 64)))) for _ in range(40)] + [("a" * 64, "a" * 64 + "")]
    got = likeness([f"3:{a}:" for a, _ in pairs], [f"3:{b}:" for _, b in pairs])
    want = [1.0 if a == b else 1 - distance(a, b) / (len(a) + len(b)) for a, b in pairs]
    assert np.allclose(got, want)
    assert likeness(["3:ab:cd", "3:x:ab", None], ["12:ab:cd", "6:ab:q", "3::"])[:2].tolist() == [0.0, 1.0]
    assert fingerprint(b"") == "3::"


def test_next_row_with_ties_and_nulls(spark):
    rows = [(i, f"t{i}") for i in range(500)] + [(None, "n1"), (None, "n2"), (7, "t7b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["text"]: r["next_text"] for r in with_next_row(df, ["text"], rows_per_part=60).collect()}
    assert len(found) == len(rows) and sorted(found.values()) == sorted(found)
    start, seen = "n1", []
    while start not in seen:
        seen.append(start)
        start = found[start]
    assert len(seen) == len(rows)
    assert found["t100"] == "t101" and found["t499"] in ("n1", "n2")
    one = with_next_row(df.where("doc_id = 3"), ["text"]).collect()
    assert [(r["text"], r["next_text"]) for r in one] == [("t3", "t3")]
    assert with_next_row(df.where("doc_id < 0"), ["text"]).count() == 0


# 4 -----------------------------------------------------------------------


def test_shards_are_even_and_gapless(spark, sf_dir, texts):
    found = Q.op4_hash_ring(spark, sf_dir).collect()
    shards = collections.defaultdict(list)
    for r in found:
        shards[r["shard"]].append(r["slot"])
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "rows", None)
    assert sorted(shards) == list(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1


def test_overflow_goes_clockwise():
    owners, counts = [0, 1, 0, 2], [5, 1, 4, 0]
    flows = place_counts(owners, counts, [4, 3, 3])
    got = collections.Counter()
    for arc, lo, hi, shard, _ in flows:
        got[arc, shard] += hi - lo
    # shard 0 keeps four keys of its first arc; the fifth meets shard 1 next, those of the third arc shard 2
    assert got == {(0, 0): 4, (1, 1): 1, (0, 1): 1, (2, 2): 3, (2, 1): 1}
    with pytest.raises(ValueError):
        place_counts(owners, counts, [1, 1, 1])


def test_few_keys_move_when_a_shard_is_added(spark, odd, empty):
    keys = spark.range(4000).withColumnRenamed("id", "doc_id")
    a, b = (rows_of(assign_shards(keys, n, slack=0.25)) for n in (8, 9))
    moved = sum(a[k]["shard"] != b[k]["shard"] for k in a)
    assert moved < 0.35 * len(a)
    sizes = collections.Counter(r["shard"] for r in a.values())
    assert max(sizes.values()) <= 1.25 * 500
    same = spark.range(3000).selectExpr("1L as doc_id", "id as other")
    even = collections.Counter(r["shard"] for r in assign_shards(same, 8, order=("other",)).collect())
    assert max(even.values()) - min(even.values()) <= 1
    placed = assign_shards(odd, 3)
    assert placed.count() == odd.count() and set(placed.columns) == set(odd.columns)
    assert assign_shards(empty, 3).count() == 0


def test_columns_of_the_caller_are_left_alone(spark):
    names = ["_rank", "_cell", "_arc", "_at", "_lo", "_hi", "_slot", "row", "key", "order"]
    df = spark.range(50).select(F.col("id").alias("doc_id"), *((F.col("id") + 100 + k).alias(n) for k, n in enumerate(names)))
    for r in assign_shards(df, 4, order=("_slot",)).collect():
        assert [r[n] for n in names] == [r["doc_id"] + 100 + k for k in range(len(names))]
    lines = df.select("doc_id", F.concat(F.lit("some words of line "), "doc_id", F.lit("\nx")).alias("text"), *((F.col("_rank") + k).alias(n) for k, n in enumerate(("_doc", "_gone", "line", "doc", "gone", "row", "key"))))
    for r in dedup_lines(lines).collect():
        assert [r[n] for n in ("_doc", "_gone", "line", "doc", "gone", "row", "key")] == [r["doc_id"] + 100 + k for k in range(7)]


def test_ring_against_a_walk(spark):
    """Every key goes to the first point from its hash on whose shard has room, one key after the other along the ring."""
    from barloom.llm.hash_ring import even_capacity, ring_points

    points = ring_points(5, 8)
    keys = spark.range(700).select(F.col("id").alias("doc_id"), F.shiftrightunsigned(F.xxhash64(F.lit("ring"), "id"), 2).alias("at"), F.pmod(F.xxhash64(F.lit("cell"), "id"), F.lit(32)).alias("cell")).collect()
    arc = lambda at: next((i for i, (p, _) in enumerate(points) if p >= at), len(points)) % len(points)
    queue = collections.defaultdict(list)
    for r in sorted(keys, key=lambda r: (r["cell"], r["at"], r["doc_id"])):
        queue[arc(r["at"])].append(r["doc_id"])
    room, want, waiting = even_capacity(700, 5), {}, []
    for i, (_, shard) in enumerate(points):  # its own keys first
        own = queue[i]
        for k in own[: room[shard]]:
            want[k] = shard
        queue[i] = own[room[shard] :]
        room[shard] = max(0, room[shard] - len(own))
    for lap in range(2):  # then what overflowed, clockwise
        for i, (_, shard) in enumerate(points):
            if lap == 0:
                waiting += queue[i]
            while waiting and room[shard]:
                want[waiting.pop(0)] = shard
                room[shard] -= 1
    assert {k: r["shard"] for k, r in rows_of(assign_shards(spark.range(700).withColumnRenamed("id", "doc_id"), 5, virtual_nodes=8)).items()} == want


# 5 -----------------------------------------------------------------------


def plain_removed(texts, t=0.8):
    sets, gone, index = [], set(), collections.defaultdict(list)
    for i in sorted(texts):
        for k, line in enumerate((texts[i] or "").split("\n")):
            s = frozenset(w for w in re.split(r"[\x20\x09-\x0D]+", line.lower()) if w)
            if not s:
                continue
            meets = collections.Counter(j for w in s for j in index[w])
            if any(n / (len(s) + len(sets[j]) - n) >= t - 1e-12 for j, n in meets.items()):
                gone.add((i, k))
            for w in s:
                index[w].append(len(sets))
            sets.append(s)
    return gone


def test_lines_against_all_pairs(spark, sf_dir, texts):
    found = Q.op5_line_dedup(spark, sf_dir).collect()
    assert {(r["doc_id"], k) for r in found for k in r["removed"]} == plain_removed(texts)
    assert all(r["n_lines"] == len(texts[r["doc_id"]].split("\n")) and r["n_removed"] == len(r["removed"]) for r in found)


def test_families_of_variant_lines(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(30)]
    texts = {}
    for i in range(150):
        line = list(base)
        for _ in range(rng.randint(0, 4)):
            line[rng.randrange(30)] = f"x{rng.randrange(60)}"
        texts[i] = " ".join(line) + "\n" + " ".join(f"y{rng.randrange(8)}" for _ in range(rng.randint(1, 7)))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r["doc_id"], k) for r in line_report(df).collect() for k in r["removed"]}
    assert got == plain_removed(texts)


def test_line_dedup_of_odd_rows(odd, empty):
    kept = dedup_lines(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert texts[1] is None and texts[2] == "" and texts[4] == "" and texts[5] == "one two three" and texts[6] == " \t\n "
    assert dedup_lines(empty).count() == 0


# 6 -----------------------------------------------------------------------


def plain_links(vectors, labels, t):
    x = np.stack(vectors).astype(np.float64)
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    g = (x @ x.T >= t) & (np.array(labels)[:, None] == np.array(labels)[None, :])
    np.fill_diagonal(g, False)
    return g


def test_embeddings_against_all_pairs(spark, sf_dir):
    table = pq.read_table(f"{sf_dir}/embeddings.parquet").to_pandas()
    g = plain_links(list(table.embedding), table.label, 0.93)
    want = components(list(table.vec_id), [(table.vec_id[a], table.vec_id[b]) for a, b in zip(*np.nonzero(g))])
    found = rows_of(Q.op6_embedding_dedup(spark, sf_dir), "vec_id")
    for k, i in enumerate(table.vec_id):
        assert (found[i]["n_links"], found[i]["component_id"], found[i]["kept"]) == (g[k].sum(), want[i], want[i] == i)


def test_cells_lose_no_link(spark):
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(40, 16))
    x = (centers[rng.integers(0, 40, 5000)] + rng.normal(size=(5000, 16)) * 0.45).astype(np.float32)
    x[4000:4050] = x[0]
    labels = [int(v) for v in (rng.random(5000) < 0.1)]
    df = spark.createDataFrame([(i, [float(v) for v in r], lab) for i, (r, lab) in enumerate(zip(x, labels, strict=True))], "vec_id long, embedding array<float>, label int")
    g = plain_links(list(x), labels, 0.9)
    found = rows_of(near_embeddings(df, 0.9), "vec_id")
    assert [found[i]["n_links"] for i in range(5000)] == g.sum(axis=1).tolist()
    want = components(range(5000), list(zip(*np.nonzero(g))))
    assert all(found[i]["component_id"] == want[i] for i in range(5000))


def test_vectors_that_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1),
            (8, [None, 1.0], 1), (9, [1.0, 0.0], None), (10, [], 1), (None, [1.0, 0.0], 1), (11, [1.0, 0.0, 0.0], 1), (2, [2.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(0) for c in ("rep", "n", "cell", "dim")})
    found = near_embeddings(df, 0.93).collect()
    assert len(found) == len(rows)
    by = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found}
    assert by[1] == (2, 1, True) and by[2] == (2, 1, False)
    assert all(by[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)) and by[None] == (0, None, True)
    assert near_embeddings(df.where("vec_id < 0"), 0.93).count() == 0


def test_vectors_under_one_id_and_other_types(spark):
    rows = [(1, [1.0, 0.0], "p"), (1, [0.0, 1.0], "p"), (2, [1.0, 1e-9], "p"), (3, [0.0, 2.0], "p"), (4, [0.0, 2.0], "q")]
    found = near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"), 0.93).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in found) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 0, 4)]


# 8 -----------------------------------------------------------------------


def test_features_one_by_one():
    from barloom.llm.toxicity import FEATURES, Reader

    read = Reader({"vile ": 2.0, "rott": 1.0})
    f = lambda text: dict(zip(FEATURES, read.features(text), strict=True))
    plain = f("The weather is mild today.")
    assert plain["hits"] == plain["near_second_person"] == plain["hidden"] == 0 and plain["log_words"] == pytest.approx(np.log1p(5))
    assert f("a vile b")["hits"] == pytest.approx(np.log1p(1)) and f("a vilely b")["hits"] == 0  # a whole word
    assert f("rotten apples")["top_weight"] == 1.0 and f("rotten vile")["weighted_density"] == pytest.approx(1.5)
    assert f("you are vile")["near_second_person"] == pytest.approx(1 / 3) and f("you " + "x" * 90 + " vile")["near_second_person"] == 0
    assert f("you and your")["second_person"] == pytest.approx(2 / 3)
    assert f("ABc d")["capitals"] == pytest.approx(0.5) and f("LOUD cry")["shouting"] == pytest.approx(0.5)
    assert f("no!!")["punctuation"] == pytest.approx(0.5) and f("no!!")["exclamation"] == pytest.approx(0.5) and f("a12b")["digits"] == pytest.approx(0.5)
    assert f("r0tten v1le")["hidden"] == pytest.approx(1.0) and f("r0tten v1le")["hidden_hits"] == pytest.approx(np.log1p(2))
    assert len(read.features("")) == len(FEATURES)


def test_scores_from_trees_and_steps(spark, larger_dir):
    """Every score again in plain Python: features, walks down the fitted trees, logistic link, interpolated steps."""
    from barloom.llm.toxicity import Reader, _held_out, fit_toxicity

    docs, labels = spark.read.parquet(f"{larger_dir}/documents.parquet"), spark.read.parquet(f"{larger_dir}/labels.parquet")
    model = fit_toxicity(docs, labels.where(~_held_out(F.col("doc_id"))))
    assert model.trees is not None
    reader = Reader(model.lexicon)

    def walk(node, x):
        while node.subtreeDepth():
            split = node.split()
            node = node.leftChild() if x[split.featureIndex()] <= split.threshold() else node.rightChild()
        return node.prediction()

    roots = [t._java_obj.rootNode() for t in model.trees.trees]
    bounds, levels = list(model.steps.boundaries), list(model.steps.predictions)
    found = rows_of(Q.op8_toxicity(spark, larger_dir))
    for r in docs.limit(40).collect():
        x = reader.features(r["text"] or "")
        margin = sum(w * walk(root, x) for w, root in zip(model.trees.treeWeights, roots, strict=True))
        p = 1 / (1 + np.exp(-2 * margin))
        score = 0.999 * np.interp(p, bounds, levels) + 0.001 * p
        assert found[r["doc_id"]]["score"] == pytest.approx(score, abs=1e-12) and found[r["doc_id"]]["predicted"] == (score >= 0.7)


def test_labelled_ids_with_several_texts(spark, larger_dir):
    """The model does not depend on the order of the rows where an id has several texts."""
    docs, labels = spark.read.parquet(f"{larger_dir}/documents.parquet"), spark.read.parquet(f"{larger_dir}/labels.parquet")
    other = docs.withColumn("text", F.concat(F.reverse("text"), F.lit(" you")))
    both = docs.unionByName(other)
    one = rows_of(score_documents(both.repartition(3), labels).groupBy("doc_id").agg(F.sort_array(F.collect_list("score")).alias("s")))
    two = rows_of(score_documents(both.orderBy(F.desc("doc_id"), "text").coalesce(2), labels).groupBy("doc_id").agg(F.sort_array(F.collect_list("score")).alias("s")))
    assert {i: r["s"] for i, r in one.items()} == {i: r["s"] for i, r in two.items()}


def test_calibration_is_isotonic(spark, larger_dir):
    from barloom.llm.toxicity import fit_toxicity

    big = larger_dir
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    model = fit_toxicity(docs, labels)
    bounds, levels = model.steps.boundaries, model.steps.predictions
    assert list(bounds) == sorted(bounds) and list(levels) == sorted(levels) and 0 <= levels[0] <= levels[-1] <= 1


def test_toxic_rows_without_an_id_go(spark):
    rows = [(i, f"you are vile scum number{i} awful" if i % 2 else f"a calm day number{i} outside", "en", "a", 1) for i in range(400)]
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(400)], LABELS)
    more = [(None, "you are vile scum today awful", "en", "a", 1), (None, "a calm day outside", "en", "a", 1), (3, "a calm day outside", "en", "a", 1)]
    kept = [(r["doc_id"], r["text"]) for r in drop_toxic(spark.createDataFrame(rows + more, DOCS), labels).collect()]
    assert (None, "a calm day outside") in kept and (3, "a calm day outside") in kept and not any("vile" in t for _, t in kept)



def test_toxicity_on_held_out_rows(spark, larger_dir):
    big = larger_dir
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{big}/labels.parquet").to_pylist()}
    found = rows_of(Q.op8_toxicity(spark, big))
    assert len(found) == pq.read_table(f"{big}/documents.parquet").num_rows
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for i, r in found.items())
    held = [(found[i]["score"], t) for i, t in labels.items() if found[i]["held_out"]]
    pos, neg = np.array([s for s, t in held if t == 1]), np.array([s for s, t in held if t == 0])
    auc = (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()
    assert auc > 0.85
    assert np.mean([found[i]["predicted"] for i, t in labels.items() if t == 0]) < 0.05


def test_toxicity_of_odd_rows(spark, odd, empty):
    none = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in score_documents(odd, none).collect()} == {0.0}
    one = spark.createDataFrame([(1, None, 1), (2, 0, 0), (None, 1, 1), (3, 1, None), (5, 0, 0), (5, 0, 1)], LABELS)
    assert score_documents(odd, one).count() == odd.count()
    assert drop_toxic(empty, one).count() == 0
    assert drop_toxic(odd, none).columns == odd.columns


# 9 -----------------------------------------------------------------------


def plain_spans(texts, length):
    where = collections.defaultdict(list)
    for i, text in texts.items():
        for s in range(len(text) - length + 1):
            where[text[s : s + length]].append((i, s))
    cover = {i: np.zeros(len(t) + 1, dtype=int) for i, t in texts.items()}
    for places in where.values():
        if len(places) > 1:
            for i, s in places:
                cover[i][s] += 1
                cover[i][s + length] -= 1
    return {i: np.cumsum(c)[:-1] > 0 for i, c in cover.items()}


def check_spans(found, texts, length):
    for i, gone in plain_spans(texts, length).items():
        kept = bytes(np.frombuffer(texts[i], np.uint8)[~gone])
        starts = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        r = found[i]
        assert (r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) == (len(texts[i]), int(gone.sum()), starts, hashlib.sha256(kept).hexdigest())
        assert r["kept"] is None or bytes(r["kept"]) == kept


def test_repeats_against_all_strings(spark, sf_dir, texts):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check_spans(rows_of(remove_repeats(docs)), {i: t.encode() for i, t in texts.items()}, 400)


def test_repeats_of_split_grams(spark, monkeypatch):
    import barloom.llm.suffix_dedup as module

    monkeypatch.setattr(module, "SPLIT", 4)
    rng = random.Random(9)
    base = "".join(rng.choice("abcd") for _ in range(300))
    texts = {}
    for i in range(60):
        text = list(base)
        for _ in range(rng.randint(0, 6)):
            text[rng.randrange(300)] = rng.choice("xyz")
        texts[i] = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 30))) + "".join(text) + "q" * rng.choice([0, 80])
    texts[60], texts[61] = "", "short"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check_spans(rows_of(remove_repeats(df, length=40, gram=12)), {i: t.encode() for i, t in texts.items()}, 40)


def test_columnwise_order_sorts_suffixes():
    rng = np.random.default_rng(2)
    m = rng.integers(0, 3, (40, 25)).astype(np.uint8)
    for column, order, common in columnwise_order(m):
        rows = [bytes(m[i, column:]) for i in order]
        assert rows == sorted(rows)
        for k in range(1, 40):
            n = next((j for j in range(25 - column) if rows[k][j] != rows[k - 1][j]), 25 - column)
            assert common[k] == n


def test_every_string_holds_an_anchor():
    data = bytes(random.Random(5).choice(b"ab") for _ in range(900)) + b"c" * 200
    place, _ = anchors(data, 60, 20)
    for s in range(len(data) - 59):
        assert ((place >= s) & (place <= s + 40)).any()
    assert len(anchors(b"x" * 59, 60, 20)[0]) == 0


def test_repeats_of_odd_rows(odd, empty):
    found = remove_repeats(odd).collect()
    assert len(found) == odd.count()
    by = {r["doc_id"]: r for r in found}
    assert by[3]["n_removed"] == by[3]["n_bytes"] > 400 and by[1]["n_bytes"] == 0 and by[None]["n_removed"] == 0
    assert remove_repeats(empty).count() == 0


# 10 ----------------------------------------------------------------------


def plain_simhash(text, words=3):
    tokens = [t for t in re.split(rb"[\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())) if t]
    if not tokens:
        return 0
    shingles = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_all_pairs(spark, sf_dir, texts):
    prints = {i: plain_simhash(t) for i, t in texts.items()}
    linked = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = components(prints, linked)
    found = rows_of(Q.op10_simhash(spark, sf_dir))
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in found.items()} == {i: (f"{p:016x}", want[i]) for i, p in prints.items()}


def test_grid_join_finds_all_close_prints(spark):
    from barloom.llm.simhash import close_pairs

    rng = random.Random(7)
    prints = {0, -1, (1 << 63) - 1, -(1 << 63)}
    for _ in range(150):
        p = rng.getrandbits(64)
        for _ in range(3):
            q = p
            for _ in range(rng.randint(0, 3)):
                q ^= 1 << rng.randrange(64)
            prints.add(q - (1 << 64) if q >> 63 else q)
    got = {tuple(r) for r in close_pairs(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()}
    want = {(a, b) for a, b in itertools.permutations(prints, 2) if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert got == want


def test_simhash_of_odd_rows(odd, empty):
    found = near_duplicates(odd).collect()
    assert len(found) == odd.count()
    by = {r["doc_id"]: r for r in found}
    assert by[1]["fp"] == by[2]["fp"] == by[6]["fp"] == 0 and by[6]["component_id"] == 1 and by[4]["component_id"] == 3
    assert near_duplicates(empty).count() == 0
    kept = keep_representatives(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 3, 5, 7]
