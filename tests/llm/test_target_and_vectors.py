"""Importance resampling, whitening and collision search against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F, types as T

from barloom.llm import importance, queries as Q, whitening
from barloom.llm.collision_search import nearest_by_inner_product
from barloom.llm.importance import ngrams, resampled_documents, resampling_report
from barloom.llm.whitening import whiten
from test_operators import DOCS, LONG

SMALL = {chr(c): chr(c + 32) for c in range(65, 91)}
WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
VECTORS = "vec_id long, embedding array<float>, label int"
ODD_TEXTS = ["Hello World 12 foo", "", None, "  ", "ÜNï A b\x00c ①x É", " ".join("w" * n for n in range(1, 130)), "x", "the end"]


def words_of(text):
    return WORDS.findall((text or "").translate(str.maketrans(SMALL)))


def features_of(text, most=2):
    words = words_of(text)
    return [zlib.crc32(" ".join(words[i : i + n]).encode()) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def plain_report(docs, target, share=25, least=20, buckets=10000):
    """``(id, n_features, weight, score, rank)`` in the order of ``docs``."""
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(c % buckets for c in features_of(text))
    for text in target:
        t.update(c % buckets for c in features_of(text))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)}
    rows = []
    for i, text in docs:
        own = [gain[c % buckets] for c in features_of(text)]
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(own) // len(own) if own else 0
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = [k for k, (_, text) in enumerate(docs) if len(words_of(text)) >= least]
    for place, k in enumerate(sorted(able, key=lambda k: (-rows[k][3], rows[k][0] is None, rows[k][0]))[: share * len(able) // 100], 1):
        rows[k][4] = place
    return rows


def order(row):
    return [(x is None, x) for x in row]


# 11 ----------------------------------------------------------------------


@pytest.mark.parametrize("most", [1, 2, 3])
def test_ngrams_of_joined_texts(most):
    words, owners, sums = ngrams([None if t is None else t.encode() for t in ODD_TEXTS], most)
    assert words.tolist() == [len(words_of(t)) for t in ODD_TEXTS]
    assert sorted(zip(owners.tolist(), sums.tolist(), strict=True)) == sorted((i, c) for i, t in enumerate(ODD_TEXTS) for c in features_of(t, most))


def test_resampling_against_plain(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()]
    target = pq.read_table(f"{sf_dir}/benchmark.parquet")["text"].to_pylist()
    found = [list(r) for r in Q.op11_importance_resampling(spark, sf_dir).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert sorted(found, key=order) == sorted(plain_report(docs, target), key=order)
    assert sum(r[4] is not None for r in found) == 25 * sum(len(words_of(t)) >= 20 for _, t in docs) // 100 > 0


def test_resampling_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(importance, "CHUNK", 2000)  # texts of one batch in several joins
    rng = random.Random(3)
    texts = ODD_TEXTS + [LONG % tuple(range(3000))] * 2 + [" ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(60))) for _ in range(60)]
    docs = list(enumerate(texts)) + [(None, texts[-1]), (None, "alone " * 30), (12, texts[12]), (12, texts[12])]
    target = ["w1 w2 w3 w4", None, "", "hello world"]
    df = spark.createDataFrame([(i, t, "en", None, None) for i, t in docs], DOCS)
    df = df.withColumns({c: F.lit("mine") for c in ("key", "id", "score", "weight", "rank", "n_words", "above", "bucket", "n")})
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    want = plain_report(docs, target)
    found = [list(r) for r in resampling_report(df, aim).drop("n_words").collect()]
    assert sorted(found, key=order) == sorted(want, key=order)
    drawn = resampled_documents(df, aim).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in drawn) == sorted((str(i), t) for (i, t), w in zip(docs, want, strict=True) if w[4])
    assert {r["rank"] for r in drawn} == {"mine"}


def test_resampling_of_empty_tables(spark):
    empty, one = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b " * 20, "en", "a", 1)], DOCS)
    assert resampling_report(empty, one).collect() == [] == resampled_documents(empty, one).collect()
    [row] = resampling_report(one, empty, share=100).collect()
    assert (row["n_words"], row["rank"]) == (40, 1)
    assert resampling_report(one, empty, share=99).collect()[0]["rank"] is None


def test_draw_prefers_texts_like_the_target(spark):
    rng = random.Random(5)
    text = lambda kind: " ".join(f"{kind}{rng.randrange(50)}" for _ in range(40))
    docs = [(i, text("near" if i % 5 == 0 else "far"), "en", "a", 1) for i in range(400)]
    aim = spark.createDataFrame([(text("near"),) for _ in range(20)], "text string")
    ids = [r["doc_id"] for r in resampled_documents(spark.createDataFrame(docs, DOCS), aim, share=15).collect()]
    assert len(ids) == 60 and sum(i % 5 == 0 for i in ids) >= 36  # 12 by chance


# 12 ----------------------------------------------------------------------


def held_to_eigh(found, vectors):
    """Compares a whitening with NumPy's eigenvectors, up to signs."""
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100000
    n, sums = len(x), x.sum(axis=0)
    values, turn = np.linalg.eigh(np.cov(x.T, bias=True))
    values, turn = values[::-1], turn[:, ::-1]
    k = found["component"].max()
    wide = found.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    want = (x - sums / n) @ turn[:, :k] / np.sqrt(values[:k])
    assert np.allclose(np.abs((wide * want).mean(axis=0)), 1, atol=1e-9)
    assert np.allclose(wide, want * np.sign((wide * want).sum(axis=0)), atol=1e-8)
    assert np.allclose(found.groupby("component")["explained"].first(), values[:k] / values.sum(), rtol=1e-9)
    one = found[found["component"] == 1].sort_values("vec_id")
    assert [int(d) for d in one["deviation"]] == [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    assert (found["n"] == n).all() and found["identity_error"].max() < 1e-9 and found["identity_error"].nunique() == 1


def test_whitening_of_the_table(spark, sf_dir):
    rows = sorted(pq.read_table(f"{sf_dir}/embeddings.parquet").to_pylist(), key=lambda r: r["vec_id"])
    found = Q.op12_whitening(spark, sf_dir)
    assert dict(found.dtypes)["deviation"] == "bigint"
    found = found.toPandas()
    assert len(found) == 8 * len(rows)
    held_to_eigh(found, [r["embedding"] for r in rows])


def test_whitening_of_close_eigenvalues(spark):
    """A flat spectrum with one large value, some of medium size, and copies that hold a third of the rows."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 40)) @ np.diag([9, 3, 3.01, 3.02] + [1] * 36)
    x[600:] = x[0]
    vectors = [[float(np.float32(c)) for c in v] for v in x]
    df = spark.createDataFrame([(i, v, None) for i, v in enumerate(vectors)], VECTORS).repartition(5)
    held_to_eigh(whiten(df, components=6).toPandas(), vectors)


def test_larger_value_beside_the_block_is_found():
    """A block that misses the leading vector is told so by the random block beside it."""

    class Diagonal:
        dim, passes, trace = 60, 0, 60.0

        def __matmul__(self, block):
            self.passes += 1
            return np.concatenate([[9.0, 8.0], np.linspace(3, 1, 58)])[:, None] * block

    found = whitening.leading_eigenvectors(Diagonal(), 3)
    assert np.allclose(found.values, [9, 8, 3]) and found.residual < 1e-12
    assert np.allclose(np.abs(found.vectors[:3]), np.eye(3), atol=1e-10)
    real, calls = whitening._ritz, []

    def blind(v, block):
        if not calls:
            block = block.copy()
            block[0] = 0  # the first block holds nothing of the leading vector, and nor do its products
        calls.append(1)
        return real(v, block)

    whitening._ritz = blind
    try:
        found = whitening.leading_eigenvectors(Diagonal(), 3)
    finally:
        whitening._ritz = real
    assert np.allclose(found.values, [9, 8, 3])


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(7)
    good = [[float(np.float32(c)) for c in v] for v in rng.normal(size=(30, 5))]
    rows = [(i, v, 1) for i, v in enumerate(good)]
    bad = [(90, None, 1), (91, [], 1), (92, [1.0, None, 1.0, 1.0, 1.0], 1), (93, [math.nan] * 5, 1), (94, [math.inf, 0.0, 0.0, 0.0, 0.0], 1), (95, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows + bad, VECTORS).withColumns({c: F.lit("mine") for c in ("n", "x", "component", "whitened", "ids")})
    held_to_eigh(whiten(df).toPandas(), good)
    again = spark.createDataFrame([*rows, (None, good[0], None), (3, good[4], None)], VECTORS)
    found = whiten(again, components=2).toPandas()
    assert len(found) == 64 and found["vec_id"].isna().sum() == 2 and (found["vec_id"] == 3).sum() == 4
    large = spark.createDataFrame([(i, [c * 1e9 for c in v], 1) for i, v in enumerate(good)], "vec_id long, embedding array<double>, label int")
    held_to_eigh(whiten(large).toPandas(), [[c * 1e9 for c in v] for v in good])


def test_whitening_without_variance(spark):
    assert whiten(spark.createDataFrame([], VECTORS)).collect() == []
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0], 0)], VECTORS)).collect() == []
    assert whiten(spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(9)], VECTORS)).collect() == []
    line = spark.createDataFrame([(i, [float(i)] + [0.0] * 30, 0) for i in range(9)], VECTORS)
    found = whiten(line).toPandas()
    assert set(found["component"]) == {1} and np.allclose(found["explained"], 1)


# 13 ----------------------------------------------------------------------


def plain_nearest(rows, k):
    """``{query row: [(-score, id) ...]}``."""
    x = np.array([v for _, v in rows], np.float64)
    ids = np.array([i for i, _ in rows])
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        scores = (x * x[q]).sum(axis=1)
        scores[q] = -np.inf
        out[int(q)] = [(-scores[i], int(ids[i])) for i in np.lexsort((ids, -scores))[: min(k, len(rows) - 1)]]
    return out


def held_to_search(found, rows, k, recall):
    want = plain_nearest(rows, k)
    by_id = {i: np.array(v, np.float64) for i, v in rows}
    hit = 0
    for q, best in want.items():
        mine = sorted((r["rank"], -r["score"], r["vec_id"]) for r in found if r["query_id"] == rows[q][0])
        assert [m[0] for m in mine] == list(range(1, len(best) + 1))
        assert [m[1:] for m in mine] == sorted(m[1:] for m in mine)
        assert all(abs(-s - (by_id[i] * by_id[rows[q][0]]).sum()) <= 1e-12 * max(1, abs(s)) for _, s, i in mine)
        # an equal score stands for the row it ties with
        hit += len({i for *_, i in mine} & {i for _, i in best})
    assert hit >= recall * sum(map(len, want.values())), hit
    assert len(found) == sum(map(len, want.values()))


def test_search_of_the_table(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{sf_dir}/embeddings.parquet").to_pylist()]
    held_to_search(Q.op13_collision_search(spark, sf_dir).collect(), rows, 20, 0.95)


def test_search_over_many_blocks(spark, monkeypatch):
    """Norms far apart, a large group of near copies, one of exact copies, and several rounds of blocks."""
    from barloom.llm import collision_search as search

    monkeypatch.setattr(search, "BLOCK", 300)
    monkeypatch.setattr(search, "CHUNK", 30)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(4000, 24)) * rng.lognormal(0, 0.3, 4000)[:, None]
    x[1000:2200] = x[0] + rng.normal(size=(1200, 24)) * 0.01
    x[3000:3500] = x[1]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).repartition(6)
    held_to_search(nearest_by_inner_product(df, F.col("vec_id") % 20 == 0, 20).collect(), rows, 20, 0.95)


def test_search_of_odd_rows(spark):
    rng = np.random.default_rng(13)
    good = [(i, [float(np.float32(c)) for c in rng.normal(size=4)]) for i in range(30)]
    good[21] = (21, good[20][1])
    good[22] = (22, good[20][1])  # a tie
    bad = [(100, None), (120, [0.0] * 4), (140, [math.nan] * 4), (160, [None, 1.0, 1.0, 1.0]), (None, [1.0] * 4), (180, [1.0, 2.0]), (200, []), (220, [math.inf] * 4)]
    df = spark.createDataFrame([(i, v, None) for i, v in good + bad], VECTORS).withColumns({c: F.lit(1) for c in ("key", "dim", "block", "bound", "query", "x", "asks")})
    found = nearest_by_inner_product(df, F.col("vec_id") % 20 == 0, 5).collect()
    held_to_search(found, good, 5, 1.0)
    all_of = nearest_by_inner_product(df, F.col("vec_id") == 0, 50).collect()
    assert len(all_of) == 29 and {r["query_id"] for r in all_of} == {0}
    twice = spark.createDataFrame([(0, [1.0, 0.0], 0), (0, [1.0, 1.0], 0), (1, [2.0, 0.0], 0)], VECTORS)
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in nearest_by_inner_product(twice, F.col("vec_id") == 0, 5).collect()) == [(1, 1, 2.0), (1, 1, 2.0), (2, 0, 1.0), (2, 0, 1.0)]
    nothing = spark.createDataFrame([], T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))]))
    assert nearest_by_inner_product(nothing, F.col("vec_id") % 20 == 0).collect() == []
    assert nearest_by_inner_product(df, F.col("vec_id") == 77).collect() == []
