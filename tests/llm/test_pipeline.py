"""The corpus pipeline, stage by stage, against plain versions of its decisions."""

import collections
import re

import corpus_pipeline
import pyarrow.parquet as pq
import pytest
from barloom.llm.mixing import mix_sources
from barloom.llm.queries import op8_toxicity, piece_model
from barloom.llm.sentencepiece_codec import decode_documents
from test_operators import components, plain_removed
from test_whole_rows import plain_shingles


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        from barloom.llm.scratch import keep

        docs = keep(stage(spark, docs, sf_dir))
        out.append(docs)
    return out


def test_columns(stages, spark, sf_dir):
    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").dtypes
    assert all(s.dtypes == columns for s in stages[:-1])


def test_decisions(stages, spark, sf_dir):
    first = {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()}
    toxic = {r["doc_id"] for r in op8_toxicity(spark, sf_dir).where("predicted = 1").collect()}
    texts = {r["doc_id"]: r["text"] for r in stages[0].collect()}
    assert texts == {i: t for i, t in first.items() if i not in toxic}
    gone = plain_removed(texts)
    cut = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in texts.items()}
    second = stages[1].collect()
    assert {r["doc_id"]: r["text"] for r in second} == cut
    assert all(r["n_chars"] == len(r["text"]) for r in second)
    sets, ids = {i: plain_shingles(t) for i, t in cut.items()}, list(cut)
    linked = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    group = components(ids, linked)
    assert {r["doc_id"] for r in stages[2].collect()} == {i for i in ids if group[i] == i}
    times = collections.Counter(r["doc_id"] for r in stages[3].collect())
    assert set(times.values()) <= {1, 2}
    # each source has the largest sum of whole documents that its target leaves room for
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    target = {r["source"]: r["target"] for r in mix_sources(stages[2]).collect()}
    have, taken = collections.defaultdict(list), collections.Counter()
    for r in stages[2].collect():
        have[r["source"]].append(size(r))
    for r in stages[3].collect():
        taken[r["source"]] += size(r)
    for source, sizes in have.items():
        passes = int(target[source] // sum(sizes))
        room, sums = round(target[source] - passes * sum(sizes)), 1
        for n in sizes:
            sums |= sums << n
        assert taken[source] == passes * sum(sizes) + max(s for s in range(room + 1) if sums >> s & 1)
    back = decode_documents(stages[4], piece_model()).collect()
    assert all(r["text"] == cut[r["doc_id"]] for r in back)
    assert collections.Counter(r["doc_id"] for r in back) == times


def test_run(spark, sf_dir, stages):
    found = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, found.select("doc_id", "n_tokens").collect())) == sorted(map(tuple, stages[4].select("doc_id", "n_tokens").collect()))
