"""Memory of a Python worker is a piece of a batch, not the batch."""

import random
import tracemalloc

import corpus_pipeline
import pyarrow as pa
import pytest
from barloom.llm.parts import SENT
from barloom.llm.shingle_dedup import _sets


def test_memory_of_long_texts_in_one_batch():
    """A batch of long texts takes a piece's memory: shingle sets of 12 MB of text come one piece after the other."""
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(5000)]
    batch = pa.record_batch({"key": list(range(120)), "text": [" ".join(rng.choices(words, k=15_000)) for _ in range(120)]})
    tracemalloc.start()
    rows = sum(out.num_rows for out in _sets(5, 0.8)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 120 and peak < 25e6


LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def open_limit(spark):
    before = spark.conf.get(LIMIT, None)
    spark.conf.unset(LIMIT)
    yield spark
    spark.conf.unset(LIMIT) if before is None else spark.conf.set(LIMIT, before)


@pytest.mark.parametrize("own", [None, 1 << 18])
@pytest.mark.parametrize("stage", [corpus_pipeline.toxicity, corpus_pipeline.near_dedup, corpus_pipeline.encoding])
def test_stages_send_short_batches(open_limit, sf_dir, stage, own):
    """8 MB of text in one task reach Python in batches of SENT bytes at most, or of the session's own limit."""
    spark, texts = open_limit, 400
    if own:
        spark.conf.set(LIMIT, own)
    stage(spark, spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string"), sf_dir)

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch({"rows": [batch.num_rows], "bytes": [batch.nbytes]})

    docs = spark.range(texts, numPartitions=1).selectExpr("id", "repeat('some text ', 2000) as text")
    found = docs.mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r["rows"] for r in found) == texts
    assert max(r["bytes"] for r in found) <= (own or SENT) + 40_000
