"""All N segmentations of every text, and batches in bounded pieces."""

import pyarrow as pa
from barloom.llm.parts import parts_of
from barloom.llm.queries import op2_sentencepiece, piece_model
from barloom.llm.sentencepiece_codec import decode_ids, encode_documents, load_lattice, nbest_segmentations

ODD = [(1, None), (2, ""), (3, "a"), (4, "the thing in the  ring"), (5, "日本 $ ① é"), (None, "an ing"), (4, "the thing in the  ring"), (6, "x" * 300)]


def test_every_segmentation_comes_as_ids(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    found = encode_documents(docs, piece_model(), n=4).collect()
    assert len(found) == len(ODD)
    pieces, texts = load_lattice(piece_model(), 4).pieces, dict(ODD)
    for r in found:
        assert r["nbest_ids"][0] == r["token_ids"]
        assert list(map(len, r["nbest_ids"])) == r["nbest_tokens"] and len(r["nbest_ids"]) == len(r["nbest_scores"])
        assert len(set(map(tuple, r["nbest_ids"]))) == len(r["nbest_ids"])
        assert all(decode_ids(pieces, ids) == (texts[r["doc_id"]] or "") for ids in r["nbest_ids"]) and r["round_trip"]
    apart = {(r["doc_id"], r["place"]): r["token_ids"] for r in nbest_segmentations(docs, piece_model(), n=4).collect()}
    assert {(r["doc_id"], k): ids for r in found for k, ids in enumerate(r["nbest_ids"], 1)} == apart


def test_query_has_four_segmentations(spark, sf_dir):
    found = op2_sentencepiece(spark, sf_dir)
    assert found.where("size(nbest_ids) = 0 or nbest_ids[0] <> token_ids or transform(nbest_ids, x -> size(x)) <> nbest_tokens").count() == 0
    assert found.where("n_tokens > 50 and size(nbest_ids) <> 4").count() == 0


def test_parts_are_bounded_and_whole():
    texts = [None, "", "a" * 5000, *("b" * k for k in range(40)), "c" * 900, None]
    batch = pa.record_batch({"doc_id": list(range(len(texts))), "text": texts})
    parts = list(parts_of(iter([batch, batch.slice(0, 0)]), rows=7, size=1000))
    assert pa.Table.from_batches(parts).column("text").to_pylist() == texts
    assert all(p.num_rows <= 7 and (p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 1000) for p in parts)
    lists = pa.record_batch({"doc_id": [1, 2, 3], "ids": [[1] * 600, None, [2] * 600]})
    assert [p.num_rows for p in parts_of(iter([lists]), size=1000)] == [2, 1]
