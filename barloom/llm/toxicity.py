"""Toxicity scores from gradient-boosted trees over dense text features.

The lexicon is read off labelled texts: words and beginnings of words that
stand in toxic texts far more often than chance gives. Features are the
densities of its terms, their closeness to second-person words, and rates of
capitals, punctuation and obfuscated spellings. The trees' probabilities are
calibrated by isotonic regression on labelled texts that the trees have not
seen.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F

from barloom.llm.parts import parts_of
from barloom.llm.rows import keyed_rows, with_keys
from barloom.llm.scratch import keep, settled

#: Labelled rows the model learns from, at most: the first by a hash of the id.
MOST_TRAINING_ROWS = 12_000
LEXICON_SIZE, LEAST_TEXTS, LEAST_CHI2, LEAST_SHARE = 256, 4, 25.0, 0.5
START_LENGTHS = (4, 5, 6)
THRESHOLD = 0.7
#: Words that address the reader, in the corpus's languages.
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "vous", "votre", "vos", "tú", "ti", "usted", "ustedes", "vosotros")
NEAR = 60
_STRIP = ".,;:!?\"'()[]{}<>*#$%&@~`|/\\-_+=^"
_LEET = str.maketrans("013457@$!|+", "oieastasiit")
_HIDDEN = re.compile(r"[^\W\d_]+[0-9@$*!|+][\w@$*!|+]*[^\W\d_]")
FEATURES = (
    "hits", "hit_density", "weighted_density", "top_weight", "distinct_hits", "toned_share", "near_second_person",
    "second_person", "capitals", "shouting", "punctuation", "exclamation", "digits", "hidden", "hidden_hits", "log_words",
)


def terms_of(text: str) -> set[str]:
    """A text's words (ending in a space) and beginnings of words, each once."""
    out: set[str] = set()
    for word in {w.strip(_STRIP) for w in set(text.lower().split())}:
        if len(word) >= 3:
            out.add(word + " ")
            out.update(word[:n] for n in START_LENGTHS if len(word) >= n)
    return out


def fit_lexicon(rows: DataFrame) -> dict[str, float]:
    """Log-odds of the terms that mark toxic texts, from ``rows(text, toxic)``; at most LEXICON_SIZE of them."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with_term: tuple[Counter, Counter] = (Counter(), Counter())
        for frame in frames:
            for text, toxic in zip(frame["text"], frame["toxic"], strict=True):
                with_term[int(toxic)].update(terms_of(text or ""))
        pos, neg = with_term[1], with_term[0]
        # a term of no toxic text marks nothing
        yield pd.DataFrame({"term": list(pos), "pos": list(pos.values()), "neg": [neg[t] for t in pos]})
        rest = [t for t in neg if t not in pos]
        yield pd.DataFrame({"term": rest, "pos": 0, "neg": [neg[t] for t in rest]})

    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    if not n_pos or not n_neg:
        return {}
    table = rows.select("text", "toxic").mapInPandas(count, "term string, pos long, neg long")
    table = table.groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    a, b = F.col("pos").cast("double"), F.col("neg").cast("double")
    odds = F.log(((a + 0.5) / (n_pos + 1)) / ((b + 0.5) / (n_neg + 1)))
    cross = (a * (n_neg - b) - b * (n_pos - a)) ** 2 * (n_pos + n_neg)
    chi2 = cross / ((a + b) * (n_pos + n_neg - a - b + 1e-9) * n_pos * n_neg)
    marked = table.where((a >= LEAST_TEXTS) & (a >= LEAST_SHARE * (a + b))).select("term", odds.alias("odds"), chi2.alias("chi2"))
    best = marked.where(F.col("chi2") >= LEAST_CHI2).orderBy(F.desc("chi2"), "term").limit(LEXICON_SIZE).collect()
    return {r["term"]: r["odds"] for r in best}


class Reader:
    """Turns texts into feature rows for one lexicon."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon = lexicon
        self.automaton = ahocorasick.Automaton()
        for term, odds in lexicon.items():
            self.automaton.add_word(term.rstrip(" "), ())
        for word in SECOND_PERSON:
            self.automaton.add_word(word, ())
        self.kinds: dict[str, tuple[float, float, bool]] = {}
        for text in {t.rstrip(" ") for t in lexicon} | set(SECOND_PERSON):
            self.kinds[text] = (lexicon.get(text, 0.0), lexicon.get(text + " ", 0.0), text in SECOND_PERSON)
        for text, kind in self.kinds.items():
            self.automaton.add_word(text, (len(text), *kind, text))
        self.automaton.make_automaton()

    def features(self, text: str) -> list[float]:
        lower, n_words = text.lower(), len(text.split())
        hits: dict[int, float] = {}
        names, second = set(), []
        for end, (size, as_start, as_word, addressed, name) in self.automaton.iter(lower):
            start = end - size + 1
            if start and lower[start - 1].isalnum():
                continue
            whole = end + 1 == len(lower) or not lower[end + 1].isalnum()
            weight = max(as_start, as_word if whole else 0.0)
            if weight > 0:
                hits[start] = max(weight, hits.get(start, 0.0))
                names.add(name)
            if addressed and whole:
                second.append(start)
        near = sum(self._close(second, at) for at in hits)
        raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8), minlength=128)
        letters = max(1, int(raw[65:91].sum() + raw[97:123].sum()))
        size = max(1, int(raw.sum()))
        hidden = _HIDDEN.findall(lower) if any(raw[c] for c in b"013457@$!|+*") else []
        undone = [w.translate(_LEET) for w in hidden]
        found = sum(1 for w in undone if w + " " in self.lexicon or any(w[:n] in self.lexicon for n in START_LENGTHS))
        per = 1.0 / max(1, n_words)
        words_up = len(re.findall(r"\b[A-Z]{3,}\b", text)) if raw[65:91].sum() >= 3 else 0
        total = sum(hits.values())
        return [
            math.log1p(len(hits)), len(hits) * per, total * per, max(hits.values(), default=0.0), math.log1p(len(names)),
            total / (1 + len(hits)), near * per, len(second) * per, raw[65:91].sum() / letters, words_up * per,
            sum(raw[c] for c in b"!?.,;:") / size, (raw[33] + raw[63]) / size, raw[48:58].sum() / size,
            len(hidden) * per, math.log1p(found), math.log1p(n_words),
        ]

    @staticmethod
    def _close(places: list[int], at: int) -> bool:
        i = bisect_left(places, at - NEAR)
        return i < len(places) and places[i] <= at + NEAR


def features_of(docs: DataFrame, lexicon: dict[str, float], others: list[str]) -> DataFrame:
    """``docs`` as the columns ``others`` (doc_id, toxic...) and the array ``x`` of FEATURES."""
    fields = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lexicon)
        for batch in parts_of(batches, rows=1024, column="text"):
            x = [[float(v) for v in reader.features(t or "")] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*map(batch.column, others), pa.array(x, pa.list_(pa.float64()))], names=[*others, "x"])

    return docs.select(*others, "text").mapInArrow(run, ", ".join([*fields, "x array<double>"]))


class ToxicityModel:
    """Lexicon, trees and calibration, fitted on labelled texts."""

    def __init__(self, lexicon: dict[str, float], trees, steps, prior: float) -> None:
        self.lexicon, self.trees, self.steps, self.prior = lexicon, trees, steps, prior

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``(doc_id, score)`` of every row of ``docs``, in the order of likelihood from 0 to 1."""
        texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        if self.trees is None:
            return texts.select("doc_id", F.lit(self.prior).alias("score"))
        rows = features_of(texts, self.lexicon, ["doc_id"]).select("doc_id", array_to_vector("x").alias("features"))
        raw = self.trees.transform(rows).select("doc_id", vector_to_array("probability")[1].alias("p"))
        level = self.steps.transform(raw)
        # a thousandth of the uncalibrated probability keeps the order inside a step
        return level.select("doc_id", (F.col("prediction") * 0.999 + F.col("p") * 0.001).alias("score"))


def fit_toxicity(docs: DataFrame, labels: DataFrame, seed: int = 3, most_rows: int = MOST_TRAINING_ROWS) -> ToxicityModel:
    """Fit on the documents that ``labels(doc_id, toxic)`` marks 0 or 1.

    At most ``most_rows`` labelled ids are used, the first by a hash of the
    id; of them, three in ten calibrate and the rest grow the trees. An id
    labelled twice has the higher label, an id with several texts the one of
    least hash. Null ids, labels and texts are left
    out. Without labels of both kinds the score is the share of toxic labels
    (0 without any).
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    # at most ``most_rows`` rows of two numbers: broadcast, so that no text is moved
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = keep(rows.withColumn("calibrates", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(10)) < 3))
    lexicon = fit_lexicon(rows.where("not calibrates"))
    table = keep(features_of(rows, lexicon, ["doc_id", "toxic", "calibrates"]))
    seen = {(r["calibrates"], r["toxic"]): r["count"] for r in table.groupBy("calibrates", "toxic").count().collect()}
    total = sum(seen.values())
    prior = sum(n for (_, t), n in seen.items() if t == 1) / total if total else 0.0
    if len(seen) < 4:
        return ToxicityModel(lexicon, None, None, prior)
    # a few thousand short rows: one sorted partition, so that reruns agree
    ready = table.select("doc_id", F.col("toxic").cast("double").alias("label"), "calibrates", array_to_vector("x").alias("features"))
    ready = ready.repartition(1).sortWithinPartitions("doc_id")
    trees = GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.2, seed=seed, maxBins=32).fit(ready.where("not calibrates"))
    held = trees.transform(ready.where("calibrates")).select("label", vector_to_array("probability")[1].alias("p"))
    steps = IsotonicRegression(featuresCol="p", labelCol="label").fit(held)
    return ToxicityModel(lexicon, trees, steps, prior)


def _held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    Ids whose crc32 leaves 1 modulo 3 are held out: their labels are not
    read. Null and empty texts are scored like any other; a null id is not
    held out.
    """
    out = _held_out(F.col("doc_id"))
    scored = fit_toxicity(docs, labels.where(~out)).score(docs)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more, judged row by row, also where ids are null or repeat."""
    rows = keyed_rows(docs).rows

    def found() -> DataFrame:
        model = fit_toxicity(docs, labels.where(~_held_out(F.col("doc_id"))))
        scored = model.score(rows.select("key", F.col("row.text").alias("text")), "key")
        return scored.where(F.col("score") >= threshold).select(F.col("doc_id").alias("key"))

    toxic = settled(found)
    return with_keys(rows, toxic, "left_anti").select("row.*")
