"""Near-duplicate lines, by an exact set-similarity join.

A line is the set of its lower-cased words. Words are ordered from rare to
frequent over the whole corpus. Two lines whose Jaccard similarity reaches t
share a word among the first n - ceil(t * n) + 1 of the larger and the first
n - ceil(2t / (1 + t) * n) + 1 of the smaller (prefix filter), a shared
word's places leave room for enough common words (positional filter), and the
sizes differ by at most the factor t (length filter). A 128-bit parity signature
bounds from below how many words only one of the lines has. What passes is
verified on the words themselves. A line is removed if an equal or similar
line stands before it.

Everything on this path is DataFrame work: no Python touches a row.
"""

from __future__ import annotations

import functools
import itertools
import math
import operator

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType

from barloom.llm.lookup import constant_array
from barloom.llm.scratch import drop, keep, settled

#: Counters of word frequency. They fix the order of words, which affects
#: speed and never the result, so a word may share its counter with others. As
#: many as these leave most rare words apart from the frequent ones.
COUNTERS = 1 << 16
#: Pairs of neighbours in a line's prefix, from its end, under which the line
#: looks for a first similar one, and how many lines such a pair must have.
HUB_KEYS, HUB_LINES = 5, 32
#: Rounds in which lines meet under the words of their prefixes, each with its share of the words: what a round shuffles is deleted before the last ones write.
ROUNDS = 3
_SPACE = r"[\x20\x09-\x0D]+"
_NOT_SPACE = r"[^\x20\x09-\x0D]"
_OTHER_SPACE = "\x09\x0b\x0c\x0d"


def _split(line: Column) -> Column:
    """Lower-cased words of a line, with empty ones between spaces; one-character splits and searches are the fast ones."""
    low, other = F.lower(line), functools.reduce(operator.or_, (line.contains(c) for c in _OTHER_SPACE))
    return F.when(other, F.split(low, _SPACE)).otherwise(F.split(low, " "))


def _words(line: Column) -> Column:
    return F.array_distinct(F.array_remove(_split(line), ""))


def _keyed(docs: DataFrame, id_col: str, text_col: str, carried: list[str]) -> DataFrame:
    """``(doc, text, row)``: ``doc`` tells documents apart and orders them, ``row`` has the columns ``carried``.

    It is the id, unless an id is null or repeated: then it is the id, a hash
    of the text and, for null ids, a number of the row, written once. Null ids
    come first.
    """
    row = F.struct(F.lit(0).alias("_"), *(docs[c] for c in carried)).alias("row")
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    if ids.groupBy("id").count().where("count > 1 or id is null").isEmpty():
        return docs.select(F.col(id_col).cast("long").alias("doc"), docs[text_col].alias("text"), row)
    known = F.col(id_col).isNotNull()
    number = F.when(known, F.lit(0).cast("long")).otherwise(F.monotonically_increasing_id())
    key = F.struct(known.alias("known"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), F.xxhash64(text_col).alias("hash"), number.alias("number"))
    return keep(docs.select(key.alias("doc"), docs[text_col].alias("text"), row))


def _lines(docs: DataFrame) -> DataFrame:
    """``(doc, line_no, line)`` of every line that has a word; a null text has none."""
    lines = docs.select("doc", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.where(F.col("line").rlike(_NOT_SPACE))


def _counter(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit(COUNTERS - 1)).cast("int")


def word_classes(docs: DataFrame) -> list[int]:
    """Twice the binary logarithm of each counter's number of words, rounded down.

    Words are counted between spaces alone; one that a line end joins to the
    next counts as another word, which shifts no counter by much.
    """
    words = docs.select(F.explode(F.split(F.lower("text"), " ")).alias("w"))
    found = words.groupBy(_counter(F.xxhash64("w")).alias("c")).count().collect()  # at most COUNTERS rows
    counts = {r["c"]: r["count"] for r in found}
    return [min(126, int(2 * math.log2(counts[c]))) if counts.get(c) else 0 for c in range(COUNTERS)]


def _middle_class(classes: list[int]) -> int:
    """The least class below which at least half of all words are, as far as classes tell their number."""
    weights = sorted((c, 2 ** (c / 2)) for c in classes if c)
    sums = list(itertools.accumulate(w for _, w in weights))
    return next((c + 1 for (c, _), w in zip(weights, sums, strict=True) if 2 * w >= sums[-1]), 1)


def _sets(lines: DataFrame, classes: list[int], threshold: float) -> DataFrame:
    """``(doc, line_no, k1, k2, n, sig, sig2, prefix)`` of each line.

    ``sig`` has a bit for each residue of the words' hashes modulo 64, set if
    an odd number of words of the rarer classes has it, ``sig2`` for the
    others; ``prefix`` holds 31-bit hashes of the rarest words. Different words
    may share a hash: that only adds candidates.
    """
    # nothing here may be NULL: Spark sorts such arrays as plain numbers
    rank, low = constant_array(classes), F.lit((1 << 56) - 1)
    border = F.lit(_middle_class(classes) << 56)  # stands between the halves once sorted

    def placed(h: Column) -> Column:
        return F.shiftleft(F.coalesce(F.get(rank, _counter(h)), F.lit(0)), 56).bitwiseOR(h.bitwiseAND(low))

    def parity(words: str) -> Column:
        """The bits modulo 64 that an odd number of words has."""
        return F.aggregate(words, F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))))

    # Functions with a lambda box what they read unless it is a column, and a column that the next step names once is
    # no column any more: each array below is named twice, so that only the lambdas themselves are not compiled.
    at = ["doc", "line_no", "k1", "k2"]
    hashes = F.array_distinct(F.transform(_split(F.col("line")), lambda w: F.xxhash64(w)))
    rows = lines.select("doc", "line_no", F.xxhash64("line").alias("k1"), F.hash("line").alias("k2"), F.array_remove(hashes, F.xxhash64(F.lit(""))).alias("h"))
    rows = rows.select(*at, F.size("h").alias("n"), F.sort_array(F.concat(F.transform("h", placed), F.array(border))).alias("o"))
    rows = rows.select(*at, "n", "o", F.array_position("o", border).cast("int").alias("half"))
    length = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9).cast("int") + 1
    halves = F.slice("o", F.lit(1), F.col("half") - 1).alias("rare"), F.slice("o", F.col("half") + 1, F.col("n")).alias("common")
    rows = rows.select(*at, *halves, F.slice(F.array_remove("o", border), F.lit(1), length).alias("first"))
    prefix = F.when(F.size("first") > 0, F.transform("first", lambda x: x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")))
    n = F.size("rare") + F.size("common")
    return rows.select(*at, n.alias("n"), parity("rare").alias("sig"), parity("common").alias("sig2"), prefix.alias("prefix"))


def _verify(pairs: DataFrame, docs: DataFrame, threshold: float, many: bool = True) -> DataFrame:
    """The ``(doc, line_no)`` of the written ``pairs(late, early)`` that are similar, judged on the words; the pairs are deleted.

    If they are ``many``, texts meet a hash table of line numbers and are not sorted; few can be broadcast.
    """
    ends = pairs.select(F.col("late").alias("at")).union(pairs.select("early")).distinct()
    wanted = ends.groupBy(F.col("at.doc").alias("doc")).agg(F.collect_set("at.line_no").alias("numbers"))
    found = docs.select("doc", "text").join(wanted.hint("shuffle_hash") if many else wanted, "doc").select("doc", "numbers", F.split("text", "\n").alias("lines"))
    # ``lines`` is named twice, so that a text is split once and not for each of its numbers
    picked = F.when(F.size("lines") > 0, F.transform("numbers", lambda k: F.struct(k.alias("line_no"), F.get("lines", k).alias("line"))))
    words = found.select("doc", F.inline(picked)).select(F.struct("doc", "line_no").alias("at"), _words(F.col("line")).alias("words"))
    numbers = isinstance(docs.schema["doc"].dataType, LongType)  # ids by themselves are unique, see ``_keyed``
    words = keep(words if numbers else words.dropDuplicates(["at"]))
    left, right = words.select(F.col("at").alias("late"), F.col("words").alias("a")), words.select(F.col("at").alias("early"), F.col("words").alias("b"))
    # common words >= threshold * all words; the intersection stands here once, as Spark makes it as often as it is named
    alike = F.size(F.array_intersect("a", "b")) * F.lit(1 + threshold) >= F.lit(threshold) * (F.size("a") + F.size("b")) - 1e-9
    found = keep(pairs.join(left, "late").join(right, "early").where(alike).select("late.doc", "late.line_no").distinct())
    drop(words, pairs)
    return found


def _family_heads(firsts: DataFrame, threshold: float) -> DataFrame:
    """``(late, early)``, written: each line with the first line that shares a pair of its rare words, where many share it."""
    size = F.size("prefix")
    last = [F.get("prefix", size - 1 - i) for i in range(HUB_KEYS + 1)]
    pair = [F.when(size > i + 1, F.xxhash64(last[i], last[i + 1])) for i in range(HUB_KEYS)]
    whole = F.when(size == 1, F.xxhash64("prefix"))
    keyed = firsts.select(F.explode(F.array(*pair, whole)).alias("key"), "doc", "line_no", "n", "sig").where(F.col("key").isNotNull())
    often = keep(keyed.groupBy("key").count().where(F.col("count") >= HUB_LINES).select("key"))
    among = keep(keyed.join(often, "key", "left_semi"))
    heads = keep(among.groupBy("key").agg(F.min(F.struct("doc", "line_no", "n", "sig")).alias("head")))
    late, early = F.struct("doc", "line_no"), F.struct("head.doc", "head.line_no")
    small, large = F.least("n", "head.n"), F.greatest("n", "head.n")
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (small + large) - 1e-9)
    parity = F.bit_count(F.col("sig").bitwiseXOR(F.col("head.sig"))) <= small + large - 2 * need
    met = among.join(heads, "key").where((late > early) & (small >= F.lit(threshold) * large - 1e-9) & parity)
    pairs = keep(met.select(late.alias("late"), early.alias("early")).distinct())
    drop(often, among, heads)
    return pairs


def _prefix_words(firsts: DataFrame, turn: int, prefix: Column | str = "prefix") -> DataFrame:
    """The columns of ``firsts`` that a filter needs, with every ``place`` and ``word`` of the prefix that belongs to the round ``turn``."""
    rows = firsts.select("doc", "line_no", "n", "sig", "sig2", "done", F.posexplode(prefix).alias("place", "word"))
    return rows.where(F.pmod("word", F.lit(ROUNDS)) == turn)


def _all_candidates(firsts: DataFrame, t: float) -> DataFrame:
    """``(late, early)`` of all rounds, written."""
    met = [keep(_candidates(firsts, turn, t)) for turn in range(ROUNDS)]
    every = met[0]
    for part in met[1:]:
        every = every.union(part)
    pairs = keep(every.distinct())  # a pair can meet in several rounds
    drop(*met)
    return pairs


def _half_octave(n: Column) -> Column:
    """Twice the binary logarithm of a number of words, rounded down; it never falls as the number grows."""
    return F.floor(F.lit(2) * F.log2(n))


def _sides(firsts: DataFrame, turn: int, t: float) -> tuple[DataFrame, DataFrame]:
    """The larger and the smaller lines of pairs in the round ``turn``, columns ``a_`` and ``b_``, that meet under ``key``.

    A key is a word and the half octave of the larger line's number of words.
    The smaller line is under every half octave that a similar larger one can
    have, so lines of far sizes do not meet.
    """
    columns = ("doc", "line_no", "n", "sig", "sig2", "place", "done")

    def under(band: Column) -> Column:
        return (F.col("word").cast("long") * 64 + band).alias("key")

    n = F.col("n")
    a = _prefix_words(firsts, turn).select(under(_half_octave(n)), *(F.col(c).alias(f"a_{c}") for c in columns))
    short = n - F.ceil(F.lit(2 * t / (1 + t)) * n - 1e-9).cast("int") + 1
    b = _prefix_words(firsts, turn, F.slice("prefix", F.lit(1), short))
    b = b.withColumn("band", F.explode(F.sequence(_half_octave(n), _half_octave(n / F.lit(t) + 1e-6))))
    return a, b.select(under(F.col("band")), *(F.col(c).alias(f"b_{c}") for c in columns))


def _candidates(firsts: DataFrame, turn: int, t: float) -> DataFrame:
    """``(late, early)`` that pass all filters, of lines under the words of the round ``turn``; lines with ``done`` are no late ones.

    A pair meets under a word of the larger line's prefix that is in the
    smaller line's shorter one, the first in document order being the larger
    on ties.
    """
    a, b = _sides(firsts, turn, t)
    # whole numbers of words in common reach this bound as they reach the next whole number
    need = F.lit(t / (1 + t)) * (F.col("a_n") + F.col("b_n")) - 1e-9
    sooner = (F.col("a_doc") < F.col("b_doc")) | ((F.col("a_doc") == F.col("b_doc")) & (F.col("a_line_no") < F.col("b_line_no")))
    larger = (F.col("a_n") > F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & sooner)
    room = F.least(F.col("a_n") - F.col("a_place"), F.col("b_n") - F.col("b_place")) >= need
    near = F.col("b_n") >= F.lit(t) * F.col("a_n") - 1e-9
    open_ = ~F.when(sooner, F.col("b_done")).otherwise(F.col("a_done"))
    different = (F.col("a_doc") != F.col("b_doc")) | (F.col("a_line_no") != F.col("b_line_no"))
    odd = F.bit_count(F.col("a_sig").bitwiseXOR(F.col("b_sig"))) + F.bit_count(F.col("a_sig2").bitwiseXOR(F.col("b_sig2")))
    parity = odd <= F.col("a_n") + F.col("b_n") - 2 * need
    met = a.join(b, "key").where(near & room & parity & larger & different & open_)
    one, two = F.struct(F.col("a_doc").alias("doc"), F.col("a_line_no").alias("line_no")), F.struct(F.col("b_doc").alias("doc"), F.col("b_line_no").alias("line_no"))
    return met.select(F.greatest(one, two).alias("late"), F.least(one, two).alias("early")).distinct()


def _removed(docs: DataFrame, threshold: float) -> DataFrame:
    """``(doc, line_no)``: the lines (from 0) of ``_keyed`` rows that have an equal or similar line before them.

    The order is by document id, null ids first, rows of one id by a hash of
    their text, then by line number. A line without words is never removed.
    Rows that repeat an id and its text are one document; every row without an
    id is one of its own.

    Equal lines collapse to their first. In families of many variants a line
    next looks at the family's first; only lines that remain meet all others.
    """
    lines = _lines(docs)
    every = lines.select("doc", "line_no", F.xxhash64("line").alias("k1"), F.hash("line").alias("k2"))
    sets = _sets(lines, word_classes(docs), threshold)
    firsts = sets.groupBy("k1", "k2").agg(F.min(F.struct("doc", "line_no", "n", "sig", "sig2", "prefix")).alias("s"), F.count("*").alias("copies"))
    firsts = keep(firsts.select("k1", "k2", "s.*", "copies"))
    sure = _verify(_family_heads(firsts, threshold), docs, threshold, many=False)

    at = ["doc", "line_no"]
    marked = firsts.join(sure.withColumn("done", F.lit(True)), at, "left").withColumn("done", F.coalesce("done", F.lit(False)))
    similar = sure.union(_verify(_all_candidates(marked, threshold), docs, threshold))
    gone = similar.withColumn("gone", F.lit(True))
    first_at = firsts.select("k1", "k2", *at, "copies").join(gone, at, "left")
    first_at = first_at.select("k1", "k2", F.struct(*at).alias("at"), F.coalesce("gone", F.lit(False)).alias("gone"), "copies")
    first_at = keep(first_at.where(F.col("gone") | (F.col("copies") > 1)).drop("copies"))  # a single line that stays has nothing to tell
    drop(firsts)
    out = every.join(first_at.hint("shuffle_hash"), ["k1", "k2"]).where(F.col("gone") | (F.struct(*at) > F.col("at")))
    return out.select(*at).distinct()


def dedup_lines(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines of ``_removed`` taken out of the text; every row stays.

    A text whose lines are all removed becomes empty; null and empty texts
    stay as they are. Line ends between kept lines are kept. Other columns
    keep their values, whatever their names.
    """
    others = [c for c in docs.columns if c != text_col]
    keyed = _keyed(docs, id_col, text_col, others)
    lists = settled(lambda: _removed(keyed, threshold).groupBy("doc").agg(F.sort_array(F.collect_set("line_no")).alias("gone")))
    joined = keyed.join(lists, "doc", "left").withColumn("lines", F.when(F.col("gone").isNotNull(), F.split("text", "\n")))
    # what stands between two removed lines is a slice
    joined = joined.withColumn("ends", F.concat(F.array(F.lit(-1)), "gone", F.array(F.size("lines"))))
    after = lambda k: F.get("ends", k) + 2
    parts = F.transform(F.sequence(F.lit(0), F.size("gone")), lambda k: F.slice("lines", after(k), F.get("ends", k + 1) - F.get("ends", k) - 1))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(parts), "\n"))
    return joined.select(*((text if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns))


def line_report(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_lines, n_removed, removed)``: the removed line numbers of every row of ``docs``, ascending."""
    keyed = _keyed(docs, id_col, text_col, [id_col])
    lists = settled(lambda: _removed(keyed, threshold).groupBy("doc").agg(F.sort_array(F.collect_set("line_no")).alias("removed")))
    sizes = keyed.select(
        F.col("row").getField(id_col).cast("long").alias("doc_id"), "doc", F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).alias("n_lines"),
    )
    joined = sizes.join(lists, "doc", "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return joined.select("doc_id", "n_lines", F.size(removed).alias("n_removed"), removed.alias("removed"))
