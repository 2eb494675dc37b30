"""Benchmark decontamination with a distributed positional inverted index.

Test items are cut into windows of ``WINDOW`` words.  The corpus is counted for
the words of the items; each window's ``ANCHORS`` rarest words look it up.  The
index stores the corpus positions of all anchor words (``build_index``).  A
window's candidates are the places where the offset-adjusted lists of its
anchors meet (``intersect``), and a candidate is an exact phrase match if the
document's words there equal the window.  ``proximity`` gives the places where a
window's anchors stand within ``slop`` words of their distance in the window.

DataFrame functions only.  A row is known by ``doc_id`` and its text's hash, so
that rows sharing an id keep their own results.  Postings, candidates and hits
are rows, dealt by word, by place and by document; nothing is gathered per word.

Defined results: a null or empty text has no words and no hits; items without
words have no window; repeated items and windows count once per item id; a word
that overlaps several matches is hit once; an empty benchmark leaves every
document clean; other columns are ignored.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vendorlytics.llm.storage import drop, stored

WINDOW = 13
ANCHORS = 2
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KEY = ("doc_id", "text_hash")


def words(text: Column) -> Column:
    """Words of a text with A-Z in lower case; none for null."""
    lower = F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)
    return F.array_remove(F.split(lower, SEPARATORS), "")


def corpus(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))


def windows(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(phrase, n_terms, items): the distinct windows and the items that have them."""
    w = items.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - WINDOW, F.lit(0)))
    phrase = F.transform(starts, lambda i: F.array_join(F.slice("w", i + 1, WINDOW), " "))
    return w.select("item", F.explode(phrase).alias("phrase")).groupBy("phrase").agg(
        F.sort_array(F.collect_set("item")).alias("items")) \
        .withColumn("n_terms", F.size(F.split("phrase", " ")))


def places(docs: DataFrame) -> DataFrame:
    """Every word of the corpus: (doc_id, text_hash, pos, term)."""
    return docs.select(*KEY, F.posexplode(words(F.col("text"))).alias("pos", "term"))


def anchors(test: DataFrame, counts: DataFrame) -> DataFrame:
    """(phrase, turn, offset, term): each window's rarest words, rarest first."""
    terms = test.select("phrase", F.posexplode(F.split("phrase", " ")).alias("offset", "term"))
    ranked = terms.join(counts, "term", "left").groupBy("phrase").agg(F.slice(F.sort_array(F.collect_list(F.struct(
        F.coalesce("n", F.lit(0)).alias("n"), "term", "offset"))), 1, ANCHORS).alias("a"))
    # A window with a word that the corpus lacks can't occur.
    return ranked.where(F.col("a")[0]["n"] > 0).select("phrase", F.posexplode("a").alias("turn", "x")) \
        .select("phrase", "turn", "x.offset", "x.term")


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (term, doc_id, text_hash, pos) of the words in ``terms``."""
    return places(docs).join(terms.select("term").distinct(), "term")


def starts_of(index: DataFrame, anchored: DataFrame) -> DataFrame:
    """Offset-adjusted postings: where a window would start for each anchor."""
    return index.join(anchored, "term").select(
        *KEY, "phrase", "turn", (F.col("pos") - F.col("offset")).alias("start"))


def intersect(index: DataFrame, anchored: DataFrame) -> DataFrame:
    """(doc_id, text_hash, phrase, start) where all anchors of a window agree.  The
    anchors are met as a set, since repeated rows post each of theirs again."""
    turns = F.bit_or(F.expr("shiftleft(1, turn)"))
    need = anchored.groupBy("phrase").agg(turns.alias("need"))
    return starts_of(index, anchored).where("start >= 0").groupBy(*KEY, "phrase", "start").agg(
        turns.alias("met")).join(need, "phrase").where("met = need").select(*KEY, "phrase", "start")


def proximity(index: DataFrame, anchored: DataFrame, slop: int) -> DataFrame:
    """(doc_id, text_hash, phrase, start, distance): places where a window's two
    anchors stand at most ``slop`` words off their distance in the window; start
    is where the rarest anchor puts the window, distance the least such gap."""
    s = starts_of(index, anchored).withColumn("cell", F.floor(F.col("start") / (slop + 1)))
    first = s.where("turn = 0").drop("turn")
    second = s.where("turn = 1").select(
        *KEY, "phrase", F.col("start").alias("other"),
        F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    same = [F.col(f"f.{k}").eqNullSafe(F.col(f"s.{k}")) for k in KEY]
    return first.alias("f").join(second.alias("s"), [*same, F.col("f.phrase") == F.col("s.phrase"),
                                                     F.col("f.cell") == F.col("s.cell")]) \
        .withColumn("distance", F.abs(F.col("start") - F.col("other"))).where(F.col("distance") <= slop) \
        .groupBy("f.doc_id", "f.text_hash", "f.phrase", "start").agg(F.min("distance").alias("distance"))


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text_hash, hits, items): the exact matches of each document that
    has any: arrays of (start, n_terms) and of the item ids as text."""
    docs = corpus(docs)
    test = stored(windows(items), "test-windows")
    vocabulary = stored(test.select(F.explode(F.split("phrase", " ")).alias("term")).distinct(), "test-words")
    counts = places(docs).select("term").join(vocabulary, "term").groupBy("term").agg(F.count("*").alias("n"))
    anchored = stored(anchors(test, counts), "anchors")
    index = stored(build_index(docs, anchored), "postings")
    met = intersect(index, anchored).join(test, "phrase").groupBy(*KEY).agg(
        F.collect_set(F.struct("start", "phrase", "n_terms", "items")).alias("met"))
    met = stored(met, "candidates")
    drop(index)
    d, m = docs.dropDuplicates(list(KEY)).alias("d"), met.alias("m")
    exact = F.filter("met", lambda c: (c["start"] + c["n_terms"] <= F.size("w")) & (F.array_join(F.slice("w", c["start"] + 1, c["n_terms"]), " ") == c["phrase"]))
    # Always a shuffle of both: a broadcast would hold at some sizes only.
    return m.hint("merge").join(d, [F.col(f"d.{k}").eqNullSafe(F.col(f"m.{k}")) for k in KEY]) \
        .select(*(f"d.{k}" for k in KEY), words(F.col("text")).alias("w"), "met") \
        .select(*KEY, exact.alias("met")).where(F.size("met") > 0).select(
            *KEY, F.transform("met", lambda c: F.struct(c["start"].alias("start"), c["n_terms"].alias("n_terms"))).alias("hits"),
            F.array_distinct(F.flatten("met.items")).alias("items"))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document row: doc_id, text_hash, n_words, n_hit, item_ids (array of
    text, sorted), contaminated (at least a twentieth of the words are hit)."""
    found = matches(docs, items).select(
        *KEY, "items", F.size(F.array_distinct(F.flatten(F.transform(
            "hits", lambda h: F.sequence(h["start"], h["start"] + h["n_terms"] - 1))))).alias("n_hit"))
    base = corpus(docs).select(*KEY, F.size(words(F.col("text"))).cast("long").alias("n_words"))
    b, f = base.alias("b"), found.alias("f")
    out = b.join(f, [F.col(f"b.{k}").eqNullSafe(F.col(f"f.{k}")) for k in KEY], "left").select(
        "b.doc_id", "b.text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.array_sort("items"), F.array().cast("array<string>")).alias("item_ids"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))
