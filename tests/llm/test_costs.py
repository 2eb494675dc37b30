"""Steps that were made cheaper: tallies of token ids, pairs of lines that needn't be
compared, and buckets whose repeated rows go late."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from vendorlytics.llm import components, lines, token_files
from vendorlytics.llm.components import connect


def test_tallies_hold_every_id_of_the_slices(spark):
    """The ids' counts come with the encoding (before: a second pass over all ids)."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b a b", None, "", "c\nd " * 300, "wörd " * 9, "a"])], "doc_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = token_files.encode(docs, path, tally=True)
    want = Counter(np.concatenate([np.frombuffer(bytes(r.ids), "<u4") for r in coded.collect()]).tolist())
    assert token_files.id_counts(coded) == want and want[token_files.END_ID] >= 6
    assert token_files.encode(docs, path).columns == ["doc_id", "n_tokens", "ids"]


def test_character_counts_never_part_near_lines():
    """Lines up to ``EDITS`` edits apart pass; unlike lines that share a segment needn't be compared (before: all were)."""
    r = random.Random(3)
    texts = ["".join(r.choice("abc dé\U0001f600Ā") for _ in range(r.randrange(24, 60))) for _ in range(200)]
    changed = []
    for t in texts:
        for _ in range(lines.EDITS):
            i, how = r.randrange(len(t)), r.randrange(3)
            t = t[:i] + (r.choice("xyzé") if how else "") + t[i + (how < 2):]
        changed.append(t)
    (sizes, table), (others, other) = lines.char_counts(texts), lines.char_counts(changed)
    assert (np.abs(table - other).sum(1) <= 2 * lines.EDITS).all() and (np.abs(sizes - others) <= lines.EDITS).all()
    _, far = lines.char_counts(["x" * 20 + "a" * 10, "x" * 20 + "b" * 10])
    assert np.abs(far[0] - far[1]).sum() > 2 * lines.EDITS


def test_bucket_sizes_count_distinct_reps(spark):
    """Repeated rows are dropped after the buckets of one rep; sizes and pairs don't see them."""
    seen = []

    def compare(rows):
        seen.extend(tuple(r) for r in rows.select("bucket", "rep", "size").collect())
        return rows.where("false").select(F.col("rep").alias("a"), F.col("rep").alias("b"))

    held = spark.createDataFrame([(1, 10)] * 5 + [(1, 11), (1, 12), (1, 12), (2, 7), (2, 7), (3, 11), (3, 10)], "bucket long, rep long")
    out = connect(held, lambda pairs: pairs.where("a = 10 AND b = 11"), compare)
    assert sorted(map(tuple, out.collect())) == [(10, 10), (11, 10)]
    assert sorted(seen) == [(1, 10, 3), (1, 11, 3), (1, 12, 3)]


def test_stars_take_no_step(spark, monkeypatch):
    """Edges that are stars already are told by one pass, chains take steps; new links
    tie labels together without the links that made them."""
    steps, step = [], components._step
    monkeypatch.setattr(components, "_step", lambda star, kind: steps.append(kind) or step(star, kind))
    rows = [(1, k) for k in range(2, 40)] + [(50, 60), (70, 50), (50, 60)]
    labels = components.components(spark.createDataFrame(rows, "a long, b long"))
    want = {(k, 1) for k in range(1, 40)} | {(50, 50), (60, 50), (70, 50)}
    assert not steps and {tuple(r) for r in labels.collect()} == want and labels.count() == len(want)
    none = spark.createDataFrame([], "a long, b long")
    assert components.joined(labels, none) is labels and not steps
    more = components.joined(labels, spark.createDataFrame([(60, 39), (80, 81)], "a long, b long"))
    assert steps and {tuple(r) for r in more.collect()} == {(k, 1) for k in [*range(1, 40), 50, 60, 70]} | {(80, 80), (81, 80)}


def test_line_texts_are_looked_up_once(spark, monkeypatch):
    """One pass over the texts serves the stars, the meetings and what these find."""
    passes, look = [], lines.line_texts
    monkeypatch.setattr(lines, "line_texts", lambda docs, wanted: passes.append(1) or look(docs, wanted))
    base = "the quick brown fox jumps over the lazy dog and runs"
    rows = [(1, base), (2, "X" + base[1:]), (3, base[:-1] + "Y"), (3, base[:-1] + "Y"), (4, "nothing like the others at all, no"), (5, None)]
    got = lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed, r.text) for r in got if r.doc_id < 5) == [
        (1, 0, base), (2, 1, ""), (3, 1, ""), (3, 1, ""), (4, 0, rows[4][1])]
    assert len(passes) == 1
