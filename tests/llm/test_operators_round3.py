"""Importance resampling, nearest neighbours and the divergence audit on small
inputs against plain versions, with nulls, empty and very long texts, ties, repeated
rows, empty tables and extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vendorlytics.llm import divergence, importance, neighbours, regular_sort
from vendorlytics.llm.storage import stored

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ALPHA = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def prose(seed, n, vocabulary=60):
    r = random.Random(seed)
    return " ".join(r.choice(["Word", "té", "x", "Ünit"]) + str(int(r.paretovariate(1.1)) % vocabulary) for _ in range(n))


# ------------------------------------------------------------------ 11 importance resampling

def features(text):
    w = ALNUM.findall((text or "").translate(SMALL))
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])], len(w)


def plain_resample(rows, target):
    def buckets(texts):
        c = Counter()
        for t in texts:
            c.update(zlib.crc32(f.encode()) % 10000 for f in features(t)[0])
        return c

    s, t = buckets(x for _, x in rows), buckets(target)
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + 10000) / ((s[b] + 1) * (total_t + 10000)))) for b in range(10000)]
    out = []
    for i, text in rows:
        f, n = features(text)
        weight = sum(gain[zlib.crc32(x.encode()) % 10000] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[:25 * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def resample_rows():
    rows = [(i, prose(i, random.Random(i).randrange(5, 90))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " \n"), (503, "one"), (504, "y" * 70_000 + " z " + "q" * 200_000 + " " + prose(3, 30)),
             (505, "the-end; THE END" * 20), (None, prose(77, 40)), (506, "日本 é " * 30)]
    return rows + rows[3:5]


def test_resample_equals_a_plain_version(spark):
    rows = resample_rows()
    target = [prose(1000 + i, 50, 9) for i in range(6)] + [None, ""]
    docs = spark.createDataFrame([(i, t, 1, "a") for i, t in rows], "doc_id long, text string, weight int, score string").repartition(5)
    goal = spark.createDataFrame([(t, 5) for t in target], "text string, n_features int")
    out = importance.resample(docs, goal).collect()
    got = [(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in out]
    want = plain_resample(rows, target)
    assert sorted((x[:4] for x in got), key=str) == sorted((x[:4] for x in want), key=str)
    # Repeated rows have the same score: which of them is drawn first is open.
    assert sorted((x for x in got if x[4]), key=lambda x: x[4]) == sorted((x for x in want if x[4]), key=lambda x: x[4])


def test_resample_of_empty_tables(spark):
    docs = spark.createDataFrame([(i, t) for i, t in resample_rows()], "doc_id long, text string")
    goal = spark.createDataFrame([("a b",)], "text string")
    assert importance.resample(docs.limit(0), goal).count() == 0
    assert sorted((tuple(r)[0], *tuple(r)[2:]) for r in importance.resample(docs.dropna(), goal.limit(0)).collect()) == \
        sorted(x for x in plain_resample([r for r in resample_rows() if None not in r], []))


def test_checksums_of_joined_words():
    texts = ["a bb ccc", "é " + "w" * 63 + " " + "v" * 64 + " " + "u" * 65 + " " + "t" * 1000 + " " + "s" * 70_000 + " end", "", "x"]
    f = importance.Features(pa.array(texts), 1 << 31)
    both = [x for t in texts for x in features(t)[0] if " " in x]
    assert f.two.tolist() == [zlib.crc32(x.encode()) % (1 << 31) for x in both]


@pytest.mark.parametrize("shape", ["sorted", "reverse", "ties", "random"])
def test_regular_sampling_ranks_exactly_and_evenly(spark, shape):
    n = 20_000
    r = np.random.default_rng(4)
    a = {"sorted": np.arange(n), "reverse": -np.arange(n), "ties": r.integers(0, 3, n), "random": r.integers(0, 10**9, n)}[shape]
    df = stored(spark.createDataFrame(pa.table({"a": a.astype(np.int64), "b": np.arange(n), "x": np.arange(n)})).repartition(7), "keys")
    p = regular_sort.segments_for(n, 8)
    samples = regular_sort.sample_keys(df, ["a", "b"], p, n)
    assert len(samples[0]) <= 2 * p * p
    sizes = np.bincount(regular_sort.place([a.astype(np.int64), np.arange(n)], regular_sort.splitters(samples, p)))
    assert sizes.max() <= 2 * n / p + p
    out = regular_sort.first_ranks(df, ["a", "b"], 7_000, n).collect()
    order = np.lexsort([np.arange(n), a])
    want = {int(i): k + 1 for k, i in enumerate(order[:7_000])}
    assert len(out) == n and {x.b: x["rank"] for x in out if x["rank"]} == want and all(x.x == x.b for x in out)


# ------------------------------------------------------------------ 12 nearest neighbours

def plain_nearest(rows, k=10, every=100):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and len(v) == 16
            and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for n, (i, q) in enumerate(good):
        if i % every == 0:
            near = sorted((float(np.sqrt(((q - x) ** 2).sum())), j) for m, (j, x) in enumerate(good) if m != n)[:k]
            out += [(i, r + 1, j, d) for r, (d, j) in enumerate(near)]
    return out


def vectors(n=1500, seed=3):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    same = x[5].tolist()
    rows += [(2000 + i, same) for i in range(300)]  # a vector that many rows share
    rows += [(3000, None), (3100, []), (3200, [0.0] * 16), (3300, [None] * 16), (3400, [math.nan] * 16), (3500, [math.inf] * 16),
             (3600, [1.0] * 5), (None, same)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, id int, cell int")


def test_neighbours_recall_and_exact_distances(spark):
    rows = vectors()
    out = neighbours.nearest(frame(spark, rows).repartition(6)).collect()
    want = {(i, r): (j, d) for i, r, j, d in plain_nearest(rows)}
    got = {(x.query_id, x["rank"]): (x.vec_id, x.score) for x in out}
    assert len(out) == len(got) and set(got) == set(want)
    truth, found = Counter(), Counter()
    for (i, _), (j, d) in want.items():
        truth[i, j] += 1
    for (i, _), (j, d) in got.items():
        found[i, j] += 1
        assert i != j
    hit = sum((truth & found).values())
    assert hit >= 0.95 * sum(truth.values())
    by_id = {i: np.array(v, float) for i, v in rows if v and len(v) == 16 and None not in v}
    for (i, _), (j, d) in got.items():
        assert d == pytest.approx(float(np.sqrt(((by_id[i] - by_id[j]) ** 2).sum())), rel=1e-12)
    # The shared vector's queries show its smallest ids, at distance 0.
    assert [got[2100, r] for r in range(1, 11)] == [(j, 0.0) for j in [5, *range(2000, 2009)]]


def test_neighbours_are_exact_when_the_test_never_stops(spark):
    rows = vectors(700, 8)[:900]
    out = neighbours.nearest(frame(spark, rows), confidence=1 - 1e-12).collect()
    got = sorted((x.query_id, x["rank"], x.vec_id) for x in out)
    assert got == sorted(x[:3] for x in plain_nearest(rows))


def test_neighbours_of_few_empty_and_repeated_rows(spark):
    few = [(0, [1.0, 2.0]), (1, [1.0, 2.5]), (100, [3.0, 2.0]), (0, [1.0, 2.0])]
    got = sorted((x.query_id, x["rank"], x.vec_id) for x in neighbours.nearest(frame(spark, few)).collect())
    assert got == [(0, 1, 1), (0, 2, 100), (100, 1, 0), (100, 2, 1)]
    shared = [(0, [1.0, 2.0]), (0, [1.0, 4.0]), (7, [1.0, 3.5])]
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in neighbours.nearest(frame(spark, shared)).collect())
    assert got == [(0, 1, 7, 0.5), (0, 1, 7, 1.5), (0, 2, 0, 2.0), (0, 2, 0, 2.0)]
    assert neighbours.nearest(frame(spark, few).limit(0)).count() == 0


def test_chi_square_quantile():
    assert neighbours.chi_square_quantile(8, 0.95) == pytest.approx(15.507313, rel=1e-6)
    assert neighbours.chi_square_quantile(2, 0.5) == pytest.approx(2 * math.log(2), rel=1e-9)


# ------------------------------------------------------------------ 13 divergence

def plain_audit(rows):
    docs = [(lang or "", source or "", ALPHA.findall((text or "").translate(SMALL))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t, n in df.items() if n >= 3)
        v = len(kept)
        by = {s: Counter(t for d in mine if d[1] == s for t in d[2] if df[t] >= 3) for s in {d[1] for d in mine}}
        whole = sum(by.values(), Counter())

        def share(c, t):
            return 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + v)

        for s, c in by.items():
            pair = [(-sum((share(c, t) - share(o, t)) ** 2 // share(o, t) for t in kept), name) for name, o in by.items() if name != s]
            term = [(-((share(c, t) - share(whole, t)) ** 2 // share(whole, t)), t) for t in kept
                    if c[t] > 0 and share(c, t) > share(whole, t)]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, item, -value, k + 1) for k, (value, item) in enumerate(found) if part == "pair" or k < 200]
    return sorted(out)


def audit_rows():
    r = random.Random(6)
    names = ["ab", "Ab", "cd", "e", "ünder", "日本", "f1g"] + [f"{a}{b}" for a in "ghij" for b in "klmnopqrst"]
    rows = []
    for i in range(160):
        words = [r.choice(names[:3]) if r.random() < 0.5 else names[int(r.paretovariate(0.8)) % len(names)] for _ in range(r.randrange(0, 80))]
        rows.append((r.choice(["en", "de", None]), r.choice(["s0", "s1", "s2", None]), " ".join(words)))
    rows += [("fr", "a", "one two"), ("fr", "b", "one"), ("fr", "c", None), ("en", "lone", "123 456"), ("xx", "only", "z z z"), ("en", "s0", "y" * 60_000)]
    return rows + rows[:4]


@pytest.mark.parametrize("chunk, block", [(divergence.CHUNK, divergence.BLOCK), (8, 2)])
def test_audit_equals_a_plain_version(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(divergence, "CHUNK", chunk)
    monkeypatch.setattr(divergence, "BLOCK", block)
    docs = spark.createDataFrame([(*x, 1, "t") for x in audit_rows()], "lang string, source string, text string, n int, term string")
    got = sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence.audit(docs.repartition(4)).collect())
    assert got == plain_audit(audit_rows())
    assert divergence.audit(docs.limit(0)).count() == 0


def test_joint_cells_with_dense_and_sparse_levels():
    r = np.random.default_rng(1)
    width = 1000

    def profile(counts, zero):
        x = divergence.Profile(width, zero)
        for c in range(1, counts.max() + 1):
            ids = np.flatnonzero(counts == c)
            if len(ids):
                x.add(zero + c, *divergence.container(ids, width))
        return x.close()

    a, b = (np.minimum(r.geometric(0.4, width) - 1, 9) for _ in range(2))
    pa_, pb = profile(a, 10), profile(b, 100)
    assert len(pa_.dense) and len(pa_.sparse) and len(pb.dense) and len(pb.sparse)
    cells = Counter()
    for p, q, n in zip(*(x.tolist() for x in divergence.joint(pa_, pb))):
        cells[p, q] += n
    assert +cells == Counter(zip((a + 10).tolist(), (b + 100).tolist()))


def test_shares_beyond_longs_are_exact(spark):
    big = spark.createDataFrame([(12, 30, 7), (10**11, 10**13, 10**6), (5 * 10**12, 6 * 10**12, 3)], "c long, n long, v long")
    got = [r.p for r in big.select(divergence.share("c", "n", "v").alias("p")).collect()]
    assert got == [1 + 10**9 * (c + 1) // (n + v) for c, n, v in [(12, 30, 7), (10**11, 10**13, 10**6), (5 * 10**12, 6 * 10**12, 3)]]


# ------------------------------------------------------------------ earlier operators: mended cases

def test_links_of_different_texts_under_one_id_are_kept(spark):
    from vendorlytics.llm import neardup

    a, b = ([f"{x}{i}" for i in range(60)] for x in "ab")
    near = [[*w[:30], "changed", *w[31:]] for w in (a, b)]
    rows = [(1, a), (1, b), (2, near[0]), (3, near[1]), (9, [f"c{i}" for i in range(60)])]
    docs = spark.createDataFrame([(i, " ".join(w), "r", "s", 0) for i, w in rows], "doc_id long, text string, rep string, set_hash string, n int")
    got = sorted({(r.doc_id, r.component_id) for r in neardup.link(docs).collect()})
    assert got == [(1, 1), (2, 1), (3, 1), (9, 9)]
    assert neardup.link(docs.limit(0)).count() == 0


def test_lines_with_clashing_columns_null_ids_and_repeated_rows(spark):
    from vendorlytics.llm import lines

    common = "this line stands in all the documents there are"
    rows = [(i, f"{common}\nline number {i} of its own kind here") for i in range(1, 40)]
    rows += [(None, f"{common}\nonly without an id"), (5, "another text under the id five\n" + common), rows[2], (50, ""), (51, None)]
    docs = spark.createDataFrame([(i, t, "g", 7, "k", 1.5) for i, t in rows],
                                 "doc_id long, text string, gone string, _ord int, _k string, __near double")
    out = lines.deduplicate(docs.repartition(5))
    assert set(out.columns) == {*docs.columns, "n_lines", "n_removed", "n_near"}
    got = out.collect()
    assert len(got) == len(rows) and all((r.gone, r["_ord"], r["_k"], r["__near"]) == ("g", 7, "k", 1.5) for r in got)
    assert sum(common in (r.text or "") for r in got) == 1  # the row without an id comes first
    assert [r.text for r in got if r.doc_id is None] == [rows[39][1]]
    assert lines.deduplicate(docs.limit(0)).count() == 0


def test_bucket_sizes_count_distinct_lines(spark, monkeypatch):
    from vendorlytics.llm import components

    seen = []

    def compare(named):
        seen.extend(r["size"] for r in named.collect())
        return named.select(F.col("rep").alias("a"), F.col("rep").alias("b")).where("false")

    rows = [(1, 10)] * 2000 + [(1, 11)] + [(2, 10)] * 3
    buckets = spark.createDataFrame(rows, "bucket long, rep long").repartition(6)
    assert components.connect(buckets, lambda p: p.where("false"), compare).count() == 0
    assert sorted(seen) == [2, 2]


def test_toxicity_is_learned_alike_at_every_size(spark):
    from vendorlytics.llm import toxicity

    r = random.Random(5)

    def table(n, toxic_share, label):
        rows = []
        for i in range(n):
            bad = r.random() < toxic_share
            words = [f"w{r.randrange(50)}" for _ in range(12)]
            if bad:
                words[r.randrange(12)] = "vileword"
            elif r.random() < 0.3:
                words[r.randrange(12)] = "edgeword"  # in clean and toxic documents alike
            if bad and r.random() < 0.9:
                words[r.randrange(12)] = "edgeword"
            rows.append((i, " ".join(words), int(bad), "x", 1))
        df = spark.createDataFrame(rows, "doc_id long, text string, bad int, toxic string, weight int")
        return df, df.select("doc_id", F.col("bad").alias("toxic"))

    docs, labels = table(3000, 0.1, 0)
    for sample in (10_000, 300):  # all labels, and a tenth of the clean ones
        tagger = toxicity.learn(docs, labels, sample)
        marks = toxicity.Tokens(pa.array(["vileword edgeword w1"]))
        high = tagger.marginals(marks)
        assert high[0] > 0.5 and high[1] < 0.5 and high[2] < 0.5
        scored = toxicity.score(docs.limit(200), labels.limit(0)) if sample == 300 else None
        if scored is not None:
            assert scored.where("predicted = 1").count() == 0
        found = toxicity.tag(docs, tagger, keep=("doc_id", "bad")).where("(score >= 0.3) != (bad = 1)").count()
        assert found <= 30
    drawn, share = toxicity.drawn_labels(labels, 300)
    assert drawn.count() <= 2 * 300 and share[False] < 0.2


def test_plain_marginals_and_scores_follow_from_the_tagger(spark):
    """The query's score against a plain forward-backward, token by token."""
    from vendorlytics.llm import toxicity

    texts = ["bad word bad", "", None, "one", "clean words only here", "x " * 150 + "bad"]
    tagger = toxicity.Tagger()
    weights = np.random.default_rng(3).normal(0, 0.5, 1 << toxicity.BITS)
    tagger.weights, tagger.start = weights.astype(np.float32), -0.4
    tagger.transition, tagger.curve = np.array([[0.0, -1.2], [-0.7, 0.3]]), np.array([-2.0, 1.1, 0.4])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.score, r.n_toxic) for r in toxicity.tag(docs, tagger).collect()}
    move = np.exp(tagger.transition)
    for i, text in enumerate(texts):
        tokens = toxicity.Tokens(pa.array([text], pa.string()))
        e = [float(tagger.weights[tokens.slots()[f]].sum()) for f in tokens.form]
        ahead, back = [], [np.ones(2)]
        for t, x in enumerate(e):
            v = (np.array([1, np.exp(tagger.start)]) if t == 0 else ahead[-1] @ move) * np.array([1, np.exp(x)])
            ahead.append(v / v.sum())
        for x in reversed(e[1:]):
            v = move @ (np.array([1, np.exp(x)]) * back[-1])
            back.append(v / v.sum())
        p = np.array([(a * b)[1] / (a * b).sum() for a, b in zip(ahead, reversed(back[:len(e)]))])
        total, most = (p[p >= toxicity.CLEAN].sum(), np.clip(p.max(), 1e-4, 1 - 1e-4)) if len(p) else (0, 1e-4)
        want = 1 / (1 + math.exp(-(np.array([1, math.log1p(total), math.log(most / (1 - most))]) @ tagger.curve)))
        assert got[i] == pytest.approx((want, total), rel=1e-5, abs=1e-9)


def test_addresses_of_task_files():
    from vendorlytics.llm.storage import arrow_address

    assert arrow_address("file:/tmp/x") == "file:///tmp/x" and arrow_address("s3a://b/k") == "s3://b/k"
    assert arrow_address("hdfs://n:8020/x") == "hdfs://n:8020/x" and arrow_address("file:///x") == "file:///x"
