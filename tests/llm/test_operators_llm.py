"""Each operator on small inputs against a plain version, with nulls, empty and
very long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from vendorlytics.llm import (
    crf,
    decontaminate,
    edit,
    language_model,
    lines,
    neardup,
    passages,
    pieces,
    quality,
    rans,
    token_files,
    toxicity,
    warc,
)
from vendorlytics.llm.attention import CLASSES, Model, Vocabulary, windows, window_index
from vendorlytics.llm.components import components
from vendorlytics.llm.storage import fresh_folder

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = "".join(map(chr, range(65, 91)))
SMALL = str.maketrans(UPPER, UPPER.lower())


def documents(spark, rows):
    """Documents with a clashing extra column."""
    return spark.createDataFrame(
        [(i, t, "en", "src", "x", 1) for i, t in rows],
        "doc_id long, text string, lang string, source string, n_words string, ids int")


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{int(r.paretovariate(1.1)) % vocabulary}" for _ in range(n))


def corpus():
    base, other = prose(1, 120), prose(2, 90)
    words = base.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    far = " ".join(w if k % 4 else f"n{k}" for k, w in enumerate(words))
    return [(5, base), (3, near), (9, base), (1, far), (7, other), (7, other), (11, None), (12, ""), (13, " \n\t "),
            (None, other), (14, "two words"), (15, "two words"), (16, "Two  Words"), (17, "x" * 60_000),
            (18, other + "\n" + prose(3, 40)), (20, "Line one is a long line\nLine one is a long line\nshort")]


# ------------------------------------------------------------------ 1 SentencePiece

ODD = ["", None, " ", "  a", "a  ", "\n", "\n\nA b\n", "a▁b▁▁c", "日本語 テキスト\r\n;\r", "\x00x", "🙂 é́", "a\tb", " x   y",
       "x" * 3000, " \n \n", "<s> </s> <unk> <0x0A>", "Hello, world! It's 3.14..."]


def test_pieces_equal_the_library():
    model = pieces.model(PIECES)
    texts = ODD + [t for _, t in corpus()]
    got = model.encode(pa.array(texts, pa.string()))
    want = model.library.encode([t or "" for t in texts])
    assert got.to_pylist() == want
    assert model.decode(got).to_pylist() == model.library.decode(want)


def test_long_chunks_use_the_same_agenda():
    model = pieces.model(PIECES)
    text = "antidisestablishmentarianism" * 20
    assert model._ids(model.agenda("▁" + text)) == np.array(model.library.encode(text), np.int32).tobytes()


def test_pieces_in_spark_keep_rows_and_columns(spark):
    df = documents(spark, corpus())
    out = pieces.decode(pieces.encode(df, PIECES), PIECES)
    assert set(out.columns) == {*df.columns, "decoded"}
    rows = out.collect()
    assert len(rows) == len(corpus()) and all(r.decoded == (r.text or "") for r in rows)
    assert pieces.encode(df.limit(0), PIECES).count() == 0


# ------------------------------------------------------------------ 2 MinHash

def shingles(text):
    w = WORD.findall((text or "").translate(SMALL))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain_components(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i, _ in sets}


def family():
    """Copies of one text at all distances, so that stars alone don't connect them."""
    r, words = random.Random(5), [f"f{k}" for k in range(150)]
    rows = [(100, " ".join(words))]
    for c in range(40):
        w = list(words)
        for _ in range(r.randint(0, 12)):
            w[r.randrange(len(w))] = f"c{c}x{r.randrange(9)}"
        rows.append((101 + c, " ".join(w)))
    return rows


@pytest.mark.parametrize("make", [corpus, family])
def test_near_duplicates_equal_all_pairs(spark, make):
    rows = make()
    want = plain_components(rows)
    got = neardup.link(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == want[r.doc_id])
    assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((i, len(shingles(t))) for i, t in rows)


def test_blocks_find_pairs_that_no_star_met(spark):
    r = np.random.default_rng(0)
    base = r.integers(0, 2**62, 300).astype(np.uint64)
    rows = []
    for rep in range(300):
        s = np.unique(np.where(r.random(300) < (0.05 if rep in (7, 250) else 0.4), r.integers(0, 2**62, 300).astype(np.uint64), base))
        rows.append((1, rep, rep, 300, len(s), bytearray((s & np.uint64(65535)).astype("<u2").tobytes())))
    df = spark.createDataFrame(rows, "bucket long, rep long, label long, size long, n long, marks binary")
    assert (7, 250) in {(x.a, x.b) for x in neardup.block_pairs(df).collect()}


def test_components_of_chains_and_empty_edges(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 40), (3, 3)], "a long, b long")
    assert {(r.node, r.label) for r in components(chain).collect()} == {*((i, 0) for i in range(31)), (40, 40), (50, 40)}
    assert components(chain.limit(0)).count() == 0


# ------------------------------------------------------------------ 3 token files

@pytest.mark.parametrize("n", [1, 31, 32, 33, rans.LANES * rans.CHECKPOINT, 70_001])
def test_rans_round_trip(n):
    ids = (np.random.default_rng(n).pareto(1.0, n) * 3).astype(np.int64) % 500
    table = rans.Table(rans.quantise(np.bincount(ids, minlength=500)))
    full = np.append(ids, np.full(-n % rans.LANES, ids[0]))
    words, first, states, places = table.encode(full[None, :])
    steps, out = len(full) // rans.LANES, []
    for m in range(states.shape[1]):  # every checkpoint decodes by itself
        size = min(rans.CHECKPOINT, steps - m * rans.CHECKPOINT)
        out.append(table.decode(words, states[:, m], places[:, m], size).reshape(-1))
    assert (np.concatenate(out)[:n] == ids).all() and first[-1] == len(words)


def test_quantised_frequencies_keep_rare_symbols():
    freq = rans.quantise(np.array([10**12, 1, 0, 5]))
    assert freq.sum() == 1 << rans.SCALE and freq[1] >= 1 and freq[2] == 0


def test_token_files_equal_the_library(spark):
    from tokenizers import Tokenizer

    rows = corpus() + [(30 + k, t) for k, t in enumerate(ODD)] + [
        (60, "it's <|endoftext|> \n\n x\ny  z\n"), (61, "é\nè é  x\x85 y  \n z"), (62, "a\x1c b \x1f\nc (d)e'f 'tis 12ab")]
    folder = fresh_folder(spark, "test-tokens")
    token_files.write(documents(spark, rows), BYTES, folder)
    tokenizer, start, want = Tokenizer.from_file(BYTES), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, start, ids))
        start += len(ids)
    got = [(r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in token_files.read(spark, folder).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    empty = fresh_folder(spark, "test-tokens")
    token_files.write(documents(spark, rows).limit(0), BYTES, empty)
    assert token_files.read(spark, empty).count() == 0


def test_chunks_of_all_kinds_go_through_the_library_alike():
    rng, coder = np.random.default_rng(5), token_files.coder(BYTES)
    letters = [" ", "\n", "\t", "\x1c", "\x7f", "\x85", "\xa0", "a", "Z", "9", "-", "é", "ß", "ж", "\u1680", "\u2003", "\u3000", "中", "😀",
               "<|endoftext|>"]
    chunks = sorted({"".join(rng.choice(letters, rng.integers(1, 5))) for _ in range(3000)})
    raw = [c.encode() for c in chunks]
    sure = token_files.plain_lines(np.frombuffer(b"".join(raw), np.uint8), np.array([len(c) for c in raw]))
    special = np.array([any(x in c for x in coder.special) for c in chunks])
    assert not (sure & ~special & ~np.array([coder.is_line(c) for c in raw])).any() and sure.any() and (~sure).any()
    want = [np.array(coder.tokenizer.encode(c, add_special_tokens=False).ids, np.int32).tobytes() for c in chunks]
    assert coder.encode_chunks(raw) == want
    plain = [c for c, s in zip(raw, special) if not s]
    assert coder.encode_chunks(plain) == [w for w, s in zip(want, special) if not s]


def test_kept_chunks_change_no_ids_and_long_ones_are_not_kept():
    c, column = token_files.Coder(BYTES), pa.array(["a b a " + "x" * 500, None, "", "b a\n\nc"])
    first, again = c.encode(column), c.encode(column)
    assert first == again and c.cache.young and max(map(len, c.cache.young)) <= token_files.LONGEST


def test_damaged_token_file_is_noticed(spark):
    folder = fresh_folder(spark, "test-tokens")
    token_files.write(documents(spark, corpus()), BYTES, folder)
    local = folder.removeprefix("file:")
    import glob
    name = max(glob.glob(f"{local}/ids-*"))
    raw = bytearray(open(name, "rb").read())
    raw[40] ^= 1
    open(name, "wb").write(bytes(raw))
    with pytest.raises(Exception, match="damaged block"):
        token_files.read(spark, folder).collect()


# ------------------------------------------------------------------ 4 decontamination

def words4(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(SMALL))


def test_decontamination_equals_a_scan(spark):
    passage = prose(8, 30)
    items = [(1, passage), (2, "short Item"), (3, None), (4, "--- !!"), (10, passage), (5, prose(9, 13))]
    rows = corpus() + [(40, prose(4, 50) + " " + passage.upper() + "! " + prose(5, 300)), (41, "a short-item, twice: short item"),
                       (42, passage), (43, " ".join(passage.split()[:12])), (None, passage)]
    out = decontaminate.decontaminate(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    want = Counter()
    for i, t in rows:
        w, hit, found = words4(t), set(), set()
        for item, text in items:
            x = words4(text)
            for a in range(max(1, len(x) - 12)) if x else ():
                run = x[a:a + 13]
                for p in range(len(w) - len(run) + 1):
                    if w[p:p + len(run)] == run:
                        hit |= set(range(p, p + len(run)))
                        found.add(str(item))
        want[(i, len(w), len(hit), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= len(w))] += 1
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids), r.contaminated) for r in out.collect()) == want
    none = decontaminate.decontaminate(documents(spark, rows), spark.createDataFrame([], "item_id long, text string"))
    assert none.where("contaminated OR n_hit > 0").count() == 0


def test_repeated_rows_keep_their_matches(spark):
    passage = prose(8, 30)
    rows = [(1, passage), (1, passage), (1, "another text"), (None, passage), (None, passage), (None, passage), (2, "x " + passage)]
    out = decontaminate.decontaminate(documents(spark, rows), spark.createDataFrame([(4, passage)], "item_id long, text string"))
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids), r.contaminated) for r in out.collect()) == {
        (1, 30, 30, ("4",), True): 2, (1, 2, 0, (), False): 1, (None, 30, 30, ("4",), True): 3, (2, 31, 30, ("4",), True): 1}


def test_proximity_allows_words_in_between(spark):
    test = decontaminate.windows(spark.createDataFrame([(1, "rare alpha common beta")], "item_id long, text string"))
    docs = decontaminate.corpus(spark.createDataFrame(
        [(1, "rare alpha common beta common"), (2, "rare very alpha common beta common"), (3, "beta rare")], "doc_id long, text string"))
    counts = spark.createDataFrame([("rare", 2), ("alpha", 2), ("common", 9), ("beta", 3)], "term string, n long")
    anchored = decontaminate.anchors(test, counts)
    index = decontaminate.build_index(docs, anchored)
    near = {(r.doc_id, r.distance) for r in decontaminate.proximity(index, anchored, 1).collect()}
    assert near == {(1, 0), (2, 1)}
    assert {r.doc_id for r in decontaminate.intersect(index, anchored).collect()} == {1}


# ------------------------------------------------------------------ 5 passages

def test_passages_equal_a_scan(spark):
    shared, rows = prose(20, 45, 10**6), corpus()
    rows += [(50, prose(21, 30) + " " + shared + " " + prose(22, 30)), (48, shared), (49, prose(23, 7) + " " + shared),
             (51, prose(24, 25, 10**6) * 1 + " x " + prose(24, 25, 10**6)), (52, " ".join(["same"] * 50))]
    order = sorted({(i, t or "") for i, t in rows if i is not None})
    seen, want = set(), {}
    for i, t in order:
        w = WORD.findall(t)
        gone = set()
        for s in range(len(w) - 19):
            run = tuple(w[s:s + 20])
            if run in seen:
                gone |= set(range(s, s + 20))
            seen.add(run)
        want[(i, t)] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    got = passages.deduplicate(documents(spark, [r for r in rows if r[0] is not None])).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == Counter(
        (i, *want[(i, t or "")]) for i, t in rows if i is not None)
    first = passages.deduplicate(documents(spark, [(None, shared), (1, shared)])).collect()
    assert {(r.doc_id, r.n_removed) for r in first} == {(None, 0), (1, 45)}


def test_cover_has_every_difference():
    c, p = passages.COVER, passages.PERIOD
    assert {(a - b) % p for a in c for b in c} == set(range(p)) and passages.ANCHOR + p - 1 == passages.WINDOW


# ------------------------------------------------------------------ 6 WARC

def test_warc_round_trip_and_lookup(spark):
    same = "<html>" + "a" * 200
    pages = [(4, "http://b.example.org/x?q=1#f", same), (2, "https://Example.com:443/", same), (9, None, same),
             (5, "http://www.example.org", "short"), (6, "http://www.example.org", "short"), (7, "ftp://h:21/a b\nc", None),
             (8, "u", ""), (None, "http://n", "é" * 60), (3, "http://n", "é" * 60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    folder = fresh_folder(spark, "test-warc")
    warc.write(df, folder)
    rows = warc.read(spark, folder).collect()
    by_id = {r.page_id: r for r in rows}
    assert len(rows) == len(pages)
    for i, url, html in pages:
        r, payload = by_id[i], (html or "").encode()
        assert (r.url, r.payload_bytes, r.payload_digest) == (url, len(payload), hashlib.sha256(payload).hexdigest())
        smallest = min((j for j, _, h in pages if j is not None and (h or "") == (html or "")), default=None)
        revisit = len(payload) >= 100 and smallest is not None and i != smallest
        assert (r.record_type, r.refers_to) == (("revisit", smallest) if revisit else ("response", None))
        assert revisit or r.payload == payload
    asked = spark.createDataFrame([("http://www.example.org#other",), ("http://none",)], "url string")
    assert {r.page_id for r in warc.lookup(asked, folder).collect()} == {5, 6}
    empty = fresh_folder(spark, "test-warc")
    warc.write(df.limit(0), empty)
    assert warc.read(spark, empty).count() == 0 and warc.lookup(asked, empty).count() == 0


def test_url_keys():
    assert warc.url_key("https://user@A.b.Org:443/x?y#z") == "org,b,a)/x?y"
    assert warc.url_key("http://h:8080") == "h:8080)/" and warc.url_key(None) == ""


# ------------------------------------------------------------------ 7 toxicity

@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 200])
def test_marginals_equal_the_plain_recursion(n):
    r = np.random.default_rng(n)
    e, transition, start = r.normal(size=n) * 2, np.exp(r.normal(size=(2, 2))), 0.3
    p, pairs = crf.Chains(np.array([0, 0, n])).run(e, transition, start)
    a, b = np.zeros((n, 2)), np.ones((n, 2))
    a[0] = 1, np.exp(start + e[0])
    for t in range(1, n):
        a[t] = a[t - 1] @ transition * [1, np.exp(e[t])]
        a[t] /= a[t].sum()
    for t in range(n - 2, -1, -1):
        b[t] = transition @ ([1, np.exp(e[t + 1])] * b[t + 1])
        b[t] /= b[t].sum()
    q = a * b
    assert np.allclose(p, q[:, 1] / q.sum(1)) and math.isclose(pairs.sum(), n - 1, abs_tol=1e-6)


def toxic_corpus(n=600):
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        words = prose(i, 60).split()
        if bad:
            words.insert(i % 50, f"Vile{'abcdefg'[i % 7]}{i % 11},")
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_finds_unseen_forms_of_a_stem(spark):
    rows, labels = toxic_corpus()
    rows += [(9000, None), (9001, ""), (9002, "éé vileq99 éé"), (9003, "!!"), (9003, "!!")]
    out = toxicity.score(documents(spark, rows), spark.createDataFrame(labels + [(77, None), (10**6, 1)], "doc_id long, toxic int")).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    truth = dict(labels)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    found = next(r for r in out if r.doc_id == 9002)
    assert found.predicted == 1 and [(s.begin, s.end) for s in found.spans] == [(3, 10)]
    assert not any(r.predicted for r in out if r.doc_id in (9000, 9001, 9003))


def test_toxicity_without_labels_scores_next_to_zero(spark):
    out = toxicity.score(documents(spark, corpus()), spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r.score < 1e-9 and r.predicted == 0 for r in out.collect())


# ------------------------------------------------------------------ 8 lines

def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance_equals_the_full_table():
    r = random.Random(1)
    for _ in range(3000):
        a = "".join(r.choice("abé") for _ in range(r.randint(0, 12)))
        b = list(a)
        for _ in range(r.randint(0, 5)):
            b[r.randint(0, len(b)):r.randint(0, len(b))] = r.choice(["", "a", "b"])
        b = "".join(b)
        assert all(edit.within(a, b, k) == (plain_distance(a, b) <= k) for k in (1, 2, 3))


def test_lines_equal_all_pairs(spark):
    r, rows = random.Random(3), []
    base = [" ".join(f"z{r.randrange(10**6)}é" for _ in range(8)) for _ in range(12)]
    for i in range(60):
        text = []
        for _ in range(4):
            line = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                k = r.randrange(len(line))
                line[k:k + r.randint(0, 1)] = r.choice(["", "q", "é"])
            text.append("".join(line))
        rows.append((i, "\n".join(text + ["", "short", f"own {i}"])))
    rows += [(70, None), (71, ""), (72, " \n\t"), (73, "short"), (74, "x" * 70_000 + "\n" + base[0])]
    flat = [(i, k, x) for i, t in rows for k, x in enumerate((t or "").split("\n")) if WORD.search(x)]
    distinct = list(dict.fromkeys(x for _, _, x in flat))
    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in enumerate(distinct):
        for y in distinct[:a]:
            if min(len(x), len(y)) >= lines.NEAR and abs(len(x) - len(y)) <= 2 and edit.within(x, y, 2):
                root[find(x)] = find(y)
    seen, gone = set(), Counter()
    kept = {i: (t or "").split("\n") for i, t in rows}
    for i, k, x in flat:
        if find(x) in seen:
            gone[i] += 1
            kept[i][k] = None
        seen.add(find(x))
    got = {r.doc_id: r for r in lines.deduplicate(documents(spark, rows)).collect()}
    for i, t in rows:
        assert got[i].n_removed == gone[i]
        assert (got[i].text or "") == "\n".join(x for x in kept[i] if x is not None)
    assert got[70].text is None and got[0].lang == "en"
    assert lines.deduplicate(documents(spark, rows).limit(0)).count() == 0


# ------------------------------------------------------------------ 9 language model

def test_model_is_a_causal_distribution():
    r = np.random.default_rng(0)
    model = Model(300, Vocabulary(r.integers(0, 99, 300).astype(float)))
    p = model.class_probability(r.normal(size=(5, 16)).astype(np.float32))
    assert np.allclose(p.sum(1), 1, atol=1e-5) and (p > 0).all() and p.shape[1] == CLASSES
    ids, first = r.integers(0, 300, 200), np.array([0, 90, 90, 200])
    inputs = np.append(1, ids[:-1])
    inputs[[0, 90]] = 1
    whole = model.probability(inputs, ids, first)
    later = ids.copy()
    later[60:] = 7
    changed = np.append(1, later[:-1])
    changed[[0, 90]] = 1
    assert np.allclose(whole[:60] * (model.vocabulary.of[ids[:60]] >= 0), model.probability(changed, later, first)[:60], rtol=1e-4)
    begin, low, high = windows(first)
    at, counted = window_index(begin, low, high, 200)
    assert sorted(at[counted].tolist()) == list(range(200))  # each id once


def test_gradient_lowers_the_loss():
    r = np.random.default_rng(1)
    ids = np.tile(np.arange(20), 40)
    model = Model(20, Vocabulary(np.bincount(ids).astype(float)))
    losses = model.train(np.append(1, ids[:-1]), ids, *windows(np.array([0, len(ids)])), steps=80, batch=16)
    assert np.mean(losses[-10:]) < 0.5 * losses[0]


def test_base_scores_equal_the_formula(spark):
    rows = [(i, prose(i, 80)) for i in range(80)] + [r for r in corpus() if r[0] is None or r[0] != 7] + [(7, "dup"), (7, "dup")]
    rows = [(i if i is None or i < 3 else i, t) for i, t in rows]
    out = language_model.score(documents(spark, rows), PIECES, sample=40, steps=5).collect()
    tokens = [(i, WORD.findall((t or "").translate(SMALL)) + [None]) for i, t in rows]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(x for i, w in tokens if not held(i) for x in w)
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(w), sum(c[x] > 0 for x in w), n,
                    round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 4)) for i, w in tokens)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in out) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)


MARKED = ["a▁b", "▁", "x ▁ y ▁▁ z", "▁a▁▁ b▁", "▂▁ ▁▂", "one two▁three four"]


def test_space_marks_inside_words_are_scored(spark):
    rows = [(i, prose(i, 40)) for i in range(30)] + [(100 + k, t) for k, t in enumerate(MARKED * 3)]
    out = {r.doc_id: r for r in language_model.score(documents(spark, rows), PIECES, sample=40, steps=2).collect()}
    assert len(out) == len(rows)
    for i, t in rows:
        assert out[i].n_tokens == len(WORD.findall(t)) + 1 and math.isfinite(out[i].score) and out[i].score < 0
    model = pieces.model(PIECES, checked=False)
    words = language_model.words_of(pa.array(MARKED, pa.string()))
    _, targets, first, at = language_model.sequences(words, model)
    assert len(at) == sum(len(WORD.findall(t)) + 1 for t in MARKED) and (np.diff(np.append(at, len(targets))) > 0).all()
    parts = [targets[a:b].tolist() for a, b in zip(at, np.append(at[1:], len(targets)))]
    want = [x for t in MARKED for x in [*(model.library.encode(w) for w in WORD.findall(t)), [language_model.END]]]
    assert parts == want


def test_bounds_on_what_tasks_hold_change_no_score(spark, monkeypatch):
    rows = [(i, prose(i, 60)) for i in range(60)] + [(100 + k, t) for k, t in enumerate(MARKED)]
    rows += [(200, "unheard " + "of" * 9), (200, "unheard " + "of" * 9), (None, "Extraordinary antidisestablishmentarianism")]

    def scores():
        out = language_model.score(documents(spark, rows), PIECES, sample=40, steps=5).collect()
        return sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 4)) for r in out)

    want = scores()
    monkeypatch.setattr(language_model, "FREQUENT", 12)
    monkeypatch.setattr(language_model, "PAIRS", 5)
    assert scores() == want


def test_attention_is_trained_on_every_document(spark, monkeypatch):
    rows = [(i, prose(i, 60)) for i in range(80)] + [(500, "antidisestablishmentarianism"), (501, None), (502, "")]
    subwords = pieces.model(PIECES, checked=False)
    inputs, targets, first, _ = language_model.sequences(language_model.words_of(pa.array([t for _, t in rows], pa.string())), subwords)
    cuts = windows(first)
    model = Model(len(subwords.shown), Vocabulary(np.bincount(targets, minlength=len(subwords.shown)).astype(float)))
    before, loss = model.p["embed"].copy(), -np.log(model.probability(inputs, targets, first)).mean()
    docs = documents(spark, rows).repartition(5)
    assert language_model.train_all(docs, model, PIECES, passes=2) == 2 * len(cuts[0])
    moved = (model.p["embed"] != before).any(1)
    assert set(np.flatnonzero(moved)) <= set(inputs.tolist()) and moved[inputs[first[80]:first[81]]].all()
    assert -np.log(model.probability(inputs, targets, first)).mean() < loss
    assert language_model.train_all(docs.limit(0), model, PIECES) == 0

    given, train = [], language_model.train_all
    monkeypatch.setattr(language_model, "train_all", lambda d, *a: given.append({r.doc_id for r in d.collect()}) or train(d, *a))
    language_model.score(documents(spark, rows), PIECES, sample=40, steps=2).count()
    used = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 10 != 0}
    assert given[0] <= used and len(used - given[0]) <= 20  # only the mixture's are left out


# ------------------------------------------------------------------ 10 quality

def test_binomial_tail_is_exact(spark):
    cases = [(0, 10), (3, 400), (5, 1000), (90, 10000), (480, 50000), (20, 20)]
    df = spark.createDataFrame(cases, "x long, n long")
    for r in df.withColumn("p", quality.binomial_tail(F.col("x"), F.col("n"), 0.01)).collect():
        exact = sum(math.exp(math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1)
                             + i * math.log(0.01) + (r.n - i) * math.log(0.99)) for i in range(r.x + 1))
        assert math.isclose(r.p, exact, rel_tol=1e-9) if r.x < r.n * 0.01 else r.p == 1.0


def test_measures_equal_a_scan(spark):
    rows = corpus() + [(30, "a b c a b c # $ x\na b\na b\n \n"), (31, "é|ü <x> %")]
    for r in quality.measure(documents(spark, rows)).collect():
        t = next((t for i, t in rows if i == r.doc_id), None) or ""
        w = WORD.findall(t)
        grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for k in range(3)}
        listed = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(listed) - len(set(listed)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_cutoffs_are_certified_and_reject_the_bad(spark):
    rows, labels = [], []
    for i in range(2600):
        bad = i % 4 == 0
        text = " ".join(f"word{i}x{k}{'###' if bad else ''}" for k in range(60))
        rows.append((i, text))
        labels.append((i, 0 if bad else 1))
    out = quality.judge(documents(spark, rows), spark.createDataFrame(labels + [(1, None), (10**7, 1)], "doc_id long, quality int")).collect()
    kept = {r.doc_id: r.kept for r in out}
    good = [kept[i] for i, q in labels if q]
    assert not any(kept[i] for i, q in labels if not q) and sum(good) >= 0.95 * len(good)
    few = quality.judge(documents(spark, rows[:40]), spark.createDataFrame(labels[:40], "doc_id long, quality int"))
    assert few.where("NOT kept").count() == 0  # too few labels certify nothing
