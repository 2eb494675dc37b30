"""The pipeline against a plain chain over documents with planted cases."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import sentencepiece

import corpus_pipeline
from test_operators_llm import WORD, plain_components, plain_distance, words4
from vendorlytics.llm import lines

LONG = "a line of some length that several documents hold"


def text(r, n, mark=None):
    words = [f"{r.choice('bcdfgk')}{r.choice('aeiou')}{r.randrange(300)}" for _ in range(n)]
    if mark:
        words[r.randrange(n)] = mark
    return " ".join(words)


def planted():
    """(rows (doc_id, text), labels, benchmark items)."""
    r = random.Random(11)
    rows, labels = [], []
    for i in range(100, 700):
        bad = r.random() < 0.2
        rows.append((i, text(r, 60, f"vile{r.choice('abcdefg')}{i % 11}" if bad else None)))
        labels.append((i, int(bad)))
    passage = text(r, 30)
    base = text(r, 120).split()
    near = " ".join(base[:50] + ["changed"] + base[51:])
    twice = text(r, 50)
    rows += [
        (1000, "\n".join([LONG, text(r, 40), "short"])), (1001, "\n".join([text(r, 40), LONG + "s", "short"])),
        (1002, LONG), (1003, "short\n\nshort"),  # nothing of their own
        (1010, " ".join(base)), (1011, near), (1012, " ".join(base)), (1013, " ".join([*base[:20], "vilea1", *base[21:]])),
        (1020, text(r, 20) + " " + passage.upper() + " " + text(r, 40)),  # contaminated
        (1021, text(r, 900) + " " + " ".join(passage.split()[5:18])),  # a passage, but below a twentieth
        (1022, "tiny-item!"), (1023, " ".join(passage.split()[:12]) + " " + text(r, 30)),
        (1030, None), (1031, ""), (1032, " \n\t"), (1033, None),
        (1040, text(r, 40)), (1040, text(r, 45)), (1041, twice), (1041, twice),
        (None, text(r, 33)), (None, "vileb3 " + text(r, 30)), (None, passage)]
    rows += [rows[-3]]
    return rows, labels, [(1, passage), (2, "Tiny item"), (3, None), (4, "--")]


def plain_lines_kept(docs):
    """Texts after line deduplication, None where nothing is left of a text that had words."""
    order = sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0))
    flat = [(d, k, x) for d in order for k, x in enumerate((d[1] or "").split("\n")) if WORD.search(x)]
    distinct = list(dict.fromkeys(x for *_, x in flat))
    label, words = {x: x for x in distinct}, {x: set(x.split()) for x in distinct}
    for a, x in enumerate(distinct):
        for y in distinct[:a]:
            if min(len(x), len(y)) >= lines.NEAR and abs(len(x) - len(y)) <= 2 and len(words[x] ^ words[y]) <= 6 \
                    and plain_distance(x, y) <= 2:  # an edit changes three words of the two at most
                old, new = label[x], label[y]
                label = {k: new if v == old else v for k, v in label.items()}
    seen, left = set(), {d: (d[1] or "").split("\n") for d in order}
    for d, k, x in flat:
        if label[x] in seen:
            left[d][k] = None
        seen.add(label[x])
    out = {}
    for d, parts in left.items():
        kept = "\n".join(p for p in parts if p is not None)
        out[d] = d[1] if None not in parts else kept if WORD.search(kept) else False
    return [(d[0], out[d]) for d in docs if out[d] is not False]


def plain_contaminated(t, items):
    w, hit = words4(t), set()
    for _, item in items:
        x = words4(item)
        for a in range(max(1, len(x) - 12)) if x else ():
            run = x[a:a + 13]
            for p in range(len(w) - len(run) + 1):
                if w[p:p + len(run)] == run:
                    hit |= set(range(p, p + len(run)))
    return bool(hit) and 20 * len(hit) >= len(w)


def test_pipeline_equals_a_plain_chain(spark, tmp_path, monkeypatch):
    rows, labels, items = planted()
    spark.createDataFrame([(i, t, "en", f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(rows)],
                          "doc_id long, text string, lang string, source string, n_chars long") \
        .repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages, store = {}, corpus_pipeline.stored

    def noted(df, name):
        stages[name] = store(df, name)
        return stages[name]

    monkeypatch.setattr(corpus_pipeline, "stored", noted)
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()

    def kept(name):
        return Counter((r.doc_id, r.text) for r in stages[f"pipeline-{name}"].select("doc_id", "text").collect())

    docs = [d for d in rows if "vile" not in (d[1] or "")]
    assert kept("toxicity") == Counter(docs)
    docs = plain_lines_kept(docs)
    assert kept("line_dedup") == Counter(docs) and not {1002, 1003, 1012} & {i for i, _ in docs}
    group = plain_components(docs)
    docs = [*{d for d in docs if d[0] is not None and group[d[0]] == d[0]}, *(d for d in docs if d[0] is None)]
    assert kept("minhash_neardup") == Counter(docs) and group[1011] == 1010
    docs = [d for d in docs if not plain_contaminated(d[1], items)]
    assert kept("decontamination") == Counter(docs)
    assert {i for i, _ in docs} >= {1021, 1023, 1030, 1031, 1040, None} and not {1020, 1022} & {i for i, _ in docs}
    library, want = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), Counter()
    for i, t in docs:
        ids = library.encode(t or "")
        want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), library.decode(ids) == (t or ""))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.round_trip) for r in last) == want
    assert all(r.lang == "en" and r.source[0] == "s" for r in last)


def test_pipeline_of_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"),
                         ("labels", "doc_id long, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
