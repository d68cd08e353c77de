"""Cross-tokenizer alignment, toxicity and fill-in-middle against plain versions of their contracts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fenmark.llm import align, fim, kernels, langid, toxicity
from fenmark.llm.queries import QUERIES

from test_llm_operators import ODD, corpus, frame, sha

STRANGE = [
    "", None, " ", "  two  spaces ", "a\tb \t c\n\n d\r\n", "\u2581 is no space", "un\u2581seen", "<|endoftext|> and </s> <s> <unk> <0x41>", "caf\u00e9 d\u00e9j\u00e0 vu \u00e9 \u00e9t\u00e9", "\u4e2d\u6587 \u5b57 \U0001f600 \U0001f468\u200d\U0001f469",
    "a\u00a0b \u2003 c\u3000d \u00a0 e", "x" * 5000, "ab" * 3000 + " end", "don't we'll I'M 'S it's", "1234567890 12 3.14 -7", "\x00 zero \x1c\x1f \x7f", "\u0301 combining e\u0301 \ufb01 \u212b", "a b a b a b a b", "... --- ... !!", "\ufeff bom \u180e x",
    "p\u00adq \u0378 \U0010ffff", " leading", "trailing ", "\n", "\u0440\u0443\u0441\u0441\u043a\u0438\u0439 \u044f\u0437\u044b\u043a \u0438 \u0435\u0449\u0451",
]


def table(spark, texts, parts=3):
    return frame(spark, [(i, t, "x", "a", 1) for i, t in enumerate(texts)], parts)


# Alignment


def plain_groups(e, text):
    """Groups of (A ids, B ids) of a whole text by walking its tokens' ends; None without tokens."""
    if not text:
        return None
    full = (" " + text).encode()
    a, b = e.a.encode(" " + text, add_special_tokens=False).ids, e.b.encode(text)
    if b"".join(e.bytes_a[i] for i in a) != full or b"".join(e.bytes_b[i] for i in b) != full:
        return None
    groups, i, j, end_a, end_b = [], 0, 0, 0, 0
    while i < len(a):
        own = ([], [])
        while not own[0] or end_a != end_b:
            if end_a <= end_b:
                own[0].append(a[i])
                end_a, i = end_a + len(e.bytes_a[a[i]]), i + 1
            else:
                own[1].append(b[j])
                end_b, j = end_b + len(e.bytes_b[b[j]]), j + 1
        groups.append(own)
    return groups


def plain_aligned(texts):
    e = align.Encoders(align.Files.read())
    found = [plain_groups(e, t) for t in texts]
    links = [Counter() if g is None else Counter(p for x, y in g for p, n in ((p, n) for p, n in Counter((i, k) for i in x for k in y).items()) for _ in range(n)) for g in found]
    counts = Counter(p for own in links for p in own)
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for g, own in zip(found, links, strict=True):
        if g is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(own.values()), sum(n for p, n in own.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in own.items()), text))
    return out, counts


TOKEN_TEXTS = [*STRANGE, *(r[1] for r in corpus(5, 40))]


@pytest.fixture(scope="module")
def plain_tokens():
    return plain_aligned(TOKEN_TEXTS)


@pytest.mark.parametrize("small", [False, True])
def test_alignment_equals_plain_walk(spark, monkeypatch, plain_tokens, small):
    if small:  # partial counts are let go early, few pieces are remembered, and every group goes by its distinct ids
        for name, value in {"HELD": 50, "PIECES": 5, "SMALL": 0}.items():
            monkeypatch.setattr(align, name, value)
    got = {r.doc_id: tuple(r)[1:] for r in align.aligned(table(spark, TOKEN_TEXTS)).collect()}
    assert [got[i] for i in range(len(TOKEN_TEXTS))] == plain_tokens[0]
    assert sum(x[0] == 0 for x in plain_tokens[0]) >= 4 and max(x[3] for x in plain_tokens[0]) > 1000


def test_quick_encoding_equals_the_tokenizer():
    e, rng = align.Encoders(align.Files.read()), random.Random(6)
    letters = "".join(map(chr, range(128))) + "".join(map(chr, range(0xC0, 0x260))) + " '  \n\t" * 9 + "sdmtlvre" * 9
    texts = [" " + "".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(6000)]
    texts += [" " + " ".join("".join(rng.choice("abcdeghijklmnoprstuvz'\u00e9\u00fc\u00df") for _ in range(rng.randint(1, 14))) for _ in range(8)) for _ in range(500)]
    assert e.encode(texts)[0] == [x.ids for x in e.a.encode_batch(texts, add_special_tokens=False)]


def test_pair_counts_are_sorted_shards(spark, plain_tokens):
    counts = align.pair_counts(table(spark, TOKEN_TEXTS))
    got = [tuple(r) for r in counts.frame(spark).collect()]
    assert {(a, b): n for a, b, n in got} == plain_tokens[1] and len(got) == len(plain_tokens[1])
    assert all(x[2] < y[1] for x, y in zip(counts.shards, counts.shards[1:], strict=False))
    some = np.array([align.packed(np.array([a]), np.array([b]))[0] for a, b, _ in got[:50]] + [-1, 1 << 60])
    assert counts.of(some).tolist() == [n for _, _, n in got[:50]] + [0, 0]


def test_runs_of_equal_pairs_are_summed_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        counts = align.counted(spark.createDataFrame([(k % 7, 1) for k in range(100)], "pair long, n long").repartition(5))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert counts.of(np.arange(8)).tolist() == [15, 15, 14, 14, 14, 14, 14, 0]


def test_alignment_query_hashes_groups(spark):
    rows = QUERIES["op11_alignment"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all((len(r.groups_sha256) == 64) == (r.n_groups > 0) and r.n_best <= r.n_links <= r.count_sum for r in rows)
    assert set(rows[0].asDict()) == {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"}


# Fill-in-middle


def plain_middle(doc_id, text, fim_percent=90, spm_percent=20, seed=1):
    text = text or ""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * g : 8 * g + 8], 16) for g in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim_percent:
        return n, "plain", None, None, text
    if h[3] % 100 < spm_percent:
        return n, "spm", a, b - a, "<S>" + suffix + "<P>" + prefix + "<M>" + middle
    return n, "psm", a, b - a, "<P>" + prefix + "<S>" + suffix + "<M>" + middle


def test_middles_equal_plain_cuts_and_are_read_back(spark):
    rng = random.Random(4)
    texts = [*STRANGE, "holds <P> one", "<S", "<M>", "ends in <P", "> begins", *("".join(rng.choice("<>PSM \u00e9\U0001f600a") for _ in range(rng.randint(0, 30))) for _ in range(400)), "long \u00e9 " * 60_000]
    for percent in (90, 100, 0):
        made = fim.transformed(table(spark, texts), fim_percent=percent)
        got = {r.doc_id: r for r in made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()}
        for i, t in enumerate(texts):
            r = got[i]
            assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_middle(i, t, percent), t
            assert r.back == (t or "")
    assert {r.form for r in fim.transformed(table(spark, texts)).collect()} == {"plain", "psm", "spm"}


def test_cuts_between_words(spark):
    texts = ["one two  three\nfour", " lead \u00e9t\u00e9 ", "x", "a b c d e f g h i j"] * 10
    seen = set()
    for r in fim.transformed(table(spark, texts), fim_percent=100, unit="word").withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect():
        t = texts[r.doc_id]
        lead = t[:1].isspace()
        assert r.n == len(t.split()) + lead and r.back == t
        for k in (r.prefix_chars, r.prefix_chars + r.middle_chars):
            assert k in (0, len(t)) or (t[k - 1].isspace() and not t[k].isspace())
            seen.add(k)
    assert len(seen) > 5
    with pytest.raises(ValueError):
        fim.unit_starts(np.zeros(1, np.uint8), np.zeros(1, np.int64), "line")


def test_slices_of_columns_are_cut_alike():
    texts = pa.array(["skipped", "<P> here", "caf\u00e9 noir", "", None, "plain"])
    h = np.arange(24).reshape(6, 4)
    whole, part = fim.cut(texts, h), fim.cut(texts.slice(1, 4), h[1:5])
    assert all(whole[c].slice(1, 4).to_pylist() == part[c].to_pylist() for c in whole)


# Toxicity


def test_pooling_equals_plain_convolution(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 5)
    texts = pa.array(["", "one", "two words", None, "a b c d e f g h i j k l m", "\u00e9t\u00e9 x y", "last one here then"])
    rng = np.random.default_rng(1)
    m = toxicity.Model.fresh(rng)
    for w in toxicity.WIDTHS:
        m.bias[w] = rng.normal(0, 0.1, toxicity.FILTERS).astype(np.float32)
    (chunk,) = kernels.chunks(texts, lower=True)
    ids, first = toxicity.word_ids(chunk)
    got = m.pooled(ids, first)
    for i in range(len(texts)):
        e = np.array([m.embedding[x].sum(0) for x in ids[first[i] : first[i + 1]]]).reshape(-1, toxicity.DIM)
        padded = np.concatenate([e, np.zeros((2, toxicity.DIM))])
        want = [max([0.0] + [sum(float(padded[k + o] @ m.filters[w][o][:, f]) for o in range(w)) + float(m.bias[w][f]) for k in range(len(e))]) for w in toxicity.WIDTHS for f in range(toxicity.FILTERS)]
        assert got[i] == pytest.approx(want, abs=1e-4)


def toxic_corpus(n=1000, seed=2):
    """Documents of two languages; toxic ones hold one of a few stems with endings of all kinds, or a phrase of two harmless words."""
    rng = random.Random(seed)
    words = {"x": ["ba", "be", "bo", "lun", "mar", "tos", "vir", "calm", "wave"], "y": ["\u00e9t\u00e9", "ose", "rue", "nid", "lac", "mur", "pas"]}
    docs, labels = [], []
    for i in range(n):
        lang, bad = "xy"[i % 2], i % 3 == 0
        own = [rng.choice(words[lang]) for _ in range(rng.randint(5, 120))]
        if bad:
            own.insert(rng.randrange(len(own)), rng.choice(["zork", "krull"]) + "".join(rng.choice("aeiou") for _ in range(rng.randint(0, 3))))
        docs.append((i, " ".join(own), lang, f"s{i % 3}", 1))
        labels.append((i, 1, int(bad)))
    return docs, labels


LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def toxic(spark):
    docs, labels = toxic_corpus()
    return frame(spark, docs), spark.createDataFrame(labels, LABELS), {i: y for i, _, y in labels}


def test_toxicity_of_held_out_documents(spark, toxic):
    docs, labels, truth = toxic
    rows = toxicity.scored(docs, labels).collect()
    own = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and len(own) > 100 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    caught = [r.predicted for r in own if truth[r.doc_id]]
    assert sum(caught) >= 0.95 * len(caught) and sum(r.predicted for r in own if not truth[r.doc_id]) <= 0.02 * len(own)


def test_held_out_labels_and_other_columns_are_never_learned_from(spark, toxic):
    docs, labels, _ = toxic
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    known = langid.learn(docs)
    a, b = (toxicity.fit(x, y, profiles=known) for x, y in ((docs, labels), (docs.withColumn("source", F.lit("z")).repartition(7), flipped.repartition(2))))
    column = pa.array(["zork ba be", "ba be bo", "rue krullo", ""])
    assert a.scores(column).tolist() == b.scores(column).tolist() and set(a.thresholds) >= {None, "x", "y"}


def test_all_labelled_documents_are_learned_from(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD", 2000)
    rng = np.random.default_rng(4)
    plain, bad = [f"w{k}" for k in range(300)], [f"{a}{b}{k}" for k, (a, b) in enumerate((a, b) for a in "bcdfghklmn" for b in "aiou")]
    rows, labels = [], []
    for i in range(4000):
        y = i % 4 == 0
        words = rng.choice(plain, 30).tolist() + [bad[i // 4 % len(bad)]] * y
        rows.append((i, " ".join(rng.permutation(words).tolist()), "x", "a", 1))
        labels.append((i, 1, int(y)))
    docs, told = frame(spark, rows), spark.createDataFrame(labels, LABELS)
    # Of 40 toxic words a start on 10 documents of each class meets 10 at most.
    known = toxicity.fit(docs, told, train_docs=10)
    got = toxicity.scored(docs, classifier=known).where("held_out").collect()
    caught = [r.predicted for r in got if r.doc_id % 4 == 0]
    assert sum(caught) >= 0.8 * len(caught) and sum(r.predicted for r in got if r.doc_id % 4) <= 0.05 * len(got)
    again = toxicity.fit(docs.repartition(7), told.repartition(3), train_docs=10, profiles=known.profiles)
    column = pa.array([" ".join(plain[k : k + 9]) + " " + bad[k] for k in range(40)])
    assert again.scores(column).tolist() == known.scores(column).tolist()


def test_thresholds_lie_in_the_widest_best_gap():
    raw, y = np.array([5.0, 4.0, 1.0, 0.0, -3.0]), np.array([1, 1, 0, 0, 0])
    assert toxicity.best_threshold(raw, y, np.ones(5)) == 2.5
    assert toxicity.best_threshold(np.array([1.0, 1.0]), np.array([1, 0]), np.ones(2)) == 0.0


def test_labels_of_one_class_give_scores_of_zero(spark, toxic):
    docs, labels, _ = toxic
    for told in (labels.limit(0), labels.where("toxic = 0")):
        assert {(r.score, r.predicted) for r in toxicity.scored(docs, told).select("score", "predicted").distinct().collect()} == {(0.0, 0)}


# Odd rows


@pytest.mark.parametrize("name", ["align", "fim", "toxicity"])
def test_odd_rows_empty_tables_and_clashing_columns(spark, toxic, name):
    classifier = toxicity.fit(*toxic[:2]) if name == "toxicity" else None
    run = {"align": align.aligned, "fim": fim.transformed, "toxicity": lambda d: toxicity.scored(d, classifier=classifier)}[name]
    df = frame(spark, ODD)
    clash = df.select("*", *(F.lit("x").alias(c) for c in ("h1", "n", "form", "output", "pair", "score", "held_out", "y", "c0")), F.lit(1).alias("Doc_ID"), F.lit(2).alias("TEXT"))
    got = run(df).collect()
    assert len(got) == len(ODD) and run(df.limit(0)).collect() == []
    assert sorted(map(repr, run(clash).collect())) == sorted(map(repr, got))
    twice = run(frame(spark, ODD * 2)).collect()
    if name != "align":  # counts of pairs grow with repeated rows, by contract
        assert Counter(map(repr, twice)) == Counter({k: 2 * n for k, n in Counter(map(repr, got)).items()})
    else:
        assert sum(r.count_sum for r in twice) == 4 * sum(r.count_sum for r in got)


def test_classifier_of_odd_labels_is_fitted(spark, toxic):
    docs, labels, _ = toxic
    more = spark.createDataFrame([(None, None, 1), (1, 1, None), (2, 0, 7), (10**12, 1, 1)], LABELS)
    clash = labels.unionByName(more).select("*", F.lit("x").alias("text"), F.lit(3).alias("TOXIC"))
    odd = docs.unionByName(frame(spark, [(None, "no id", "x", "a", 1), (9_001, None, "x", "a", 1)]))
    assert toxicity.fit(odd, clash).model is not None
