import random
import re

import numpy as np
from brute import table
from pyspark.sql import functions as F

from gridloom.llm import language, pieces, toxicity

SYLLABLES = {"en": "the and ing tion th er of", "de": "der und sch ung ein ch ü", "fr": "le eau que ment é ai", "es": "los ción que ado ñ ar"}


def texts(n=40, seed=0):
    rng = random.Random(seed)
    for lang, parts in SYLLABLES.items():
        for _ in range(n):
            yield lang, " ".join("".join(rng.choice(parts.split()) for _ in range(rng.randint(1, 3))) for _ in range(60))


def test_languages(spark):
    rows = list(texts())
    x = np.stack([language.histogram(t) for _, t in rows])
    model = language.Model.fit(x, [v for v, _ in rows])
    assert model.families == ["germanic", "romance"] and model.pairs == [("de", "en"), ("es", "fr")]
    fresh = list(texts(10, 1))
    docs = table(spark, [*enumerate(t for _, t in fresh), (100, None), (101, ""), (102, "12 !? 3"), (None, fresh[0][1])])
    got = language.identify(docs, model).select("row.doc_id", "lang_pred", "score").collect()
    assert sum(r.lang_pred == fresh[r.doc_id][0] for r in got if r.doc_id is not None and r.doc_id < 100) >= 39
    assert {(r.lang_pred, r.score) for r in got if (r.doc_id or 0) >= 100} == {("und", 0.0)}
    assert all(0 <= r.score <= 1 for r in got) and len(got) == 44


def test_learning_reads_only_what_it_may(spark):
    rows = list(texts(20))
    docs = spark.createDataFrame([(i, t, v if i % 2 else None, 5) for i, (v, t) in enumerate(rows)], "doc_id long, text string, lang string, n int")
    model = language.learn(docs, F.col("doc_id") < 70)
    assert sorted(v for f in model.languages.values() for v in f) == ["de", "en", "es", "fr"]
    assert language.learn(docs, F.lit(False)).families == []
    assert language.identify(docs, language.Model()).select("lang_pred").distinct().first()[0] == "und"
    assert language.identify(table(spark, []), model).count() == 0


def test_every_language_is_learned(spark):
    langs = ["fi", "ru", "de", "tr", "ar", "hi", "lt", "fr", "el", "ka", "th", "zz"]
    word = lambda k, rng: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0"[2 * k : 2 * k + 3]) for _ in range(4))
    rng = random.Random(3)
    rows = [(v, " ".join(word(k, rng) for _ in range(30))) for k, v in enumerate(langs) for _ in range(3 if v == "zz" else 40 + 4 * (k % 3))]
    schema = "doc_id long, text string, lang string"
    docs = spark.createDataFrame([(None if v == "el" else i, t, v) for i, (v, t) in enumerate(rows)], schema)
    for bounds in ({}, {"rows_each": 20, "rows": 96}, {"rows_each": 20, "rows": 24}):
        model = language.learn(docs, F.lit(True), **bounds)
        assert sorted(v for f in model.languages.values() for v in f) == sorted(langs)
    got = language.identify(docs, language.learn(docs, F.lit(True), rows_each=20, rows=96)).select("row.lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(rows)
    assert sum(r.lang == r.lang_pred for r in got if r.lang == "zz") == 3


def test_unseen_misspellings_are_toxic(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice(["tan", "re", "lo", "mi", "su", "ke"]) for _ in range(rng.randint(1, 4)))

    def make(bad):
        w = [word() for _ in range(rng.randint(5, 200))]
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["idiotic", "idiots", "moronic", "morons"])
        return w

    rows = [(make(k % 2), k % 2) for k in range(300)]
    model = toxicity.fit([t for t, _ in rows], np.array([y for _, y in rows]))
    docs = table(spark, [(1, " ".join(make(0)) + " IDIOTT!"), (2, " ".join(make(0))), (3, None), (4, "  "), (5, "x" * 30 + " moronn")])
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).select("row.doc_id", "score").collect()}
    assert got[1] >= 0.5 and got[5] >= 0.5 and got[2] < 0.5 and got[3] == got[4] == 0.0
    assert toxicity.score(table(spark, []), model).count() == 0
    assert toxicity.fit([], np.zeros(0, int)).score(np.zeros(3)) < 0.5


def test_subwords_do_not_depend_on_their_company():
    alone = [toxicity.subwords([w])[0].tolist() for w in ("idiot", "a", "né")]
    b, o = toxicity.subwords(["idiot", "a", "né"])
    assert [sorted(b[o == k].tolist()) for k in range(3)] == [sorted(x) for x in alone]


ODD = ["  a  b   c", "日本語abc 😀 \n\t x", "a" * 50, "if (x == 10) {\n        return  foo;\n    }", " ", "", " " * 70, "Der Bär – señor."]


def test_encoding_is_the_librarys_at_any_chunk_size(spark, corpus):
    rows = [*corpus[:12], *enumerate(ODD, 200), (None, "x y"), (4, dict(corpus)[4])]
    model = pieces.Pieces.at(pieces.default_path()).model
    for chunk in (23, 1 << 14):
        out = pieces.decode(pieces.encode(table(spark, rows), giant=chunk, chunk=chunk)).select("row.doc_id", "row.text", "ids", "decoded").collect()
        assert len(out) == len(rows)
        for r in out:
            assert r.ids == model.encode(r.text or "") and r.decoded == (r.text or "")
    assert pieces.encode(table(spark, [])).count() == 0


def test_products_of_matrices_associate():
    p = pieces.Pieces.at(pieces.default_path())
    text = pieces.SPACE + ("Thonst aonthrein thedtiou anon. " * 4).replace(" ", pieces.SPACE)
    cuts = [0, 17, 40, 71, len(text)]
    m = [p.matrix(text, a, b, b == len(text), 0) for a, b in zip(cuts, cuts[1:])]
    left = pieces.product(pieces.product(pieces.product(m[0], m[1]), m[2]), m[3])
    right = pieces.product(m[0], pieces.product(m[1], pieces.product(m[2], m[3])))
    assert left == right == p.matrix(text, 0, len(text), True, 0)


def plain_buckets(word):
    """A word's buckets from its letters, in whole numbers: every n-gram of it, its ends marked, and the whole."""
    mask, bits = (1 << 64) - 1, 64 - (toxicity.BUCKETS - 1).bit_length()
    letters = [ord(c) for c in f"<{word}>"]
    out = []
    for n in toxicity.SUBWORDS:
        for i in range(len(letters) - n + 1):
            h = 0
            for c in letters[i : i + n]:
                h = (h * 0x100000001B3 + c + 1) & mask
            out.append(((h ^ h >> 29) * (0x9E3779B97F4A7C15 + 2 * n) & mask) >> bits)
    whole = sum(c * pow(0x9E3779B97F4A7C15, (len(letters) - i) % 61, 1 << 64) for i, c in enumerate(letters)) & mask
    return [*out, (whole * 0xD1342543DE82EF95 & mask) >> bits]


def plain_score(model, text):
    """The score again, word by word and n-gram by n-gram."""
    w = sorted((sum(float(model.logit[k]) for k in plain_buckets(x)) / len(plain_buckets(x)) for x in re.findall(r"\w+", (text or "").lower())), reverse=True)
    if not w:
        return 0.0
    k = -(-len(w) // toxicity.SHARE)
    return 1 / (1 + np.exp(-(model.slopes[0] * w[0] + model.slopes[1] * sum(w[:k]) / k + model.shift)))


def test_a_verdict_does_not_depend_on_where_words_stand():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["tan", "re", "lo", "mi", "su", "ke"]) for _ in range(3))
    texts = [[word() for _ in range(rng.randint(16, 90))] for _ in range(300)]
    for k in range(0, 300, 3):
        texts[k][rng.randrange(len(texts[k]))] = rng.choice(["idiot", "moron"])
    model = toxicity.fit(texts, np.array([k % 3 == 0 for k in range(300)], int))
    score = lambda w: model.score(model.word_logits(w))
    neutral = sorted(((model.word_logits([w])[0], w) for w in {w for t in texts[1::3] for w in t}))
    quiet = [w for _, w in neutral[: len(neutral) // 2]]
    for t in texts[:90]:
        moved = t[:]
        rng.shuffle(moved)
        assert abs(score(moved) - score(t)) < 1e-6
        for n in range(1, 8):
            longer = rng.sample(quiet, n) + t
            if -(-len(longer) // toxicity.SHARE) == -(-len(t) // toxicity.SHARE):
                assert abs(score(longer) - score(t)) < 1e-6  # quiet words in front change nothing
    assert np.mean([(score(t) >= 0.5) == (k % 3 == 0) for k, t in enumerate(texts)]) > 0.95


def test_scores_by_a_plain_version_and_on_rows_kept_aside(spark):
    import zlib

    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["tan", "re", "lo", "mi", "su", "ke"]) for _ in range(rng.randint(1, 4)))
    rows = []
    for k in range(600):
        w = [word() for _ in range(rng.randint(3, 120))]
        if k % 3 == 0:
            w[rng.randrange(len(w))] = rng.choice(["idiot", "idiots", "idiotic", "moron", "morons", "moronic"])
        rows.append((k, " ".join(w), int(k % 3 == 0)))
    rows += [(None, "no id at all", 1), (5, rows[5][1], rows[5][2]), (601, "x " * 200_000 + "idiot", 1)]
    docs = table(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(7, 1, rows[7][2]), (8, 0, None)], "doc_id long, quality int, toxic int")
    aside = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    model = toxicity.learn(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    got = [(r.doc_id, r.text, r.score) for r in toxicity.score(docs, model).select("row.doc_id", "row.text", "score").collect()]
    assert len(got) == len(rows)
    for i, t, s in got[::7] + [g for g in got if g[0] in (None, 5)]:
        assert abs(s - plain_score(model, t)) < 1e-6
    truth = {i: y for i, _, y in rows}
    held = [(s >= 0.5, truth[i]) for i, _, s in got if aside(i)]
    assert len(held) > 80 and sum(p == y for p, y in held) >= 0.95 * len(held)


def test_predictions_by_a_plain_version_and_on_rows_kept_aside(spark):
    rows = list(texts(60, 4))
    x = np.stack([language.histogram(t) for _, t in rows])
    model = language.Model.fit(x[::2], [v for v, _ in rows[::2]])
    docs = table(spark, [*enumerate(t for _, t in rows), (3, rows[3][1]), (900, rows[0][1] * 400)])
    got = language.identify(docs, model).select("row.doc_id", "row.text", "lang_pred", "score").collect()
    for r in got:
        h = language.histogram(r.text).astype(np.float64)
        margins = [float(h @ model.weights[:, k]) + float(model.bias[k]) for k in range(len(model.bias))]
        k = len(model.families)
        family = max(range(k), key=lambda j: margins[j])
        own = model.languages[model.families[family]]
        wins = {v: [0, 0.0] for v in own}
        for (a, b), m in zip(model.pairs, margins[k:]):
            if a in own:
                wins[a if m > 0 else b][0] += 1
                wins[a][1] += m
                wins[b][1] -= m
        assert r.lang_pred == max(own, key=lambda v: (wins[v], v)) and 0 <= r.score <= 1
    held = [(r.lang_pred, rows[r.doc_id][0]) for r in got if r.doc_id < len(rows) and r.doc_id % 2]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)


def test_every_query_runs_and_has_its_columns(spark, tmp_path, corpus):
    from gridloom.llm import queries

    docs = [(i, t, v, "s", len(t or "")) for (i, t), v in zip(corpus, ["en", "de", None] * 20)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in corpus], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want = {
        "op1_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
        "op3_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
        "op5_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
        "op6_sentencepiece": "doc_id bigint, n_ids bigint, ids_sha256 string, round_trip boolean",
        "op8_simhash_near_dedup": "doc_id bigint, fingerprint string, component_id bigint",
        "op10_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    }
    for name, columns in want.items():
        out = queries.queries()[name](spark, str(tmp_path))
        assert [f"{c} {t}" for c, t in out.dtypes] == columns.split(", ")
        rows = out.collect()
        assert {r.doc_id for r in rows} == {i for i, _ in corpus}
        for r in rows:
            if name == "op5_fingerprints":
                assert len(r.fingerprint) == 256 and int(r.fingerprint, 16) >= 0 and len(r.edited_sha256) == 64
            if name == "op6_sentencepiece":
                assert r.round_trip
            if name == "op10_toxicity":
                assert r.predicted == int(r.score >= 0.5)


def test_matrices_are_multiplied_up_a_tree(spark, monkeypatch):
    """A text of more than a hundred chunks, three matrices at a time: five levels."""
    monkeypatch.setattr(pieces, "FAN", 3)
    rng = random.Random(8)
    long = " ".join(rng.choice(["the", "pieces", "überall", "aaaa", "of", "語", "\n", "x" * 20]) for _ in range(1500))
    rows = [(1, long), (2, long[:70]), (3, "a" * 300), (4, long), (5, "")]
    out = pieces.encode(table(spark, rows), giant=64, chunk=48)
    model = pieces.Pieces.at(pieces.default_path()).model
    assert len(long) // 48 > 100
    for r in out.select("row.doc_id", "row.text", "ids").collect():
        assert list(r.ids) == model.encode(r.text)
