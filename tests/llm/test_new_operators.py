"""Operators 11 to 13: whitening, toxicity and fill-in-middle."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from equiscope.llm import common, infill, minhash, queries, toxicity, whitening

# 11

VEC = "vec_id long, embedding array<float>, label int, n int, component string, deviation long"


def vectors(spark, rows):
    """Extra columns carry names that the result uses."""
    return spark.createDataFrame([(i, v, 1, 2, "c", 3) for i, v in rows], VEC)


def kept_integers(rows):
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(1024.0 * float(np.float32(c)))) + 100000 for c in v] for _, v in good], np.int64)
    return [i for i, _ in good], x


def check_whitening(got, rows, k=8, tol=1e-6):
    ids, x = kept_integers(rows)
    n, s = len(x), x.sum(axis=0)
    y = n * x.astype(object) - s.astype(object)
    c = (y / n).astype(float)
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    assert len(got) == len(ids) * min(k, x.shape[1])
    assert set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-4
    deviation = dict(zip(ids, (y**2).sum(axis=1), strict=True))
    assert all(deviation[i] == d for i, d in zip(got["vec_id"], got["deviation"], strict=True))
    for j in range(min(k, x.shape[1])):
        own = got[got["component"] == j + 1].set_index("vec_id").loc[ids]
        assert np.allclose(own["explained"], e[j] / e.sum(), rtol=1e-4)
        want = c @ u[:, j] / np.sqrt(e[j])
        sign = np.sign((own["whitened"].to_numpy() * want).sum())
        assert np.abs(own["whitened"].to_numpy() * sign - want).max() < tol * max(1, np.abs(want).max())


def test_whitening_of_the_table(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check_whitening(queries.op11_embedding_whitening(spark, sf).toPandas(), rows)


def test_whitening_of_ill_conditioned_rows_far_from_zero(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 10)) * np.geomspace(3000, 3, 10)
    mixed = base @ np.linalg.qr(rng.normal(size=(10, 10)))[0] + 50000
    rows = [(i, [float(c) for c in v.astype(np.float32)]) for i, v in enumerate(mixed)]
    check_whitening(whitening.whiten(vectors(spark, rows)).toPandas(), rows, tol=1e-5)


def test_whitening_leaves_out_directions_without_variance(spark):
    rng = np.random.default_rng(6)
    a = rng.integers(-50, 50, size=(120, 3)).astype(float)
    rows = [(i, [*v, v[0], 7.0, v[1] + v[2]]) for i, v in enumerate(a.tolist())]
    got = whitening.whiten(vectors(spark, rows)).toPandas()
    assert set(got["component"]) == {1, 2, 3} and got["identity_error"].iloc[0] < 1e-6
    assert abs(got[got["vec_id"] == 0]["explained"].sum() - 1) < 1e-12


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(c) for c in rng.normal(size=4).astype(np.float32)]) for i in range(40)]
    odd = [(100, None), (101, [1.0, None, 2.0, 3.0]), (102, [1.0, float("nan"), 2.0, 3.0]), (103, [float("inf"), 0.0, 0.0, 0.0]), (3, rows[3][1]), (None, rows[4][1])]
    got = whitening.whiten(vectors(spark, [*rows, *odd]), k=2).toPandas()
    assert len(got) == 42 * 2 and set(got["n"]) == {42} and got["vec_id"].isna().sum() == 2
    assert set(got.columns) == {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"}
    for few in ([], [(1, [1.0, 2.0])], [(1, []), (2, [])], [(1, [2.0, 2.0])] * 5):
        assert whitening.whiten(vectors(spark, few)).count() == 0
    with pytest.raises(Exception, match="entries"):
        whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0])]))


def test_deviations_are_exact_or_null():
    c = whitening.Centre(3, [10, 11])
    assert c.deviations(np.array([[3, 4]])) == [(9 - 10) ** 2 + (12 - 11) ** 2]
    big = whitening.Centre(1 << 40, [0, 0])
    assert big.deviations(np.array([[3, 4], [1 << 21, 0]])) == [25 * (1 << 80) if 25 * (1 << 80) < 1 << 63 else None, None]
    assert whitening.Centre(1 << 20, [0]).deviations(np.array([[2048], [2047]])) == [1 << 62, 2047**2 << 40]


def test_triangular_solve():
    rng = np.random.default_rng(8)
    r = np.triu(rng.normal(size=(70, 70))) + 9 * np.eye(70)
    a = rng.normal(size=(20, 70))
    assert np.abs(whitening.solve_right(a, r) @ r - a).max() < 1e-12


# 12


def tox_rows(n, seed):
    """Texts of four languages with bad words: whole ones in two languages, stems with endings in the others."""
    rng = random.Random(seed)
    own = {"en": ["idiot", "scum"], "de": ["loweix", "lostray"], "fr": ["crétin", "nul"], "es": ["chonzo", "burla"]}
    made = {k: ["".join(rng.choices("aeioubcdfghklmnprst", k=rng.randint(2, 8))) for _ in range(300)] for k in own}
    out = []
    for i in range(n):
        lang = rng.choice(list(own))
        words = rng.choices(made[lang], k=rng.choice([3, 40, 200]))
        toxic = rng.random() < 0.2
        if toxic:
            bad = rng.choice(own[lang])
            words.insert(rng.randrange(len(words)), bad[:5] + "".join(rng.choices("aeiou", k=4)) if lang in ("de", "es") else bad.upper())
        out.append((i, " ".join(words) + ".", lang, int(toxic)))
    return out


DOCS = "doc_id long, text string, lang string, source string, n int, score string, predicted int, _text string, label int"


def tox_tables(spark, rows):
    docs = spark.createDataFrame([(i, t, lang, None, 1, "s", 2, "x", 3) for i, t, lang, _ in rows], DOCS)
    return docs, spark.createDataFrame([(i, 0, y) for i, _, _, y in rows], "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    rows = tox_rows(3000, 3)
    docs, labels = tox_tables(spark, rows)
    out = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    model = toxicity.fit(docs.filter(~docs.doc_id.isin(out)), labels, buckets=1 << 15)
    got = {r["doc_id"]: r for r in toxicity.predict(docs, model).collect()}
    truth = {i: y for i, _, _, y in rows}
    hits = [i for i in out if got[i]["predicted"] == 1]
    right = sum(truth[i] for i in hits)
    assert right / len(hits) > 0.95 and right / sum(truth[i] for i in out) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got.values())


def test_toxicity_equals_a_plain_convolution():
    rng = np.random.default_rng(4)
    buckets, f = 64, 5
    model = toxicity.ToxModel(rng.normal(size=(buckets, 6 * f)).astype(np.float32), rng.normal(size=3 * f), rng.normal(size=3 * f), 0.3, rng.normal(size=(buckets, 2)).astype(np.float32), np.array([0.1, -0.2]), 1.5)
    texts = ["", "one", "Two words", "a b c d e f g über Straße!", "... 12", " ".join(f"w{chr(97 + i % 26)}{chr(97 + i % 7)}" for i in range(400))]

    def plain(t):
        words = re.findall(r"[a-z\x80-\U0010ffff]+", t.translate({c: c + 32 for c in range(65, 91)}))
        parts = [toxicity.words(w.encode(), buckets)[0][0] for w in words]
        row = [model.table[p].sum(axis=0) for p in parts]
        pooled, col = [], 0
        for k, width in enumerate(toxicity.WIDTHS):
            best = np.full(f, -np.inf)
            for s in range(len(row) + 1):
                best = np.maximum(best, sum((row[s + o][col + o * f : col + (o + 1) * f] for o in range(width) if s + o < len(row)), np.zeros(f)))
            pooled.append(best + model.bias[k * f : (k + 1) * f])
            col += width * f
        z = np.maximum(np.concatenate(pooled), 0) @ model.out + model.offset
        lang = int(sum((model.lang_table[p[0]] for p in parts), np.zeros(2)).argmax())
        return 1 / (1 + np.exp(-model.slope * (z - model.thresholds[lang])))

    assert np.allclose(model.scores([t.encode() for t in texts]), [plain(t) for t in texts], atol=1e-5)
    long = " ".join(texts * 3).encode()
    whole = list(toxicity.tokens_of([long], buckets))[0][2]
    assert np.array_equal(whole, np.concatenate([toxicity.words(long, buckets)[0]]))
    assert np.array_equal(next(toxicity.tokens_of([long], buckets, limit=50))[2], whole)


def test_toxicity_of_odd_rows(spark):
    rows = [(1, None, "en", 1), (2, "", None, 0), (3, "one", "en", 0), (4, "idiot", "en", 1), (4, "idiot", "en", 1), (None, "no id", "en", 1), (5, "x" * 5000, "fr", 0), (6, "w " * 4000, "fr", 0), (7, " \t12 ??", "fr", 1)]
    docs, labels = tox_tables(spark, rows)
    model = toxicity.fit(docs, labels, buckets=1 << 10, epochs=2)
    got = toxicity.predict(docs, model).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, *_ in rows) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.predict(docs.limit(0), model).count() == 0
    none = toxicity.predict(docs, toxicity.fit(docs, labels.limit(0))).collect()
    assert {r["predicted"] for r in none} == {0}
    one = toxicity.fit(docs.filter("doc_id = 3"), labels)
    assert toxicity.predict(docs, one).count() == len(rows)


def test_best_threshold():
    z, y = np.array([0.1, 0.2, 0.6, 0.8, 0.9]), np.array([0, 0, 1, 0, 1])
    cuts = [t for t in np.arange(0, 1, 0.05)]
    f1 = lambda t: 2 * y[z > t].sum() / ((z > t).sum() + y.sum())
    assert f1(toxicity.best_threshold(z, y, np.ones(5))) == max(map(f1, cuts))


# 13

UNIT = {"line": re.compile(r"[^\n]*\n|[^\n]+"), "char": re.compile(r"(?s).")}


def plain_infill(i, t, unit="line", rate=100, spm=50, seed=7):
    t = t or ""
    h = hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    u = UNIT[unit].findall(t)
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(u), "plain", None, None, t
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h[3] % 100 < spm:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [None, "", "\n", "\n\n", "one", "one\n", "ünï\ncódé 漢字\n\U0001f600 end", "a<P>b", "<\nS>\n<P", "x\r\ny\n", "<S\n>\nM>", "\x00\n\x00", "w\n" * 3000, "é" * 5000, "漢\U0001f600\n" * 200]


@pytest.mark.parametrize(("unit", "rate", "spm"), [("line", 100, 50), ("char", 100, 50), ("char", 60, 100), ("line", 0, 50)])
def test_infill_equals_brute_force_and_comes_back(spark, unit, rate, spm):
    rows = [(i * 31 + k, t) for k, t in enumerate(TEXTS) for i in range(6)] + [(None, "a\nb\nc"), (5, "same\nid"), (5, "same\nid")]
    docs = spark.createDataFrame([(i, t, 1, "f", "o", 2) for i, t in rows], "doc_id long, text string, n int, form string, output string, _text int")
    made = infill.fill_in_middle(docs, unit=unit, rate=rate, spm=spm)
    got = made.withColumn("again", infill.restored(made.output, made.form)).collect()
    want = sorted(((i, t or "", *plain_infill(i, t, unit, rate, spm)) for i, t in rows), key=repr)
    assert sorted(((r["doc_id"], r["again"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got), key=repr) == want
    assert infill.fill_in_middle(docs.limit(0)).count() == 0


def test_infill_of_the_table(spark, sf):
    got = {r["doc_id"]: r for r in queries.op13_fill_in_middle(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        n, form, p, m, out = plain_infill(r["doc_id"], r["text"])
        g = got.pop(r["doc_id"])
        assert (g["n"], g["form"], g["prefix_chars"], g["middle_chars"]) == (n, form, p, m)
        assert g["output_sha256"] == hashlib.sha256(out.encode()).hexdigest() and g["restored_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert not got


def test_exception_index_in_both_directions():
    rng = random.Random(9)
    for _ in range(100):
        t = "".join(rng.choices("ab\n éß漢\U0001f600", k=rng.randint(0, 40)))
        x, b = infill.Exceptions(t.encode()), t.encode()
        assert x.size == len(t)
        for k in range(len(t) + 1):
            at = len(t[:k].encode())
            assert x.to_byte(k) == at and x.to_char(at) == k and b[:at].decode() == t[:k]


# the pipeline


def test_stages_give_extra_columns_back(spark, sf):
    """Columns that carry names which stages use inside come through with their values."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    extra = {"_id": F.lit("mine"), "_text": F.lit("kept"), "score": F.col("doc_id") + 1, "rejected": F.lit("no"), "lang_pred": F.lit(7), "kept": F.lit(1.5), "c0": F.lit("c"), "_id_": F.lit("too"), "text_sha256": F.lit("t"), "contaminated": F.lit("x")}
    plain = spark.read.parquet(f"{sf}/documents.parquet")
    docs = plain.withColumns(extra)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        got = {r["doc_id"]: r for r in out.collect()}
        assert {r["doc_id"] for r in stage(spark, plain, sf).collect()} == set(got), name
        assert all((r["_id"], r["_text"], r["score"], r["rejected"], r["lang_pred"], r["kept"], r["c0"], r["_id_"], r["text_sha256"], r["contaminated"]) == ("mine", "kept", i + 1, "no", 7, 1.5, "c", "too", "t", "x") for i, r in got.items()), name
    assert corpus_pipeline.mixed(spark, docs, sf).count() == docs.count()


# 10


def test_end_tags_without_an_element_cost_nothing():
    import time

    from equiscope.llm import htmltext

    began = time.time()
    page = htmltext.Page("<p>" + "<b>x" * 20000 + "</i>" * 20000 + " end")
    assert time.time() - began < 2 and page.blocks[-1][1].endswith("end")


def test_names_against_the_article_hold_whatever_their_size():
    from equiscope.llm.htmltext import article

    story, long = "<p>A short story.</p>", "<p>" + "and much more of this " * 50 + "</p>"
    for beside in (f"<div class=comments>{long}</div>", f"<div id=cookie-notice>{long}</div>", f"<div class=menu>{long}</div>", f"<form>{long}</form>", f"<div role=dialog>{long}</div>"):
        assert article(f"<body><div>{story}</div>{beside}</body>", set()) == "A short story.", beside
        assert article(f"<body>{beside}<article>{story}</article></body>", set()) == "A short story.", beside
    assert article("<form><p>hello form</p></form>", set()) == ""
    assert article(f"<form id=page><div class=menu>{long}</div><h1>Head</h1>{story}</form>", set()) == "Head A short story."
    both = article("<div class=content>story</div><article>teaser one</article><article>teaser two</article>", set())
    assert both.startswith("story")


def test_main_slot_follows_nested_classes():
    from equiscope.llm.htmltext import main_slot

    page = [(1, 0, 4000), (2, 1, 4000), (3, 2, 3800), (4, 2, 200), (5, 3, 2000), (6, 3, 1800)]
    assert main_slot(page, 0.8) == 3
    assert main_slot([(1, 0, 600), (2, 0, 400)], 0.8) is None
    assert main_slot([], 0.8) is None


def test_classes_find_articles_without_any_names(spark):
    """Elements of the table's pages as div without class, id or role: of a host with two pages that differ, articles are what they are with names."""
    from pyspark.sql import functions as F

    from equiscope.llm import htmltext

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    bare = F.regexp_replace(F.regexp_replace("html", r"<(/?)(nav|header|footer|aside|article|main)\b", "<$1div"), r'<div class="[^"]*">', "<div>")
    named = {r["page_id"]: r["text"] for r in htmltext.main_text(pages).collect()}
    got = {r["page_id"]: r["text"] for r in htmltext.main_text(pages.withColumn("html", bare)).collect()}
    assert all(set(named[k].split()) <= set(got[k].split()) for k in named)
    assert sum(got[k] == named[k] for k in named) >= 0.9 * len(named)


def test_headings_around_the_main_slot_stay(spark):
    from equiscope.llm import htmltext

    page = "<body><div>Buy now at shop {i}</div><div><h2>Head {i}</h2><div>" + "<p>One of {i} and more text of this kind.</p>" * 6 + "</div></div><div>seen {i} times</div></body>"
    rows = [(i, f"http://s.example/{i}", page.replace("{i}", f"n{i}")) for i in range(5)]
    got = {r["page_id"]: r["text"] for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: " ".join([f"Head n{i}"] + [f"One of n{i} and more text of this kind."] * 6) for i in range(5)}


# 6


def test_left_over_pairs_of_a_template_family(spark):
    """Texts of one template just below the bound make no candidates; those above it, of like and unlike sizes, are all there."""
    from equiscope.llm import minhash

    rng = random.Random(5)
    base = [f"t{i}" for i in range(460)]
    texts = {i: " ".join(base + [f"own{i}x{j}" for j in range(46)]) for i in range(150)}
    for i in range(150, 300):  # each a near copy of another, longer or shorter by some words
        words = texts[i - 150].split()
        cut = rng.randrange(0, 30)
        texts[i] = " ".join(words[:460] + words[460 : 506 - cut] + [f"end{i}x{j}" for j in range(rng.randrange(0, 20))])
    texts |= {300: "a b c d e f", 301: "a b c d e f", 302: "a b", 303: ""}

    def sets(t):
        w = t.split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())

    s = {i: sets(t) for i, t in texts.items()}
    links = {(a, b) for a in s for b in s if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b])}
    for ways in (4096, 7):
        minhash.ROWS_PER_WAY = ways
        try:
            docs = spark.createDataFrame([(i, i, t.encode()) for i, t in texts.items()], "doc long, label long, text binary")
            got = {(r["c"], r["d"]) for r in minhash.left_over(docs.select("doc", "label"), docs.select("doc", "text"), 5, 85).collect()}
        finally:
            minhash.ROWS_PER_WAY = 4096
        assert len(links) > 50 and links <= got
        assert len(got) <= 3 * len(links)
    assert minhash.length_classes(50).tolist()[:5] == [1, 3, 7, 15, 31]


def test_near_dedup_broadcasts_no_table(spark, sf, monkeypatch):
    plans, write = [], common.staged
    monkeypatch.setattr(common, "staged", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    out = minhash.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 10 and not [p for p in plans if "BroadcastHashJoin" in p]
