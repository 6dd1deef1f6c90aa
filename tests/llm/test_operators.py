import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from equiscope.llm import decontaminate, exact, gru, htmltext, langid, lm, minhash, mixing, queries, sentences, suffix, tokens
from equiscope.llm.components import components
from tests.llm import brute

ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ünï códe 漢字 \U0001f600"), (5, "ünï códe 漢字 \U0001f600"), (None, "no id"), (6, None), (7, "a  b   c "), (8, " lead"), (9, "▁mark ▁ x"), (10, "\x00\x01 nul"), (11, "x" * 3000), (12, "w " * 4000)]
SCHEMA = "doc_id long, text string, lang string, source string, th int, n int, key string, label string, word string, c int"


def table(spark, rows, lang="en"):
    """Extra columns carry names that the operators use inside."""
    return spark.createDataFrame([(i, t, lang, f"s{(i or 0) % 3}", 1, 2, "k", "l", "w", 3) for i, t in rows], SCHEMA)


def read(spark, sf, name="documents"):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def as_dict(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}


# 1


def sp():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_token_counts_match_the_library(spark, sf):
    docs, model = read(spark, sf), sp()
    got = as_dict(queries.op1_token_counts(spark, sf), "n_bytes", "n_tokens", "over_limit")
    assert got == {i: (len(t.encode()), n := len(model.encode(t)), n > 4096) for i, t in texts_of(docs).items()}


def test_token_counts_of_odd_texts(spark):
    model = sp()
    got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in tokens.token_counts(table(spark, ODD), part_chars=64, batch_bytes=100, memory=3).collect())
    assert got == Counter((i, len((t or "").encode()), len(model.encode(t or ""))) for i, t in ODD)
    assert tokens.token_counts(table(spark, ODD).limit(0)).count() == 0


def test_parts_are_safe():
    model, rng = sp(), random.Random(3)
    for _ in range(200):
        t = "".join(rng.choice(["a", "the", " ", "  ", "\n", "▁", "é", "."]) for _ in range(rng.randint(0, 60)))
        assert sum(len(model.encode(p)) for p in tokens.safe_parts(t, 5)) == len(model.encode(t)), repr(t)


def test_token_counts_of_a_json_vocabulary(spark):
    got = tokens.token_counts(table(spark, [(1, "hello world"), (2, None)]), "byte_bpe_50k.json")
    assert as_dict(got, "n_tokens") == {1: (2,), 2: (0,)}


# 2


def test_repeated_strings_match_brute_force(spark, sf):
    got = as_dict(queries.op2_suffix_dedup(spark, sf), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.removed(texts_of(read(spark, sf)), 100)


@pytest.mark.parametrize("crowd", [5000, 2])
def test_repeated_strings_in_hard_texts(spark, crowd):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(3, 40)))
    shared = [word() * 4 for _ in range(6)]
    texts = {i: "".join(rng.choice([word(), word(), rng.choice(shared), "ab" * 90, "z" * 150]) for _ in range(rng.randint(0, 8))) for i in range(60)}
    texts |= {60: texts[3], 61: None, 62: "z" * 99, 63: "z" * 100, 64: "q" * 101}
    got = as_dict(suffix.substring_dedup(table(spark, texts.items()), crowd=crowd, block_bytes=4000), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.removed(texts, 100)


def test_repeated_strings_of_long_texts_and_odd_rows(spark, monkeypatch):
    rng = random.Random(6)
    long = "".join(rng.choice("abc") for _ in range(5000))
    texts = {1: long, 2: long[700:2500] + "x" + long[2400:2900], 3: long[::-1] + long[100:300]}
    got = as_dict(suffix.substring_dedup(table(spark, texts.items())), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.removed(texts, 100)
    b = [t.encode() for t in texts.values()]
    whole = {(int(i), int(a + k)) for i, a, w, *_ in (x for y in suffix.runs_by_text(b, 100) for x in zip(*y, strict=True)) for k in range(w)}
    cut = {(int(i), int(a + k)) for i, a, w, *_ in (x for y in suffix.runs_by_text(b, 100, 500) for x in zip(*y, strict=True)) for k in range(w)}
    assert whole == cut == {(i, s) for i, t in enumerate(b) for s in range(len(t) - 99)}
    rows = suffix.substring_dedup(table(spark, ODD), keep_text=True).collect()
    assert len(rows) == len(ODD) and {r["kept_text"] for r in rows if r["doc_id"] == 5} == {ODD[4][1]}
    assert suffix.substring_dedup(table(spark, ODD).limit(0)).count() == 0


def test_merged_bwt_is_the_bwt_of_all():
    rng = random.Random(9)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 30))) for _ in range(12)]
    shards = [suffix.Shard(strings[:5]), suffix.Shard(strings[5:6]), suffix.Shard(strings[6:])]
    z, classes = suffix.merge(shards, 8)
    seen = Counter()
    met = []
    for s, k in zip(z, classes, strict=True):
        string, offset = shards[s].locate(np.array([seen[s]]))
        seen[s] += 1
        met.append((strings[[0, 5, 6][s] + int(string[0])][int(offset[0]) :], k))
    assert [m[0][:8] for m in met] == sorted(m[0][:8] for m in met)
    for a, b in zip(met, met[1:], strict=False):
        assert (a[1] == b[1]) == (a[0][:8] == b[0][:8] and len(a[0]) >= 8 and len(b[0]) >= 8)


def test_rows_alone_in_their_class_need_no_refining():
    rng = random.Random(10)
    for letters, depth in ((b"ab", 8), (b"ab", 3), (b"a", 12), (bytes(range(256)), 2), (b"a", 40)):
        strings = [bytes(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(12)]
        shards = [suffix.Shard(strings[:5]), suffix.Shard(strings[5:6]), suffix.Shard(strings[6:])]
        z, classes = suffix.merge(shards, depth)
        rank = [int((z[:i] == s).sum()) for i, s in enumerate(z)]
        size = Counter(classes.tolist())
        want, got = {}, {}
        for s, r, k in zip(z.tolist(), rank, classes.tolist(), strict=True):
            if size[k] > 1:
                want.setdefault(k, []).append((s, r))
        for s, r, k in zip(*(x.tolist() for x in suffix.interleaved(shards, depth)), strict=True):
            got.setdefault(k, []).append((s, r))
        assert list(got.values()) == list(want.values())


# 3


def exact_expected(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    return Counter((i, m := max((x for x in v if x is not None), default=None), len(v), i is not None and i == m, brute.sha(t.encode())) for t, v in by.items() for i in v)


def test_exact_dedup(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in read(spark, sf).collect()]
    for r, df in ((rows, read(spark, sf)), (ODD, table(spark, ODD)), ([], table(spark, ODD).limit(0))):
        got = Counter(tuple(x[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for x in exact.exact_dedup(df, buckets=4).collect())
        assert got == exact_expected(r)


def test_index_persists_and_new_data_are_matched(spark, tmp_path):
    first = exact.DigestIndex(spark, str(tmp_path / "i"), 4)
    exact.exact_dedup(table(spark, [(1, "a"), (2, "b"), (3, "a")]), first).count()
    again = exact.DigestIndex(spark, str(tmp_path / "i"), 4)
    got = as_dict(exact.exact_dedup(table(spark, [(10, "a"), (11, "c"), (12, "c")]), again), "keep_id", "kept", "in_index", "group_size")
    assert got == {10: (3, False, True, 1), 11: (12, False, False, 2), 12: (12, True, False, 2)}
    assert sorted(r["keep_id"] for r in again.table().collect()) == [2, 3, 12]


# 4


def test_repeated_passage_goes_everywhere_but_first(spark):
    rng = random.Random(1)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)) + "."
    passage = " ".join(say(11) for _ in range(5))
    texts = {i: f"{say(9)} {say(14)} {passage} {say(12)} {say(7)}" for i in (4, 2, 9)} | {5: say(30), 7: " ".join(say(8) for _ in range(5))}
    rows = {r["doc_id"]: r for r in sentences.sentence_dedup(table(spark, texts.items())).collect()}
    assert {i: r["n_removed"] for i, r in rows.items()} == {2: 0, 4: 5, 5: 0, 7: 0, 9: 5}
    for i in (4, 9):
        assert passage not in rows[i]["kept_text"] and rows[i]["kept_text"] == texts[i].replace(passage, "")
    assert rows[2]["kept_text"] == texts[2]


def test_sentence_spans_match_brute_force(spark, sf):
    texts = texts_of(read(spark, sf))
    seen, gone = set(), defaultdict(set)
    for i, t in sorted(texts.items()):
        b = t.encode()
        parts = sentences.sentences(b)
        keys = [(k, tuple(b" ".join(b[s:e].split()) for s, e, _ in parts[k[0] : k[1]])) for k in sentences.runs(parts, 2, 20)]
        for (s, e), key in keys:
            if key in seen:
                gone[i] |= set(range(s, e))
            seen.add(key)
    got = as_dict(queries.op4_sentence_dedup(spark, sf), "n_removed")
    assert got == {i: (len(gone[i]),) for i in texts} and sum(map(len, gone.values()))


def test_repeated_passages_go_to_their_ends_at_any_offset(spark):
    rng = random.Random(3)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    han = lambda n: "".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(n))
    short = " ".join(say(n) + "." for n in (8, 8, 8, 3))  # no run from its last sentences is long enough
    plain = say(60)  # no mark in it, behind different numbers of words
    blankless = "".join(han(12) + "。" for _ in range(4))
    texts = {1: f"{say(30)}. {short} {say(30)}.", 2: f"{say(9)}. {short} {say(9)}.", 3: f"{say(5)} {plain} {say(40)}", 4: f"{say(18)} {plain} {say(33)}"}
    texts |= {5: han(9) + "。" + blankless + han(7), 6: han(5) + "。" + blankless + han(8)}
    rows = {r["doc_id"]: r for r in sentences.sentence_dedup(table(spark, texts.items())).collect()}
    assert rows[2]["kept_text"] == texts[2].replace(short, "")
    assert rows[4]["n_removed_bytes"] > 0.5 * len(plain) and set(texts[4].split()) - set(plain.split()) <= set(rows[4]["kept_text"].split())
    assert rows[6]["kept_text"] == texts[6].replace(blankless, "")
    assert all(rows[i]["n_removed"] == 0 for i in (1, 3, 5))


def test_sentence_dedup_of_odd_rows(spark):
    rows = sentences.sentence_dedup(table(spark, ODD)).collect()
    assert len(rows) == len(ODD) and all(r["n_removed"] == 0 for r in rows if r["doc_id"] not in (11, 12))
    assert sentences.sentence_dedup(table(spark, ODD).limit(0)).count() == 0


# 5


def test_language_id_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op5_language_id(spark, sf).join(read(spark, sf).select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


FOREIGN = [
    "Быстрая коричневая лиса прыгает через ленивую собаку и бежит дальше в лес, где никто её не видел.", "الثعلب البني السريع يقفز فوق الكلب الكسول ويجري في الغابة بعيدا",
    "快速的棕色狐狸跳过懒狗然后跑进森林里没有人看见它的踪影", "Η γρήγορη καφέ αλεπού πηδά πάνω από το τεμπέλικο σκυλί και τρέχει στο δάσος",
    "Nopea ruskea kettu hyppää laiskan koiran yli ja juoksee metsään, jossa kukaan ei ole nähnyt sitä koskaan aikaisemmin.",
    "xkcd brtl mnpq vwzx ghjk lrtp sdfg qwrt bnmv zxcv plkj hgfd trwq mnbv cxzl kjhg fdsp rtwq vbnm lkjh",
]


def test_foreign_texts_and_noise_are_rejected_and_clean_ones_kept(spark):
    docs = read(spark, "/root/testdata/sf0.01")
    model = langid.fit(docs.filter(~langid.held_out()))
    got = langid.predict(table(spark, list(enumerate(FOREIGN))), model).collect()
    assert len(got) == len(FOREIGN) and all(r["rejected"] for r in got)
    held = langid.predict(docs.filter(langid.held_out()), model).collect()
    assert sum(r["rejected"] for r in held) <= 0.01 * len(held)


def test_sample_of_one_repeated_id_is_bounded(spark):
    rows = spark.createDataFrame([(1, f"der die das und {i}", "de") for i in range(60)], "doc_id long, text string, lang string")
    assert langid.fit(rows, sample=5).langs in (["de"], ["und"])


def test_language_id_of_odd_rows(spark, sf):
    model = langid.fit(read(spark, sf))
    rows = {r["doc_id"]: r for r in langid.predict(table(spark, ODD + [(20, "12 34 --"), (21, "٣٤")]), model).collect()}
    assert {i for i, r in rows.items() if r["lang_pred"] == "und"} == {1, 2, 3, 6, 20, 21}
    assert all(rows[i]["rejected"] and rows[i]["score"] == 0 for i in (1, 2, 3, 6, 20))
    none = langid.fit(table(spark, ODD).limit(0))
    assert {r["lang_pred"] for r in langid.predict(table(spark, ODD), none).collect()} == {"und"}


def test_pieces_of_long_texts_add_up():
    text = ("The quick brown fox, " * 40).encode()
    assert np.allclose(langid.histogram(text, 256), langid.histogram(text, 256, piece=37), atol=1e-6)
    m = langid.train(np.eye(256, dtype=np.float32), np.arange(256) % 2, ["a", "b"], epochs=2)
    assert np.allclose(m.predict([text, b"x", text])[0], m.predict([text])[0])


# 6


def near_rows(spark, texts, **how):
    return as_dict(minhash.near_duplicates(table(spark, texts.items()), **how), "n_shingles", "component_id")


def test_near_duplicates_match_brute_force(spark, sf):
    got = as_dict(queries.op6_minhash_near_dedup(spark, sf), "n_shingles", "component_id")
    assert got == brute.groups(texts_of(read(spark, sf)))


def test_near_duplicates_around_a_base_and_in_chains(spark):
    rng = random.Random(2)
    words = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    base, texts = words(200), {}
    for i in range(40):  # near the base, not near each other
        w = list(base)
        w[rng.randrange(5, 100)], w[rng.randrange(105, 195)] = words(2)
        texts[i] = " ".join(w)
    texts[40] = " ".join(base)
    chain = words(150)
    for i in range(50, 62):
        chain[rng.randrange(10, 140)] = words(1)[0]
        texts[i] = " ".join(chain).upper()
    texts |= {70: "a b c", 71: "A  b c", 72: "a b", 73: None, 74: ""}
    assert near_rows(spark, texts) == brute.groups(texts)


def family(twins, others, slots=20, seed=7):
    """Texts of a pool of passages, two for each slot: any two differ in at least two slots, but for `twins` pairs that differ in one."""
    rng = random.Random(seed)
    pool = [[" ".join(f"w{rng.randint(0, 10**7)}" for _ in range(12)) for _ in range(2)] for _ in range(slots)]
    chosen = []

    def add(codes, alone):
        if all(sum(x != y for x, y in zip(c, o, strict=True)) >= 2 for c in codes for o in alone):
            chosen.extend(codes)

    while len(chosen) < 2 * twins + others:
        c = [int(rng.random() < 0.15) for _ in range(slots)]
        k = rng.randrange(slots)
        add([c, [*c[:k], 1 - c[k], *c[k + 1 :]]] if len(chosen) < 2 * twins else [c], list(chosen))
    return {i: " ".join(pool[k][v] for k, v in enumerate(c)) for i, c in enumerate(chosen)}


def test_near_duplicates_inside_a_template_family(spark):
    texts = family(60, 300)
    want = brute.groups(texts)
    assert sum(c != i for i, (_, c) in want.items()) == 60
    # one row a band crowds the buckets of this small family as a family of many thousands crowds those of five
    assert near_rows(spark, texts, rows=1) == want


def test_near_duplicates_of_odd_rows(spark):
    rows = minhash.near_duplicates(table(spark, ODD)).collect()
    assert len(rows) == len(ODD) and [r["kept"] for r in rows if r["doc_id"] == 5] == [True, True]
    assert [(r["component_id"], r["kept"]) for r in rows if r["doc_id"] is None] == [(None, False)]
    assert minhash.near_duplicates(table(spark, ODD).limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)] + [(200, 200 + i) for i in range(30)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}


def test_an_append_adds_one_file_to_a_bucket(spark, tmp_path):
    made = lambda lo, hi: spark.range(lo, hi, numPartitions=5).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    index = exact.DigestIndex(spark, f"file://{tmp_path}/index", buckets=6)
    for k, (lo, hi) in enumerate([(0, 300), (200, 500)], 1):
        index.add(made(lo, hi))
        files = Counter(f.name.split("_")[-1].split(".")[0] for f in (tmp_path / "index").glob("*.parquet"))
        assert len(files) == 6 and set(files.values()) == {k}
    assert sorted(r["keep_id"] for r in index.table().collect()) == list(range(500))
    assert index.table().filter(F.col("digest") == F.unhex(F.sha2(F.lit("7"), 256))).first()["keep_id"] == 7, "a bucket that is pruned to holds its rows"
    assert [exact.buckets_for(n) for n in (0, 1, 10**6, 10**8, 10**10, 10**13)] == [64, 64, 64, 128, 16384, 65536]


# 7


def test_counts_and_base_scores(spark, sf):
    import math

    texts = texts_of(read(spark, sf))
    words = {i: [*brute.WORD.findall((t or "").translate(brute.LOW)), "\0"] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    c = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in queries.op7_lm_scoring(spark, sf).collect()}
    for i, ws in words.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel=1e-9)


def test_scores_match_a_plain_network(spark, monkeypatch):
    """Every score again: words by a pattern, counts by a Counter, the network unit by unit, words outside the list by their count."""
    import math

    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("The the cat Dog é 漢 runs far a b c d e f g h".split()) for _ in range(rng.randrange(90)))) for i in range(30)]
    rows += [(30, None), (31, "never met " * 3), (32, "cat " * 200)]
    train, made = rows[:25], []

    def fit(docs, vocab, model, *a, **k):
        noise = np.random.default_rng(1).normal(0, 0.4, len(model.vector()))
        made.append((vocab, model.with_vector(model.vector() + noise)))
        return made[0][1]

    monkeypatch.setattr(lm, "fit", fit)
    got = as_dict(lm.scores(table(spark, rows), table(spark, train), listed=9, frequent=12, hidden=3, per_class=4), "n_tokens", "score")
    vocab, model = made[0]
    words = {i: [*brute.WORD.findall((t or "").translate(brute.LOW)), "\0"] for i, t in rows}
    c = Counter(w for i, _ in train for w in words[i])
    place = {w: int(vocab.look_up(lm.tokens([w.encode() if w != "\0" else b""])[0][:1])[1][0]) for w in c}
    listed = [w for w in c if place[w] < 9]
    assert len(listed) == 9 and min(c[w] for w in listed if w != "\0") >= max(n for w, n in c.items() if place[w] == 9)
    outside = sum(c.values()) - sum(c[w] for w in listed) + 0.5 * (len(c) - 9) + 0.5
    for i, ws in words.items():
        ids = [place.get(w, 9) for w in ws]
        want = sum(brute.gru_log_probs(model, ids)) / math.log(10) + sum(math.log10((c[w] + 0.5) / outside) for w, k in zip(ws, ids, strict=True) if k == 9)
        assert got[i] == (len(ws), pytest.approx(want, rel=2e-5, abs=1e-4))


def test_gradients_match_differences():
    """The gradient of a window, over a document's border, against differences of the plain network's loss."""
    rng = np.random.default_rng(2)
    model = gru.Gru.start(np.array([9, 7, 5, 3, 2]), 4.0, 3, 3)
    model = model.with_vector(np.where(model.vector() < -100, -3, model.vector()) + rng.normal(0, 0.5, len(model.vector())))
    parts = [[0, 5, 2, 1], [4, 3, 3]]
    fresh = np.zeros((1, 7), bool)
    fresh[0, [0, 4]] = True
    g, rows, _ = model.gradients(np.zeros((3, 1), np.float32), np.array([sum(parts, [])], np.int32), fresh, np.ones((1, 7), bool))
    loss = lambda: -sum(sum(brute.gru_log_probs(model, p)) for p in parts) / 7
    for a in model.names:
        v = getattr(model, a)
        setattr(model, a, v := v.astype(np.float64))
        full = np.zeros(v.shape)
        full[rows if a == "x" else slice(None)] = g[a]
        for i in np.ndindex(v.shape):
            v[i] += 1e-5
            up = loss()
            v[i] -= 2e-5
            assert full[i] == pytest.approx((up - loss()) / 2e-5, abs=2e-5), (a, i)
            v[i] += 1e-5


def test_rare_words_are_joined_whatever_the_broadcast(spark, sf):
    docs = read(spark, sf)
    few = as_dict(lm.scores(docs, docs, listed=64, frequent=128, hidden=4, per_class=8), "n_known", "base_score", "score")
    many = as_dict(lm.scores(docs, docs, listed=64, frequent=10**6, hidden=4, per_class=8), "n_known", "base_score", "score")
    for i, a in few.items():
        assert a == pytest.approx(many[i], rel=1e-9)


def test_every_training_document_is_read_and_learned_once(spark, monkeypatch, tmp_path):
    @F.udf("string")
    def noted(i, text):
        with open(tmp_path / str(os.getpid()), "a") as f:
            f.write(f"{i}\n")
        return text

    rows = table(spark, [(i, f"a b c{i}") for i in range(400)])
    vocab, counts = lm.vocabulary(lm.word_counts(rows, "text"), 64, 8)
    docs = rows.withColumn("text", noted("doc_id", "text"))
    lm.fit(docs, vocab, gru.Gru.start(counts, 1.0, 4, 8), "doc_id", "text", fraction=0.3, docs_per_shard=50)
    assert sorted(int(x) for f in tmp_path.iterdir() for x in f.read_text().split()) == list(range(400))
    learned = []
    monkeypatch.setattr(gru, "_judged", lambda model, used, *rest: learned.extend(used) or model)
    gru.train(None, list(range(35)))
    assert sorted(learned) == list(range(35))


def test_lm_of_odd_rows(spark, sf):
    rows = lm.scores(table(spark, ODD), read(spark, sf), listed=64, hidden=4, per_class=8).collect()
    assert len(rows) == len(ODD) and {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3, 6)} == {1}
    assert all(np.isfinite(r["score"]) for r in rows)
    assert all(r["n_known"] == 0 and np.isfinite(r["score"]) for r in lm.scores(table(spark, ODD), table(spark, ODD).limit(0), listed=64, hidden=4).collect())


def test_gru_is_a_distribution_and_learns():
    rng = np.random.default_rng(0)
    model = gru.Gru.start(np.sort(rng.integers(1, 99, 40))[::-1], 30.0, 8, 8)
    h = rng.normal(size=(41, 8)).astype(np.float32)
    h[:] = h[0]
    for a in ("c", "w"):
        setattr(model, a, rng.normal(0, 0.3, getattr(model, a).shape).astype(np.float32))
    assert np.exp(model.log_prob(h, np.arange(41))).sum() == pytest.approx(1, rel=1e-5)
    docs = [np.tile(np.arange(i % 3, i % 3 + 5), 40) for i in range(60)]
    start = gru.Gru.start(np.bincount(np.concatenate(docs), minlength=8)[:7], 0.5, 8, 4)
    taught = start
    for _ in range(25):
        taught = gru.train(taught, docs)
    assert gru.score(taught, docs).sum() > 0.5 * gru.score(start, docs).sum()
    one = gru.score(model, [docs[0]])[0]
    assert gru.score(model, docs, window=7)[0] == pytest.approx(one, rel=1e-4)


# 8


def test_mixture_meets_its_targets(spark, sf):
    rows = mixing.mix_sources(read(spark, sf), rows_per_range=40).collect()
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix_sources(read(spark, sf).repartition(7), rows_per_range=1000).collect()}
    assert {(r["doc_id"], r["taken"]) for r in rows} == again
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
        assert 0 <= r["taken"] <= 2 * r["size"]
    for v in by.values():
        assert sum(r["taken"] for r in v) == int(v[0]["target"]) and sum(r["size"] for r in v) == v[0]["source_size"]
    total = sum(r["size"] for r in rows)
    assert sum(v[0]["target"] for v in by.values()) == pytest.approx(1.5 * total)


def test_targets_reshare_the_excess(spark):
    sizes = {"a": 10, "b": 1000, "c": 400, "d": 0, None: 90}
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    order = ["a", "b", "c", "d", None]
    w = dict(zip(order, (3, 1, 2, 3, 1), strict=True))
    want, free, left = {}, set(order), 1.5 * 1500
    while True:
        t = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        full = {s for s in free if t[s] > 2 * sizes[s]}
        if not full:
            break
        want |= {s: 2 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        free -= full
    assert got == pytest.approx(want | t)


def test_mixing_of_odd_rows(spark):
    rows = mixing.mix_sources(table(spark, ODD)).collect()
    assert len(rows) == len(ODD) and sum(r["taken"] for r in rows) > 0
    none = mixing.mix_sources(table(spark, [(1, None), (2, "")])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in none] == [(0, 0, 0)] * 2
    assert mixing.mix_sources(table(spark, ODD).limit(0)).count() == 0


# 9


def test_contamination_matches_brute_force(spark, sf):
    docs, bench = read(spark, sf), read(spark, sf, "benchmark")
    got = as_dict(queries.op9_decontamination(spark, sf), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = brute.contaminated(texts_of(docs), [(r["item_id"], r["text"]) for r in bench.collect()])
    assert got == want and any(v[4] for v in want.values())


def test_automaton_with_short_and_overlapping_items(spark):
    rng = random.Random(8)
    items = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))) for i in range(25)] + [(99, None), (3, "c c c c c c")]
    texts = {i: " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 40))) for i in range(60)}
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (10**6, 20):  # one automaton, and several
        got = as_dict(decontaminate.contamination(table(spark, texts.items()), bench, window=5, most_words=most), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
        assert got == brute.contaminated(texts, items, 5)


def test_many_automata_find_what_one_finds(spark, sf):
    docs, bench = read(spark, sf), read(spark, sf, "benchmark")
    odd = spark.createDataFrame([(None, "one"), (None, "lead"), (7, None), (8, "ünï códe")], "item_id long, text string")
    docs, bench = docs.unionByName(table(spark, ODD), allowMissingColumns=True), bench.unionByName(odd)
    rows = lambda most: Counter(tuple(r) for r in decontaminate.contamination(docs, bench, most_words=most, keep_text=True).collect())
    assert decontaminate.shard_count(bench, "text", 300) > 3
    assert rows(10**6) == rows(300)


def test_items_without_an_id_hit(spark):
    bench = spark.createDataFrame([(None, "alpha beta gamma"), (7, "delta")], "item_id long, text string")
    rows = table(spark, [(1, "say alpha beta gamma delta"), (2, "alpha beta")])
    got = as_dict(decontaminate.contamination(rows, bench), "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == {1: (4, 2, brute.sha(b"7"), True), 2: (0, 0, brute.sha(b""), False)}


def test_hit_spans_leave_the_text(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    rows = {r["doc_id"]: r for r in decontaminate.contamination(table(spark, [*ODD, (30, "Say: ALPHA, beta--gamma! ok")]), bench, keep_text=True).collect()}
    assert rows[30]["clean_text"] == "Say: ! ok" and rows[30]["n_hit"] == 3 and not rows[1]["contaminated"]
    assert decontaminate.contamination(table(spark, ODD), bench.limit(0)).filter("n_hit > 0").count() == 0


# 10

PAGE = "<html><head><title>t{i}</title><script>x='<p>no'</script></head><body><div class='top-menu'><a href=/a>home {i}</a></div><div id=box><ul><li><a href=x>link {i} one</a><li><a href=y>link two {i}</a></ul></div><p>All rights reserved by the site.</p><div class='story'><h1>Head {i}</h1><p>Body of <b>page</b> {i} &amp; more.<br>Second line<p>Next para {i}</div><form><p>Sign up {i}</form><div class=\"user-comments\"><p>nice {i}</div></body></html>"


def test_template_text_and_menus_go(spark):
    pages = spark.createDataFrame([(i, f"http://h.example/{i}", PAGE.replace("{i}", str(i)), 1) for i in range(6)] + [(6, "http://h.example/6", None, 1), (7, None, "<p>a<p>b", 1)], "page_id long, url string, html string, host int")
    for limit in (1 << 20, 0):  # by broadcast, and by join
        got = {r["page_id"]: (r["text"], r["n_chars"]) for r in htmltext.main_text(pages, broadcast_bytes=limit).collect()}
        for i in range(6):
            text = f"Head {i} Body of page {i} & more. Second line Next para {i}"
            assert got[i] == (text, len(text))
        assert got[6] == ("", 0) and got[7] == ("a b", 3)
    assert htmltext.main_text(pages.limit(0)).count() == 0


def test_articles_of_the_tables_are_whole(spark, sf):
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in read(spark, sf, "pages").collect()}
    for r in queries.op10_html_extraction(spark, sf).collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]], re.S)
        assert r["text"] == " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)>", " ", inner[1]))).split())


def test_copies_of_an_article_are_no_template(spark):
    body = "<html><body><nav>menu {n}</nav><div><p>The one article of {i}.</p><p>Its end {i}.</p></div></body></html>"
    rows = [(k, f"http://c.example/a?utm={k}", body.replace("{i}", "a").replace("{n}", str(k % 2)), 1) for k in range(7)]
    rows += [(10 + k, f"http://c.example/{k}", body.replace("{i}", f"b{k}"), 1) for k in range(3)]
    got = {r["page_id"]: r["text"] for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, host int")).collect()}
    assert got == {k: "The one article of a. Its end a." for k in range(7)} | {10 + k: f"The one article of b{k}. Its end b{k}." for k in range(3)}


def test_names_alone_do_not_drop_an_article():
    story = "<h1>Head</h1><p>A first paragraph of some length.</p><p>And a second one.</p>"
    text = "Head A first paragraph of some length. And a second one."
    for wrapper in ("<div class='layout with-sidebar'>", "<div class=no-sidebar>", "<div class=search-results>", "<div id=header-and-content>", "<div class=sidebar>", "<form>"):
        end = "</form>" if wrapper == "<form>" else "</div>"
        assert htmltext.article(f"{wrapper}<article>{story}</article>{end}", set()) == text, wrapper
        assert htmltext.article(f"{wrapper}{story}{end}<p class=ad>buy", set()) == text, wrapper
    assert htmltext.article(f"<div>{story}</div><div class='sidebar-left'>x</div><div class=userComments>y</div>", set()) == text
    assert htmltext.article(f"<article>{story}</article><div class=comments><article>{story}</article></div>", set()) == text


def test_deep_and_open_markup_costs_its_size():
    import time
    import tracemalloc

    tracemalloc.start()
    assert htmltext.article("<div class=share>" * 50_000 + "deep" + "</div>" * 50_000, set()) == "deep"
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
    began = time.time()
    htmltext.article('<a b="' * 40_000 + "'x", set())
    htmltext.article("<a '" * 40_001, set())
    assert time.time() - began < 5


def test_heading_of_an_article_is_its_own():
    assert htmltext.article("<header>Site</header><article><header><h1>Head</h1></header><p>Text of it.</p><footer>by me</footer></article>", set()) == "Head Text of it."


def test_banner_without_a_telling_name_goes_by_its_class(spark):
    page = "<body><div class=x1><p>We use cookies, dear reader.</p></div><div class=x2><p>Story {i} begins here.</p><p>And ends {i}.</p></div><div class=x3>Call us at 5550 today</div></body>"
    rows = [(i, f"http://b.example/{i}", page.replace("{i}", f"n{i}")) for i in range(8)]
    got = {r["page_id"]: r["text"] for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story n{i} begins here. And ends n{i}." for i in range(8)}


def test_broken_markup():
    assert htmltext.article("a < b <p title=\"x>y\">c</p <i>d</i> <!-- e", set()) is not None
    for s in ("<", "</", "<a href='", "<script>", "<p" * 50, "<!doctype", "&#x110000; &bogus;", "</p></p>"):
        htmltext.article(s, set())


# all


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = read(spark, sf)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns, name
        kept, before = texts_of(after), texts_of(docs)
        if name == "exact_dedup":
            assert kept == {i: t for i, t in before.items() if i == max(k for k, v in before.items() if v == t)}
        if name == "near_dedup":
            assert set(kept) == {i for i, (_, c) in brute.groups(before).items() if c == i}
        if name == "decontamination":
            bench = [(r["item_id"], r["text"]) for r in read(spark, sf, "benchmark").collect()]
            assert set(kept) == {i for i, v in brute.contaminated(before, bench).items() if not v[4]}
        docs = spark.createDataFrame(after.collect(), after.schema)
    assert corpus_pipeline.run(spark, sf).agg(F.count("doc_id")).first()[0] == docs.count()


def test_stages_leave_one_of_repeated_rows_and_take_empty_tables(spark, sf):
    import corpus_pipeline as pipe

    words = "aa bb cc dd ee ff gg hh ii jj kk ll mm nn oo pp qq rr ss tt uu vv ww xx yy zz"
    rows = [(1, words, "en", "s", 1), (1, words, "en", "s", 1), (2, words, "en", "s", 1), (2, words[:40], "en", "s", 1), (None, None, "en", "s", 1), (3, "", "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    kept = sorted(((r["doc_id"], r["text"]) for r in pipe.exact_copies(spark, docs, sf).collect()), key=str)
    assert kept == sorted([(2, words), (2, words[:40]), (3, "")], key=str)
    assert pipe.near_copies(spark, docs.dropDuplicates(), sf).filter("doc_id = 1").count() == 1
    for _, stage in pipe.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
    for _, stage in pipe.STAGES[1:]:
        assert stage(spark, docs, sf).count() > 0


def test_pipeline_keeps_clean_rows_without_an_id(spark, sf):
    import corpus_pipeline

    rows = table(spark, [(5, "one two three"), (None, "one two three"), (None, "four five six seven"), (6, "eight nine")])
    for _, stage in corpus_pipeline.STAGES[1:4]:
        got = sorted((r["doc_id"] or 0, r["text"]) for r in stage(spark, rows, sf).collect())
        assert [x for x in got if x[1] != "one two three"] == [(0, "four five six seven"), (6, "eight nine")]
        assert (5, "one two three") in got


def test_every_label_can_be_predicted(spark, monkeypatch):
    rows = table(spark, [(i, f"text {i}") for i in range(300)]).withColumn("lang", F.concat(F.lit("l"), F.col("doc_id").cast("string")))
    assert len(langid.fit(rows).langs) == 300
    monkeypatch.setattr(langid, "MOST_LABELS", 299)
    with pytest.raises(ValueError):
        langid.fit(rows)


def test_queries_and_oracles_have_the_same_names(spark):
    from equiscope.llm import oracles

    assert set(oracles.oracle_sql()) <= set(queries.queries())
