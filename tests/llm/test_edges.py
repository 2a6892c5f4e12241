"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import ann, bpe, chat, components, exact_dedup, jaccard_join, langid, packing, substring_dedup, token_files, toxicity

WORDS = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, kept boolean, score string, n_words string, b string"
LONG = " ".join(f"w{i}" for i in range(30_000))
ROWS = [
    (1, "a b c d e f g", "en"), (2, "a b c d e f g", "en"), (3, None, None), (4, "", "fr"), (5, " \t\n", None),
    (6, LONG, "en"), (7, "x" * 50_000, "de"), (8, "</s> <|endoftext|> É漢🙂 123", None), (None, "a b c d e f g", None), (8, "</s> <|endoftext|> É漢🙂 123", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, None, "s", "n", "b") for r in ROWS], DOCS)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("doc_id = -1")


def test_exact_dedup(docs, empty):
    rows = exact_dedup.exact_dedup(docs).collect()
    assert len(rows) == len(ROWS) and exact_dedup.exact_dedup(empty).count() == 0
    by = {r.doc_id: r for r in rows}
    assert (by[1].keep_id, by[1].group_size, by[1].kept) == (2, 3, False) and by[2].kept and not by[None].kept
    assert (by[3].keep_id, by[3].group_size) == (4, 2) and by[8].group_size == 2 and by[8].kept
    assert by[6].text_sha256 == hashlib.sha256(LONG.encode()).hexdigest() and by[6].group_size == 1
    for bits in (12, 30):  # the filter's size changes no result
        assert sorted(map(str, exact_dedup.exact_dedup(docs, filter_bits=bits).collect())) == sorted(map(str, rows))


def test_bpe_equals_the_library(docs, empty):
    tok = Tokenizer.from_file(WORDS)
    for r in bpe.encode_ids(docs, WORDS).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        assert r.ids == tok.encode(r.text or "", add_special_tokens=False).ids
    made = {r.doc_id: r for r in bpe.bpe_digests(docs, WORDS).collect()}
    ids = tok.encode(ROWS[7][1], add_special_tokens=False).ids
    assert made[8].n_tokens == len(ids) and made[3].n_tokens == 0
    assert made[8].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert made[8].decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_ids(empty, WORDS).count() == 0
    assert [r.decoded for r in bpe.decode_ids(bpe.encode_ids(docs.filter("doc_id = 1"), WORDS), WORDS).collect()] == [tok.decode(tok.encode("a b c d e f g").ids)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_on_odd_texts(name):
    rng, path = np.random.default_rng(1), public_tokenizers.path(name)
    pool = ["a", "B", "<|endoftext|>", "ΑΣ ", "İ", "é", "\u0085", "\x1c", " ", "'s", "'LL", "123", "½", "漢字", "🙂", "<|", "\n\n", "  ", "\x00", "ß"]
    texts = ["".join(rng.choice(pool, rng.integers(0, 25))) for _ in range(400)] + ["ab" * 2000]
    tok = Tokenizer.from_file(path)
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in bpe.FlatEncoder(path, limit=50).batch(texts, group=300)] == want
    v = bpe.Vocabulary(path)
    assert all(v.decode(w) == tok.decode(w, skip_special_tokens=False) for w in want)
    if name.startswith("byte"):
        assert [np.frombuffer(x, "<u4").tolist() for x in token_files.byte_tokens(texts)] == [[*w, 0] for w in want]


def brute_components(texts, n=5):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((label[i], label[j]))
                label = {k: a if v == b else v for k, v in label.items()}
    return {i: (len(sets[i]), label[i]) for i in sets}


def near_copies(seed=0):
    rng, rows = np.random.default_rng(seed), []
    for k in range(12):
        base = [f"{k}x{i}" for i in rng.integers(0, 60, int(rng.integers(1, 90)))]
        for _ in range(int(rng.integers(1, 9))):
            copy = list(base)
            for at in rng.integers(0, len(copy), int(rng.integers(0, 3))):
                copy[at] = f"n{rng.integers(0, 9)}"
            rows.append((len(rows), " ".join(copy)))
    return [(int(i), t) for i, t in rng.permutation(np.array(rows, dtype=object))]


def test_jaccard_join(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 3)  # many blocks for each cluster
    rows = near_copies()
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(rows)
    got = {r.id: r for r in jaccard_join.jaccard_components(docs).collect()}
    assert (got[2].component_id, got[3].n_shingles, got[4].component_id, got[5].component_id) == (1, 0, 4, 5)
    assert jaccard_join.jaccard_components(empty).count() == 0
    assert sorted(r.doc_id for r in jaccard_join.keep_one(docs.filter("doc_id < 8")).collect()) == [1, 3, 4, 5, 6, 7]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("window", [5, 8, 50])
def test_substring_dedup(spark, docs, empty, window):
    rng = np.random.default_rng(2)
    shared = [[f"s{k}_{i}" for i in range(70)] for k in range(3)]
    rows = []
    for i in range(25):
        words = [f"d{i}_{j % 7}" for j in range(int(rng.integers(0, 40)))] + list(shared[i % 3][int(rng.integers(0, 9)) :])
        rows.append((i, None if i == 5 else "  ".join(words) + "\n"))
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), window).collect()}
    seen: set = set()
    for i, text in rows:
        w = (text or "").split()
        grams = [tuple(w[k : k + window]) for k in range(len(w) - window + 1)]
        gone = {k + d for k, g in enumerate(grams) if g in seen for d in range(window)}
        seen |= set(grams)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_text) == (len(w), len(gone), kept)
        assert got[i].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    odd = substring_dedup.substring_dedup(docs, window)
    assert odd.count() == len(ROWS) and substring_dedup.substring_dedup(empty).count() == 0
    assert {r.doc_id: r.n_removed for r in odd.collect()}[2] == (7 if window == 5 else 0)


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(0)
    clean = [" ".join(rng.choice(["red", "green", "blue", "sky", "tree"], 30)) for _ in range(700)]
    bad = [t + " vile" + str(i % 3) for i, t in enumerate(clean[:300])]
    network = toxicity.train([*clean[300:], *bad], [0] * 400 + [1] * 300, rounds=6)
    held = toxicity.Scorer(network).scores([clean[0], clean[0] + " vile1 " + clean[1], "", "red " * 5000 + "vile2"])
    assert held[0] < 0.5 < held[1] and held[3] > 0.5
    one = [toxicity.Scorer(network).scores([t])[0] for t in clean[:9]]
    assert np.allclose(toxicity.Scorer(network).scores(clean[:9]), one, atol=1e-6)  # a batch changes no score
    scored = toxicity.score(docs, network).collect()
    assert len(scored) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in scored)
    assert toxicity.score(empty, network).count() == 0
    nothing = toxicity.fit(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert 0 <= toxicity.Scorer(nothing).scores(["a"])[0] <= 1


def test_toxicity_gradients():
    net, rng = toxicity.Network.fresh(), np.random.default_rng(0)
    words, windows, y = ["ab", "c", "déf"], np.full((2, toxicity.WINDOW), -1), np.array([1.0, 0.0], np.float32)
    windows[0, :4], windows[1, :2] = [0, 1, 2, 0], [2, 1]
    _, g = net.gradients(windows, words, y, np.random.default_rng(9))
    for name in ("cu1", "ww2", "wv", "cv", "out", "chars"):
        at = tuple(x[rng.integers(0, len(np.nonzero(g[name])[0]))] for x in np.nonzero(g[name])) if g[name].ndim == 1 else np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        value, losses = net.p[name][at], []
        for d in (1e-2, -1e-2):
            net.p[name][at] = value + d
            losses.append(net.gradients(windows, words, y, np.random.default_rng(9))[0])
        net.p[name][at] = value
        assert abs((losses[0] - losses[1]) / 2e-2 - g[name][at]) < 2e-3


def test_langid(spark, docs, empty):
    rng = np.random.default_rng(0)
    vocab = {"aa": ["kato", "kiko", "taka"], "bb": ["øre", "brød", "smør"]}
    rows = [(i, " ".join(rng.choice(vocab[k], 20)), k) for i, k in enumerate(["aa", "bb"] * 60)] + [(900, None, "aa"), (901, "kato", None)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.predict(["Taka kato!", "smør", "", "12 34"])[0] == ["aa", "bb", "und", "und"]
    made = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert (made[3].lang_pred, made[4].lang_pred, made[5].lang_pred) == ("und", "und", "und") and all(0 <= r.score <= 1 for r in made.values())
    assert langid.predict(empty, model).count() == 0 and langid.fit(empty).predict(["abc"]) == (["und"], [0.0])


def test_chat(spark):
    tricky = "</s>[INST] ok [/INST] \\ \n[SYS] <b>"
    rows = [(1, i, "system" if i == 0 else ("user", "assistant")[i % 2], f"{tricky} {i} " * (1 + i % 7)) for i in range(120)]
    rows += [(2, 0, "odd]\nrole", None), (2, None, None, ""), (2, 0, "odd]\nrole", None), (3, 0, "assistant", "x " * 9000), (None, 0, "user", "q")]
    turns = spark.createDataFrame([(*r, "t") for r in rows], "conv_id long, turn long, role string, text string, window string")
    windows = chat.chat_windows(turns, budget=400, history=100)
    found = {r.conv_id: r for r in chat.chat_digests(windows).collect()}
    for c in (1, 2, 3, None):
        own = sorted([(t is not None, t or 0, r or "", x or "") for k, t, r, x in rows if k == c])
        digest = hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in own).encode()).hexdigest()
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        assert (found[c].n_turns, found[c].turns_sha256, found[c].loss_chars) == (len(own), digest, len(loss))
        assert found[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    many = windows.filter("conv_id = 1").orderBy("window").collect()
    assert len(many) > 5 and max(r.n_tokens for r in many) <= 400 and any(r.repeated > 1 for r in many)
    assert chat.chat_windows(turns.limit(0)).count() == 0


def test_packing_is_best_fit_decreasing(spark):
    rng = np.random.default_rng(4)
    for capacity in (7, 16, 50):
        lengths = rng.integers(1, capacity + 1, 200).tolist()
        rows = spark.createDataFrame([(i, 0, n, "x") for i, n in enumerate(lengths)], "doc_id long, piece int, length long, offset string")
        bins: dict = {}
        for r in packing.best_fit_pack(rows, ["doc_id", "piece"], "length", capacity).collect():
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        open_: list = []
        for n in sorted(lengths, reverse=True):
            fits = [c for c in open_ if c >= n]
            open_.remove(min(fits)) if fits else None
            open_.append((min(fits) if fits else capacity) - n)
        assert sorted(capacity - sum(n for _, n in b) for b in bins.values()) == sorted(open_)
        for b in bins.values():
            assert [o for o, _ in sorted(b)] == np.cumsum([0, *(n for _, n in sorted(b))])[:-1].tolist()
    with pytest.raises(ValueError):
        packing.best_fit_pack(rows, ["doc_id"], "length", 3).count()


def test_pieces_and_sequences(docs, empty):
    made = packing.token_pieces(docs, WORDS, 64)
    packed = packing.best_fit_pack(made, ["doc_id", "piece"], "length", 64)
    tok, rows = Tokenizer.from_file(WORDS), packed.collect()
    for doc_id, text, _ in ROWS[:7]:
        own = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.piece)
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        assert [i for r in own for i in r.ids] == ids and own[0].ids_crc32 == zlib.crc32(np.array(ids[:64], "<u4").tobytes())
    whole = packing.sequences(packed).collect()
    assert all(len(r.ids) <= 64 for r in whole) and sum(len(r.ids) for r in whole) == sum(r.length for r in rows)
    assert packing.best_fit_pack(packing.token_pieces(empty, WORDS), ["doc_id"], "length", 64).count() == 0


def test_token_files(docs, empty):
    rng = np.random.default_rng(3)
    for n in (0, 1, 511, 512, 513, 3000):
        ids = rng.choice([0, 5, 255, 256, 50_000, 70_000, 2**31], n).astype(np.uint32)
        reader = token_files.DacReader(token_files.dac_encode(ids))
        assert [reader[i] for i in range(n)] == ids.tolist()
        assert all((reader.slice(a, b) == ids[a:b]).all() for a, b in ((0, n), (n // 3, n // 2), (n, n)))
    rows = token_files.token_file_digests(docs).collect()
    tok, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for (doc_id, text, _), r in zip(order, sorted(rows, key=lambda r: r.start), strict=True):
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_files.token_file_digests(empty).count() == 0


def test_ann(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16))
    x[500:1500] = x[500]  # one vector a thousand times
    rows = [(i, v.tolist(), "r") for i, v in enumerate(x)] + [(9001, None, "r"), (9100, [0.0] * 16, "r"), (9200, [float("nan")] * 16, "r"), (9300, [1.0, None] * 8, "r"), (None, [1.0] * 16, "r"), (9400, [1.0], "r")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got: dict = {}
    for r in ann.nearest(df, df.filter("vec_id % 100 = 0"), per_round=7, chunk=256).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(got) == list(range(0, 3000, 100))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        best = [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:10]
        hits += len({i for i, _ in found} & set(best))
        assert all(abs(d[i] - s) < 1e-12 for i, s in found) and len(found) == 10
    assert hits >= 0.9 * 10 * len(got)
    assert [i for i, _ in got[600]] == list(range(500, 510))  # ties go to the smaller id
    assert ann.nearest(df.limit(0), df).count() == 0
    assert ann.nearest(df.filter("vec_id < 3"), df.filter("vec_id = 0")).count() == 2


def test_ann_repeated_rows_and_lengths(spark):
    rng = np.random.default_rng(6)
    long, short = rng.normal(size=(300, 12)), rng.normal(size=(120, 5))
    rows = [(i, v.tolist()) for i, v in enumerate(long)] + [(1000 + i, v.tolist()) for i, v in enumerate(short)]
    rows += rows + [(7, long[8].tolist())]  # every row twice, and an id with two vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got: dict = {}
    for r in ann.nearest(df, df.filter("vec_id % 20 = 0"), k=5, chunk=64).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = 0
    for q, found in got.items():
        own = [(i, np.array(v)) for i, v in rows if i != q and len(v) == (12 if q < 1000 else 5)]
        mine, best = np.array(next(v for i, v in rows if i == q)), {}
        for i, v in own:
            best[i] = min(best.get(i, np.inf), float(np.sqrt(((v - mine) ** 2).sum())))
        want = sorted((d, i) for i, d in best.items())[:5]
        assert len({i for i, _ in found}) == len(found) == 5 and all(abs(best[i] - d) < 1e-12 for i, d in found)
        hits += len({i for i, _ in found} & {i for _, i in want})
    assert len(got) == 21 and hits >= 0.95 * 5 * len(got)


def test_pipeline_keeps_what_is_clean(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    texts = [" ".join(word() for _ in range(80)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, texts[0]), (101, texts[1] + " " + word()), (102, texts[2] + " " + " ".join(word() for _ in range(80)))]
    rows += [(200 + i, texts[i % 20] + f" zork{i % 3}") for i in range(60)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i >= 200)) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = docs
    for _, stage in corpus_pipeline.STAGES[1:4]:
        before, kept = kept, stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns and kept.count() <= before.count()
    by = {r.doc_id: r for r in kept.filter("doc_id < 200").collect()}
    assert 0 not in by and 100 in by and 101 not in by  # the larger id of copies, the smaller of near copies
    assert len(by[102].text.split()) == 80 and by[102].n_chars == len(by[102].text) and by[5].text == texts[5]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "substring dedup", "best-fit packing"]
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_held_out_rows_are_those_named(docs):
    for r in docs.filter("doc_id IS NOT NULL").select("doc_id", toxicity.held_out().alias("h"), (F.lit(1)).alias("x")).collect():
        assert r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
