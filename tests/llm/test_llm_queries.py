"""Every registered training-data query over small odd tables, against plain versions of what it must give."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from lodestone.llm import jaccard_join, langid, toxicity
from lodestone.llm.common import table

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string, window string",
    "embeddings": "vec_id long, label int, embedding array<float>, rank string",
}
RNG = np.random.default_rng(8)
WORDS = {"aa": ["kato", "kiko", "taka", "mola", "sinu"], "bb": ["øre", "brød", "smør", "fløde", "kål"]}
LONG = " ".join(f"w{i}" for i in range(9000))


def documents():
    said = lambda lang, n: " ".join(RNG.choice(WORDS[lang], n)) + " " + " ".join(f"{lang}{x}" for x in RNG.integers(0, 10**6, 3))
    rows = [(i, said("ab"[i % 2] * 2, 70), "ab"[i % 2] * 2) for i in range(90)]
    rows += [(1000 + i, said("aa", 20) + " vile nasty foul " * 2 + said("aa", 9), "aa") for i in range(260)]
    passage = " ".join(f"shared{i}" for i in range(80))
    rows += [(200 + i, f"own{i} " * 5 + passage + f" end{i}" * 30, "aa") for i in range(6)]
    rows += [(300, rows[0][1], "aa"), (301, rows[1][1] + " more", "bb"), (302, rows[1][1].upper(), None), (303, LONG, None), (304, LONG + " x", None)]
    rows += [(400, None, None), (401, "", "aa"), (402, " \t\n", None), (403, "12 34", "bb"), (404, "</s> <|endoftext|> É漢🙂", None)]
    rows += [(None, rows[0][1], "aa"), (None, None, None), (404, "</s> <|endoftext|> É漢🙂", None), (5, rows[5][1], "bb")]
    return [(i, t, lang, "s", None if t is None else len(t), None, "x") for i, t, lang in rows]


def conversations():
    rows = [(c, t, "system" if not t and c % 2 else ("user", "assistant")[t % 2], f"turn {t} of {c} " * int(RNG.integers(1, 40))) for c in range(1, 7) for t in range(12)]
    rows += [(8, 0, "user", "u " * 1000), (8, 1, "assistant", "a " * 1500), (8, 2, "user", "u " * 10), (9, 0, "system", "s " * 2040)]
    rows += [(9, k, ("assistant", "user")[k % 2], "short") for k in range(1, 30)]
    return [(*r, "w") for r in [*rows, (None, 0, None, None), (3, None, "user", "late"), (3, 5, "assistant", "again"), (3, 5, "assistant", "again")]]


def embeddings():
    x = RNG.normal(size=(260, 8)).astype(np.float32)
    x[120:140] = x[120]
    rows = [(i, 0, v.tolist(), "r") for i, v in enumerate(x)]
    return [*rows, rows[100], (900, 0, [1.0] * 5, "r"), (901, 0, [0.5] * 5, "r"), (1000, 0, None, "r"), (1001, 0, [0.0] * 8, "r"), (1100, 0, [float("nan")] * 8, "r"), (None, 0, [1.0] * 8, "r")]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    docs = documents()
    rows = {"documents": docs, "labels": [(d[0], 1, None if d[0] == 3 else int("vile" in (d[1] or ""))) for d in docs if d[0] is not None], "conversations": conversations(), "embeddings": embeddings()}
    for name, schema in SCHEMAS.items():
        spark.createDataFrame(rows[name], schema).repartition(3).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(f"{path}/{name}.parquet")
    return path


def run(spark, name, path):
    return __spark_entry__.queries()[name](spark, path).collect()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark, odd):
    return [(r.doc_id, r.text, r.lang) for r in table(spark, odd, "documents").collect()]


OPS = [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)]


@pytest.mark.parametrize("name", [*OPS, "pipeline"])
def test_empty_tables(spark, empty, name):
    assert len(run(spark, name, empty)) == (1 if name == "op7_chat" else 0)


def test_op1(spark, odd, docs):
    want = []
    for i, t, _ in docs:
        group = [j for j, x, _ in docs if (x or "") == (t or "")]
        keep = max((j for j in group if j is not None), default=None)
        want.append((i, keep, len(group), i == keep, sha(t or "")))
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in run(spark, "op1_exact_dedup", odd)]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_op2(spark, odd, docs):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t, _ in docs:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run(spark, "op2_bpe", odd)]
    assert sorted(map(str, got)) == sorted(map(str, want))


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def components(rows):
    """The smallest id that each row is linked with; rows without id are linked with nothing."""
    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            linked = both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both)
            if None not in (rows[a][0], rows[b][0]) and (linked or rows[a][0] == rows[b][0] and sets[a] == sets[b] != set()):
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    least = {x: min(rows[k][0] for k in range(len(rows)) if label[k] == x) for k, x in enumerate(label) if rows[k][0] is not None}
    return [(i, len(s), least.get(x)) for (i, _), s, x in zip(rows, sets, label, strict=True)]


def test_op3(spark, odd, docs):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in run(spark, "op3_jaccard_join", odd)]
    assert sorted(map(str, got)) == sorted(map(str, components([d[:2] for d in docs])))


@pytest.mark.parametrize("hot", [False, True])
def test_stock_paragraphs_and_hot_columns(spark, monkeypatch, hot):
    """Documents of stock paragraphs hang together by ties without being alike; rows are copied a few times at most."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 16)
    if hot:
        monkeypatch.setattr(jaccard_join, "HOT_LEAST", 9)
        monkeypatch.setattr(jaccard_join, "HOT_GROUPS", 1 << 20)
        monkeypatch.setattr(jaccard_join, "CELLS", 2)
        monkeypatch.setattr(jaccard_join, "FEW_COPIES", 0)
    stock = [" ".join(f"p{k}w{i}" for i in range(20)) for k in range(12)]
    rows = [(i, " ".join(stock[k] for k in rng.choice(12, 4, replace=False))) for i in range(300)]
    base = [f"n{i}" for i in range(80)]
    for i in range(300, 360):  # near copies of one text
        words = list(base)
        words[int(rng.integers(80))] = f"x{i}"
        rows.append((i, " ".join(words)))
    made = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(tuple(r) for r in made.collect()) == sorted(components(rows))


def removed(rows, window=50):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    first: dict = {}
    for i, w in split:
        if i is not None:
            for k in range(len(w) - window + 1):
                g = tuple(w[k : k + window])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, w in split:
        gone = {k + d for k in range(len(w) - window + 1) if i is not None and first[tuple(w[k : k + window])] < i for d in range(window)}
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


def test_op4(spark, odd, docs):
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in run(spark, "op4_substring_dedup", odd)]
    want = [(i, n, k, sha(t)) for i, n, k, t in removed([d[:2] for d in docs])]
    assert sorted(map(str, got)) == sorted(map(str, want)) and sum(k for _, _, k, _ in want) > 300


def plain_score(net, text):
    """One text's score, window by window and step by step."""
    p, h = net.p, toxicity.HIDDEN
    sig = lambda x: 1 / (1 + np.exp(-x))

    def states(inputs, w, b, u):
        out, s = [], np.zeros(h)
        for x in inputs:
            a, g = x @ w + b, s @ u
            z, r = sig(a[:h] + g[:h]), sig(a[h : 2 * h] + g[h : 2 * h])
            s = z * s + (1 - z) * np.tanh(a[2 * h :] + r * g[2 * h :])
            out.append(s)
        return out

    def read(inputs, name):
        one = states(inputs, p[name + "w1"], p[name + "b1"], p[name + "u1"])
        two = states(inputs[::-1], p[name + "w2"], p[name + "b2"], p[name + "u2"])[::-1]
        both = [np.concatenate(x) for x in zip(one, two, strict=True)]
        e = np.array([b @ p[name + "v"] for b in both])
        a = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
        return sum(x * b for x, b in zip(a, both, strict=True))

    words = toxicity.WORD.findall(text.lower())
    vectors = []
    for w in words:
        ids, _, hashed = net.spell([w])
        vectors.append(np.concatenate([p["words"][hashed[0]], read(list(p["chars"][ids[:, 0]]), "c")]))
    if not words:
        return float(sig(p["bias"][0]))
    starts = range(0, max(1, -(-(len(words) - toxicity.WINDOW) // toxicity.STRIDE) + 1) * toxicity.STRIDE, toxicity.STRIDE)
    return float(sig(max(read(vectors[a : a + toxicity.WINDOW], "w") @ p["out"] + p["bias"][0] for a in starts)))


def test_op5(spark, odd, docs):
    labels = table(spark, odd, "labels")
    net = toxicity.fit(table(spark, odd, "documents"), labels.filter(~toxicity.held_out()))
    got = run(spark, "op5_toxicity", odd)
    assert len(got) == len(docs)
    texts = {(i, sha(t or "")): t or "" for i, t, _ in docs if len(t or "") < 3000}
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7)
    for (i, _), t in sorted(texts.items(), key=str)[::9]:
        want = plain_score(net, t)
        assert min(abs(r.score - want) for r in by[i]) < 1e-3


def test_op6(spark, odd, docs):
    """Against plain sets of n-grams instead of the filter; the small sample is all rows that teach."""
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0

    def grams(text):
        found = set()
        for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
            w = f" {word} "
            found |= {(n, w[k : k + n]) for n in langid.SIZES for k in range(len(w) - n + 1)}
        return found

    teach = [(grams(t), lang) for i, t, lang in docs if i is not None and not held(i) and t is not None and lang]
    counts: dict = {}
    for g, lang in teach:
        for x in g:
            counts.setdefault(x, {}).setdefault(lang, 0)
            counts[x][lang] += 1
    size = {k: sum(lang == k for _, lang in teach) for k in ("aa", "bb")}
    own: dict = {"aa": set(), "bb": set()}
    for x, c in counts.items():
        share = {k: n / size[k] for k, n in c.items()}
        for k, s in share.items():
            if s >= 0.004 and (c[k] > 1 or s > 0.02) and s >= 0.15 * max(share.values()):
                own[k].add(x)
    got: dict = {}
    for r in run(spark, "op6_langid", odd):
        got.setdefault(r.doc_id, set()).add(r.lang_pred)
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and held(r.doc_id))
    for i, t, _ in docs:
        g = grams(t)
        hits = {k: len(g & own[k]) for k in own}
        if not re.search(r"[^\W\d_]", t or ""):
            assert "und" in got[i]
        elif abs(hits["aa"] - hits["bb"]) > 3:
            assert max(hits, key=hits.get) in got[i]


def test_op7(spark, odd):
    rows = [tuple(r)[:4] for r in table(spark, odd, "conversations").collect()]
    tricky = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)]
    got = {r.conv_id: r for r in run(spark, "op7_chat", odd)}
    assert set(got) == {r[0] for r in rows}
    for c, r in got.items():
        own = sorted((t is not None, t or 0, role or "", x or "") for k, t, role, x in rows if k == c)
        loss = "".join(x for _, _, role, x in own if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(own), sha("".join(f"{role}\n{x}\n" for _, _, role, x in own)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss)) and r.formatted_chars >= sum(len(x) for *_, x in own)


def test_windows_keep_to_the_budget(spark, odd):
    from lodestone.llm import chat

    made = chat.chat_windows(table(spark, odd, "conversations")).collect()
    n = {t: k for t, k in zip((r.text for r in made), chat.turn_tokens([r.text for r in made]), strict=True)}
    single = lambda r: len(chat.parse(r.text)) == 1
    assert all(r.n_tokens <= 2048 or single(r) for r in made) and n
    nine = [r for r in made if r.conv_id == 9]  # its system turn is most of the budget, so it isn't repeated
    assert len(nine) <= 3 and sum("[SYS]" in r.text for r in nine) == 1


def test_op8(spark, odd, docs):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = run(spark, "op8_packing", odd)
    want = []
    for i, t, _ in docs:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
    bins: dict = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    open_: list = []
    for n in sorted((w[3] for w in want), reverse=True):
        fits = [c for c in open_ if c >= n]
        open_.remove(min(fits)) if fits else None
        open_.append((min(fits) if fits else 4096) - n)
    assert len(bins) == len(open_)
    for b in bins.values():
        assert [o for o, _ in sorted(b)] == np.cumsum([0, *(n for _, n in sorted(b))])[:-1].tolist() and sum(n for _, n in b) <= 4096


def test_op9(spark, odd, docs):
    tok, at, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for i, t, _ in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or "")):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.start, r.n_tokens, r.ids_crc32)) for r in run(spark, "op9_token_files", odd))


def test_op10(spark, odd):
    rows = {(r.vec_id, tuple(r.embedding)) for r in table(spark, odd, "embeddings").collect() if r.vec_id is not None and r.embedding and np.isfinite(r.embedding).all() and any(r.embedding)}
    got: dict = {}
    for r in sorted(run(spark, "op10_ann", odd), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert set(got) == {0, 100, 200, 900}
    for q, found in got.items():
        mine = np.array(next(v for i, v in rows if i == q))
        near = sorted((float(np.sqrt(((np.array(v) - mine) ** 2).sum())), i) for i, v in rows if i != q and len(v) == len(mine))[:10]
        assert [i for _, i in found] == [i for _, i in near] and np.allclose([d for d, _ in found], [d for d, _ in near], atol=1e-12)


def test_pipeline(spark, odd, docs):
    """All stages one after another in plain Python, but for the network's own scores."""
    net = toxicity.fit(table(spark, odd, "documents"), table(spark, odd, "labels").filter(~toxicity.held_out()))
    scores = toxicity.Scorer(net).scores([t or "" for _, t, _ in docs])
    rows = [(i, t) for (i, t, _), s in zip(docs, scores, strict=True) if s < 0.7]
    assert len(rows) < len(docs)
    newest = {}
    for i, t in rows:
        if (t or "") not in newest or (i is not None and (newest[t or ""] is None or i > newest[t or ""])):
            newest[t or ""] = i
    rows = [(i, t) for i, t in rows if newest[t or ""] == i]
    rows = [(i, t) for (i, t), (_, _, c) in zip(rows, components(rows), strict=True) if i is None or c == i]
    kept = [(i, t if not k else left) for (i, t), (_, n, k, left) in zip(rows, removed(rows), strict=True) if not k or k < n]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted(str((i, len(tok.encode(t or "", add_special_tokens=False).ids) + 1)) for i, t in kept)
    got: dict = {}
    for r in run(spark, "pipeline", odd):
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    whole: dict = {}
    for i, t in kept:
        whole[i] = whole.get(i, 0) + len(tok.encode(t or "", add_special_tokens=False).ids) + 1
    assert got == whole and len(want) == len(kept)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "substring dedup", "best-fit packing"]
