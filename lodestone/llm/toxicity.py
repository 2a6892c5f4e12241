"""Toxicity by a bidirectional gated recurrent network in numpy.

A word's vector is a hashed word embedding beside a bidirectional GRU over its characters, pooled by attention.
A second bidirectional GRU with attention pooling reads windows of words, each overlapping the next by half,
and a logistic unit scores the window; a text scores as its worst window, so nothing is cut off. Words are runs
of letters, digits and underscores in lower case; longer runs than ``CHARS`` are read in pieces.

Labels belong to whole texts, so training alternates: the current network picks the worst windows of each
labelled text (the first time, words that only toxic texts use pick them), then learns from those windows.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow.compute as pc
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import table, text_or_empty

CHARS, WINDOW, STRIDE = 16, 32, 16
WORD = re.compile(r"\w{1,16}")
LETTERS, HASHED, HIDDEN = 512, 1 << 13, 8


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def gru(xp: np.ndarray, mask: np.ndarray | None, u: np.ndarray, keep: bool = False):
    """States (steps, n, h) of a GRU over projected inputs (steps, n, 3h); masked steps hold the state."""
    steps, n, h = len(xp), xp.shape[1], u.shape[0]
    state, states, kept = np.zeros((n, h), np.float32), np.empty((steps, n, h), np.float32), []
    for t in range(steps):
        g = state @ u
        zr = sigmoid(xp[t, :, : 2 * h] + g[:, : 2 * h])
        z, r = zr[:, :h], zr[:, h:]
        c = np.tanh(xp[t, :, 2 * h :] + r * g[:, 2 * h :])
        new = c + z * (state - c)
        if mask is not None:
            new = state + mask[t] * (new - state)
        if keep:
            kept.append((state, z, r, c, g[:, 2 * h :]))
        state = states[t] = new
    return states, kept


def gru_back(d: np.ndarray, mask: np.ndarray, u: np.ndarray, kept: list):
    """Gradients of inputs and recurrent weights for gradients of the states."""
    dxp, du, carry = np.empty((len(d), d.shape[1], 3 * u.shape[0]), np.float32), np.zeros_like(u), 0
    for t in range(len(d) - 1, -1, -1):
        state, z, r, c, gc = kept[t]
        dh = d[t] + carry
        dn = mask[t] * dh
        dc = dn * (1 - z) * (1 - c * c)
        dz = dn * (state - c) * z * (1 - z)
        dr = dc * gc * r * (1 - r)
        dxp[t] = np.concatenate([dz, dr, dc], 1)
        dg = np.concatenate([dz, dr, dc * r], 1)
        du += state.T @ dg
        carry = dh - dn + dn * z + dg @ u.T
    return dxp, du


def both_ways(x: np.ndarray, mask: np.ndarray, p: dict, name: str, keep: bool = False):
    """States of both directions side by side, from inputs (steps, n, d)."""
    one, k1 = gru(x @ p[name + "w1"] + p[name + "b1"], mask, p[name + "u1"], keep)
    two, k2 = gru((x @ p[name + "w2"] + p[name + "b2"])[::-1], mask[::-1], p[name + "u2"], keep)
    return np.concatenate([one, two[::-1]], 2), (k1, k2)


def attend(states: np.ndarray, mask: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Attention weights (steps, n, 1) and the weighted sum of states (n, d)."""
    e = np.where(mask > 0, (states @ v)[..., None], np.float32(-1e9))
    a = np.exp(e - e.max(0)) * mask
    a /= np.maximum(a.sum(0), np.float32(1e-9))
    return a, (a * states).sum(0)


@dataclass
class Network:
    p: dict = field(default_factory=dict)

    @staticmethod
    def fresh(seed: int = 11) -> Network:
        r, h = np.random.default_rng(seed), HIDDEN
        p = {"chars": r.normal(0, 0.3, (LETTERS, 8)), "words": r.normal(0, 0.1, (HASHED, 8))}
        for name, d in (("c", 8), ("w", 8 + 2 * h)):
            for k in "12":
                p[f"{name}w{k}"], p[f"{name}u{k}"] = r.normal(0, d**-0.5, (d, 3 * h)), r.normal(0, h**-0.5, (h, 3 * h))
                p[f"{name}b{k}"] = np.zeros(3 * h)
            p[f"{name}v"] = r.normal(0, 0.3, 2 * h)
        p["out"], p["bias"] = r.normal(0, 0.3, 2 * h), np.full(1, -1.0)
        return Network({k: v.astype(np.float32) for k, v in p.items()})

    # words to vectors
    @staticmethod
    def spell(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Character ids (steps, n), their mask (steps, n, 1), and hashed word ids (n)."""
        size = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer("".join(words).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        inside = np.arange(max(size.max(initial=1), 1)) < size[:, None]
        ids = np.zeros(inside.shape, np.int64)
        ids[inside] = np.where(flat < 384, flat, 384 + flat % 128)
        code = np.zeros(len(words), np.uint64)
        grid = np.zeros(inside.shape, np.uint64)
        grid[inside] = flat
        for column, own in zip(grid.T, inside.T, strict=True):
            code = np.where(own, code * np.uint64(0x100000001B3) + column, code)
        code ^= code >> np.uint64(29)
        return ids.T, inside.T[..., None].astype(np.float32), (code % np.uint64(HASHED)).astype(np.int64)

    def word_vectors(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), 8 + 2 * HIDDEN), np.float32)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for a in range(0, len(order), 2048):
            part = order[a : a + 2048]
            ids, mask, hashed = self.spell([words[i] for i in part])
            states, _ = both_ways(self.p["chars"][ids], mask, self.p, "c")
            out[part] = np.concatenate([self.p["words"][hashed], attend(states, mask, self.p["cv"])[1]], 1)
        return out

    def gradients(self, windows: np.ndarray, words: list[str], labels: np.ndarray, rng) -> tuple[float, dict]:
        """Loss and gradients for windows of word numbers (n, WINDOW; -1: none)."""
        p, g = self.p, {}
        ids, cmask, hashed = self.spell(words)
        x = p["chars"][ids]
        cs, ck = both_ways(x, cmask, p, "c", True)
        ca, cp = attend(cs, cmask, p["cv"])
        known = (rng.random(len(words)) > 0.3).astype(np.float32)[:, None]  # words also have to be told by spelling
        vectors = np.concatenate([p["words"][hashed] * known, cp], 1)
        at = windows.T
        wmask = (at >= 0)[..., None].astype(np.float32)
        wx = vectors[np.maximum(at, 0)]
        ws, wk = both_ways(wx, wmask, p, "w", True)
        wa, wp = attend(ws, wmask, p["wv"])
        score = sigmoid(wp @ p["out"] + p["bias"])
        d = ((score - labels) / len(labels)).astype(np.float32)
        g["out"], g["bias"] = wp.T @ d, d.sum(keepdims=True)
        dx = self._back(d[:, None] * p["out"], ws, wa, wmask, wk, wx, "w", "wv", g)
        flat = np.zeros_like(vectors)
        np.add.at(flat, np.maximum(at, 0).ravel(), (dx * wmask).reshape(-1, dx.shape[2]))
        g["words"] = np.zeros_like(p["words"])
        np.add.at(g["words"], hashed, flat[:, :8] * known)
        dx = self._back(flat[:, 8:], cs, ca, cmask, ck, x, "c", "cv", g)
        g["chars"] = np.zeros_like(p["chars"])
        np.add.at(g["chars"], ids.ravel(), (dx * cmask).reshape(-1, dx.shape[2]))
        loss = -np.mean(labels * np.log(score + 1e-7) + (1 - labels) * np.log(1 - score + 1e-7))
        return float(loss), g

    def _back(self, dpool, states, a, mask, kept, x, name, v, g) -> np.ndarray:
        p, h = self.p, HIDDEN
        along = (states * dpool).sum(2, keepdims=True)
        de = a * (along - (a * along).sum(0))
        g[v] = (de * states).sum((0, 1))
        d = a * dpool + de * p[v]
        one, g[name + "u1"] = gru_back(d[..., :h], mask, p[name + "u1"], kept[0])
        two, g[name + "u2"] = gru_back(d[::-1, :, h:], mask[::-1], p[name + "u2"], kept[1])
        two = two[::-1]
        flat = x.reshape(-1, x.shape[2])
        for k, dxp in (("1", one), ("2", two)):
            g[name + "w" + k] = flat.T @ dxp.reshape(-1, 3 * h)
            g[name + "b" + k] = dxp.sum((0, 1))
        return one @ p[name + "w1"].T + two @ p[name + "w2"].T


def windows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts with so many words each, laid end to end: every window's text, first word and size."""
    n = np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1)
    n = np.where(counts == 0, 0, n)
    text = np.repeat(np.arange(len(counts)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begin = np.repeat(np.cumsum(counts) - counts, n) + k * STRIDE
    return text, begin, np.minimum(WINDOW, np.repeat(np.cumsum(counts), n) - begin)


class Scorer:
    """Scores texts; keeps projected word vectors in a pool of bounded size."""

    def __init__(self, network: Network, limit: int = 100_000):
        self.network, self.limit = network, limit
        self._clear()

    def _clear(self) -> None:
        self.entry: dict[str, int] = {}
        self.room, self.used = np.empty((4096, 6 * HIDDEN), np.float32), 0

    def _entries(self, words: list[str]) -> np.ndarray:
        if len(self.entry) > self.limit:
            self._clear()
        p, new = self.network.p, [w for w in words if w not in self.entry]
        if new:
            v = self.network.word_vectors(new)
            self.entry.update(zip(new, range(self.used, self.used + len(new)), strict=True))
            while self.used + len(new) > len(self.room):
                self.room = np.concatenate([self.room, np.empty_like(self.room)])
            self.room[self.used : self.used + len(new)] = np.concatenate([v @ p["ww1"] + p["wb1"], v @ p["ww2"] + p["wb2"]], 1)
            self.used += len(new)
        return np.array([self.entry[w] for w in words], np.int64)

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[str]], np.ndarray]:
        """Each window's text and logit, the texts' words, and each window's first word."""
        split = [WORD.findall(t.lower()) for t in texts]
        coded = pa.array(list(itertools.chain.from_iterable(split)), pa.large_string()).dictionary_encode()
        at = self._entries(coded.dictionary.to_pylist())[coded.indices.to_numpy()] if len(coded) else np.empty(0, np.int64)
        text, begin, size = windows_of(np.array([len(x) for x in split], np.int64))
        out, p, h = np.empty(len(text), np.float32), self.network.p, HIDDEN
        full = size == WINDOW
        for group in (np.flatnonzero(full), np.flatnonzero(~full)):
            group = group[np.argsort(size[group], kind="stable")]
            for a in range(0, len(group), 1024):
                w = group[a : a + 1024]
                steps = int(size[w].max())
                place = begin[w] + np.arange(steps)[:, None]
                mask = (np.arange(steps)[:, None] < size[w])[..., None].astype(np.float32)
                x = self.room[at[np.minimum(place, len(at) - 1)]]
                m = None if full[w[0]] else mask
                one, _ = gru(x[..., : 3 * h], m, p["wu1"])
                two, _ = gru(x[::-1, :, 3 * h :], None if m is None else m[::-1], p["wu2"])
                pooled = attend(np.concatenate([one, two[::-1]], 2), mask, p["wv"])[1]
                out[w] = pooled @ p["out"] + p["bias"]
        return text, out, split, begin

    def scores(self, texts: list[str], group: int = 1 << 20) -> np.ndarray:
        """Each text's worst window as a probability; without words, the network's score of nothing."""
        out, a = np.full(len(texts), self.network.p["bias"][0], np.float64), 0
        while a < len(texts):
            b, size = a, 0
            while b < len(texts) and (b == a or size + len(texts[b]) <= group):
                size += len(texts[b])
                b += 1
            text, logit, _, _ = self.logits(texts[a:b])
            worst = np.full(b - a, -np.inf)
            np.maximum.at(worst, text, logit)
            out[a:b] = np.where(np.isinf(worst), out[a:b], worst)
            a = b
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def train(texts: list[str], labels: list[int], rounds: int = 5, seed: int = 5, batch: int = 64) -> Network:
    """Fit a network to labelled texts; without both labels among them, the fresh network comes back."""
    net, rng = Network.fresh(), np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    if not 0 < y.sum() < len(y):
        return net
    split = [WORD.findall(t.lower()) for t in texts]
    counts = np.array([len(x) for x in split], np.int64)
    text, begin, size = windows_of(counts)
    words, number = [], {}
    flat = np.fromiter((number.setdefault(w, len(number)) for x in split for w in x), np.int64, int(counts.sum()))
    words = list(number)
    del split
    of = np.repeat(np.arange(len(texts)), counts)
    pairs = np.unique(np.stack([flat, of]), axis=1) if len(flat) < 1 << 16 else np.divmod(np.unique(flat * len(texts) + of), len(texts))
    toxic_df = np.bincount(pairs[0], y[pairs[1]], len(words))
    clean_df = np.bincount(pairs[0], 1 - y[pairs[1]], len(words))
    hint = np.where(clean_df == 0, toxic_df - 1.5, -1.0)[flat] if len(flat) else np.zeros(0)
    rank = np.array([hint[b : b + s].max() for b, s in zip(begin, size, strict=True)])
    moments, step = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}, 0
    for turn in range(rounds):
        chosen, order = [], np.lexsort((-rank, text))
        first = np.searchsorted(text[order], np.arange(len(texts)))
        for i in range(len(texts)):
            own = order[first[i] : (first[i + 1] if i + 1 < len(texts) else len(order))]
            if not len(own):
                continue
            if y[i]:
                chosen.append(own[0])
            else:
                chosen += [*own[: 1 if turn else 0], *rng.choice(own, min(2, len(own)), replace=False)]
        chosen = np.array(chosen)
        rng.shuffle(chosen)
        for a in range(0, len(chosen), batch):
            w = chosen[a : a + batch]
            place = begin[w][:, None] + np.arange(WINDOW)
            inside = np.arange(WINDOW) < size[w][:, None]
            grid = np.where(inside, flat[np.minimum(place, len(flat) - 1)], -1)
            distinct, back = np.unique(grid, return_inverse=True)
            back = back.reshape(grid.shape)
            if distinct[0] == -1:
                distinct, back = distinct[1:], back - 1
            _, g = net.gradients(back, [words[i] for i in distinct], y[text[w]], rng)
            step += 1
            rate = 0.012 * min(1, step / 20) * (0.5 ** max(0, turn - 2))
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            for k, x in g.items():
                x = x * min(1, 1 / (norm + 1e-9))
                m, v = moments[k]
                m += 0.1 * (x - m)
                v += 0.01 * (x * x - v)
                net.p[k] -= rate * (m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        if turn + 1 < rounds:
            scorer, rank = Scorer(net), np.empty(len(text))
            for a in range(0, len(texts), 256):
                lo, hi = np.searchsorted(text, [a, a + 256])
                rank[lo:hi] = scorer.logits(texts[a : a + 256])[1]
    return net


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = 1500, max_chars: int = 1 << 16) -> Network:
    """A network from about ``per_label`` labelled texts of each label, drawn by a hash of their ids (the bound of the fit).

    Rows with a null id, text or label teach nothing, nor do texts of over ``max_chars``; a row that is labelled twice
    counts twice. Without labels the network is the one before learning.
    """
    drawn = F.pmod(F.xxhash64(F.lit("fit"), id_col), F.lit(1 << 24)) / float(1 << 24)
    labels = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y"), drawn.alias("__r"))
    counts = {r[0]: r[1] for r in labels.filter("__y IN (0, 1)").groupBy("__y").count().collect()}
    if not counts:
        return Network.fresh()
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(per_label / n))])
    sample = labels.filter("__y IN (0, 1)").filter(F.col("__r") < share[F.col("__y")]).drop("__r")
    rows = docs.select(F.col(id_col).alias("__id2"), F.col(text_col).alias("__t")).filter(F.length("__t") <= max_chars)
    # the sample's size is bounded by per_label, so it is sent to the documents rather than they to it
    pulled = rows.join(F.broadcast(sample), F.col("__id2") == F.col("__id")).select("__id", "__t", "__y").toArrow()
    order = pc.sort_indices(pulled, sort_keys=[(c, "ascending") for c in pulled.column_names]).to_pylist()
    texts, y = pulled.column(1).to_pylist(), pulled.column(2).to_pylist()
    return train([texts[i] for i in order], [y[i] for i in order])


_SCORERS: dict[int, Scorer] = {}


def scorer_of(shared) -> Scorer:
    """One scorer per Python worker and broadcast network."""
    if shared.id not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[shared.id] = Scorer(shared.value)
    return _SCORERS[shared.id]


class _Shared:
    """A broadcast value and an id that workers can key caches by."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id()

    @property
    def value(self):
        return self.broadcast.value


def score(df: DataFrame, network: Network, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``df`` with score (0 to 1) and predicted (1 from ``threshold`` on).

    Whole texts are read, in overlapping windows. A null text counts as empty; texts without words all have
    one same low score. Existing columns of these names are replaced.
    """
    shared = _Shared(df.sparkSession.sparkContext.broadcast(network))

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(scorer_of(shared).scores(texts.tolist()), dtype=float)

    out = df.drop("score", "predicted").withColumn("score", scored(text_or_empty(text_col)))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(id_col: str = "doc_id"):
    """Whether a row's label is kept from the fit; a null id is not held out (and teaches nothing)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op5_toxicity(spark, sf_dir):
    """The toxicity of every document, learnt from labels that are not held out.

    One row for every document, repeated ones too; nulls, empty and long texts and empty tables as in ``score`` and ``fit``.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    network = fit(docs, labels.filter(~held_out()))
    return score(docs.select("doc_id", held_out().alias("held_out"), "text"), network).drop("text")
