"""Operator 9: toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Inputs of a word are a hashed word vector and the mean of hashed vectors of its character three-, four- and
five-grams with end marks, so that unseen forms of a known stem score alike. A text of any length is cut into
overlapping windows of words; the network reads each in both directions, pools by attention and gives one
number. A text's score is the logistic of the log-sum-exp over all its windows, so one toxic window is enough
and no part is left out. Training minimises the log loss of that score on a bounded sample of labelled texts.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultspark.llm.common import give_back

SAMPLE = 900  # labelled texts of each class that are learned from, at most
LONGEST = 50_000  # characters of a text that are learned from; longer ones give a window at a place drawn by hash
EPOCHS, BATCH, RATE = 6, 48, 0.04
WINDOW, STRIDE = 48, 36  # words; neighbours share a quarter
WORD_ROWS, GRAM_ROWS, WORD_DIM, GRAM_DIM, HIDDEN, ATTEND = 1 << 15, 1 << 16, 6, 10, 8, 6
GRAMS = (3, 4, 5)
TOKEN = re.compile(r"[^\W_]+")
CHUNK_WORDS = 40_000  # words scored together: bounds memory, not the result


def _hash_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word bucket, gram buckets, owner of each gram) for words; whole words whatever their length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    whole = np.zeros(len(words), np.int64)
    grams, owners = [], []
    start = 0
    order = np.argsort(lengths, kind="stable")
    while start < len(order):  # words of like length share an array
        width = max(14, int(lengths[order[start]]) * 3 // 2)
        stop = int(np.searchsorted(lengths[order], width, side="right"))
        stop = min(stop, start + max(1, 400_000 // width))
        rows = order[start:stop]
        start = stop
        n, width = len(rows), int(lengths[rows].max(initial=1))
        chars = np.zeros((n, width + 2), np.uint32)
        chars[:, 1 : width + 1] = np.array([words[i] for i in rows], dtype=f"U{width}").view(np.uint32).reshape(n, width)
        chars[:, 0] = 2
        chars[np.arange(n), lengths[rows] + 1] = 3
        size = lengths[rows] + 2
        state = np.zeros(n, np.uint32)
        for c in range(width + 2):
            live = c < size
            state = np.where(live, state * np.uint32(16777619) ^ chars[:, c], state)
        whole[rows] = (state ^ state >> np.uint32(15)) % WORD_ROWS
        for g in GRAMS:
            if width + 2 < g:
                continue
            h = np.full((n, width + 3 - g), g, np.uint32)
            for k in range(g):
                h = h * np.uint32(2654435761) ^ chars[:, k : width + 3 - g + k]
            h ^= h >> np.uint32(13)
            h *= np.uint32(2246822519)
            h ^= h >> np.uint32(16)
            ok = np.arange(width + 3 - g)[None, :] + g <= size[:, None]
            grams.append((h % GRAM_ROWS)[ok])
            owners.append(np.broadcast_to(rows[:, None], ok.shape)[ok])
    if not grams:
        return whole, np.empty(0, np.int64), np.empty(0, np.int64)
    return whole, np.concatenate(grams).astype(np.int64), np.concatenate(owners)


class Words:
    """Distinct words of some texts, with their buckets."""

    def __init__(self, words: list[str]):
        self.codes, distinct = pd.factorize(np.array(words, dtype=object))
        self.size = len(distinct)
        self.whole, grams, owner = _hash_grams(list(distinct))
        order = np.argsort(owner, kind="stable")
        self.grams, self.owner = grams[order], owner[order]
        self.count = np.bincount(self.owner, minlength=self.size).astype(np.float32)
        self.starts = np.searchsorted(self.owner, np.arange(self.size))


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions (n, WINDOW) into the words of all texts, -1 for none; text of each window). No words: one empty window."""
    rows, owner, at = [], [], 0
    step = np.arange(WINDOW)
    for i, n in enumerate(counts.tolist()):
        starts = np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)
        pos = starts[:, None] + step[None, :]
        rows.append(np.where(pos < n, pos + at, -1))
        owner.append(np.full(len(starts), i))
        at += n
    return np.concatenate(rows), np.concatenate(owner)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Weights, forward and backward pass, Adam."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        d, h = WORD_DIM + GRAM_DIM, HIDDEN
        f = lambda *s, k: (r.standard_normal(s) * k).astype(np.float32)
        self.p = {"word": f(WORD_ROWS, WORD_DIM, k=0.02), "gram": f(GRAM_ROWS, GRAM_DIM, k=0.1), "attend": f(2 * h, ATTEND, k=0.3), "attend_b": np.zeros(ATTEND, np.float32), "focus": f(ATTEND, k=0.5), "out": f(2 * h, k=0.5), "out_b": np.full(1, -3, np.float32)}
        for side in "fb":
            self.p |= {f"w{side}": f(d, 3 * h, k=d**-0.5), f"u{side}": f(h, 3 * h, k=h**-0.5), f"b{side}": np.zeros(3 * h, np.float32)}

    def inputs(self, words: Words) -> np.ndarray:
        p, total = self.p, np.zeros((words.size + 1, GRAM_DIM), np.float32)
        # Rows that few texts of the sample use are zero throughout, see rows_in_use.
        for a in range(0, words.size, 8192):  # bounded gathers
            b = min(a + 8192, words.size)
            lo, hi = words.starts[a], words.starts[b] if b < words.size else len(words.grams)
            if hi > lo:
                has = np.flatnonzero(words.count[a:b] > 0)
                total[a + has] = np.add.reduceat(p["gram"][words.grams[lo:hi]], words.starts[a + has] - lo, axis=0)
        total[:-1] /= np.maximum(1, words.count)[:, None]
        return np.concatenate([np.concatenate([p["word"][words.whole], np.zeros((1, WORD_DIM), np.float32)]), total], axis=1)

    def forward(self, x: np.ndarray, codes: np.ndarray, keep: bool = False):
        """Numbers of windows; codes (n, WINDOW) are rows of x, the last row standing for no word."""
        p, h, n = self.p, HIDDEN, len(codes)
        mask = (codes != len(x) - 1).astype(np.float32)
        states, saved = [], []
        for side in "fb":
            gates = x @ p[f"w{side}"] + p[f"b{side}"]
            state = np.zeros((n, h), np.float32)
            out = np.zeros((WINDOW, n, h), np.float32)
            trail = []
            for t in range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1):
                g = gates[codes[:, t]]
                ur = state @ p[f"u{side}"][:, : 2 * h]
                zr = _sigmoid(g[:, : 2 * h] + ur)
                z, r = zr[:, :h] * mask[:, t : t + 1], zr[:, h:]
                c = np.tanh(g[:, 2 * h :] + (r * state) @ p[f"u{side}"][:, 2 * h :])
                new = state + z * (c - state)
                if keep:
                    trail.append((t, state, zr[:, :h], r, c))
                state = out[t] = new
            states.append(out)
            saved.append(trail)
        both = np.concatenate(states, axis=2)
        a = np.tanh(both @ p["attend"] + p["attend_b"])
        e = np.where(mask.T > 0, a @ p["focus"], -1e4)
        e = np.exp(e - e.max(axis=0, keepdims=True))
        w = e / e.sum(axis=0, keepdims=True)
        pooled = np.einsum("tn,tnh->nh", w, both)
        number = pooled @ p["out"] + p["out_b"][0]
        return (number, (x, codes, mask, saved, both, a, w, pooled)) if keep else number

    def backward(self, d_number: np.ndarray, kept, words: Words) -> dict[str, np.ndarray]:
        x, codes, mask, saved, both, a, w, pooled = kept
        p, h = self.p, HIDDEN
        g = {"out": pooled.T @ d_number, "out_b": d_number.sum(keepdims=True)}
        d_pooled = d_number[:, None] * p["out"][None, :]
        d_both = w[:, :, None] * d_pooled[None]
        d_w = np.einsum("tnh,nh->tn", both, d_pooled)
        d_e = w * (d_w - (w * d_w).sum(axis=0, keepdims=True))
        g["focus"] = np.einsum("tn,tna->a", d_e, a)
        d_a = d_e[:, :, None] * p["focus"] * (1 - a * a)
        g["attend"] = np.einsum("tnh,tna->ha", both, d_a, optimize=True)
        g["attend_b"] = d_a.sum(axis=(0, 1))
        d_both += d_a @ p["attend"].T
        d_x = np.zeros_like(x)
        for k, side in enumerate("fb"):
            u, d_state = p[f"u{side}"], np.zeros((len(codes), h), np.float32)
            d_u, d_gates = np.zeros_like(u), np.zeros((len(x), 3 * h), np.float32)
            flat_codes, flat_d = [], []
            for t, before, z0, r, c in reversed(saved[k]):
                d_new = d_both[t, :, k * h : (k + 1) * h] + d_state
                m = mask[:, t : t + 1]
                z = z0 * m
                d_c = d_new * z * (1 - c * c)
                d_z = d_new * (c - before) * m * z0 * (1 - z0)
                d_rs = d_c @ u[:, 2 * h :].T
                d_r = d_rs * before * r * (1 - r)
                d_zr = np.concatenate([d_z, d_r], axis=1)
                d_state = d_new * (1 - z) + d_rs * r + d_zr @ u[:, : 2 * h].T
                d_u[:, : 2 * h] += before.T @ d_zr
                d_u[:, 2 * h :] += (r * before).T @ d_c
                flat_codes.append(codes[:, t])
                flat_d.append(np.concatenate([d_zr, d_c], axis=1))
            where, what = np.concatenate(flat_codes), np.concatenate(flat_d)
            for col in range(3 * h):
                d_gates[:, col] = np.bincount(where, weights=what[:, col], minlength=len(x))
            g[f"u{side}"], g[f"b{side}"], g[f"w{side}"] = d_u, d_gates.sum(axis=0), x.T @ d_gates
            d_x += d_gates @ p[f"w{side}"].T
        d_x = d_x[:-1]
        d_gram = (d_x[:, WORD_DIM:] / np.maximum(1, words.count)[:, None])[words.owner]
        for name, rows, part in (("word", words.whole, d_x[:, :WORD_DIM]), ("gram", words.grams, d_gram)):
            used, at = np.unique(rows, return_inverse=True)
            g[name] = (used, np.stack([np.bincount(at, weights=part[:, c], minlength=len(used)) for c in range(part.shape[1])], axis=1).astype(np.float32))
        return g

    def scores(self, texts: list[str | None], keep: bool = False):
        """Log-odds of texts; with keep, what the backward pass needs too."""
        tokens = [TOKEN.findall(t.lower()) if t else [] for t in texts]
        counts = np.array([len(t) for t in tokens])
        words = Words([w for t in tokens for w in t])
        x = self.inputs(words)
        pos, owner = windows(counts)
        codes = np.where(pos >= 0, np.concatenate([words.codes, [0]])[pos], words.size)
        if not keep:
            number = np.concatenate([self.forward(x, codes[k : k + 2048]) for k in range(0, len(codes), 2048)])
        else:
            number, kept = self.forward(x, codes, True)
        firsts = np.searchsorted(owner, np.arange(len(texts)))
        top = np.maximum.reduceat(number, firsts)
        share = np.exp(number - top[owner])
        total = np.add.reduceat(share, firsts)
        score = top + np.log(total)
        return (score, share / total[owner], owner, kept, words) if keep else score


LEAST_TEXTS = 3  # texts of the sample that must use a row of the tables


def rows_in_use(model: Model, texts: list[str | None]) -> dict[str, np.ndarray]:
    """Which table rows LEAST_TEXTS texts or more use; the others are zeroed, so that no text is learned by its own words."""
    used = {name: np.zeros(len(model.p[name])) for name in ("word", "gram")}
    for t in texts:
        words = Words(sorted(set(TOKEN.findall(t.lower())))) if t else Words([])
        for name, rows in (("word", words.whole), ("gram", words.grams)):
            used[name][np.unique(rows)] += 1
    kept = {name: n >= LEAST_TEXTS for name, n in used.items()}
    for name, known in kept.items():
        model.p[name][~known] = 0
    return kept


def train(texts: list[str | None], toxic: list[int], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Fits a model; with one class only, every score is that class's constant."""
    model, y = Model(seed), np.array(toxic, dtype=np.float32)
    if len(set(toxic)) < 2:
        model.p["out"][:] = 0
        model.p["out_b"][:] = 6.0 if toxic and toxic[0] else -12.0
        return model
    r = np.random.default_rng(seed)
    first, second, step = {}, {}, 0
    for k, v in model.p.items():
        first[k], second[k] = np.zeros_like(v), np.zeros_like(v)
    kept_rows = rows_in_use(model, texts)
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    least = max(1, min(BATCH, len(y) // 12))
    batches = epochs * -(-len(y) // least)
    for _ in range(epochs):
        order = r.permutation(len(y))
        for k in range(0, len(y), least):
            rows = order[k : k + least]
            score, share, owner, kept, words = model.scores([texts[i] for i in rows], keep=True)
            d = (_sigmoid(score) - y[rows]) * weight[rows] / len(rows)
            grads = model.backward((d[owner] * share).astype(np.float32), kept, words)
            step += 1
            rate = RATE * (1 - step / (batches + 1)) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
            for name, g in grads.items():
                at, g = g if isinstance(g, tuple) else (slice(None), g)
                if name in kept_rows:
                    known = kept_rows[name][at]
                    at, g = at[known], g[known]
                first[name][at] = m = 0.9 * first[name][at] + 0.1 * g
                second[name][at] = v = 0.99 * second[name][at] + 0.01 * g * g
                model.p[name][at] -= (rate * m / (np.sqrt(v) + 1e-7)).astype(np.float32)
    return model


def held_out(key: str) -> F.Column:
    return F.crc32(F.col(key).cast("string")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learns from at most `sample` labelled rows of each class whose crc32(key) mod 5 is not 0, those of smallest hash.

    Only the text is an input. Rows labelled null, with no document, or with a text of more than LONGEST characters
    teach nothing; of repeated labels the largest counts, of rows that repeat a key the largest text. Null and empty
    texts teach like others. Empty tables, or labels of one class, give a constant score. The sample's keys are at
    most 2 x sample, so they are broadcast, and what is collected is bounded by sample and LONGEST. Other columns,
    whatever their names, are not looked at.
    """
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key)).groupBy(key).agg(F.max(label).alias("y"))
    parts = [known.filter(F.col("y") == y).orderBy(F.xxhash64(key), key).limit(sample) for y in (1, 0)]
    chosen = parts[0].unionByName(parts[1]).select(F.col(key).alias("k"), "y")
    found = docs.select(F.col(key).alias("id"), F.col(text).alias("t")).join(F.broadcast(chosen), F.col("id") == F.col("k"))
    start = F.pmod(F.xxhash64("k", F.lit(9)), F.greatest(F.lit(1), F.char_length("t") - LONGEST + 1)) + 1
    rows = found.select("k", "y", F.substr("t", start.cast("int"), F.lit(LONGEST)).alias("t")).groupBy("k", "y").agg(F.max("t").alias("t")).collect()
    rows = sorted(rows, key=lambda r: r["k"])
    model = train([r["t"] for r in rows], [int(r["y"]) for r in rows])
    del rows
    give_back()
    return model


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with `out`, the probability from 0 to 1 that each whole text is toxic. No shuffle.

    Null and empty texts get one empty window; texts of any length are scored in all their windows. Repeated rows
    and other columns stay, but for an `out` that is there already; an empty table gives no rows.
    """
    weights = docs.sparkSession.sparkContext.broadcast(model.p)  # fixed size, whatever the input

    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        model = Model.__new__(Model)
        model.p = weights.value
        texts, out, size = [], [], 0
        for k, t in enumerate(column):
            texts.append(t.as_py())
            size += len(texts[-1] or "") // 6
            if size > CHUNK_WORDS or k == len(column) - 1:
                out.append(_sigmoid(model.scores(texts)))
                texts, size = [], 0
        give_back()
        return pa.array(np.concatenate([np.empty(0), *out]).astype(np.float64))

    return docs.withColumn(out, run(F.col(text)))
