import random
import zlib

import numpy as np

from vaultspark.llm import toxicity


def texts(n, seed):
    r = random.Random(seed)
    clean = ["".join(r.choice(["th", "er", "on", "an", "re", "he", "in"]) for _ in range(r.randint(1, 4))) for _ in range(400)]
    stems = ["grolk", "vistna"]
    out, labels = [], []
    for k in range(n):
        words = [r.choice(clean) for _ in range(r.randint(5, 200))]
        if k % 3 == 0:
            for _ in range(r.randint(1, 4)):
                words.insert(r.randrange(len(words)), r.choice(stems) + r.choice(["er", "ung", "os", "ity"]))
        out.append(" ".join(words))
        labels.append(int(k % 3 == 0))
    return out, labels


def test_windows_cover_every_word():
    for n in (0, 1, 47, 48, 49, 500):
        pos, owner = toxicity.windows(np.array([n, 3]))
        assert set(pos[owner == 0].ravel()) - {-1} == set(range(n))
        assert set(pos[owner == 1].ravel()) - {-1} == {n, n + 1, n + 2}


def test_gradients_equal_differences():
    model = toxicity.Model(1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    rows = ["one two three " * 30, "four", ""]
    d = np.array([0.3, -0.2, 0.1])

    def loss():
        return float((model.scores(rows) * d).sum())

    score, share, owner, kept, words = model.scores(rows, keep=True)
    grads = model.backward(d[owner] * share, kept, words)
    for name in ("wf", "ub", "attend", "focus", "out", "bf"):
        at = tuple(np.array(model.p[name].shape) // 2)
        old = model.p[name][at]
        model.p[name][at] = old + 1e-4
        up = loss()
        model.p[name][at] = old - 1e-4
        down = loss()
        model.p[name][at] = old
        assert abs((up - down) / 2e-4 - grads[name][at]) < 1e-3


def test_learns_stems_and_scores_unseen_forms(spark):
    train, y = texts(240, 1)
    model = toxicity.train(train, y)
    test, labels = texts(120, 2)
    test += ["word " * 3000 + "grolkheit", None, "", "x" * 100_000]
    labels += [1, 0, 0, 0]
    rows = [(i, t, "clash") for i, t in enumerate(test)] + [(0, test[0], "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, y string")
    got = toxicity.score(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    right = sum((by[i] >= 0.5) == bool(t) for i, t in enumerate(labels))
    assert right / len(labels) > 0.93
    assert toxicity.score(df.limit(0), model).count() == 0


def plain_score(model, text):
    """Log-odds of a text by the definition: words one after another, windows of WINDOW words every STRIDE."""
    p, h = model.p, toxicity.HIDDEN
    sig = lambda v: 1 / (1 + np.exp(-v))
    words = toxicity.TOKEN.findall((text or "").lower())
    vectors = [model.inputs(toxicity.Words([w]))[0] for w in words]

    def run(side, row):
        state, out = np.zeros(h), []
        w, u, b = p[f"w{side}"], p[f"u{side}"], p[f"b{side}"]
        for x in row:
            g = x @ w + b
            z, r = sig(g[:h] + state @ u[:, :h]), sig(g[h : 2 * h] + state @ u[:, h : 2 * h])
            c = np.tanh(g[2 * h :] + (r * state) @ u[:, 2 * h :])
            state = (1 - z) * state + z * c
            out.append(state)
        return out

    numbers, start = [], 0
    while True:
        row = vectors[start : start + toxicity.WINDOW]
        if row:
            both = np.array([np.concatenate(x) for x in zip(run("f", row), run("b", row[::-1])[::-1])])
            e = np.exp(np.tanh(both @ p["attend"] + p["attend_b"]) @ p["focus"])
            pooled = (e / e.sum()) @ both
        else:
            pooled = np.zeros(2 * h)
        numbers.append(pooled @ p["out"] + p["out_b"][0])
        start += toxicity.STRIDE
        if start + toxicity.WINDOW - toxicity.STRIDE >= len(words):
            return np.log(np.exp(numbers).sum())


def test_scores_equal_a_plain_forward_pass():
    model = toxicity.Model(3)
    r = random.Random(9)
    rows = [" ".join(r.choice(["alpha", "be", "γάμμα", "delta7"]) for _ in range(n)) for n in (1, 2, 47, 48, 49, 84, 85, 200)] + ["", None]
    got = model.scores(rows)
    assert np.allclose(got, [plain_score(model, t) for t in rows], atol=1e-4)


def test_held_out_accuracy_on_the_table(spark):
    """Learned and scored as the query does it: documents of a small table that were held out."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs.join(labels, "doc_id").filter(toxicity.held_out("doc_id")).select("doc_id", "text", "toxic"), model).collect()
    toxic, clean = ([r.score for r in rows if r.toxic == y] for y in (1, 0))
    assert toxic and clean
    assert np.mean([[a > b for b in clean] for a in toxic]) > 0.85
    assert np.mean([x < 0.5 for x in clean]) > 0.9


def test_long_texts_teach_by_a_window(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "LONGEST", 10)
    monkeypatch.setattr(toxicity, "train", lambda t, y: seen.extend(t))
    docs = spark.createDataFrame([(1, "short"), (1, "sh"), (2, "abcdefghijklmnopqrst"), (3, None), (4, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 5)], "doc_id long, toxic int")
    toxicity.fit(docs, labels)
    want = {1: "short", 2: "abcdefghijklmnopqrst", 3: None, 4: ""}
    want = [t for i, t in want.items() if zlib.crc32(str(i).encode()) % 5]
    assert len(seen) == len(want)
    assert all(x == t if x is None or len(t) <= 10 else len(x) == 10 and x in t for x, t in zip(seen, want))


def test_fit_never_sees_held_out_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda t, y: seen.extend(zip(t, y)))
    docs = spark.createDataFrame([(i, str(i)) for i in range(60)] + [(None, "n")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2 if i != 7 else None) for i in range(80)] + [(3, 1), (None, 1)], "doc_id long, toxic int")
    toxicity.fit(docs, labels)
    want = {str(i) for i in range(60) if zlib.crc32(str(i).encode()) % 5 and i != 7}
    assert {t for t, _ in seen} == want and len(seen) == len(want)


def test_one_class_only():
    assert (toxicity.train(["a", "b"], [0, 0]).scores(["c", None]) < 0).all()
    assert (toxicity.train([], []).scores(["c"]) < 0).all()
