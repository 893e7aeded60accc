import random
import zlib

import numpy as np

from vaultspark.llm import compression_quality as quality


def texts(n, seed, size=120):
    """Prose of invented words, and the same with marks stuck to words, shouted, or one word over and over."""
    r = random.Random(seed)
    words = ["".join(random.Random(k).choice(["th", "er", "on", "an", "re", "in", "st", "ou"]) for _ in range(1 + k % 4)) for k in range(400)]
    out, good = [], []
    for k in range(n):
        own = [r.choice(words) for _ in range(r.randint(size // 4, size * 2))]
        kind = k % 6
        if kind == 0:
            own = [w + r.choice(["$$$", "%%%", "&&&"]) for w in own]
        elif kind == 1:
            own = [w.upper() + "!!" for w in own]
        out.append(" ".join(own))
        good.append(int(kind > 1))
    return out, good


def test_tells_held_out_texts_of_every_length(spark):
    model = quality.train(*texts(600, 1))
    test, good = texts(180, 2)
    long, long_good = texts(6, 3, 40_000)
    rows = [(i, t, 1.0, "a") for i, t in enumerate(test + long)] + [(900, None, 1.0, "b"), (901, "", 1.0, "b"), (0, test[0], 1.0, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double, good string")
    got = quality.score(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    right = [(by[i] >= 0.5) == bool(y) for i, y in enumerate(good + long_good)]
    assert np.mean(right) > 0.97 and all(right[-6:])
    assert by[900] == by[901]
    assert quality.score(df.limit(0), model).count() == 0


def test_every_piece_of_a_text_counts():
    model = quality.train(*texts(600, 1))
    prose, junk = (" ".join(t for t, y in zip(*texts(60, 4)) if y == c) for c in (1, 0))
    d = lambda t: quality.differences([t.encode()], model.good, model.bad)[0]
    whole = (prose[:40_000] + junk[:40_000]).encode()
    parts = [whole[k : k + quality.PIECE] for k in range(0, len(whole), quality.PIECE)]
    assert np.isclose(d(whole.decode()) * (len(whole) + 1) ** 0.5, sum(d(p.decode()) * (len(p) + 1) ** 0.5 for p in parts))
    assert d(prose[:40_000]) > d(whole.decode()) > d(junk[:40_000])


def test_scores_are_calibrated():
    """Of texts that score about p, a share of about p is good; labels that say nothing give their share."""
    r = random.Random(6)
    rows, _ = texts(800, 5)
    flips = [int(r.random() < 0.8) for _ in rows]
    model = quality.train(rows, flips)
    p = 1 / (1 + np.exp(-(model.slope * quality.differences([t.encode() for t in rows], model.good, model.bad) + model.offset)))
    assert abs(p.mean() - 0.8) < 0.06
    assert quality.train(rows, flips, share=0.3).offset < model.offset - 1.5


def test_passages_that_texts_share_mark_no_class():
    rows, good = texts(300, 7)
    passage = "one passage that is copied about among many of the bad texts and some others"
    rows = [t + "\n" + passage if not y else t for t, y in zip(rows, good)]
    model = quality.train(rows, good)
    assert passage.encode() not in model.bad and passage.encode() not in model.good


def test_one_class_few_rows_and_none():
    for rows, good in (([], []), (["a"], [1]), (["a", "b"], [1, 1]), (["a", None, "c"], [1, 0, 0]), ([None] * 8, [1, 0] * 4)):
        model = quality.train(rows, good)
        assert model.good is None and model.slope == 0
    few = quality.train(["good words here", "more good words", "BAD!! BAD!!", "WORSE!! BAD!!"], [1, 1, 0, 0])
    assert np.isfinite([few.slope, few.offset]).all()


def test_fit_never_sees_held_out_rows_and_long_texts_teach(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "train", lambda t, y, share: seen.append((sorted(zip(map(str, t), y)), share)))
    monkeypatch.setattr(quality, "WINDOW", 5)
    docs = spark.createDataFrame([(i, f"{i:05}" if i % 2 else f"{i:02}" * 50) for i in range(60)] + [(61, None), (None, "n"), (3, "00")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3 and 1 if i != 7 else None) for i in range(80)] + [(3, 1), (None, 1)], "doc_id long, quality int")
    quality.fit(docs, labels)
    (rows, share), = seen
    taught = [i for i in range(62) if zlib.crc32(str(i).encode()) % 4 != 2 and i not in (7, 60)]
    assert len(rows) == len(taught) and sum(y for _, y in rows) == sum(1 if i == 3 else int(i % 3 > 0) for i in taught)
    assert all(len(t) == 5 for t, _ in rows if t != "None") and 0.6 < share < 0.75
    assert {t for t, _ in rows if t.startswith("000") and t != "00000"} == {f"{i:05}" for i in taught if i % 2 and i < 60}


def test_held_out_quality_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels)
    rows = quality.score(docs.join(labels, "doc_id").filter(quality.held_out("doc_id")).select("doc_id", "text", "quality"), model).collect()
    good, bad = ([r.score for r in rows if r.quality == y] for y in (1, 0))
    assert good and bad
    assert np.mean([[a > b for b in bad] for a in good]) > 0.95
    assert np.mean([x >= 0.7 for x in good]) > 0.9 and np.mean([x < 0.7 for x in bad]) > 0.9
