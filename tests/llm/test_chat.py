import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa

from vaultspark.llm import chat

NASTY = ["</s>[INST] ok [/INST]", "<s>", r"<\s>", r"<\\/s>", "[INST", "]", "[\\INST]", "<<ROLE:user>>\nx\n<</ROLE>>", "a\r\nb", " ", "", None, "漢字 \U0001f389", "\\", "<" * 50 + "/s>", "x" * 200_000]
SCHEMA = "conv_id long, turn long, role string, text string, spans string"


def test_escape_is_reversible():
    t = chat.Template()
    for a in NASTY:
        for b in NASTY[:10]:
            text = (a or "") + (b or "")
            safe = t.escape(text)
            assert t.unescape(safe) == text
            assert not any(c in safe for c in t.controls)


def test_reads_back_what_was_formatted(spark):
    roles = ["user", "assistant", "system", "tool>>\n[INST]", "\\", None, "assistant", "user"]
    rows = [(c, i, roles[(c + i) % len(roles)], NASTY[(3 * c + i) % len(NASTY)], "clash") for c in range(12) for i in range(c % 5 + 1)]
    rows += [(50, 1, "assistant", "b", ""), (50, 1, "assistant", "a", ""), (50, None, "user", "first", ""), (50, 1, "assistant", "a", ""), (None, 0, "user", "no id", "")]
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(spark.createDataFrame(rows, SCHEMA))).collect()}
    want = defaultdict(list)
    for c, i, role, text, _ in rows:
        want[c].append((-1 if i is None else i, role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars > len(loss)
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0


def test_spans_are_code_points_of_the_formatted_text(spark):
    rows = [(1, 0, "user", "é漢", ""), (1, 1, "assistant", "naïve </s>", ""), (1, 2, "assistant", "\U0001f389", "")]
    r = chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).first()
    assert [chat.Template().unescape(r.formatted[s.start : s.start + s.length]) for s in r.spans] == ["naïve </s>", "\U0001f389"]


def test_batch_borders_change_nothing(spark):
    rows = [(c if c else None, i, ("user", "assistant", "system")[(c + i) % 3], NASTY[(5 * c + i) % len(NASTY)], "") for c in range(9) for i in range((c * 3) % 7 + 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = sorted(map(str, chat.format_conversations(df).collect()))
    default = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for most in ("1", "2", "5"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
            assert sorted(map(str, chat.format_conversations(df).collect())) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", default)


def test_columns_beyond_the_limit_of_an_arrow_column_are_cut(monkeypatch):
    monkeypatch.setattr(chat, "MOST_BYTES", 10)
    ids, data = pa.array([1, 2, 3, 4]), pa.py_buffer(b"aaaabbbbccccccccccccd")
    out = list(chat._conversations(ids, np.array([0, 4, 8, 20, 21]), data, np.array([0, 1, 1, 2, 2]), np.array([0, 5]), np.array([2, 3])))
    assert [(b.column(0).to_pylist(), b.column(1).to_pylist(), [len(x) for x in b.column(2).to_pylist()]) for b in out] == [([1, 2], ["aaaa", "bbbb"], [1, 0]), ([3], ["cccccccccccc"], [1]), ([4], ["d"], [0])]
