import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__
from logloom.llm import chat
from logloom.llm.queries import BPE, op10_chat_format

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
PARTS = st.lists(st.sampled_from(["[INST]", "[/INST]", "</s>", "[", "]", "\\", "/", "s", ">", "<", "INST]", "/INST]", "/s>", "a ", "\n"]), max_size=12).map("".join)


def expected(turns):
    learnt = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learnt), sha(learnt)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(PARTS, PARTS), max_size=4))
def test_render_is_reversible(turns):
    assert chat.parse(chat.render(turns)[0]) == turns
    for _, text in turns:
        assert not any(c in chat.escape(text) for c in (chat.OPEN, chat.SAYS, chat.END))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), PARTS), max_size=4))
def test_mask_covers_the_assistant_texts(turns):
    t = _tokenizer()
    formatted, spans = chat.render(turns)
    at = np.array(t.encode(formatted, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
    loss = chat.mask(spans, at[:, 0], at[:, 1])
    assert chat.masked_text(formatted, at[:, 0], at[:, 1], loss) == [x for r, x in turns if r == "assistant" and x]


_HELD = []


def _tokenizer():
    if not _HELD:
        _HELD.append(chat.chat_tokenizer(BPE))
    return _HELD[0]


def test_query_against_plain_python(spark):
    rows = [(r.conv_id, r.turn, r.role or "", r.text or "") for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()]
    control = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", control), (-7, 1, "assistant", control)]
    by = {}
    for c, _, r, t in sorted(rows):
        by.setdefault(c, []).append((r, t))
    got = {r.conv_id: r for r in op10_chat_format(spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == expected(turns)
        assert r.formatted_chars == len(chat.render(turns)[0])


def test_odd_conversations(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "hi"), (2, 0, None, "x"), (2, None, "user", "first"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (None, 0, "user", "lost"), (4, 0, "assistant", "🙂 é" * 9000), (5, 0, "assistant", "</s>"), (5, 1, "assistant", "\\[INST]")]
    table = spark.createDataFrame([(*r, "x", 3) for r in rows], "conv_id long, turn long, role string, text string, loss string, ids int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(table, BPE)).collect()}
    want = {1: [("user", "hi"), ("assistant", "")], 2: [("user", "first"), ("", "x")], 3: [("assistant", "same")] * 2, None: [("user", "lost")], 4: [("assistant", "🙂 é" * 9000)], 5: [("assistant", "</s>"), ("assistant", "\\[INST]")]}
    assert set(got) == set(want)
    for c, turns in want.items():
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == expected(turns)


def test_no_conversations(spark):
    assert chat.read_back(chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), BPE)).count() == 0


def test_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries()
