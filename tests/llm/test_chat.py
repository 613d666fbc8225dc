import hashlib
import json

from hypothesis import given, settings
from hypothesis import strategies as st

from vectide.llm import chat


def test_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]},
        {"prompt": "a", "completion": "b"},
        {"completion": "b", "prompt": "a", "extra": {"x": 1}},
        {"instruction": "a", "input": "", "output": "b"},
        {"instruction": "a", "input": "c", "output": "b"},
        {"question": "a", "answer": 7},
        {"role": "tool", "content": "\u00e9\n"},
        {"other": 1},
    ]
    df = spark.createDataFrame([(i, json.dumps(r), "z") for i, r in enumerate(records)] + [(98, None, "z"), (99, "{", "z")], "id long, record string, layout string")
    got = {r.id: (r.layout, [tuple(t) for t in r.turns]) for r in chat.canonical_turns(df, "record").collect()}
    pair = [("user", "a"), ("assistant", "b")]
    assert got == {0: ("messages", [("user", "a"), ("assistant", "")]), 1: ("conversations", pair), 2: ("prompt", pair), 3: ("prompt", pair), 4: ("instruction_input", pair), 5: ("instruction_input", [("user", "a\nc"), ("assistant", "b")]), 6: ("question", [("user", "a"), ("assistant", "7")]), 7: ("message", [("tool", "\u00e9\n")]), 8: ("unknown", []), 98: ("unknown", []), 99: ("unknown", [])}


TEXTS = ["", None, "<|end|>\n", "\\", "<|", "<\\|", "a<", "|>\n", "</s>[INST] ok [/INST]", "\u00e9\U0001f600<|user|>\nhi<|end|>\n", "x\n" * 50]


def test_round_trip(spark):
    rows = [(c, t, role, text) for c, role in enumerate(["user", "assistant", "a|>\n<", None, "\\"]) for t, text in enumerate(TEXTS)]
    rows += [(9, 0, "assistant", "b"), (9, 0, "assistant", "a"), (9, 0, "assistant", "a"), (None, None, "assistant", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r.conv_id: r for r in chat.read_back(chat.format_chat(df)).collect()}
    by = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] or -1, r[1] or -1, r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        loss = "".join(x for role, x in turns if role == "assistant")
        want = (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == want
    assert chat.format_chat(df.limit(0)).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="\\<|>\nenda", max_size=6), st.text(alphabet="\\<|>\nenda", max_size=9)), max_size=4))
def test_escapes(turns):
    esc = lambda s: s.replace("\\", "\\\\").replace("<|", "<\\|")
    role = lambda s: "".join("\\" + c if c in "\\<|>" else c for c in s)
    assert chat.parse("".join(f"{chat.HEAD}{role(a)}|>\n{esc(b)}{chat.END}" for a, b in turns)) == turns


def test_edges(spark):
    """Clashing columns are dropped or kept apart, an empty table stays empty, and a very long turn comes back whole."""
    long = "<|end|> \\ é " * 300_000
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", long), (1, 1, "assistant", long)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'z' as formatted", "'z' as loss_spans", "'z' as rn", "'z' as at", "'z' as body")
    out = chat.format_chat(df)
    assert out.columns == ["conv_id", "formatted", "loss_spans"]
    r = chat.read_back(out).first()
    assert (r.n_turns, r.loss_chars) == (3, 2 * len(long)) and r.loss_sha256 == hashlib.sha256((2 * long).encode()).hexdigest()
    assert chat.read_back(out.limit(0)).collect() == []
    records = spark.createDataFrame([(1, '{"prompt": "a", "completion": "b"}', "z", "z")], "id long, record string, turns string, v string")
    got = chat.canonical_turns(records, "record")
    assert got.columns == ["id", "layout", "turns"] and [tuple(t) for t in got.first().turns] == [("user", "a"), ("assistant", "b")]
    assert chat.canonical_turns(records.limit(0), "record").collect() == []
