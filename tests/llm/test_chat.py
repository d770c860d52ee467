"""Layouts, template and digests of chat formatting against plain computation."""

import hashlib
import json
import random

import pyarrow.parquet as pq
import pytest

from sportlake.llm import chat, registry

ODD = ["", "\\### Assistant: </turn> ok", "### User: hi</turn>\n", "####", "<", "</", "<</turn>", "\\", "\\\\h", "\\h\\c\\\\c", "#\\#", "a: b\n: </turn>\n### @x: ", "é日😀", "\\d\\n", "</turn>\n" * 3, "@"]


def test_texts_and_roles_come_back():
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice("\\#</turn>:@hcdn \n") for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    for t in texts:
        assert chat.unescaped(chat.escaped(t)) == t
        assert "#" not in chat.escaped(t) and chat.END not in chat.escaped(t)
    turns = [(rng.choice(["user", "assistant", "system", "User", "tool", *ODD]), t) for t in texts]
    piece = "".join(chat.head(r) + chat.escaped(t) + chat.END for r, t in turns)
    assert chat.parsed(piece) == turns


RECORDS = [
    ("turn rows", {"conv_id": 4, "turn": 2, "role": "user", "text": "a"}, [(4, 2, "user", "a")]),
    ("turn rows", {"conv_id": 4, "turn": 3, "prompt": "not this"}, [(4, 3, "", "")]),
    ("messages", {"id": 1, "messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}], "text": "beside"}, [(1, 0, "user", "a"), (1, 1, "assistant", "")]),
    ("messages", {"conv_id": 1, "system": "s", "messages": [{"role": "user", "content": "a"}]}, [(1, 0, "system", "s"), (1, 1, "user", "a")]),
    ("messages in parts", {"id": 2, "messages": [{"role": "user", "content": [{"text": "a"}, {"text": "b"}]}, {"role": "assistant", "content": [{"text": "c"}]}]}, [(2, 0, "user", "ab"), (2, 1, "assistant", "c")]),
    ("from and value", {"id": 3, "conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}, {"from": "tool", "value": "c"}]}, [(3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 2, "tool", "c")]),
    ("request and response", {"id": 5, "request": {"messages": [{"role": "user", "content": "a"}]}, "response": {"choices": [{"message": {"content": "b"}}]}}, [(5, 0, "user", "a"), (5, 1, "assistant", "b")]),
    ("instruction", {"id": 6, "instruction": "do", "input": "", "output": "done"}, [(6, 0, "user", "do"), (6, 1, "assistant", "done")]),
    ("instruction", {"id": 6, "system": "be", "instruction": "do", "input": "it", "output": "done", "seen": [1, 2]}, [(6, 0, "system", "be"), (6, 1, "user", "do\n\nit"), (6, 2, "assistant", "done")]),
    ("instruction and response", {"id": 7, "instruction": "do", "context": "here", "response": "done"}, [(7, 0, "user", "do\n\nhere"), (7, 1, "assistant", "done")]),
    ("prompt", {"id": 8, "prompt": "p", "completion": 5}, [(8, 0, "user", "p"), (8, 1, "assistant", "5")]),
    ("question", {"conversation_id": 9, "question": "q", "answer": "a"}, [(9, 0, "user", "q"), (9, 1, "assistant", "a")]),
    ("turn rows in part", {"text": "alone"}, [(None, None, "", "alone")]),
]
NOT_MAPPED = [None, "", "[1]", "{", '{"other": 1}', '{"prompt": "no answer"}', "{}", "3", "[" * 100000]


def test_layouts(spark):
    rows = [(json.dumps(r),) for _, r, _ in RECORDS] + [(x,) for x in NOT_MAPPED]
    records = spark.createDataFrame(rows, "record string").repartition(3)
    got = sorted(map(repr, map(tuple, chat.canonical_turns(records).collect())))
    assert got == sorted(repr((*t, name)) for name, _, turns in RECORDS for t in turns)
    assert sorted(map(str, (r["record"] for r in chat.unmapped(records).collect()))) == sorted(map(str, NOT_MAPPED))


def test_fingerprints_depend_on_paths_alone():
    layouts = chat.Layouts()
    a, b = {"prompt": "x", "response": "y"}, {"response": {"a": 1}, "prompt": 3, "more": None}
    assert chat.fingerprint(layouts.known & chat.field_paths(a)) == chat.fingerprint(layouts.known & chat.field_paths(b))
    assert chat.field_paths({"a": [{"b": 1}, {"c": [2]}], "d": None}) == {"a", "a[].b", "a[].c"}
    sets = [p for m in chat.LAYOUTS for p in chat.allowed(m)]
    assert len({chat.fingerprint(p) for p in sets}) == len(set(sets))
    odd = json.loads('{"id": "x", "prompt": "p", "response": "r"}')
    (first, _) = chat.turns_of(odd, layouts.of(odd))
    assert isinstance(first[0], int) and first[0] == chat.number("x")


def plain(rows):
    """conv_id, turn, role, text of every row: what digests() gives, but for the length of the formatted text."""
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, (r or "").encode(), (x or "").encode()))
    out = {}
    for c, turns in by.items():
        turns.sort()
        said = b"".join(x for _, _, r, x in turns if r == b"assistant")
        out[c] = (len(turns), hashlib.sha256(b"".join(r + b"\n" + x + b"\n" for _, _, r, x in turns)).hexdigest(), len(said.decode()), hashlib.sha256(said).hexdigest())
    return out


def compared(got, rows):
    want = plain(rows)
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == want and len(got) == len(want)
    assert all(r["formatted_chars"] >= r["loss_chars"] + r["n_turns"] * len(chat.END) for r in got)


def test_query_equals_plain_computation(spark, small):
    t = pq.read_table(f"{small}/conversations.parquet").to_pylist()
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in t] + [(-7, k, r, "\\### Assistant: </turn> ok") for k, r in enumerate(("user", "assistant"))]
    compared(registry.QUERIES["op11_chat"](spark, small).collect(), rows)


@pytest.mark.parametrize("piece,turns", [(1 << 16, 4096), (30, 3)])
def test_odd_conversations(spark, monkeypatch, piece, turns):
    rng = random.Random(6)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([0, 1, 2, 7, None, -3]), rng.choice(["user", "assistant", "system", "", None, "Tool: x"]), rng.choice([*ODD, None])) for _ in range(200)]
    rows += rows[:20] + [(4, k, "assistant", "x" * k) for k in range(300)] + [(5, 0, "assistant", "y#" * 200_000)]
    monkeypatch.setattr(chat, "TURNS", turns)
    monkeypatch.setattr(chat, "PIECE", piece)
    df = spark.createDataFrame([(*r, "p", 1, None) for r in rows], "conv_id long, turn long, role string, text string, prompt string, record int, messages array<string>").repartition(5)
    records = chat.records_of(df)
    lost = [r for r in rows if all(x is None for x in r)]
    pieces = chat.formatted(chat.canonical_turns(records)).collect()
    frame = spark.createDataFrame(pieces, chat.PIECES).repartition(4)
    compared(chat.digests(frame).collect(), [r for r in rows if r not in lost])
    for p in pieces:  # the mask covers the assistant's texts and nothing else
        said = [chat.escaped(t) for r, t in chat.parsed(p["formatted"]) if r == "assistant" and t]
        assert [p["formatted"][s["start"] : s["end"]] for s in p["loss"]] == said


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.formatted(chat.canonical_turns(chat.records_of(empty)))).count() == 0
