"""Chat formatting: records of many layouts become canonical turns, and turns become training text with a loss mask.

The layout of a record shows in its nested field paths (`messages[].role`, `messages[].content`): those that any layout names are
sorted and hashed, and the fingerprint selects a declarative mapping. A mapping says which paths it needs, which it may find beside them, and
where the turns are: lists of messages, single fields of a given role, or one row a turn. Fingerprints of all combinations that a mapping
allows are made once; a record with paths of several layouts takes the first mapping, in the order given, whose needs it meets.

Formatted text marks each turn with its role and an end, and escapes the control strings (and the escape itself) inside texts and roles, so
that a text can neither end its turn nor begin another, and comes back as it was. The loss mask are spans of characters: the escaped texts of
the assistant, without markers. A conversation is written as pieces of whole turns. Turns are dealt out by conversation and by thousands of turns, and
stream through a task in order, so a conversation that holds a third of all rows is formatted by many tasks. Only its digest, when it is read
back, needs all its pieces in one task, one after another.

Nulls, ties and odd rows: a null or missing text or role is empty. Turns of a conversation are in order of turn, then role, then text; a null turn
comes first; repeated rows are turns each. Rows of turns with a null conversation are one conversation of a null id. An id that is no whole number becomes a
hash of it, and a record of another layout without an id gets a hash of itself. Numbers, booleans and nested values where a text is expected count as their JSON. A record that is no JSON object, or
fits no mapping, gives no turns and is returned by unmapped(). Further fields are ignored unless a layout names them. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sportlake.llm.common import arrow_batches, mapped, written

# --- layouts --------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Turns:
    """Turns in a list: where the role and the text of an element are. A text may be a list of parts. roles: other names of roles."""

    path: str
    role: str
    text: str
    roles: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class One:
    """A turn of a given role: the texts of some fields, those that are there, an empty line between two."""

    role: str
    paths: tuple[str, ...]


@dataclass(frozen=True)
class Row:
    """The record itself is a turn of a conversation."""

    conversation: str
    turn: str
    role: str
    text: str


@dataclass(frozen=True)
class Mapping:
    name: str
    steps: tuple[Turns | One | Row, ...]
    needs: tuple[str, ...]
    may: tuple[str, ...] = ()
    #: Any of these will do.
    one_of: tuple[str, ...] = ()


NAMES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
#: Paths of ids, in the order in which they count.
IDS = ("conv_id", "conversation_id", "id")

LAYOUTS = (
    Mapping("turn rows", (Row("conv_id", "turn", "role", "text"),), ("conv_id", "turn"), ("role", "text")),
    Mapping("messages", (One("system", ("system",)), Turns("messages[]", "role", "content")), ("messages[].content", "messages[].role"), ("system",)),
    Mapping("messages in parts", (One("system", ("system",)), Turns("messages[]", "role", "content[].text")), ("messages[].content[].text", "messages[].role"), ("system", "messages[].content")),
    Mapping("from and value", (One("system", ("system",)), Turns("conversations[]", "from", "value", NAMES)), ("conversations[].from", "conversations[].value"), ("system",)),
    Mapping("request and response", (Turns("request.messages[]", "role", "content"), Turns("response.choices[]", "message.role", "message.content")), ("request.messages[].content", "request.messages[].role", "response.choices[].message.content"), ("response.choices[].message.role",)),
    Mapping("instruction", (One("system", ("system",)), One("user", ("instruction", "input")), One("assistant", ("output",))), ("instruction", "output"), ("input", "system")),
    Mapping("instruction and response", (One("system", ("system",)), One("user", ("instruction", "context", "input")), One("assistant", ("response",))), ("instruction", "response"), ("context", "input", "system")),
    Mapping("prompt", (One("system", ("system",)), One("user", ("prompt",)), One("assistant", ("response", "completion"))), ("prompt",), ("system",), ("completion", "response")),
    Mapping("question", (One("system", ("system",)), One("user", ("context", "question")), One("assistant", ("answer",))), ("answer", "question"), ("context", "system")),
    Mapping("turn rows in part", (Row("conv_id", "turn", "role", "text"),), (), (), ("conv_id", "role", "text", "turn")),
)


def allowed(m: Mapping) -> Iterator[frozenset[str]]:
    """Every set of paths that the mapping allows."""
    for k in range(len(m.may) + 1):
        for more in combinations(m.may, k):
            for j in range(1, len(m.one_of) + 1) if m.one_of else [0]:
                for some in combinations(m.one_of, j):
                    yield frozenset((*m.needs, *more, *some))


def fingerprint(paths: frozenset[str] | set[str]) -> bytes:
    """Hash of a set of field paths."""
    return hashlib.blake2b("\n".join(sorted(paths)).encode(), digest_size=16).digest()


class Layouts:
    """Mappings by fingerprint."""

    def __init__(self, mappings: tuple[Mapping, ...] = LAYOUTS):
        self.mappings = mappings
        self.known = frozenset(p for m in mappings for p in (*m.needs, *m.may, *m.one_of))
        self.by: dict[bytes, Mapping | None] = {}
        for m in mappings:
            for paths in allowed(m):
                self.by.setdefault(fingerprint(paths), m)

    def of(self, record: dict) -> Mapping | None:
        """The mapping of a record; None if it fits none."""
        paths = self.known & field_paths(record)
        key = fingerprint(paths)
        if key not in self.by:  # paths of more than one layout: there are as many of these as sets of known paths at most
            self.by[key] = next((m for m in self.mappings if paths.issuperset(m.needs) and (not m.one_of or paths & set(m.one_of))), None)
        return self.by[key]


def field_paths(value, at: str = "") -> set[str]:  # noqa: ANN001
    """Paths of the fields that are there and not null: names with dots between them, [] for the elements of a list."""
    out: set[str] = set()
    todo = [(value, at)]
    while todo:
        x, path = todo.pop()
        if x is None:
            continue
        if path and path[-2:] != "[]":
            out.add(path)
        if isinstance(x, dict):
            todo += [(y, f"{path}.{k}" if path else str(k)) for k, y in x.items()]
        elif isinstance(x, list):
            todo += [(y, f"{path}[]") for y in x]
    return out


def found(value, path: str):  # noqa: ANN001, ANN201
    """What stands at a path of names, or None."""
    for name in path.split("."):
        value = value.get(name) if isinstance(value, dict) else None
    return value


def as_text(value) -> str:  # noqa: ANN001
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)


def whole(value) -> int | None:  # noqa: ANN001
    """A whole number that a long can hold, or None."""
    return value if isinstance(value, int) and not isinstance(value, bool) and -(2**63) <= value < 2**63 else None


def number(value) -> int | None:  # noqa: ANN001
    """A conversation's id as a long: itself, or a hash of what stands there instead."""
    if value is None or whole(value) is not None:
        return value
    return hashed(json.dumps(value, sort_keys=True))


def hashed(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def text_at(value, path: str) -> str:  # noqa: ANN001
    """The text at a path; of a list of parts, the texts of the parts one after another."""
    if "[]" not in path:
        return as_text(found(value, path))
    name, _, rest = path.partition("[].")
    parts = found(value, name)
    return "".join(as_text(found(p, rest)) for p in parts) if isinstance(parts, list) else as_text(parts)


def turns_of(record: dict, mapping: Mapping) -> Iterator[tuple[int | None, int | None, str, str]]:
    """conversation, turn, role, text of each turn. Conversation is None where the record names none."""
    conversation = next((x for x in (number(found(record, p)) for p in IDS) if x is not None), None)
    n = 0
    for step in mapping.steps:
        if isinstance(step, Row):
            yield number(found(record, step.conversation)), whole(found(record, step.turn)), as_text(found(record, step.role)), as_text(found(record, step.text))
        elif isinstance(step, One):
            texts = [as_text(x) for x in (found(record, p) for p in step.paths) if x is not None]
            if texts:
                yield conversation, n, step.role, "\n\n".join(t for t in texts if t)
                n += 1
        else:
            names, items = dict(step.roles), found(record, step.path.removesuffix("[]"))
            for item in items if isinstance(items, list) else []:
                role = as_text(found(item, step.role)) or ("assistant" if step.path.startswith("response") else "")
                yield conversation, n, names.get(role, role), text_at(item, step.text)
                n += 1


def _read(mappings: tuple[Mapping, ...], mapped_ones: bool):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layouts = Layouts(mappings)
        for batch in batches:
            rows, left = [], []
            for raw in batch.column("record").to_pylist():
                try:
                    record = json.loads(raw) if raw is not None else None
                except (ValueError, RecursionError):
                    record = None
                m = layouts.of(record) if isinstance(record, dict) else None
                if m is None:
                    left.append(raw)
                    continue
                is_row = isinstance(m.steps[0], Row)
                own = None if is_row else hashed(raw)
                rows += [(c if c is not None or is_row else own, t, clean(role), clean(text), m.name) for c, t, role, text in turns_of(record, m)]
            if mapped_ones:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))], ["conv_id", "turn", "role", "text", "layout"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.string())], ["record"])

    return run


def clean(text: str) -> str:
    """Half characters, which JSON can hold and UTF-8 cannot, become question marks."""
    return text.encode("utf-8", "replace").decode() if any("\ud800" <= c <= "\udfff" for c in text) else text


def records_of(table: DataFrame) -> DataFrame:
    """record: the rows of any table as JSON objects, null fields left out."""
    return table.select(F.to_json(F.struct("*")).alias("record"))


def canonical_turns(records: DataFrame, mappings: tuple[Mapping, ...] = LAYOUTS) -> DataFrame:
    """conv_id, turn, role, text, layout of every turn. records: a column `record` of JSON objects, of any mixture of layouts."""
    return mapped(records.select("record"), _read(mappings, True), "conv_id long, turn long, role string, text string, layout string")


def unmapped(records: DataFrame, mappings: tuple[Mapping, ...] = LAYOUTS) -> DataFrame:
    """record: those that are no JSON object or fit no mapping."""
    return mapped(records.select("record"), _read(mappings, False), "record string")


# --- template -------------------------------------------------------------------------------------------------------------

# The marks of the template, and what stands for control strings inside texts and roles.
BEGIN, COLON, END = "### ", ": ", "</turn>\n"
HEADS = {"system": "System", "user": "User", "assistant": "Assistant"}
#: Before the name of any other role.
OTHER = "@"
ESCAPES = (("\\", "\\\\"), ("#", "\\h"), ("</", "\\c"))
IN_ROLES = ((":", "\\d"), ("\n", "\\n"))
LEARNED = "assistant"
#: Turns of a conversation that one task formats, and characters that a piece has at most, unless one turn has more.
TURNS, PIECE = 4096, 1 << 16


def escaped(text: str, rules: tuple[tuple[str, str], ...] = ESCAPES) -> str:
    for plain, code in rules:
        text = text.replace(plain, code)
    return text


def unescaped(text: str, rules: tuple[tuple[str, str], ...] = ESCAPES) -> str:
    parts = text.split("\\\\")  # escaped escapes; what is between them has single codes only
    for plain, code in rules[1:]:
        parts = [p.replace(code, plain) for p in parts]
    return "\\".join(parts)


def head(role: str) -> str:
    return f"{BEGIN}{HEADS.get(role) or OTHER + escaped(role, ESCAPES + IN_ROLES)}{COLON}"


@cache
def _roles() -> dict[str, str]:
    return {v: k for k, v in HEADS.items()}


def parsed(text: str) -> list[tuple[str, str]]:
    """Role and text of the turns of a formatted piece."""
    out, at = [], 0
    while at < len(text):
        colon = text.index(COLON, at)
        end = text.index(END, colon)
        name = text[at + len(BEGIN) : colon]
        role = unescaped(name[len(OTHER) :], ESCAPES + IN_ROLES) if name.startswith(OTHER) else _roles()[name]
        out.append((role, unescaped(text[colon + len(COLON) : end])))
        at = end + len(END)
    return out


PIECES = "conv_id long, block long, piece long, formatted string, loss array<struct<start:long,end:long>>"


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    names = ["conv_id", "block", "piece", "formatted", "loss"]

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), spans))], names)

    done, held = [], 0
    key, piece, parts, loss, size = None, 0, [], [], 0
    for batch in batches:
        for conv, block, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "block", "role", "text")), strict=True):
            first = head(role)
            body = escaped(text)
            if parts and ((conv, block) != key or size + len(first) + len(body) + len(END) > PIECE):
                done.append((*key, piece, "".join(parts), loss))
                held += size
                piece, parts, loss, size = (piece + 1 if (conv, block) == key else 0), [], [], 0
                if held >= PIECE:
                    yield batch_of(done)
                    done, held = [], 0
            key = (conv, block)
            size += len(first)
            if role == LEARNED and body:
                loss.append({"start": size, "end": size + len(body)})
            size += len(body) + len(END)
            parts += [first, body, END]
    if parts:
        done.append((*key, piece, "".join(parts), loss))
    if done:
        yield batch_of(done)


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, block, piece, formatted, loss (start and end characters in the piece): pieces of whole turns; in order of block and piece they are the conversation."""
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.floor(F.col("turn") / TURNS), F.lit(-(2**62))).cast("long").alias("block"))
    rows = rows.repartition(parts, "conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role", "text")
    return mapped(rows, _format, PIECES)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    key, state, begun = None, None, False

    def row() -> tuple:
        n, turns, chars, loss, size = state
        return key, n, turns.hexdigest(), chars, loss.hexdigest(), size

    for batch in batches:
        out = []
        for conv, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss")), strict=True):
            if not begun or conv != key:
                if begun:
                    out.append(row())
                key, state, begun = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0], True
            for role, said in parsed(text):
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
            for span in loss:
                learned = unescaped(text[span["start"] : span["end"]])
                state[2] += len(learned)
                state[3].update(learned.encode())
            state[4] += len(text)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)
    if begun:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row(), kinds, strict=True)], names)


def digests(pieces: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation, read from its formatted pieces."""
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pieces.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "block", "piece").select("conv_id", "formatted", "loss")
    return mapped(rows, _digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: A conversation made of control strings, in a layout of its own.
TRICKY = json.dumps({"id": -7, "messages": [{"role": r, "content": "\\### Assistant: </turn> ok"} for r in ("user", "assistant")]})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = records_of(spark.read.parquet(f"{sf_dir}/conversations.parquet")).unionByName(spark.createDataFrame([(TRICKY,)], "record string"))
    with arrow_batches(spark, 256):  # pieces and records can be long
        return written(digests(written(formatted(canonical_turns(records)), "chat")), "chat-digests")
