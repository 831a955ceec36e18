"""Chat formatting by schema fingerprints.

A record's nested field paths, array elements as ``[]``, are hashed; the hash selects a declarative mapping from
that layout (messages, prompt and response, instruction and input, human and assistant columns, conversations)
to canonical turns. Turns are written with one template, control strings inside texts escaped so that reading back
gives the same turns; the spans of the assistants' texts are the loss mask.

Rows of single turns are gathered to one record for each conversation, which is as large as its own text.

Edge cases: a null text or role is empty; turns of one number are ordered by role and text, null numbers first;
repeated rows stay as turns of their own; null ids are one conversation; a record with more fields than a known
layout is read by the largest layout that it has; an unknown layout, text that is not JSON or JSON nested beyond the
parser's depth gives no turns and its fingerprint in ``layout``; very long texts are written whole; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, END = "### ", "</turn>\n"
CONTROL = re.compile(r"[\\#<]")
ESCAPED = re.compile(r"\\(.)", re.S)
TURN = re.compile(r"### ((?:[^\\#<\n]|\\.)*)\n((?:[^\\#<]|\\.)*)</turn>\n", re.S)
#: Other names of the canonical roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}
FORMATTED = "conv_id long, layout string, formatted string, loss array<struct<start:long,end:long>>, n_turns long"


def paths(value: Any) -> set[str]:
    """Nested field paths; a list's elements share the path with [], and a key's own marks are escaped."""
    out, todo = set(), [("", value)]
    while todo:
        at, v = todo.pop()
        if isinstance(v, dict):
            inner = [(f"{at}.{name}" if at else name, x) for k, x in v.items() for name in [re.sub(r"([\\.\[\]])", r"\\\1", k)]]
        elif isinstance(v, list):
            inner = [(at + "[]", x) for x in v]
            if not inner:
                out.add(at + "[]")
        else:
            inner = []
        if not inner and at:
            out.add(at)
        todo += inner
    return out


def schema_fingerprint(fields: set[str]) -> str:
    return hashlib.sha1("\n".join(sorted(fields)).encode()).hexdigest()[:16]


#: Layouts: field paths, and the turns as (role, path) for single fields or (list, role field, text field, renamed roles).
LAYOUTS: list[tuple[set[str], list[tuple]]] = [
    ({"messages[].role", "messages[].content"}, [("messages", "role", "content", False)]),
    ({"messages[].role", "messages[].text"}, [("messages", "role", "text", False)]),
    ({"conversations[].from", "conversations[].value"}, [("conversations", "from", "value", True)]),
    ({"turns[].speaker", "turns[].text"}, [("turns", "speaker", "text", True)]),
    ({"prompt", "response"}, [("user", "prompt"), ("assistant", "response")]),
    ({"prompt", "completion"}, [("user", "prompt"), ("assistant", "completion")]),
    ({"question", "answer"}, [("user", "question"), ("assistant", "answer")]),
    ({"system", "prompt", "response"}, [("system", "system"), ("user", "prompt"), ("assistant", "response")]),
    ({"instruction", "output"}, [("user", "instruction"), ("assistant", "output")]),
    ({"instruction", "input", "output"}, [("user", "instruction", "input"), ("assistant", "output")]),
]
MAPPINGS = {schema_fingerprint(fields): mapping for fields, mapping in LAYOUTS}


def mapping_of(fields: set[str], layout: str) -> list[tuple]:
    """The mapping of the fingerprint, or of the known layout with most fields among these; none if no layout is."""
    if layout not in MAPPINGS:
        inside = max((x for x in LAYOUTS if x[0] <= fields), key=lambda x: len(x[0]), default=(None, []))
        return inside[1]
    return MAPPINGS[layout]


def canonical_turns(record: dict, mapping: list[tuple]) -> list[tuple[str, str]]:
    out = []
    for rule in mapping:
        if isinstance(rule[-1], bool):
            name, role, text, rename = rule
            for m in (x for x in record[name] if isinstance(x, dict)):
                r = "" if m.get(role) is None else str(m[role])
                out.append((ROLES.get(r, r) if rename else r, "" if m.get(text) is None else str(m[text])))
        else:
            out.append((rule[0], "\n\n".join(str(record[k]) for k in rule[1:] if record.get(k) not in (None, ""))))
    return out


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\\n")


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text, and the code point spans of the assistants' escaped texts."""
    parts, loss, at = [], [], 0
    for role, text in turns:
        head, body = f"{HEAD}{escape_role(role)}\n", escape(text)
        if role == "assistant":
            loss.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), loss


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns that format_turns was given."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def conversation_records(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, record: the turns of each conversation, in order, as JSON.

    A user's turn with an assistant's is a prompt with a response; others are messages with text, or content if the
    id is even.
    """
    one = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = turns.groupBy(F.col(id_col).cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(one)).alias("m"))
    messages = lambda name: F.to_json(F.struct(F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["text"].alias(name))).alias("messages")))
    at = lambda k, field: F.get("m", F.lit(k))[field]
    pair = (F.size("m") == 2) & (at(0, "role") == "user") & (at(1, "role") == "assistant")
    record = F.when(pair, F.to_json(F.struct(at(0, "text").alias("prompt"), at(1, "text").alias("response"))))
    return rows.select("conv_id", record.when(F.col("conv_id") % 2 == 1, messages("text")).otherwise(messages("content")).alias("record"))


def format_records(records: DataFrame, id_col: str = "conv_id", record_col: str = "record") -> DataFrame:
    """conv_id, layout (schema fingerprint), formatted, loss (spans), n_turns, for JSON records of any known layout."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            for raw in batch.column(1).to_pylist():
                try:
                    record = json.loads(raw) if raw is not None else {}
                except (ValueError, RecursionError):
                    record = {}
                fields = paths(record)
                layout = schema_fingerprint(fields)
                turns = canonical_turns(record, mapping_of(fields, layout)) if isinstance(record, dict) else []
                text, loss = format_turns(turns)
                for column, value in zip(out, (layout, text, [{"start": a, "end": b} for a, b in loss], len(turns))):
                    column.append(value)
            spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0]), pa.array(out[1]), pa.array(out[2], spans), pa.array(out[3], pa.int64())], ["conv_id", "layout", "formatted", "loss", "n_turns"])

    return records.select(F.col(id_col).alias("conv_id"), F.col(record_col).alias("record")).mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted text and its loss mask give when read: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for text, loss in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = read_turns(text)
                learned = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
                sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
                for column, value in zip(out, (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned), len(text))):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(out, kinds))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "formatted", "loss").mapInArrow(run, schema)
