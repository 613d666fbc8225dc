"""Chat formatting by schema fingerprints.

A record is JSON (text or VARIANT) of unknown layout. The fingerprint is a hash of its nested field paths, without
scalar types; it selects one of the declarative LAYOUTS, whose expression converts the record into canonical turns
(role, text). Records of no known fingerprint, such as those with more fields, take the first layout all of whose
fields they have; else they have no turns and layout ``unknown``.

The template writes a turn as ``<|turn role|>\\ntext<|end|>\\n``. Inside texts ``\\`` becomes ``\\\\`` and ``<|`` becomes ``<\\|``; in
roles each of ``\\ < | >`` gets a ``\\`` before it, so no text or role can hold a control string and parse() restores every text.
The loss mask is a list of (start, length) in code points that cover exactly the escaped assistant texts.

Null texts and roles are empty; turns with equal numbers are ordered by role and text, repeated rows are turns of their
own, null turn numbers come first; a null conversation id is a conversation; very long turns come back whole; empty tables give empty
results; other input columns are not read, and carried columns named like results (layout, turns) are dropped.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectide.llm.exchange import lean

TURNS = "array<struct<role:string,text:string>>"
HEAD, END = "<|turn ", "<|end|>\n"
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}


def _get(path: str, kind: str = "string") -> str:
    return f"try_variant_get(v, '$.{path}', '{kind}')"


def _turn(role: str, text: str) -> str:
    return f"named_struct('role', {role}, 'text', coalesce({text}, ''))"


def _role(x: str) -> str:
    cases = " ".join(f"when '{a}' then '{b}'" for a, b in ROLE_NAMES.items())
    return f"case lower({x}) {cases} else coalesce({x}, '') end"


#: Layout: (an example record, the SQL expression that gives its turns from the VARIANT column v).
LAYOUTS: dict[str, tuple[str, str]] = {
    "message": ('{"role": "", "content": ""}', f"array({_turn(f"coalesce({_get('role')}, '')", _get('content'))})"),
    "from_value": ('{"from": "", "value": ""}', f"array({_turn(_role(_get('from')), _get('value'))})"),
    "messages": ('{"messages": [{"role": "", "content": ""}]}', f"transform({_get('messages', 'array<struct<role:string,content:string>>')}, m -> {_turn("coalesce(m.role, '')", 'm.content')})"),
    "conversations": ('{"conversations": [{"from": "", "value": ""}]}', f"transform({_get('conversations', 'array<struct<`from`:string,value:string>>')}, m -> {_turn(_role('m.`from`'), 'm.value')})"),
    "instruction_input": ('{"instruction": "", "input": "", "output": ""}', f"array({_turn("'user'", f"concat_ws('\\n', {_get('instruction')}, nullif({_get('input')}, ''))")}, {_turn("'assistant'", _get('output'))})"),
    "instruction": ('{"instruction": "", "output": ""}', f"array({_turn("'user'", _get('instruction'))}, {_turn("'assistant'", _get('output'))})"),
    "system_prompt": ('{"system": "", "prompt": "", "completion": ""}', f"array({_turn("'system'", _get('system'))}, {_turn("'user'", _get('prompt'))}, {_turn("'assistant'", _get('completion'))})"),
    "prompt": ('{"prompt": "", "completion": ""}', f"array({_turn("'user'", _get('prompt'))}, {_turn("'assistant'", _get('completion'))})"),
    "question": ('{"question": "", "answer": ""}', f"array({_turn("'user'", _get('question'))}, {_turn("'assistant'", _get('answer'))})"),
}


def field_paths(v: Column) -> Column:
    """Nested field paths of a VARIANT, without scalar types."""
    return F.regexp_replace(F.schema_of_variant(v), r": (?!OBJECT|ARRAY)[A-Z_]+(\([0-9, ]*\))?", "")


def fingerprint(v: Column) -> Column:
    return F.xxhash64(field_paths(v))


def _layout(v: Column) -> Column:
    import json

    out = F.when(F.lit(False), "")
    for name, (example, _) in LAYOUTS.items():
        out = out.when(fingerprint(v) == fingerprint(F.parse_json(F.lit(example))), name)
    for name, (example, _) in sorted(LAYOUTS.items(), key=lambda x: -len(x[1][0])):
        has = F.lit(True)
        for field in json.loads(example):
            has &= F.try_variant_get(v, f"$.{field}", "variant").isNotNull()
        out = out.when(has, name)
    return out.otherwise("unknown")


def canonical_turns(records: DataFrame, record_col: str) -> DataFrame:
    """All columns of records, with the record replaced by layout and turns."""
    kind = dict(records.dtypes)[record_col]
    v = F.col(f"`{record_col}`") if kind == "variant" else F.try_parse_json(F.col(f"`{record_col}`"))
    rest = [F.col(f"`{c}`") for c in records.columns if c not in (record_col, "layout", "turns", "v")]
    with_layout = records.select(*rest, v.alias("v")).withColumn("layout", _layout(F.col("v")))
    turns = "case layout " + " ".join(f"when '{name}' then {sql}" for name, (_, sql) in LAYOUTS.items()) + " end"
    return with_layout.withColumn("turns", F.coalesce(F.expr(turns), F.array().cast(TURNS))).drop("v")


def escape_text(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(c: Column) -> Column:
    for x in "\\<|>":
        c = F.replace(c, F.lit(x), F.lit("\\" + x))
    return c


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.DOTALL) if "\\" in s else s


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    out = []
    for piece in formatted.split(END)[:-1]:
        role, _, text = piece[len(HEAD) :].partition("|>\n")
        out.append((unescape(role), unescape(text)))
    return out


def format_chat(turns: DataFrame, conv_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a conversation: conv_id, formatted, loss_spans (array of start and length)."""
    t = turns.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{order_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    t = t.withColumn("body", escape_text(F.col("text"))).withColumn("head", F.concat(F.lit(HEAD), escape_role(F.col("role")), F.lit("|>\n")))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = t.withColumn("piece", F.concat("head", "body", F.lit(END)))
    t = t.withColumn("rn", F.row_number().over(w)).withColumn("at", F.sum(F.length("piece")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    span = F.when(F.col("role") == "assistant", F.struct((F.coalesce("at", F.lit(0)) + F.length("head")).cast("long").alias("start"), F.length("body").cast("long").alias("length")))
    got = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("rn", "piece"))).alias("p"), F.sort_array(F.collect_list(span)).alias("loss_spans"))
    return got.select("conv_id", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"), "loss_spans")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what a reader of the formatted text gets: turns, and all text under the loss mask."""

    @lean
    def run(batches):
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist()):
                turns, digest = parse(text), hashlib.sha256()
                for role, body in turns:
                    digest.update(f"{role}\n{body}\n".encode())
                loss = "".join(unescape(text[s["start"] : s["start"] + s["length"]]) for s in spans)
                for c, x in zip(cols, (len(turns), digest.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text))):
                    c.append(x)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    schema = formatted.select("conv_id").schema.add("n_turns", "long").add("turns_sha256", "string").add("loss_chars", "long").add("loss_sha256", "string").add("formatted_chars", "long")
    return formatted.mapInArrow(run, schema)
