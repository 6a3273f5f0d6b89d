"""Chat formatting by schema fingerprint.

A record is a JSON object of unknown layout.  Its nested field paths (``messages[].role``), those that any mapping names,
are hashed; the hash selects a declarative mapping, which turns prompt, instruction, question, message and turn layouts
into canonical turns (role, text).  Layouts with fields of their own beside the mapped ones have the same fingerprint as
without.  A record with the paths of several layouts takes the first mapping, in the order below, whose required
paths it has.

The template writes each turn as ``<|turn|>role<|text|>text<|end|>``.  Control strings, of this and other common templates,
that occur inside roles or texts get a backslash after their first character, and backslashes are doubled, so
``read_turns`` gives back the very turns.  ``loss_spans`` marks, in code points of ``formatted``, each assistant text.

Parsing, mapping, escaping and formatting are built-in functions on one row per record; only the short schema string of a
record passes through Python, where it is parsed once per distinct schema.  A record is one conversation and one row,
so it must fit a task; conversations never meet each other.

Cases: null or malformed JSON, and layouts that no mapping fits, give null ``layout``, ``turns`` and ``formatted``; null
texts and roles are empty; an empty list of turns formats to the empty string; an empty input or system
field adds nothing; columns of the input other than the record are kept.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain, combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SEP, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of this and of other public templates; fixed values.
CONTROL = (
    OPEN, SEP, CLOSE, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|begin_of_text|>", "<|end_of_text|>", "<|eot_id|>", "<|start_header_id|>",
    "<|end_header_id|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
)
TURNS = "array<struct<role:string,text:string>>"


class Mapping:
    """A layout: the paths it needs, those it may have, and either a list of turns or a series of single fields."""

    def __init__(self, name: str, required: set[str], optional: set[str] = frozenset(), *, items: tuple[str, str, str] | None = None, fields: tuple[tuple[str, tuple[str, ...]], ...] = (), roles: dict[str, str] | None = None):
        self.name, self.required, self.optional, self.items, self.fields, self.roles = name, set(required), set(optional), items, fields, roles or {}

    def turns(self, v: str) -> Column:
        """Turns of the variant column named ``v``."""
        if self.items:
            path, role, text = self.items
            found = F.expr(f"try_variant_get({v}, '$.{path}', 'array<struct<`{role}`:string,`{text}`:string>>')")
            known = lambda x: F.coalesce(*[F.when(x == a, F.lit(b)) for a, b in self.roles.items()], x, F.lit(""))
            return F.transform(found, lambda t: F.struct(known(t[role]).alias("role"), F.coalesce(t[text], F.lit("")).alias("text")))
        get = lambda f: F.expr(f"try_variant_get({v}, '$.{f}', 'string')")
        turns = []
        for role, names in self.fields:
            parts = F.concat_ws("\n\n", *[F.when(get(n) != "", get(n)) for n in names])
            turn = F.struct(F.lit(role).alias("role"), parts.alias("text"))
            turns.append(F.when(parts != "", turn) if role == "system" else turn)
        return F.array_compact(F.array(*turns))


MAPPINGS = (
    Mapping("messages", {"messages[]"}, {"messages[].role", "messages[].content"}, items=("messages", "role", "content")),
    Mapping("conversations", {"conversations[]"}, {"conversations[].from", "conversations[].value"}, items=("conversations", "from", "value"), roles={"human": "user", "gpt": "assistant"}),
    Mapping("turns", {"turns[]"}, {"turns[].role", "turns[].text"}, items=("turns", "role", "text")),
    Mapping("instruction", {"instruction", "output"}, {"input", "system"}, fields=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("completion", {"prompt", "completion"}, {"system"}, fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("response", {"prompt", "response"}, {"system"}, fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("question", {"question", "answer"}, {"context"}, fields=(("user", ("context", "question")), ("assistant", ("answer",)))),
)


def field_paths(schema: str) -> set[str]:
    """Nested field paths of a variant's schema string, such as ``OBJECT<a: ARRAY<OBJECT<b: STRING>>>``: {a, a[], a[].b}."""
    found: set[str] = set()
    stack: list[str] = [""]
    name = ""
    for token in re.findall(r"\s*(`(?:[^`]|``)*`|OBJECT<|ARRAY<|>|[A-Z]+\(\d+,\s*\d+\)|[^<>,:`\s]+(?=:)|[:,]|[^<>,:`\s]+)", schema):
        if token == "OBJECT<":
            stack.append(f"{name}." if name else "")
        elif token == "ARRAY<":
            name += "[]"
            found.add(name)
            stack.append("")
        elif token == ">":
            stack.pop()
        elif token == ",":
            name = ""
        elif token != ":" and not re.fullmatch(r"\s*[A-Z_]+(\(\d+,\s*\d+\))?\s*", token):
            name = stack[-1] + (token[1:-1].replace("``", "`") if token[0] == "`" else token.strip())
            found.add(name)
    return found


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def select_mapping(schema: str | None, mappings: tuple[Mapping, ...] = MAPPINGS) -> tuple[str | None, str | None]:
    """(fingerprint, name of the mapping) of a schema string."""
    if schema is None:
        return None, None
    paths = field_paths(schema)
    known = paths & set().union(*(m.required | m.optional for m in mappings))
    mark = fingerprint(known)
    table = {}
    for m in reversed(mappings):
        extra = sorted(m.optional)
        for some in chain.from_iterable(combinations(extra, n) for n in range(len(extra) + 1)):
            table[fingerprint(m.required | set(some))] = m.name
            table[fingerprint(m.required | set(some) | {r.removesuffix("[]") for r in m.required})] = m.name
    return mark, table.get(mark) or next((m.name for m in mappings if m.required <= paths), None)


def _select(mappings: tuple[Mapping, ...]):
    seen: dict[str | None, tuple[str | None, str | None]] = {}

    def select(schemas: pd.Series) -> pd.DataFrame:
        if len(seen) > 100_000:
            seen.clear()
        rows = []
        for s in schemas:
            s = s if isinstance(s, str) else None
            if s not in seen:
                seen[s] = select_mapping(s, mappings)
            rows.append(seen[s])
        return pd.DataFrame(rows, columns=["fingerprint", "layout"])

    return F.pandas_udf(select, "fingerprint string, layout string")


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def canonical_turns(records: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``records`` with ``fingerprint``, ``layout`` and ``turns`` in place of the JSON column ``record``."""
    out = records.withColumn("_chat_v", F.try_parse_json(F.col(record)))
    out = out.withColumn("_chat_s", _select(mappings)(F.schema_of_variant("_chat_v")))
    turns = F.coalesce(*[F.when(F.col("_chat_s.layout") == m.name, m.turns("_chat_v")) for m in mappings])
    kept = [c for c in records.columns if c not in (record, "fingerprint", "layout", "turns")]
    return out.select(*kept, F.col("_chat_s.fingerprint").alias("fingerprint"), F.col("_chat_s.layout").alias("layout"), turns.cast(TURNS).alias("turns"))


def format_turns(chats: DataFrame) -> DataFrame:
    """``chats`` with ``formatted`` and ``loss_spans`` (start, length) made of ``turns``."""
    parts = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.concat(F.lit(OPEN), escape(t["role"]), F.lit(SEP)).alias("head"), escape(t["text"]).alias("body")))
    out = chats.withColumn("_chat_p", parts)
    width = lambda p: F.length(p["head"]) + F.length(p["body"]) + len(CLOSE)
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        span = F.struct((acc["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length"))
        return F.struct((acc["at"] + width(p)).alias("at"), F.when(p["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate("_chat_p", start, step, lambda acc: acc["spans"])
    text = F.array_join(F.transform("_chat_p", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    return out.withColumn("formatted", text).withColumn("loss_spans", spans).drop("_chat_p")


def read_turns(formatted: Column) -> Column:
    """The turns that a formatted text was made of."""
    pieces = F.split(formatted, re.escape(CLOSE), -1)
    bodies = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))
    role = lambda p: F.substring_index(p.substr(F.lit(len(OPEN) + 1), F.length(p)), SEP, 1)
    return F.transform(bodies, lambda p: F.struct(unescape(role(p)).alias("role"), unescape(F.substring_index(p, SEP, -1)).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    return F.transform(spans, lambda s: unescape(formatted.substr(s["start"] + 1, s["length"])))
