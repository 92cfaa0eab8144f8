"""Chat formatting by schema fingerprints.

Records of different make (a prompt and its answer, an instruction with
input and output, a list of messages) become one layout: an array of turns
``(role, text)``. Which mapping applies is decided by a fingerprint, the
sha-256 of the record's nested field paths in order, so it depends on neither
the order of fields nor their types. Mappings are data: path of the list of
messages, or paths of single texts and the roles they are given. New layouts
are added to a registry, not to the code.

Two ways in: :func:`from_columns` for records that are columns of a table
(one fingerprint for all rows), :func:`from_json` for JSON texts of mixed
layouts (one per row). Rows of one turn each are gathered by
:func:`gather_turns` first.

The template writes ``<turn ROLE>``, a newline, the text, ``</turn>`` and a
newline for each turn. In roles and texts ``\\``, ``<`` and ``>`` are
written ``\\b``, ``\\l`` and ``\\g``, so no text can open or close a turn and
every text comes back exactly. The loss mask is what lies between the marks
of a turn whose role is ``assistant``.

Everything is DataFrame functions. A conversation's turns meet in one row
because its formatted text is one value.

Cases: null texts and roles are empty; turns are ordered by number (null
first), then role and text, and repeated rows are repeated turns; null
conversation ids are one conversation; records without a known fingerprint
have null turns and their fingerprint says what is missing; extra columns are
ignored by :func:`gather_turns` and kept by the others; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


@dataclass(frozen=True)
class Mapping:
    """``paths``: the layout's leaf paths (``[]`` marks a list). Either
    ``messages`` names the list, with ``role`` and ``text`` in each, or
    ``turns`` gives (role, path) pairs in order; several paths joined by
    ``+`` become one text, with a newline between those not empty."""

    paths: tuple[str, ...]
    messages: str = ""
    role: str = "role"
    text: str = "content"
    turns: tuple[tuple[str, str], ...] = ()
    #: other names of roles
    roles: tuple[tuple[str, str], ...] = ()

    @property
    def fingerprint(self) -> str:
        return fingerprint_of(self.paths)


def fingerprint_of(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


REGISTRY = (
    Mapping(("messages[].content", "messages[].role"), messages="messages"),
    Mapping(("messages[].role", "messages[].text"), messages="messages", text="text"),
    Mapping(("conversations[].from", "conversations[].value"), messages="conversations", role="from", text="value",
            roles=(("human", "user"), ("gpt", "assistant"), ("bot", "assistant"))),
    Mapping(("prompt", "response"), turns=(("user", "prompt"), ("assistant", "response"))),
    Mapping(("prompt", "completion"), turns=(("user", "prompt"), ("assistant", "completion"))),
    Mapping(("instruction", "output"), turns=(("user", "instruction"), ("assistant", "output"))),
    Mapping(("input", "instruction", "output"), turns=(("user", "instruction+input"), ("assistant", "output"))),
    Mapping(("answer", "question"), turns=(("user", "question"), ("assistant", "answer"))),
)


def leaf_paths(kind: T.DataType, at: str = "") -> list[str]:
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in leaf_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return leaf_paths(kind.elementType, f"{at}[]")
    return [at]


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role.cast("string"), F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _renamed(role: Column, mapping: Mapping) -> Column:
    out = role
    for name, to in mapping.roles:
        out = F.when(role == name, to).otherwise(out)
    return out


def _message_turns(messages: Column, mapping: Mapping) -> Column:
    return F.transform(messages, lambda m: _turn(_renamed(m[mapping.role], mapping), m[mapping.text]))


def _joined(texts: list[Column]) -> Column:
    return texts[0] if len(texts) == 1 else F.array_join(F.filter(F.array(*texts), lambda t: t.isNotNull() & (t != "")), "\n")


def from_columns(df: DataFrame, record: list[str], registry=REGISTRY) -> DataFrame:
    """Adds ``fingerprint`` and ``turns`` (null if no mapping is known), from
    the columns named in ``record``."""
    print_ = fingerprint_of(leaf_paths(T.StructType([df.schema[c] for c in record])))
    mapping = next((m for m in registry if m.fingerprint == print_), None)
    if mapping is None:
        turns = F.lit(None).cast(TURNS)
    elif mapping.messages:
        turns = _message_turns(F.col(mapping.messages), mapping)
    else:
        turns = F.array(*[_turn(F.lit(r), _joined([F.col(p) for p in path.split("+")])) for r, path in mapping.turns])
    return df.withColumn("fingerprint", F.lit(print_)).withColumn("turns", turns)


def json_paths(value: Column) -> Column:
    """Leaf paths of a variant up to lists of flat objects, in order. What lies
    deeper is told by its type, so it has no flat layout's fingerprint."""
    fields = F.map_keys(value.cast("map<string,variant>"))

    def below(name: Column) -> Column:
        kind = F.schema_of_variant(F.element_at(value.cast("map<string,variant>"), name))
        inner = F.regexp_extract_all(kind, F.lit(r"(?:OBJECT<|, )`?([^:`<>, ]+)`?: "), F.lit(1))
        listed = kind.startswith("ARRAY<")
        deep = F.regexp_like(F.regexp_replace(kind, r"^(ARRAY<)?OBJECT<", ""), F.lit("OBJECT<|ARRAY<"))
        return F.when(deep, F.array(F.concat(name, F.lit(": "), kind))).when(kind.startswith("ARRAY<OBJECT<"), F.transform(inner, lambda x: F.concat(name, F.lit("[]."), x))) \
            .when(kind.startswith("OBJECT<"), F.transform(inner, lambda x: F.concat(name, F.lit("."), x))) \
            .otherwise(F.array(F.concat(name, F.when(listed, "[]").otherwise(""))))

    return F.array_sort(F.flatten(F.transform(fields, below)))


def from_json(df: DataFrame, column: str, registry=REGISTRY) -> DataFrame:
    """Adds ``fingerprint`` and ``turns`` from JSON texts, row by row. A text
    that isn't a JSON object has neither."""
    v = F.try_parse_json(F.col(column))
    v = F.when(F.schema_of_variant(v).startswith("OBJECT<"), v)
    df = df.withColumn("_v", v).withColumn("fingerprint", F.sha2(F.array_join(json_paths(F.col("_v")), "\n"), 256))
    turns = F.lit(None).cast(TURNS)
    for m in registry:
        def at(path: str) -> Column:
            return F.try_variant_get(F.col("_v"), f"$.{path}", "string")
        if m.messages:
            listed = F.try_variant_get(F.col("_v"), f"$.{m.messages}", f"array<struct<`{m.role}`:string,`{m.text}`:string>>")
            own = _message_turns(listed, m)
        else:
            own = F.array(*[_turn(F.lit(r), _joined([at(p) for p in path.split("+")])) for r, path in m.turns])
        turns = F.when(F.col("fingerprint") == m.fingerprint, own).otherwise(turns)
    return df.withColumn("turns", turns).drop("_v")


def gather_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One record (``conv``, ``messages``) per conversation from rows by turn."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(turn).isNotNull().alias("_0"), F.col(turn).alias("_1"),
                                                  F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))))
    return rows.groupBy(conv).agg(listed.alias("_turns")).select(
        conv, F.transform("_turns", lambda t: F.struct(t["role"], t["text"])).alias("messages"))


def escaped(text: Column) -> Column:
    for sign, code in (("\\", "\\b"), ("<", "\\l"), (">", "\\g")):
        text = F.replace(text, F.lit(sign), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for sign, code in ((">", "\\g"), ("<", "\\l"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(sign))
    return text


def formatted(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit("<turn "), escaped(t["role"]), F.lit(">\n"), escaped(t["text"]), F.lit("</turn>\n"))), "")


def read_back(text: Column) -> Column:
    """The turns of a formatted text: what stands before each closing mark,
    with the opening mark taken apart."""
    bodies = F.split(text, "</turn>\n", -1)
    bodies = F.slice(bodies, 1, F.size(bodies) - 1)
    return F.transform(bodies, lambda b: F.struct(
        unescaped(F.substring_index(F.substr(b, F.lit(len("<turn ") + 1)), ">\n", 1)).alias("role"),
        unescaped(F.substr(b, F.locate(">\n", b, 1) + 2)).alias("text")))


def loss_text(turns: Column) -> Column:
    """All text under the loss mask, in order."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")


def format_chats(df: DataFrame) -> DataFrame:
    """Adds ``formatted`` from ``turns`` and drops these."""
    return df.withColumn("formatted", formatted(F.col("turns"))).drop("turns")
