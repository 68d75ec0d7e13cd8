"""Chat formatting: records of any known layout become canonical turns, then marked text with a loss mask.

A layout is told by its schema fingerprint: the sorted nested field paths of the record columns, hashed. The
registry maps a fingerprint to a declarative mapping, a few SQL expressions that give the conversation's key and
its (place, role, text) turns. Rows whose layout differs inside one JSON column get a fingerprint each.

Template of a turn: ``<|im_start|>`` role, newline, text, ``<|im_end|>`` newline. Texts and roles are escaped so
that no ``<`` or ``[`` is left in them, hence no control string of this or any bracketed template:
``\\`` becomes ``\\s``, ``<`` ``\\a``, ``[`` ``\\l``; a newline in a role becomes ``\\e``. Every backslash in
escaped text is followed by one of these letters, so replacing them in reverse order gives the text back.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

START, END = "<|im_start|>", "<|im_end|>\n"
ESCAPES = (("\\", "\\s"), ("<", "\\a"), ("[", "\\l"))


def paths(kind: DataType, at: str = "") -> list[str]:
    """Nested field paths of a type, array levels as ``[]`` and map values as ``{}``."""
    if isinstance(kind, StructType):
        return [p for f in kind.fields for p in paths(f.dataType, f"{at}.{f.name.lower()}" if at else f.name.lower())]
    if isinstance(kind, ArrayType):
        return paths(kind.elementType, f"{at}[]")
    if isinstance(kind, MapType):
        return paths(kind.valueType, f"{at}{{}}")
    return [at]


def fingerprint(field_paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(field_paths)).encode()).hexdigest()


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns. ``turns`` is a SQL expression for ``array<struct<place, role, text>>``; for a
    layout with one row per turn it gives the row's own turn, and rows of a key are put together."""

    fields: tuple[str, ...]
    turns: str

    @property
    def fingerprint(self) -> str:
        return fingerprint(list(self.fields))


def _turn(place: str, role: str, text: str) -> str:
    return f"named_struct('place', cast({place} as bigint), 'role', cast({role} as string), 'text', cast({text} as string))"


def _pair(asked: str, answer: str) -> str:
    return f"""array({_turn("0", "'user'", asked)}, {_turn("1", "'assistant'", answer)})"""


_SPEAKER = "case m.`from` when 'human' then 'user' when 'gpt' then 'assistant' else m.`from` end"
MAPPINGS = {
    m.fingerprint: m
    for m in (
        Mapping(("turn", "role", "text"), f"array({_turn('turn', 'role', 'text')})"),
        Mapping(("prompt", "response"), _pair("prompt", "response")),
        Mapping(("prompt", "completion"), _pair("prompt", "completion")),
        Mapping(("instruction", "output"), _pair("instruction", "output")),
        Mapping(("instruction", "input", "output"), _pair("concat_ws('\\n', instruction, nullif(input, ''))", "output")),
        Mapping(("messages[].role", "messages[].content"), f"transform(messages, (m, i) -> {_turn('i', 'm.role', 'm.content')})"),
        Mapping(("conversations[].from", "conversations[].value"), f"transform(conversations, (m, i) -> {_turn('i', _SPEAKER, 'm.value')})"),
    )
}

#: A JSON record of any layout above, for ``from_json``.
_ANY = (
    "prompt string, response string, completion string, instruction string, input string, output string, "
    "messages array<struct<role: string, content: string>>, conversations array<struct<`from`: string, value: string>>"
)


def canonical_turns(records: DataFrame, key: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(key, place, role, text) of records that share one layout, chosen by the frame's schema fingerprint.

    ``ignore`` names columns that do not belong to the layout. An unknown fingerprint raises with its paths.
    """
    own = [p for f in records.schema.fields if f.name not in (key, *ignore) for p in paths(f.dataType, f.name.lower())]
    mapping = MAPPINGS.get(fingerprint(own))
    if mapping is None:
        raise ValueError(f"no mapping for fields {sorted(own)}; fingerprint {fingerprint(own)}")
    turns = records.select(F.col(key).alias("key"), F.explode(F.expr(mapping.turns)).alias("turn"))
    return turns.select(F.col("key").alias(key), "turn.place", "turn.role", "turn.text")


def json_layout(record: Column) -> Column:
    """Fingerprint of the layout of one JSON object, null if it has none of the known ones.

    The paths are its keys and, for a layout with a list of objects, the keys that all objects of the list have to have.
    """
    keys, layout = F.array_sort(F.json_object_keys(record)), F.lit(None).cast("string")
    for m in MAPPINGS.values():
        tops, nested = sorted({f.split("[")[0] for f in m.fields}), sorted(f.split(".")[1] for f in m.fields if "[]." in f)
        same = keys == F.array(*[F.lit(t) for t in tops])
        if nested:
            value, known = F.get_json_object(record, f"$.{tops[0]}"), F.array(*[F.lit(n) for n in nested])
            alike = F.forall(F.from_json(value, "array<string>"), lambda e: F.coalesce(F.array_sort(F.json_object_keys(e)) == known, F.lit(False)))
            same = same & (value.isNull() | F.coalesce(alike, F.lit(False)))
        layout = F.when(same, F.lit(m.fingerprint)).otherwise(layout)
    return layout


def canonical_json_turns(records: DataFrame, key: str, json: str) -> DataFrame:
    """(key, place, role, text) of JSON records of mixed layouts, each by its own fingerprint.

    A record that is no JSON object, or of an unknown layout, raises: none is dropped unseen. A null record has
    no turns.
    """
    tagged = records.select(F.col(key).alias("_key"), F.col(json).alias("_json"), json_layout(F.col(json)).alias("_layout"), F.from_json(json, _ANY).alias("_r"))
    tagged = tagged.select("_key", "_json", "_layout", "_r.*")
    turns = F.when(F.col("_json").isNull(), F.expr("cast(array() as array<struct<place: bigint, role: string, text: string>>)"))
    for m in MAPPINGS.values():
        if "turn" not in m.fields:
            turns = turns.when(F.col("_layout") == m.fingerprint, F.expr(m.turns))
    unknown = F.raise_error(F.concat(F.lit("no mapping for record: "), F.substring("_json", 1, 200)))
    rows = tagged.select("_key", F.explode(turns.otherwise(unknown)).alias("turn"))
    return rows.select(F.col("_key").alias(key), "turn.place", "turn.role", "turn.text")


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def format_turns(turns: DataFrame, key: str, learn: str = "assistant") -> DataFrame:
    """(key, formatted, loss) of every conversation; ``loss`` lists the [start, stop) code points to learn.

    Turns go in order of place, then role, then text; null places come first. A null text or role is an empty
    one. Rows with a null key form one conversation, repeated rows are turns of their own. A conversation's
    turns meet in one row, since the output is one string; nothing else gathers rows. Without rows there are
    no conversations. Other columns are not read.
    """
    rows = turns.select(
        F.col(key).alias("key"), F.col("place"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\e")), F.lit("\n"))
    rows = rows.withColumn("head", head).withColumn("body", escape(F.col("text")))
    piece = F.char_length("head") + F.char_length("body") + len(END)
    order = Window.partitionBy("key").orderBy("place", "role", "text")
    rows = rows.withColumn("number", F.row_number().over(order)).withColumn(
        "start", F.coalesce(F.sum(piece).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.char_length("head")
    )
    parts = F.array_sort(F.collect_list(F.struct("number", "start", "role", F.concat("head", "body", F.lit(END)).alias("piece"), F.char_length("body").alias("size"))))
    grouped = rows.groupBy("key").agg(parts.alias("parts"))
    loss = F.transform(F.filter("parts", lambda p: p["role"] == learn), lambda p: F.struct(p["start"].cast("long").alias("start"), (p["start"] + p["size"]).cast("long").alias("stop")))
    return grouped.select(F.col("key").alias(key), F.array_join(F.col("parts.piece"), "").alias("formatted"), loss.alias("loss"))


def read_formatted(formatted: Column) -> Column:
    """Turns, as ``array<struct<role, text>>``, read back from a formatted conversation."""
    pieces = F.filter(F.split(formatted, "<\\|im_end\\|>\n"), lambda p: p != "")

    def turn(piece: Column) -> Column:
        line = F.locate("\n", piece)
        role = F.substring(piece, F.lit(len(START) + 1), line - len(START) - 1)
        text = F.substring(piece, line + 1, F.char_length(piece))
        return F.struct(unescape(F.replace(role, F.lit("\\e"), F.lit("\n"))).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """Unescaped text under the loss mask, spans joined without anything between."""
    spans = F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int"))))
    return F.array_join(spans, "")


def digests(conversations: DataFrame, key: str) -> DataFrame:
    """Counts and digests of formatted conversations, from the formatted text and mask alone."""
    read = conversations.select(
        F.col(key), F.col("formatted"), read_formatted(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss")).alias("learned")
    )
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        key, F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
