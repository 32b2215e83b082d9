"""Schema fingerprinting: every record's layout is told by a hash of its nested field paths,
and a declarative mapping turns each into canonical turns (native DataFrame functions only)."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

OPEN, BODY, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that must not stand in a text unescaped: those of this template and of common others.
CONTROL = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


#: Turns of a conversation that are numbered in one task.
STRETCH = 1024


def shape(paths: tuple[str, ...]) -> str:
    """Nested field paths (an element of an array is written [], and what has none VOID) as one text, fields in order of their names."""
    heads: dict[str, list[str]] = {}
    for path in paths:
        head, _, rest = path.partition(".")
        heads.setdefault(head, []).extend([rest] if rest else [])
    inner = [f"{h[:-2]}: ARRAY<{shape(tuple(r)) if r else 'VOID'}>" if h.endswith("[]") else f"{h}: {shape(tuple(r))}" if r else h for h, r in heads.items()]
    return f"OBJECT<{', '.join(sorted(inner))}>"


def fingerprint(paths: tuple[str, ...]) -> str:
    return hashlib.sha256(shape(paths).encode()).hexdigest()[:16]


def shape_of(record: Column) -> Column:
    """The same text of a variant: its schema without the types of its values."""
    return F.regexp_replace(F.schema_of_variant(record), r": [A-Z][A-Z_]*(\(\d+, ?\d+\))?(?=[,>])", "")


@dataclass(frozen=True)
class Mapping:
    """How a record becomes turns. rows: it is a turn already, (order, role, text) fields.
    turns: an array of objects with (role, text) fields. pairs: (role, field) in order. Its id is conv_id."""

    paths: tuple[str, ...]
    rows: tuple[str, str, str] | None = None
    turns: tuple[str, str, str] | None = None
    pairs: tuple[tuple[str, str], ...] = ()

    def array(self, record: Column) -> Column:
        """The record's turns: array<struct<turn, role, text>>."""
        at = lambda path, type_="string": F.try_variant_get(record, f"$.{path}", type_)
        turn = lambda n, role, text: F.struct(n.cast("long").alias("turn"), role.alias("role"), text.alias("text"))
        if self.rows:
            order, role, text = self.rows
            return F.array(turn(at(order, "bigint"), at(role), at(text)))
        if self.turns:
            name, role, text = self.turns
            known = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
            said = at(name, f"array<struct<{role}: string, {text}: string>>")
            return F.transform(said, lambda t, i: turn(i, F.coalesce(F.try_element_at(known, t[role]), t[role]), t[text]))
        return F.filter(F.array(*[turn(F.lit(i), F.lit(role), at(f)) for i, (role, f) in enumerate(self.pairs)]), lambda t: t.text.isNotNull())


def _with_turns(name: str, role: str, text: str) -> tuple[Mapping, ...]:
    """A layout whose array of turns may also be null or empty."""
    return tuple(Mapping(("conv_id", *paths), turns=(name, role, text)) for paths in ((f"{name}[].{role}", f"{name}[].{text}"), (f"{name}[]",), (name,)))


MAPPINGS = (
    Mapping(("conv_id", "turn", "role", "text"), rows=("turn", "role", "text")),
    *_with_turns("messages", "role", "content"),
    *_with_turns("conversations", "from", "value"),
    Mapping(("conv_id", "prompt", "completion"), pairs=(("user", "prompt"), ("assistant", "completion"))),
    Mapping(("conv_id", "prompt", "response"), pairs=(("user", "prompt"), ("assistant", "response"))),
    Mapping(("conv_id", "instruction", "output"), pairs=(("user", "instruction"), ("assistant", "output"))),
    Mapping(("conv_id", "instruction", "input", "output"), pairs=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping(("conv_id", "system", "instruction", "output"), pairs=(("system", "system"), ("user", "instruction"), ("assistant", "output"))),
)
#: Names of roles in other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
BY_FINGERPRINT = {fingerprint(m.paths): m for m in MAPPINGS}


def records_of(df: DataFrame, *columns: str) -> DataFrame:
    """record: each row's columns (all, if none is named) as JSON, nulls included."""
    return df.select(F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "false"}).alias("record"))


def canonical_turns(records: DataFrame, layouts: dict[str, Mapping] | None = None, record_col: str = "record") -> DataFrame:
    """conv_id, turn, role, text of JSON records, whose layouts may all differ; the fingerprint of a record's field paths selects its mapping.

    A record with an unknown fingerprint ends the query with an error that names its fields; nothing is dropped. Null record: no turn.
    Null role: "". Null text: "". An array of turns that is null or empty gives no turn, and a field of a pair that is null none for it.
    Repeated records: each gives its turns. Ties in turn stay in the order of (role, text). Empty table: no row. Columns that
    aren't named are ignored, so none can clash.
    """
    layouts = BY_FINGERPRINT if layouts is None else layouts
    read = records.select(F.parse_json(record_col).alias("_v")).where("_v IS NOT NULL").select("_v", shape_of(F.col("_v")).alias("_shape"))
    read = read.withColumn("_f", F.substring(F.sha2("_shape", 256), 1, 16))
    turns = F.raise_error(F.concat(F.lit("no mapping for the fields "), "_shape"))
    for f, mapping in layouts.items():
        turns = F.when(F.col("_f") == f, mapping.array(F.col("_v"))).otherwise(turns)
    out = read.select(F.try_variant_get("_v", "$.conv_id", "bigint").alias("conv_id"), F.explode(turns).alias("_t"))
    return out.select("conv_id", "_t.turn", *[F.coalesce(F.col(f"_t.{c}"), F.lit("")).alias(c) for c in ("role", "text")])


def escape(text: Column) -> Column:
    """A backslash before every backslash and before the last character of every control string."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        text = F.replace(text, F.lit(c), F.lit(f"{c[:-1]}\\{c[-1]}"))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, seq, segment, start, loss_start, loss_end: a conversation's formatted text is its segments in order
    of seq; start is where the segment begins in it, and [loss_start, loss_end) is the part that is
    trained on (null for turns that aren't the assistant's). All count code points.

    One row a turn, so that a long conversation never has to fit into one value, and STRETCH turns are numbered together, so that it
    never has to fit into one task. Null turn: first. Null conv_id: one conversation. Ties and repeated rows: in the order of (role, text),
    each a turn. Null role or text: the turn has no segment; canonical_turns gives none. Empty table: no row.
    """
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(BODY))
    rows = turns.select("conv_id", "turn", "role", "text", head.alias("_head"), escape(F.col("text")).alias("_body"))
    rows = rows.withColumn("segment", F.concat("_head", "_body", F.lit(CLOSE))).withColumn("_n", F.length("segment").cast("long"))
    rows = rows.withColumns({"_c": F.struct("conv_id"), "_s": F.struct(F.floor(F.col("turn") / F.lit(STRETCH)).alias("s"))})
    # what comes before each stretch; structs, as nulls are values of their own
    sizes = rows.groupBy("_c", "_s").agg(F.count("*").alias("_k"), F.sum("_n").alias("_m"))
    before = Window.partitionBy("_c").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_c", "_s", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(y) for x, y in (("_k", "_seq"), ("_m", "_start"))])
    order = Window.partitionBy("_c", "_s").orderBy("turn", "role", "text")
    rows = rows.withColumn("_i", F.row_number().over(order)).withColumn("_at", F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.join(sizes, ["_c", "_s"]).withColumns({"seq": F.col("_seq") + F.col("_i"), "start": F.col("_start") + F.col("_at")})
    at = F.when(F.col("role") == "assistant", F.col("start") + F.length("_head"))
    return rows.select("conv_id", "seq", "segment", "start", at.alias("loss_start"), (at + F.length("_body")).alias("loss_end"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, seq, role, text, loss, chars: the turns and the trained parts, from what format_turns returned alone."""
    inside = F.substring("segment", len(OPEN) + 1, F.length("segment") - len(OPEN) - len(CLOSE))
    role, text = F.substring_index(inside, BODY, 1), F.substring(inside, F.length(F.substring_index(inside, BODY, 1)) + len(BODY) + 1, F.length(inside))
    loss = F.substring("segment", (F.col("loss_start") - F.col("start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    return formatted.select("conv_id", "seq", unescape(role).alias("role"), unescape(text).alias("text"), unescape(loss).alias("loss"), F.length("segment").cast("long").alias("chars"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, a record a turn, and conversation -7, a record with messages, formatted and read back. Only the digests, which SQL
    takes of one whole value, gather a conversation's turns."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.array(*[F.struct(F.lit(r).alias("role"), F.lit(said).alias("content")) for r in ("user", "assistant")]).alias("messages"))
    records = records_of(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text").union(records_of(extra))
    back = read_back(format_turns(canonical_turns(records)))
    turns = F.array_sort(F.collect_list(F.struct("seq", "role", "text", "loss")))
    whole = lambda f: F.array_join(F.transform("_t", f), "")
    out = back.groupBy("conv_id").agg(turns.alias("_t"), F.sum("chars").alias("formatted_chars"), F.coalesce(F.sum(F.length("loss").cast("long")), F.lit(0)).alias("loss_chars"))
    return out.select(
        "conv_id",
        F.size("_t").cast("long").alias("n_turns"),
        F.sha2(whole(lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), 256).alias("turns_sha256"),
        F.col("loss_chars").cast("long").alias("loss_chars"),
        F.sha2(whole(lambda t: F.coalesce(t.loss, F.lit(""))), 256).alias("loss_sha256"),
        "formatted_chars",
    )


_ESCAPED = "replace({x}, chr(92), chr(92) || chr(92))"
for _c in CONTROL:
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[:-1]}' || chr(92) || '{_c[-1]}')"

OP6_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(length('{OPEN}{BODY}{CLOSE}') + length({_ESCAPED.format(x='role')}) + length({_ESCAPED.format(x='text')})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
