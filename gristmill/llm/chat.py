"""Chat formatting by event-sourced reconstruction (operator 7), in DataFrame functions alone.

A log holds events (conv_id, seq, kind, turn, role, text). Folding a conversation in order of
seq: `message` starts a turn's text, `delta` appends to it, `edit` replaces it, `regenerate`
empties the turn and takes back every later turn written so far. An event counts if no later
event of its conversation takes it back, which two running maxima decide; a turn's final text is
its counting events' texts in order of seq.

Template: `<s>` header body `</s>` a turn; the header is `[INST]` for user, `[/INST]` for
assistant, `<<SYS>>` for system, and `<<ROLE>>` role `<</ROLE>>` for any other role. In bodies
and role names, backslashes are doubled and each control string gets a backslash after its first
character; undoing both restores the text exactly. The loss mask names the bodies of assistant
turns: (turn index, start in the turn's piece, length), in code points.

Defined cases: null text is empty, null role is the empty role, null conv_id is a conversation
of its own; rows with the same turn are all kept, ordered by turn, role, text; an empty log gives
an empty result; a conversation is one row of output, so it must fit in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template's control strings.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>")
HEADERS = {"user": "<s>[INST]", "assistant": "<s>[/INST]", "system": "<s><<SYS>>"}
OTHER, OTHER_END, END = "<s><<ROLE>>", "<</ROLE>>", "</s>"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    out = text
    for c in CONTROLS:
        out = F.replace(out, F.lit(f"{c[0]}\\{c[1:]}"), F.lit(c))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, role, text) of a log of events."""
    conv = Window.partitionBy("conv_id")
    taken_back = F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).over(conv.orderBy("turn"))
    replaced = F.max(F.when(F.col("kind").isin("message", "edit"), F.col("seq"))).over(Window.partitionBy("conv_id", "turn"))
    live = (F.col("seq") >= F.coalesce("_back", "seq")) & (F.col("seq") >= F.coalesce("_put", "seq"))
    marked = events.select("conv_id", "seq", "kind", "turn", "role", "text", taken_back.alias("_back"), replaced.alias("_put"))
    part = F.struct("seq", F.when(F.col("kind") == "regenerate", "").otherwise(F.coalesce("text", F.lit(""))).alias("text"))
    return (
        marked.groupBy("conv_id", "turn")
        .agg(F.max_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))).alias("role"), F.array_sort(F.collect_list(F.when(live, part))).alias("parts"))
        .where(F.size("parts") > 0)
        .select("conv_id", "turn", "role", F.array_join(F.transform("parts", lambda x: x["text"]), "").alias("text"))
    )


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask) from (conv_id, turn, role, text)."""
    role = F.coalesce("role", F.lit(""))
    header = F.concat(F.lit(OTHER), escape(role), F.lit(OTHER_END))
    for name, text in HEADERS.items():
        header = F.when(role == name, text).otherwise(header)
    pieces = messages.select("conv_id", "turn", (role == "assistant").alias("loss"), header.alias("head"), escape(F.coalesce("text", F.lit(""))).alias("body"))
    turns = pieces.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", F.concat("head", "body", F.lit(END)).alias("piece"), "loss", F.length("head").alias("start"), F.length("body").alias("len")))).alias("t")
    )
    spans = F.filter(
        F.transform("t", lambda x, i: F.when(x["loss"], F.struct(i.alias("turn"), x["start"].alias("start"), x["len"].alias("len")))), lambda x: x.isNotNull()
    )
    return turns.select("conv_id", F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"), spans.alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted): roles and texts parsed from the output, and the text under the mask."""
    split = formatted.select("conv_id", "formatted", "loss_mask", F.split("formatted", END, -1).alias("p"))
    split = split.withColumn("p", F.slice("p", 1, F.size("p") - 1))

    def turn(piece: Column) -> Column:
        after = F.substring(piece, len(OTHER) + 1, 1 << 30)
        cut = F.instr(after, F.lit(OTHER_END))
        role, text = unescape(F.left(after, cut - 1)), unescape(F.substr(after, cut + len(OTHER_END)))
        for name, head in HEADERS.items():
            fits = F.startswith(piece, F.lit(head))
            role, text = F.when(fits, name).otherwise(role), F.when(fits, unescape(F.substring(piece, len(head) + 1, 1 << 30))).otherwise(text)
        return F.struct(role.alias("role"), text.alias("text"))

    masked = F.transform("loss_mask", lambda m: unescape(F.substr(F.element_at("p", m["turn"].cast("int") + 1), m["start"] + 1, m["len"])))
    return split.select("conv_id", F.transform("p", turn).alias("turns"), F.array_join(masked, "").alias("loss_text"), "formatted")


def conversation_events(rows: DataFrame) -> DataFrame:
    """A table of finished messages as a log: one `message` event a row, in order of turn."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    return rows.select("conv_id", place.alias("seq"), F.lit("message").alias("kind"), place.alias("turn"), "role", "text")


def op7_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    back = read_back(render(fold_events(conversation_events(rows.unionByName(extra)))))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def oracle() -> str:
    escaped = "replace({}, '\\', '\\\\')"
    for c in CONTROLS:
        escaped = f"replace({escaped}, '{c}', '{c[0]}\\{c[1:]}')"
    heads = " ".join(f"WHEN role = '{k}' THEN {len(v)}" for k, v in HEADERS.items())
    return f"""
    WITH r AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(length({escaped.format("text")}) + {len(END)} +
             CASE {heads} ELSE {len(OTHER) + len(OTHER_END)} + length({escaped.format("role")}) END) AS BIGINT) AS formatted_chars
    FROM r GROUP BY conv_id"""


QUERIES = {"op7_chat_format": op7_chat_format}
ORACLES = {"op7_chat_format": oracle()}
