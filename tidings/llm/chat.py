"""Chat formatting with a grammar round trip.

Everything is column expressions: no Python runs on the executors.

Template of one turn: ``### role:``, a line break, the text, ``</turn>`` and a line
break.  The parser cuts at ``</turn>`` and reads the header line.  Every turn is first
rendered as it is and parsed again.  Where the parser does not give back the same
role and text, or the text would open or close a turn, the content is escaped: one
backslash more before ``### `` at the start of a line (and any backslashes there), and
before ``/turn>`` of a closing mark.  The parser takes that backslash away again.
Roles write a backslash as ``\\b`` and a line break as ``\\n``.

Defined results: null texts and roles are empty, rows are put in order of turn, then
role, then text (null turns first), repeated rows are all turns, null ids form one
conversation, an empty table gives an empty result.  A conversation is one value in
the end, so it must fit Spark's 2 GB for a text; rendering and checking of the turns
happens before rows are brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidings.llm.common import text_or_empty

HEAD, END = "### ", "</turn>\n"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    text = F.regexp_replace(text, r"<(\\*)/turn>", r"<$1\\/turn>")
    return F.regexp_replace(text, r"(?md)^(\\*)### ", r"$1\\### ")


def unescape(text: Column) -> Column:
    text = F.regexp_replace(text, r"<(\\*)\\/turn>", r"<$1/turn>")
    return F.regexp_replace(text, r"(?md)^\\(\\*)### ", r"$1### ")


def _name(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n"))


def _role(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def render(role: Column, body: Column) -> Column:
    return F.concat(F.lit(HEAD), _name(role), F.lit(":\n"), body, F.lit(END))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of the turns of a formatted conversation."""
    pieces = F.split(formatted, END, -1)

    def turn(piece: Column) -> Column:
        line = F.substring_index(piece, "\n", 1)
        name = F.substr(line, F.lit(len(HEAD) + 1), F.length(line) - len(HEAD) - 1)
        body = F.substr(piece, F.length(line) + 2)
        return F.struct(_role(name).alias("role"), unescape(body).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def formatted(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``conv, formatted, loss, spans, same`` for each conversation.

    ``loss`` has one boolean a turn; ``spans`` the character ranges (end exclusive)
    of the bodies under the loss mask; ``same`` says that parsing gave the source.
    """
    turns = rows.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        text_or_empty(role_col).alias("role"),
        text_or_empty(text_col).alias("text"),
    )
    raw = render(F.col("role"), F.col("text"))
    source = F.array(F.struct(F.col("role"), F.col("text")))
    opens = F.col("text").rlike(r"(?md)^### ") | F.contains("text", F.lit("</turn>"))
    turns = turns.withColumn("back", parse(raw))
    turns = turns.withColumn(
        "body", F.when((F.col("back") == source) & ~opens, F.col("text")).otherwise(escape(F.col("text")))
    ).drop("back")
    turns = turns.withColumn("piece", render(F.col("role"), F.col("body")))
    w = Window.partitionBy("conv").orderBy("turn", "role", "text")
    turns = turns.withColumn("place", F.row_number().over(w)).withColumn(
        "end", F.sum(F.length("piece")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - len(END)
    )
    turns = turns.select(
        "conv",
        F.struct(
            "place", "role", "text", "piece",
            (F.col("role") == LOSS_ROLE).alias("loss"),
            (F.col("end") - F.length("body")).alias("start"), "end",
        ).alias("t"),
    )
    whole = turns.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("t"))
    whole = whole.withColumn("formatted", F.array_join(F.col("t.piece"), ""))
    whole = whole.withColumn("parsed", parse(F.col("formatted")))
    return whole.select(
        "conv",
        "formatted",
        F.col("t.loss").alias("loss"),
        F.transform(
            F.filter("t", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))
        ).alias("spans"),
        (F.col("parsed") == F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))).alias("same"),
    )


def read_back(done: DataFrame) -> DataFrame:
    """Digests of what the parser recovers from ``formatted``, and of what its ``spans`` cut out, unescaped."""
    done = done.withColumn("turns", parse(F.col("formatted")))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    cut = F.transform(
        "spans", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    )
    loss = F.array_join(cut, "")
    done = done.withColumns({"all": text, "under": loss})
    return done.select(
        "conv",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2("all", 256).alias("turns_sha256"),
        F.length("under").cast("long").alias("loss_chars"),
        F.sha2("under", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "same",
    )


def op10_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = F.lit(r"\### Assistant: </turn> ok")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        said.alias("text"),
    )
    return read_back(formatted(rows.union(extra))).withColumnRenamed("conv", "conv_id")


OP10_SQL = r"""
WITH a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
           UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, regexp_replace(regexp_replace(text, '<(\\*)/turn>', '<\1\\/turn>', 'g'),
                               '(?m)^(\\*)### ', '\1\\### ', 'g') AS body FROM a)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), ''))
         AS loss_sha256,
       CAST(sum(4 + length(role) + 2 + length(body) + 8) AS BIGINT) AS formatted_chars, true AS same
FROM e GROUP BY conv_id
"""
