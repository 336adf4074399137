"""Chat formatting by a grammar round trip, in built-in SQL expressions only.

Grammar of a formatted conversation, turn after turn:

    "### " role ": " text "</turn>" newline

The parser is fixed: it cuts the string at every "</turn>" + newline and at every "### ", takes what
stands before the first ": " of a piece as the role and the rest as the text, and replaces a
backslash before a backslash, "/" or "#" by that character alone.

Each turn is rendered as it is, parsed, and compared with its source. A turn that comes back
otherwise is rendered again with its control strings broken up by a backslash (level 1), and if it
still comes back otherwise with its own backslashes doubled first (level 2). Level 2 always comes
back: no control string is left in it, and every backslash in it is half of a pair that the parser
undoes from left to right. The whole conversation is then parsed once more from the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import let, read_table

HEAD, SEP, END = "### ", ": ", "</turn>"
_CUT = r"</turn>\n|### "


def _verbatim(text: Column) -> Column:
    return text


def _broken(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(END), F.lit("<\\/turn>")), F.lit(HEAD), F.lit("#\\## "))


def _doubled(text: Column) -> Column:
    return _broken(F.replace(text, F.lit("\\"), F.lit("\\\\")))


#: The colon of a role is broken up in the same way, so that the first ": " ends the role.
def _role(role: Column, escape) -> Column:
    return F.replace(escape(role), F.lit(SEP), F.lit(":\\# ")) if escape is not _verbatim else role


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\/#])", "$1")


def _unrole(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(":\\# "), F.lit(SEP)))


def _render(role: Column, text: Column, escape) -> Column:
    return F.concat(F.lit(HEAD), _role(role, escape), F.lit(SEP), escape(text), F.lit(END + "\n"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted string, array<struct<role,text>>; defined for every string."""

    def turn(piece: Column) -> Column:
        return let(
            F.instr(piece, SEP),
            lambda at: F.struct(
                F.when(at > 0, _unrole(F.substr(piece, F.lit(1), at - 1))).otherwise(piece).alias("role"),
                F.when(at > 0, unescape(F.substr(piece, at + len(SEP)))).otherwise("").alias("text"),
            ),
        )

    return F.transform(F.filter(F.split(formatted, _CUT), lambda p: p != ""), turn)


def format_conversations(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant"
) -> DataFrame:
    """One row per conversation: (conv, formatted, loss_mask, n_turns, max_escape_level).

    `loss_mask` has one entry per turn, struct<start,length>: the code points, counted from the start
    of that turn's rendering, that carry loss; length 0 for a turn without loss. The rendering of
    turn i is the i-th piece of `formatted` cut after "</turn>" + newline.

    Nulls: a null text or role counts as empty; turns without a conversation form one conversation
    with a null key; a null turn number comes first. Ties of a turn number are ordered by role and
    text, repeated rows are kept. Other columns are ignored. An empty table gives no rows.

    A conversation is one output string, so its turns have to meet in one task; each of them is
    rendered before the shuffle, and the turns of one input split are gathered before it too.
    """
    r, t = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), r.alias("role"), t.alias("text"))
    back = lambda escape: parse(_render(F.col("role"), F.col("text"), escape))
    same = lambda found: (F.size(found) == 1) & (found[0]["role"] == F.col("role")) & (found[0]["text"] == F.col("text"))
    level = F.when(let(back(_verbatim), same), 0).when(let(back(_broken), same), 1).otherwise(2)
    rows = rows.withColumn("level", level)
    escapes = (_verbatim, _broken, _doubled)
    pick = lambda f: F.when(F.col("level") == 0, f(escapes[0])).when(F.col("level") == 1, f(escapes[1])).otherwise(f(escapes[2]))
    start = F.length(pick(lambda e: _role(F.col("role"), e))) + len(HEAD) + len(SEP)
    rows = rows.select(
        "conv",
        F.struct(
            "turn",
            "role",
            "text",
            pick(lambda e: _render(F.col("role"), F.col("text"), e)).alias("out"),
            start.cast("int").alias("start"),
            F.when(F.col("role") == loss_role, F.length(pick(lambda e: e(F.col("text"))))).otherwise(0).cast("int").alias("length"),
            "level",
        ).alias("t"),
    )
    made = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return made.select(
        F.col("conv").alias(conv),
        F.array_join(F.transform("t", lambda x: x["out"]), "").alias("formatted"),
        F.transform("t", lambda x: F.struct(x["start"], x["length"])).alias("loss_mask"),
        F.size("t").cast("long").alias("n_turns"),
        F.array_max(F.transform("t", lambda x: x["level"])).alias("max_escape_level"),
    )


def loss_text(formatted: Column, loss_mask: Column) -> Column:
    """The unescaped text under the loss mask, read from the formatted string."""
    pieces = F.split(formatted, END + "\n")
    return F.array_join(F.zip_with(F.slice(pieces, F.lit(1), F.size(loss_mask)), loss_mask, lambda p, m: unescape(F.substr(p, m["start"] + 1, m["length"]))), "")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    made = format_conversations(table.unionByName(extra))
    read = made.withColumn("turns", parse(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_mask")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), levels AS (
  SELECT *, contains(text, '\\') OR contains(text, '\/') OR contains(text, '\#') AS slashes,
    len(text) - len(replace(text, '</turn>', '')) AS ends,
    len(text) - len(replace(text, '### ', '')) AS heads,
    slashes OR heads > 0 OR contains(text, '</turn>' || chr(10)) AS escaped
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(len(role) + len(text) + 14 + CASE WHEN escaped THEN ends // 7 + heads // 4 ELSE 0 END
    + CASE WHEN slashes THEN len(text) - len(replace(text, '\', '')) ELSE 0 END) AS BIGINT) AS formatted_chars
FROM levels GROUP BY conv_id
"""
