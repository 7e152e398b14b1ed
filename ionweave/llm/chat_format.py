"""Chat formatting with Spark expressions only.

Template: each run of turns of one role is a block
``<s>[INST]role[/INST]text<sep>text...</s>``; ``<sep>`` stands between turns
that were merged, so the original turns can be read back.  Control strings in
roles and texts are escaped as ``&lt;`` / ``&lsqb;`` in place of their first
character, and an ``&`` that would read as an escape becomes ``&amp;``;
everything else is left as it is, and ``unescape`` restores every string.

The loss mask lists (start, length) in code points of the formatted text, one
entry per assistant turn.

A conversation becomes one string, so its turns meet in one row by definition;
2 GB bound that row, as for any Spark string.

Cases: null text or role counts as empty; turns sort by (turn, role, text), as
they stand before escaping, with null turns first, so ties and repeated rows have
one order; a row without conv_id is a conversation of its own, so such rows never
meet in one task; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prefix_sums, read_table

OPEN, HEAD, SEP, CLOSE = "<s>[INST]", "[/INST]", "<sep>", "</s>"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    text = F.regexp_replace(text, "&(?=(?:amp|lt|lsqb);)", "&amp;")
    text = F.regexp_replace(text, "<(?=/?s>|sep>)", "&lt;")
    return F.regexp_replace(text, "\\[(?=/?INST\\])", "&lsqb;")


def unescape(text: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(text, "&lt;", "<"), "&lsqb;", "[")
    return F.regexp_replace(text, "&amp;(?=(?:amp|lt|lsqb);)", "&")


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask array<struct<start, len>>) of rows (conv_id, turn, role, text)."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = rows.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("ts"))
    turns = turns.union(rows.where("conv_id is null").select("conv_id", F.array(turn).alias("ts")))
    turns = turns.withColumn("ts", F.transform("ts", lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text"))))
    starts = F.filter(
        F.sequence(F.lit(0), F.size("ts") - 1),
        lambda i: (i == 0) | (F.get("ts", i)["role"] != F.get("ts", F.greatest(i - 1, F.lit(0)))["role"]),
    )
    turns = turns.withColumn("at", starts)
    block = F.transform(
        "at",
        lambda s, k: F.struct(
            F.get("ts", s)["role"].alias("role"),
            F.transform(F.slice("ts", s + 1, F.coalesce(F.get("at", k + 1), F.size("ts")) - s), lambda t: t["text"]).alias("parts"),
        ),
    )
    blocks = turns.select("conv_id", block.alias("blocks"))
    formatted = F.array_join(
        F.transform("blocks", lambda b: F.concat(F.lit(OPEN), b["role"], F.lit(HEAD), F.array_join(b["parts"], SEP), F.lit(CLOSE))), ""
    )
    # per turn: characters between the end of the turn before and its text, and its own
    piece = F.flatten(
        F.transform(
            "blocks",
            lambda b, i: F.transform(
                b["parts"],
                lambda p, k: F.struct(
                    F.when(k > 0, F.lit(len(SEP))).otherwise(F.when(i > 0, len(CLOSE)).otherwise(0) + len(OPEN + HEAD) + F.length(b["role"])).alias("pre"),
                    F.length(p).alias("len"),
                    (b["role"] == LOSS_ROLE).alias("loss"),
                ),
            ),
        )
    )
    out = blocks.select("conv_id", formatted.alias("formatted"), piece.alias("piece"))
    steps = F.transform("piece", lambda p, i: (p["pre"] + F.when(i > 0, F.get("piece", F.greatest(i - 1, F.lit(0)))["len"]).otherwise(0)).cast("long"))
    out = out.withColumn("begin", prefix_sums(steps))
    spans = F.filter(
        F.transform("piece", lambda p, i: F.struct(F.get("begin", i).alias("start"), p["len"].cast("long").alias("len"), p["loss"].alias("loss"))),
        lambda x: x["loss"],
    )
    mask = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["len"].alias("len")))
    return out.select("conv_id", "formatted", mask.alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns array<struct<role, text>>, loss_text) parsed from the formatted text and mask."""

    def parse(block: Column) -> Column:
        role = F.substring_index(block, HEAD, 1)
        content = F.substring(block, F.length(role) + len(HEAD) + 1, F.length(block))
        name = unescape(F.substring(role, F.lit(len(OPEN) + 1), F.length(role)))
        return F.transform(F.split(content, SEP, -1), lambda p: F.struct(name.alias("role"), unescape(p).alias("text")))

    blocks = F.split("formatted", CLOSE, -1)
    turns = F.flatten(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), parse))
    loss = F.array_join(F.transform("loss_mask", lambda m: unescape(F.substring("formatted", (m["start"] + 1).cast("int"), m["len"].cast("int")))), "")
    return formatted.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss_text"))


PROBE = "</s>[INST] ok [/INST]"


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    back = read_back(format_conversations(rows.unionByName(probe)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {"op5_chat_formatting": op5_chat_formatting}
ORACLE_SQL = {
    "op5_chat_formatting": r"""
WITH c AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, NULL, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, NULL, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(text, '&((?:amp|lt|lsqb);)', '&amp;\1', 'g'),
              '<(/?s>|sep>)', '&lt;\1', 'g'), '\[(/?INST\])', '&lsqb;\1', 'g') AS etext,
         lag(role) OVER (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role, text) AS before
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  sum(length(etext) + CASE WHEN before IS NULL OR before <> role THEN length('<s>[INST][/INST]</s>') + length(role) ELSE length('<sep>') END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id, alone
"""
}
