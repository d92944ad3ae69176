"""Multi-party chat formatting with perspective rotation.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant,
all others as named users, and a mask over what the assistant says (its text and end mark). System
turns belong to no participant and are never masked.

A dialogue is rendered in chunks of ``CHUNK`` consecutive turn numbers, so that no row, group or
task holds a whole conversation's text however long it is; where chunks begin is found from their
lengths alone, in two levels of ``SPAN`` chunks. Each chunk says where it begins in the rendered
dialogue; joined in the order of ``chunk`` they are the dialogue. Mask spans count from its beginning.

Defined cases: a null speaker is named ``unknown``; a null text is empty; turns without a number come
last; ties and repeated rows stay, ordered by speaker and text; end and start marks inside of a text
are broken up by a blank, so that no text can forge a turn; a conversation of system turns alone has
no perspective; a null conversation id is a conversation of its own; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfcast.llm.tables import table

CHUNK, SPAN = 64, 4096
SYSTEM = "system"
#: The marks of a rendered turn.
START, END = "<|im_start|>", "<|im_end|>"


def render_perspectives(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(conv_id, perspective, chunk, first_char, rendered, mask: array of (begin, end), n_turns)."""
    clean = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(speaker).cast("string"), F.lit("unknown")).alias("speaker"),
        F.replace(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    )
    # turns without a number follow all others, in parts by a hash of their text
    place = F.coalesce(F.floor(F.col("turn") / chunk), F.lit(1 << 60) + F.pmod(F.xxhash64("text"), F.lit(1024)))
    chunks = clean.groupBy("conv_id", place.alias("chunk")).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(0)).alias("turn"), "speaker", "text"))).alias("turns"))
    people = clean.where(F.col("speaker") != SYSTEM).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    joined = chunks.withColumnRenamed("conv_id", "__conv").join(people, F.col("__conv").eqNullSafe(F.col("conv_id")))
    own = lambda t: t["speaker"] == F.col("perspective")

    def head(t: Column) -> Column:
        return F.when(own(t), F.lit(f"{START}assistant\n")).when(t["speaker"] == SYSTEM, F.lit(f"{START}system\n")).otherwise(F.concat(F.lit(f"{START}user name="), t["speaker"], F.lit("\n")))

    parts = F.transform("turns", lambda t: F.struct(own(t).alias("own"), head(t).alias("head"), F.concat(t["text"], F.lit(END)).alias("body")))
    shown = joined.select("conv_id", "perspective", "chunk", parts.alias("parts"))
    shown = shown.withColumn("rendered", F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), ""))
    placed = shown.join(_places(shown).select(F.col("conv_id").alias("__c"), F.col("perspective").alias("__p"), F.col("chunk").alias("__k"), "first_char"), F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("perspective") == F.col("__p")) & (F.col("chunk") == F.col("__k")))
    start = F.struct(F.col("first_char").alias("at"), F.array().cast("array<struct<begin:bigint,end:bigint>>").alias("mask"))

    def step(a: Column, p: Column) -> Column:
        begin = a["at"] + F.char_length(p["head"])
        end = begin + F.char_length(p["body"])
        return F.struct((end + 1).alias("at"), F.when(p["own"], F.concat(a["mask"], F.array(F.struct(begin.alias("begin"), end.alias("end"))))).otherwise(a["mask"]).alias("mask"))

    return placed.select("conv_id", "perspective", "chunk", "first_char", "rendered", F.aggregate("parts", start, step, lambda a: a["mask"]).alias("mask"), F.size("parts").alias("n_turns"))


def _places(shown: DataFrame) -> DataFrame:
    """(conv_id, perspective, chunk, first_char): lengths are summed within spans of chunks, and the spans' sums before them are added."""
    lengths = shown.select("conv_id", "perspective", "chunk", F.floor(F.col("chunk") / SPAN).alias("span"), F.char_length("rendered").cast("long").alias("n"))
    spans = lengths.groupBy("conv_id", "perspective", "span").agg(F.sum("n").alias("n"))
    in_order = Window.partitionBy("conv_id", "perspective").orderBy("span")
    starts = spans.select(F.col("conv_id").alias("__c"), F.col("perspective").alias("__p"), F.col("span").alias("__s"), (F.sum("n").over(in_order) - F.col("n")).alias("start"))
    inside = F.sum("n").over(Window.partitionBy("conv_id", "perspective", "span").orderBy("chunk")) - F.col("n")
    same = F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("perspective") == F.col("__p")) & (F.col("span") == F.col("__s"))
    return lengths.withColumn("inside", inside).join(starts, same).select("conv_id", "perspective", "chunk", (F.col("start") + F.col("inside")).alias("first_char"))


def op1_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = render_perspectives(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["begin"].cast("string"), m["end"].cast("string"))), ",")
    masked = F.aggregate("mask", F.lit(0).cast("long"), lambda a, m: a + m["end"] - m["begin"])
    return rows.select("conv_id", "perspective", "chunk", "first_char", "rendered", spans.alias("mask_spans"), masked.alias("masked_chars"), F.col("n_turns").cast("long").alias("n_turns"))


#: Turns without a number, whose chunks go by a hash of Spark's, are left out here; the given tables have none.
SQL = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS text, CAST(floor(turn / {CHUNK}.0) AS BIGINT) AS chunk FROM conversations WHERE turn IS NOT NULL),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> '{SYSTEM}'),
r AS (SELECT t.conv_id, perspective, chunk, turn, speaker, text, speaker = perspective AS own,
  CASE WHEN speaker = perspective THEN '{START}assistant' || chr(10) WHEN speaker = '{SYSTEM}' THEN '{START}system' || chr(10) ELSE '{START}user name=' || speaker || chr(10) END AS head, text || '{END}' AS body
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
c AS (SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective ORDER BY chunk, turn, speaker, text ROWS UNBOUNDED PRECEDING) - length(body) - length(head) - 1 AS pos FROM r)
SELECT conv_id, perspective, chunk, CAST(min(pos) AS BIGINT) AS first_char, string_agg(head || body || chr(10), '' ORDER BY turn, speaker, text) AS rendered,
  coalesce(string_agg(CAST(pos + length(head) AS BIGINT) || ':' || CAST(pos + length(head) + length(body) AS BIGINT), ',' ORDER BY turn, speaker, text) FILTER (WHERE own), '') AS mask_spans,
  CAST(coalesce(sum(length(body)) FILTER (WHERE own), 0) AS BIGINT) AS masked_chars, count(*) AS n_turns
FROM c GROUP BY conv_id, perspective, chunk"""
