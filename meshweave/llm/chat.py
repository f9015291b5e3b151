"""Chat formatting by multi-party perspective rotation, with DataFrame functions only.

For every participant of a dialogue the dialogue is rendered once, that speaker as the assistant and each other one
as a named user; only the assistant's words bear loss, given as character spans of the rendered text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEVER = ("system",)


def rotate(turns: DataFrame, instructions: tuple[str, ...] = NEVER, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, speaker, rendered, spans (array of start, length), turns and loss_chars, one row for each participant.

    instructions: roles that instruct and do not speak; they keep their name, bear no loss and are no participant.
    Every dialogue is rendered whole, whatever its length; a dialogue is the unit of a training example, so it has to fit
    a task's memory as often as it has participants. Turns are ordered by turn (nulls first), role, text; repeated rows
    stay. A null role is the participant "unknown", a null text is empty, null ids form one dialogue. Dialogues of
    instructions only, and empty tables, give no rows. Other columns, of whatever name, are not read.
    """
    rows = turns.select(
        F.col(id_col),
        F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).alias("said"),
    )
    talks = rows.groupBy(id_col).agg(F.sort_array(F.collect_list("said")).alias("said"))
    speakers = F.array_sort(F.array_except(F.array_distinct(F.transform("said", lambda x: x["role"])), F.array(*map(F.lit, instructions)).cast("array<string>")))
    each = talks.select(id_col, "said", F.explode(speakers).alias("speaker"))

    def head(x):
        other = F.when(x["role"].isin(*instructions), F.concat(F.lit("<|"), x["role"], F.lit("|>\n"))).otherwise(F.concat(F.lit("<|user name="), x["role"], F.lit("|>\n")))
        return F.when(x["role"] == F.col("speaker"), F.lit("<|assistant|>\n")).otherwise(other)

    shown = F.transform("said", lambda x: F.struct(head(x).alias("head"), x["text"].alias("text"), (x["role"] == F.col("speaker")).alias("own")))
    each = each.withColumn("shown", shown)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("spans"))

    def step(done, x):
        begin = done["at"] + F.length(x["head"])
        span = F.array(F.struct(begin.cast("long").alias("start"), F.length(x["text"]).cast("long").alias("length")))
        return F.struct((begin + F.length(x["text"]) + 1).cast("long").alias("at"), F.when(x["own"], F.concat(done["spans"], span)).otherwise(done["spans"]).alias("spans"))

    spans = F.aggregate("shown", start, step)["spans"]
    rendered = F.array_join(F.transform("shown", lambda x: F.concat(x["head"], x["text"], F.lit("\n"))), "")
    loss = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["length"])
    return each.select(id_col, "speaker", rendered.alias("rendered"), spans.alias("spans"), F.size("said").cast("long").alias("turns")).withColumn("loss_chars", loss)
