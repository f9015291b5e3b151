"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Numbers, names and units of documents and benchmark items become typed placeholders, so that a question with other
parameters has the same template. Windows of five template tokens are hash-joined. Along one alignment of document
and item, equal slot values of the item must have equal values in the document; alignments that contradict
themselves are dropped. A document is contaminated by an item of whose windows it has at least a given share.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import shared_folder

NUMERAL = r"[0-9]+(?:[.,][0-9]+)*"
#: A word with a capital and then a small letter, after a word, number or comma and not after the end of a sentence.
NAMED = r"(?=\p{Lu}\p{Ll})(?<=[\p{L}\p{M}0-9][^\p{L}\p{M}0-9.!?\n]{1,8})[\p{L}\p{M}]+"
#: Placeholders are digits, for no other digit is left in a template.
NUMBER, NAME, UNIT = "0", "1", "2"
UNITS = ("mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "l", "s", "min", "h", "hours", "hour", "minutes", "days", "day", "weeks", "years", "year", "miles", "feet", "inches", "pounds", "dollars", "euros", "cents", "percent", "mph", "degrees")


@dataclass(frozen=True)
class Settings:
    """window: template tokens a window; literals: least words in it that are no placeholder; share: of an item's windows; agree: least share of an alignment's slot values with one counterpart; chunk: most benchmark windows that are broadcast at once."""

    window: int = 5
    literals: int = 3
    share: float = 0.5
    agree: float = 0.6
    chunk: int = 500_000


def template(text: Column) -> Column:
    """Template tokens of a text in order: words in lower case and placeholders. Null text has none."""
    numbered = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), NUMERAL, f" {NUMBER} ")
    measured = F.regexp_replace(numbered, f"(?i)(?<=0 {{1,3}})(?:{'|'.join(UNITS)})(?![\\p{{L}}\\p{{M}}])", f" {UNIT} ")
    named = F.lower(F.regexp_replace(measured, NAMED, f" {NAME} "))
    return F.filter(F.split(named, r"[^\p{L}\p{M}0-2]+"), lambda t: t != "")


def values(text: Column) -> Column:
    """The text of every template token, in lower case: as many, in the same order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(rf"[\p{{L}}\p{{M}}]+|{NUMERAL}"), F.lit(0))


def windows(t: Column, width: int) -> Column:
    """Hash of the template tokens of every window, in order; shorter texts have none. t is a plain column: it is read for every window."""
    at = F.when(F.size(t) >= width, F.sequence(F.lit(0), F.size(t) - width)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(t, i + j) for j in range(width)]))


def contamination(docs: DataFrame, items: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, matched, windows, share for every document and item that contaminates it.

    Items of fewer tokens than a window, or without a window of enough literals, match nothing; so do null and empty
    texts. Rows that repeat a document id count as one document, null ids as one too. Items that repeat an item id
    pool their windows. Empty tables give no rows. Other columns, of whatever name, are not read.
    """
    w = s.window
    shared_folder(docs.sparkSession)
    bench = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"), template(F.col(item_text_col)).alias("t"))
    bench = bench.select("item_id", "text", "t", F.posexplode(windows(F.col("t"), w)).alias("at", "hash"))
    literal = F.size(F.filter(F.slice("t", F.col("at") + 1, w), lambda x: ~x.isin(NUMBER, NAME, UNIT)))
    bench = bench.where(literal >= s.literals).select("item_id", "at", "hash", F.slice("t", F.col("at") + 1, w).alias("kinds"), F.slice(values(F.col("text")), F.col("at") + 1, w).alias("own")).checkpoint()
    sizes = bench.groupBy("item_id").agg(F.countDistinct("hash").alias("windows"))
    chunks = max(1, -(-bench.count() // s.chunk))
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), template(F.col(text_col)).alias("t"))
    text = text.select("doc_id", "text", F.posexplode(windows(F.col("t"), w)).alias("pos", "hash"))
    found = None
    for n in range(chunks):  # more chunks scan the documents again; each is small enough to be broadcast
        part = bench if chunks == 1 else bench.where(F.pmod(F.col("hash"), F.lit(chunks)) == n)
        hit = text.join(F.broadcast(part), "hash")
        hit = hit.select("doc_id", "item_id", "hash", (F.col("pos") - F.col("at")).alias("shift"), F.arrays_zip("kinds", "own", F.slice(values(F.col("text")), F.col("pos") + 1, w).alias("theirs")).alias("both"))
        found = hit if found is None else found.unionByName(hit)
    slots = F.transform(F.filter("both", lambda x: x["kinds"].isin(NUMBER, NAME, UNIT)), lambda x: F.struct(x["kinds"].alias("t"), x["own"].alias("item"), x["theirs"].alias("doc")))
    aligned = found.select("doc_id", "item_id", "shift", "hash", slots.alias("pairs")).groupBy("doc_id", "item_id", "shift").agg(F.collect_set("hash").alias("hashes"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    told = F.size(F.array_distinct(F.transform("pairs", lambda p: F.struct(p["t"], p["item"]))))
    fair = aligned.where((F.size("pairs") == 0) | (told >= s.agree * F.size("pairs")))
    matched = fair.select("doc_id", "item_id", F.explode("hashes").alias("hash")).groupBy("doc_id", "item_id").agg(F.countDistinct("hash").alias("matched"))
    out = matched.join(sizes, "item_id").withColumn("share", F.col("matched") / F.col("windows")).where(F.col("share") >= s.share)
    return out.select(F.col("doc_id").alias(id_col), F.col("item_id").alias(item_col if item_col != id_col else "item_id"), "matched", "windows", "share")
