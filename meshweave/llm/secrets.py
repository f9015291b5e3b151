"""Secret scans: known forms by pattern, and strings that pass for random by a battery of tests.

Runs of sixteen and more letters, digits and signs get the smallest encoding that holds them (decimal, hex, base 32, 36,
62, 64). Under it, four tests ask whether the string could be random: chi-squared of its symbols, chi-squared of its
classes of symbols (digits, capitals ...), the number of runs in the lower and upper half of the alphabet, and the serial
correlation of neighbours. Fisher's method makes them one p-value: even for random strings, near 0 for words.

How many strings with a large p-value are random depends on how many ordinary ones there are of that encoding and
length, as short words look random now and then. So the p-values of the whole corpus are counted by encoding and length;
those near 1 tell how many random strings there are, and each stratum's threshold is the least at which the share of
others among the reported stays below the false-discovery rate. All of it is DataFrame functions on arrays in a
document's row: no exchange but that of the counts.
"""

from __future__ import annotations

import math
from string import ascii_lowercase, ascii_uppercase, digits

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Held

#: The forms of the contract, with the letters of the keywords in either case. Shorter runs of the last two are no finds, so they need not match.
_KEYWORD = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"""({_KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (("assign", ASSIGN), ("access", "AKIA[A-Z0-9]{12,}"), ("hex", "[0-9a-f]{32,}"))
KINDS = [kind for kind, _ in BASE] + ["random"]
TOKEN = "[A-Za-z0-9+/_-]{16,}={0,2}"
#: Alphabets by size, each as its classes of symbols.
ENCODINGS = (
    (digits,), (digits, ascii_lowercase[:6]), (digits, ascii_uppercase[:6]), (ascii_uppercase, digits[2:8]), (digits, ascii_lowercase),
    (digits, ascii_uppercase, ascii_lowercase), (digits, ascii_uppercase, ascii_lowercase, "+/"), (digits, ascii_uppercase, ascii_lowercase, "-_"),
)
LEAST_BITS, BINS, SURE = 64, 20, 16
RUN, CHUNK = 256, 4096


def running(values: Column) -> Column:
    """Running sums of an array of longs, by runs of RUN values, so that the work grows with the array."""
    zero, none = F.lit(0).cast("long"), F.array().cast("array<long>")
    sums = lambda xs: F.aggregate(xs, F.struct(zero.alias("at"), none.alias("out")), lambda d, x: F.struct((d["at"] + x).alias("at"), F.concat(d["out"], F.array(d["at"] + x)).alias("out")))["out"]
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / RUN).cast("int")), lambda b: F.slice(values, b * RUN + 1, F.lit(RUN)))
    local = F.transform(blocks, sums)
    before = F.aggregate(local, F.struct(zero.alias("at"), none.alias("out")), lambda d, x: F.struct((d["at"] + F.element_at(x, -1)).alias("at"), F.concat(d["out"], F.array(d["at"])).alias("out")))["out"]
    return F.when(F.size(values) == 0, none).otherwise(F.flatten(F.zip_with(local, before, lambda xs, b: F.transform(xs, lambda x: x + b))))


def located(docs: DataFrame, pattern: str, name: str) -> DataFrame:
    """docs with an array name of struct start, end, match: all matches in the column text, leftmost first, in code points from 0."""
    there = F.col("text").rlike(pattern)
    rows = docs.withColumn("__m", F.when(there, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("__p", F.when(F.size("__m") > 0, F.transform(F.split("text", pattern, -1), lambda x: F.length(x).cast("long"))).otherwise(F.array().cast("array<long>")))
    rows = rows.withColumn("__l", F.zip_with(F.slice("__p", 1, F.size("__m")), "__m", lambda p, m: p + F.length(m)))
    rows = rows.withColumn("__e", running(F.col("__l")))
    return rows.withColumn(name, F.zip_with("__e", "__m", lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("match")))).drop("__m", "__p", "__l", "__e")


def erfc(z: Column) -> Column:
    """Of z not below 0, with a relative error of 1.2e-7: the Chebyshev fit of Numerical Recipes."""
    fixed = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    t = 1 / (1 + z / 2)
    out = F.lit(fixed[-1])
    for c in fixed[-2::-1]:
        out = out * t + c
    return t * F.exp(out - z * z)


def upper(z: Column) -> Column:
    """Share of a normal distribution above z."""
    half = erfc(F.abs(z) / math.sqrt(2)) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def _each(values: Column, **more) -> Column:
    """The structs of an array with more fields; each is told from the struct as it was."""
    kept, new = more.pop("kept"), more
    return F.transform(values, lambda x: F.struct(*[x[k].alias(k) for k in kept], *[f(x).alias(k) for k, f in new.items()]))


def _of(values: list, e: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), e + 1)


def tested(tokens: Column) -> Column:
    """From an array of struct start, end, match the candidates with start, end, stratum and p."""
    whole = ["".join(c) for c in ENCODINGS]
    encoding = lambda t: F.coalesce(*[F.when(F.translate(t, a, "") == "", i) for i, a in enumerate(whole)])
    least = [math.ceil(LEAST_BITS / math.log2(len(a))) for a in whole]
    out = _each(tokens, kept=["start", "end"], t=lambda x: F.rtrim(x["match"], F.lit("=")))
    out = _each(out, kept=["start", "end", "t"], e=lambda x: encoding(x["t"]), n=lambda x: F.length(x["t"]))
    out = F.filter(out, lambda x: x["e"].isNotNull() & (x["n"] >= _of(least, x["e"])))
    out = _each(out, kept=["start", "end", "t", "e", "n"], a=lambda x: _of(whole, x["e"]), k=lambda x: _of([len(a) for a in whole], x["e"]).cast("double"))
    halves = ["L" * (len(a) // 2) + "H" * (len(a) // 2) for a in whole]
    out = _each(
        out, kept=["start", "end", "t", "e", "n", "a", "k"],
        counts=lambda x: F.transform(F.split(x["a"], ""), lambda c: (x["n"] - F.length(F.replace(x["t"], c, F.lit("")))).cast("double")),
        half=lambda x: F.coalesce(*[F.when(x["e"] == i, F.translate(x["t"], a, h)) for i, (a, h) in enumerate(zip(whole, halves, strict=True))]),
    )
    changes = lambda h, pair: (F.length(h) - F.length(F.replace(h, F.lit(pair), F.lit("")))) / 2
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, v: s + v)
    sizes = [[float(len(c)) for c in classes] for classes in ENCODINGS]
    starts = [[sum(map(len, classes[:i])) + 1 for i in range(len(classes))] for classes in ENCODINGS]

    def by_class(x: Column) -> Column:
        shares = _of_arrays(sizes, x["e"])
        return total(F.zip_with(_of_arrays(starts, x["e"]), shares, lambda s, m: F.pow(total(F.slice(x["counts"], s.cast("int"), m.cast("int"))) - x["n"] * m / x["k"], F.lit(2.0)) / (x["n"] * m / x["k"])))

    def serial(x: Column) -> Column:
        place = lambda c: F.instr(x["a"], c) - (x["k"] + 1) / 2
        start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("sum"))
        part = lambda b: F.aggregate(F.split(F.substring(x["t"], b * CHUNK + 1, F.lit(CHUNK + 1)), ""), start, lambda d, c: F.struct(place(c).alias("last"), (d["sum"] + F.coalesce(d["last"] * place(c), F.lit(0.0))).alias("sum")))["sum"]
        return total(F.transform(F.sequence(F.lit(0), F.floor((x["n"] - 2) / CHUNK).cast("int")), part))

    out = _each(
        out, kept=["start", "end", "e", "n", "k"],
        symbols=lambda x: F.aggregate(x["counts"], F.lit(0.0), lambda s, v: s + v * v) * x["k"] / x["n"] - x["n"],
        classes=by_class, turns=lambda x: changes(x["half"], "LH") + changes(x["half"], "HL"), lag=serial,
    )
    free = lambda x: (_of([len(c) - 1 for c in ENCODINGS], x["e"])).cast("double")
    spread = lambda f: F.sqrt(2 / (9 * f))
    out = _each(
        out, kept=["start", "end", "e", "n"],
        p1=lambda x: upper((x["symbols"] - (x["k"] - 1)) / F.sqrt(2 * (x["k"] - 1) * (x["n"] - 1) / x["n"])),
        p2=lambda x: F.when(x["e"] > 0, upper((F.pow(x["classes"] / free(x), F.lit(1 / 3)) - 1 + 2 / (9 * free(x))) / spread(free(x)))),
        p3=lambda x: erfc(F.abs(x["turns"] - (x["n"] - 1) / 2) / F.sqrt((x["n"] - 1) / 4) / math.sqrt(2)),
        p4=lambda x: erfc(F.abs(x["lag"]) / ((x["k"] * x["k"] - 1) / 12 * F.sqrt(x["n"] - 1)) / math.sqrt(2)),
    )
    nats = lambda p: -F.ln(F.greatest(p, F.lit(1e-300)))
    out = _each(out, kept=["start", "end", "e", "n"], x=lambda x: nats(x["p1"]) + nats(F.coalesce(x["p2"], F.lit(1.0))) + nats(x["p3"]) + nats(x["p4"]))
    fisher = lambda x: F.exp(-x["x"]) * (1 + x["x"] + x["x"] * x["x"] / 2 + F.when(x["e"] > 0, F.pow(x["x"], F.lit(3.0)) / 6).otherwise(0.0))
    return _each(out, kept=["start", "end"], e=lambda x: x["e"], size=lambda x: F.floor(F.log2(x["n"].cast("double"))).cast("int"), p=fisher)


def _of_arrays(values: list[list], e: Column) -> Column:
    return F.element_at(F.array(*[F.array(*[F.lit(float(v)) for v in vs]) for vs in values]), e + 1)


def thresholds(found: DataFrame, rate: float, few: int = 50) -> DataFrame:
    """One row: a map from encoding * 64 + size to the least p that is reported, from the candidates e, size, p of all documents.

    The candidates of a stratum are counted in BINS of p. Those from SURE on tell the number of random strings; the
    threshold is the least bin from which at most the given share is others. Strata of few candidates are counted over
    all lengths of their encoding. The table has some hundred strata at most.
    """
    bins = F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).cast("int")
    counts = found.groupBy("e", "size", bins.alias("bin")).agg(F.count("*").alias("n"))
    own = counts.groupBy("e", "size").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("own"), F.sum("n").alias("all"))
    encoding = counts.groupBy("e", "bin").agg(F.sum("n").alias("n")).groupBy("e").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("pooled"))
    known = own.join(encoding, "e").withColumn("c", F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.coalesce(F.try_element_at(F.when(F.col("all") < few, F.col("pooled")).otherwise(F.col("own")), b), F.lit(0)).cast("double")))
    above = lambda j: F.aggregate(F.slice("c", j + 1, F.lit(BINS)), F.lit(0.0), lambda s, v: s + v)
    random = above(F.lit(SURE)) * BINS / (BINS - SURE)
    others = lambda j: above(j) - random * (BINS - j) / BINS
    fit = F.filter(F.sequence(F.lit(0), F.lit(SURE)), lambda j: (others(j) <= rate * above(j)) | (j == SURE))
    return known.select((F.col("e") * 64 + F.col("size")).alias("stratum"), (F.array_min(fit) / BINS).alias("p")).agg(F.map_from_entries(F.collect_list(F.struct("stratum", "p"))).alias("least"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.05) -> tuple[DataFrame, Held]:
    """One row a row of docs: the id, spans (array of struct start, rank, end; code points, end exclusive; by start and then rank, the kind's place in KINDS), and the table that they are read from, to be dropped in the end.

    Kinds: the base forms assign, access and hex, which are always found, and random, what the battery adds (also inside
    a base span). Null texts are empty. Long texts are scanned whole. Rows are judged each, whatever their id, so
    repeated rows and ids and null ids keep their rows. An empty table gives no rows. Other columns are not read.
    """
    held = Held()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    for kind, pattern in BASE:
        rows = located(rows, pattern, kind)
    rows = located(rows, TOKEN, "token")
    long_enough = F.filter("assign", lambda x: F.length(F.regexp_extract(x["match"], ASSIGN, 2)) >= 8)
    ranked = lambda found, rank: F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end")))
    base = F.concat(*[ranked(found, rank) for rank, found in enumerate((long_enough, F.col("access"), F.col("hex")))])
    kept, _ = held.cut(rows.select("id", base.alias("base"), tested(F.col("token")).alias("tested")), "secret-candidates")
    least = thresholds(kept.select(F.explode("tested").alias("x")).select("x.*"), rate)
    passed = lambda x: x["p"] >= F.try_element_at(F.col("least"), x["e"] * 64 + x["size"])
    more = ranked(F.filter("tested", passed), len(BASE))
    return kept.join(F.broadcast(least), how="cross").select("id", F.array_sort(F.concat("base", more)).alias("spans")), held
