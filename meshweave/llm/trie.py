"""Conversation prefix trie: which conversations begin alike, how far, and what it saves to keep a shared beginning once.

Every turn has a fingerprint of 64 bits; those of a conversation's prefixes are the running sums of a polynomial modulo
2**64, which NumPy scans piece by piece. Prefixes of one length and fingerprint are a group of candidates; its member of
the least id represents it, every other member's turn is verified against the representative's, and members that differ
are split off and grouped anew, until none differs. A node is owned by its least member, so each conversation owns a path
of nodes at its end; paths hang on nodes of other paths. Sums over subtrees go up from path to path with doubled
strides, as many rounds as the logarithm of the deepest nesting of paths, and down the path by blocks of depths.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pieces import by_batch, cut, digests
from .shared import RADIX, Held, mix64, powers, shared_folder

#: At most so many turns may come from another conversation.
SHARED = 3
BLOCK = 4096
WORDS = r"[\x20\x09-\x0D]+"


def power(e: int) -> int:
    return pow(RADIX, int(e), 1 << 64)


def signed(x: int) -> int:
    """A number modulo 2**64 as a long."""
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def scanned(bits: int) -> Callable[[list[tuple]], tuple]:
    """A piece's turns: their digests, words, and the running sums of their polynomial from the piece's first turn on. Rows: conv, turn, role, digest, words."""
    mask = np.uint64((1 << bits) - 1)

    def make(held: list[tuple]) -> tuple:
        said = np.frombuffer(b"".join(row[3][:8] for row in held), np.uint64)
        sums = np.add.accumulate((mix64(said) & mask) * powers()[0][: len(held)])
        return [row[3] for row in held], [row[4] for row in held], sums.view(np.int64).tolist()

    return make


def _offsets(pieces: pd.DataFrame) -> pd.DataFrame:
    """Where each piece of one conversation begins, the running sum before it, and the conversation's length and first turns."""
    pieces = pieces.sort_values(["part", "nth"], ignore_index=True)
    start, before, starts, sums = 0, 0, [], []
    heads: tuple[list, list, list] = ([], [], [])
    for n, total, first, words, said in zip(*(pieces[c] for c in ("n", "total", "sums", "words", "digests")), strict=True):
        starts.append(start)
        sums.append(signed(before))
        scale = power(start)
        for to, more in zip(heads, ([signed(before + scale * int(s)) for s in first], words, said), strict=True):
            to += list(more)[: SHARED - len(to)]
        before = signed(before + scale * int(total))
        start += int(n)
    out = pieces[["conv", "part", "nth"]].assign(start=starts, before=sums, turns=start)
    for name, values in zip(("head_sums", "head_words", "head_digests"), heads, strict=True):
        out[name] = [values] * len(out)
    return out


def _own(batch: pa.RecordBatch) -> list:
    """One row a turn that is a conversation's own. Columns: conv, start, before, digests, words, sums, borrowed, skipped, base_sum, own_sum."""
    conv, start, before, said, words, sums, borrowed, skipped, base_sum, own_sum = (c.to_pylist() for c in batch.columns)
    whole = lambda x: np.int64(x).view(np.uint64)
    ids, depths, prints, kept_words, kept_said = [], [], [], [], []
    for i, c in enumerate(conv):
        first = max(0, skipped[i] - start[i])
        n = len(words[i]) - first
        if n <= 0:
            continue
        running = whole(before[i]) + np.uint64(power(start[i])) * np.array(sums[i][first:], np.int64).view(np.uint64)
        found = whole(base_sum[i]) + np.uint64(power(borrowed[i] - skipped[i])) * (running - whole(own_sum[i]))
        ids += [c] * n
        depths.append(borrowed[i] + start[i] + np.arange(first, first + n) - skipped[i] + 1)
        prints.append(found.view(np.int64))
        kept_words += words[i][first:]
        kept_said += said[i][first:]
    flat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return [ids, flat(depths).tolist(), flat(prints).tolist(), kept_words, kept_said]


def _grouped(members: DataFrame, held: Held) -> tuple[DataFrame, DataFrame]:
    """Nodes of the groups of members, and for each conversation the last node that it shares with a smaller one and the first at which it differs from its group's representative."""
    key = ["branch", "depth", "print"]
    groups = members.groupBy(*key).agg(F.count("*").alias("n_convs"), F.min(F.struct("conv", "words", "digest")).alias("rep"))
    nodes, _ = held.cut(groups.select(*key, "n_convs", F.col("rep.conv").alias("owner"), F.col("rep.words").alias("words"), F.col("rep.digest").alias("said")), "trie-nodes")
    met = members.join(nodes.where("n_convs > 1").select(*key, "owner", "said"), key).where("conv <> owner")
    at = F.struct("depth", "owner")
    last, _ = held.cut(met.groupBy("conv").agg(F.max(at).alias("last"), F.min(F.when(F.col("digest") != F.col("said"), at)).alias("wrong")), "trie-last")
    return nodes, last


def _totals(paths: DataFrame, root: int, held: Held) -> DataFrame:
    """owner, saved and leaves of each path with all that hangs on it, from paths owner, above (the owner of the path that it hangs on), saved, leaves."""
    state = paths
    while True:
        known, _ = held.cut(state, "trie-sums")
        if not known.where("above IS NOT NULL").limit(1).count():
            return known.drop("above")
        more = known.where("above IS NOT NULL").groupBy("above").agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l")).withColumnRenamed("above", "to")
        up = known.select(F.col("owner").alias("at"), F.col("above").alias("next")).where("next IS NOT NULL")
        far = known.where(F.col("above") != root).join(up, F.col("above") == F.col("at")).select(F.col("owner").alias("from"), "next")
        state = known.join(more, F.col("owner") == F.col("to"), "left").join(far, F.col("owner") == F.col("from"), "left").select("owner", F.col("next").alias("above"), *[(F.col(a) + F.coalesce(b, F.lit(0))).alias(a) for a, b in (("saved", "s"), ("leaves", "l"))])


def trie(turns: DataFrame, fork: Callable[[Column], tuple[Column, Column]] | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", rows: int = 1024, bits: int = 64) -> tuple[DataFrame, Held]:
    """One row a node of the trie and the tables that it is read from, to be dropped in the end.

    Columns, long: conv_id (the least member, which owns the node), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (over its subtree, each node's words times its members but one), and ends_sha256 (of the ids of members
    that end here, ascending, comma-joined).

    fork: from an id the id of the conversation whose first turns it begins with, and how many (SHARED at most); its own
    as many turns are left out. An absent conversation lends none.

    Turns are ordered by turn (nulls first); rows of one turn by role and then by a digest of role and text. Null roles
    and texts are empty; an empty text has no words. Two turns are equal if the SHA-256 of role and text is. Repeated
    rows are turns each. Rows of a null id are left out. The root has depth 0 and all conversations as members; an empty
    table has no root. Long texts are digested whole. Other columns are not read.
    """
    held = Held()
    shared_folder(turns.sparkSession)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    said = turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    said = said.select("conv", "turn", "role", digest.alias("digest"), F.size(F.filter(F.split("text", WORDS), lambda w: w != "")).cast("long").alias("words"))
    order = ["conv", "turn", "role", "digest"]
    ordered = said.repartitionByRange(*order).sortWithinPartitions(*order)
    pieces, _ = held.cut(cut(ordered, ["conv"], rows, "digests array<binary>, words array<long>, sums array<long>", scanned(bits)), "trie-pieces")

    head = lambda c: F.slice(c, 1, SHARED)
    place = "conv long, part int, nth int"
    going = pieces.where("open").select("conv", "part", "nth", F.size("sums").alias("n"), F.element_at("sums", -1).alias("total"), *[head(c).alias(c) for c in ("sums", "words", "digests")])
    known, _ = held.cut(going.groupBy("conv").applyInPandas(lambda pdf: _offsets(pdf), f"{place}, start long, before long, turns long, head_sums array<long>, head_words array<long>, head_digests array<binary>"), "trie-offsets")
    facts = ["turns", "head_sums", "head_words", "head_digests"]
    whole = pieces.where("NOT open").select("conv", F.size("sums").cast("long").alias("turns"), *[head(c).alias(f"head_{c}") for c in ("sums", "words", "digests")])
    convs = whole.unionByName(known.where("start = 0").select("conv", *facts))
    begun = [F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("before")]
    placed = pieces.where("NOT open").select("conv", *begun, "digests", "words", "sums").unionByName(pieces.where("open").join(known.select("part", "nth", "start", "before"), ["part", "nth"]).select("conv", "start", "before", "digests", "words", "sums"))

    # what each conversation borrows and leaves out
    base, shared = fork(F.col("conv")) if fork else (F.lit(None).cast("long"), F.lit(0))
    lent = convs.select(F.col("conv").alias("base"), *[F.col(c).alias(f"base_{c}") for c in facts])
    forked = convs.withColumns({"base": base, "shared": shared.cast("int")}).join(lent, "base", "left")
    at = lambda c, n: F.when(n == 0, F.lit(0).cast("long")).otherwise(F.try_element_at(c, n))
    least = lambda a, b: F.least(F.col(a), F.coalesce(F.col(b), F.lit(0).cast("long"))).cast("int")
    forked = forked.withColumns({"borrowed": least("shared", "base_turns"), "skipped": least("shared", "turns")})
    forked = forked.withColumns({"length": (F.col("borrowed") + F.col("turns") - F.col("skipped")).cast("long"), "base_sum": at(F.col("base_head_sums"), F.col("borrowed")), "own_sum": at(F.col("head_sums"), F.col("skipped"))})
    convs, count = held.cut(forked.select("conv", "length", "borrowed", "skipped", "base_sum", "own_sum", *[F.slice(f"base_head_{c}", 1, F.col("borrowed")).alias(c) for c in ("sums", "words", "digests")]), "trie-convs")

    columns = "conv long, depth long, print long, words long, digest binary"
    own = by_batch(placed.join(convs.select("conv", "borrowed", "skipped", "base_sum", "own_sum"), "conv").select("conv", "start", "before", "digests", "words", "sums", "borrowed", "skipped", "base_sum", "own_sum"), columns, _own)
    taken = convs.where("borrowed > 0").select("conv", F.posexplode(F.arrays_zip("sums", "words", "digests")).alias("pos", "x")).select("conv", (F.col("pos") + 1).cast("long").alias("depth"), F.col("x.sums").alias("print"), F.col("x.words").alias("words"), F.col("x.digests").alias("digest"))
    members, _ = held.cut(own.unionByName(taken).withColumn("branch", F.lit("")), "trie-members")
    while True:
        nodes, last = _grouped(members, held)
        if not last.where("wrong IS NOT NULL").limit(1).count():
            break
        apart = last.where("wrong IS NOT NULL").select("conv", "wrong")
        beyond = F.col("depth") >= F.col("wrong.depth")
        branch = F.when(beyond, F.concat("branch", F.lit("/"), F.col("wrong.depth").cast("string"), F.lit(":"), F.col("wrong.owner").cast("string"))).otherwise(F.col("branch"))
        members, _ = held.cut(members.join(apart, "conv", "left").withColumn("branch", branch).drop("wrong"), "trie-members")

    # paths: from the node after the last shared one to the conversation's end; all but the least conversation share the root
    top = convs.agg(F.min("conv").alias("top"), F.count("*").alias("all"))
    root = top.first()["top"]
    hung = F.when(F.col("conv") != root, F.coalesce(F.col("last"), F.struct(F.lit(0).cast("long").alias("depth"), F.lit(root).cast("long").alias("owner"))))
    ended, _ = held.cut(convs.select("conv", "length").join(last.select("conv", "last"), "conv", "left").select("conv", "length", hung.alias("on")), "trie-paths")
    paths = ended.where("on IS NULL OR on.depth < length").select(F.col("conv").alias("owner"), "length", F.col("on.owner").alias("above"), F.col("on.depth").alias("depth"))
    local = nodes.select("owner", "depth", "n_convs", "words").unionByName(top.where("all > 0").select(F.col("top").alias("owner"), F.lit(0).cast("long").alias("depth"), F.col("all").alias("n_convs"), F.lit(0).cast("long").alias("words")))
    saved = (F.col("n_convs") - 1) * F.col("words")
    borne = paths.where("above IS NOT NULL").groupBy(F.col("above").alias("owner"), "depth").agg(F.count("*").alias("n_paths"))
    ends_in = borne.select("owner", F.col("depth").alias("length"), F.lit(0).cast("long").alias("none"))
    summed = paths.join(ends_in, ["owner", "length"], "left").join(local.select("owner", saved.alias("saved")).groupBy("owner").agg(F.sum("saved").alias("saved")), "owner")
    totals = _totals(summed.select("owner", "above", "saved", F.coalesce("none", F.lit(1)).cast("long").alias("leaves")), root, held) if count else summed.select("owner", "saved", F.col("none").alias("leaves"))

    hangs = paths.where("above IS NOT NULL").select("owner", "above", "depth").join(totals, "owner").groupBy(F.col("above").alias("owner"), "depth").agg(F.count("*").alias("paths"), F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    at_node = local.join(hangs, ["owner", "depth"], "left").join(paths.select("owner", "length", "above", F.col("depth").alias("from")), "owner")
    children = (zero("paths") + (F.col("depth") < F.col("length")).cast("long")).alias("n_children")
    at_node = at_node.select("owner", "depth", "length", F.when(F.col("depth") == 0, F.lit(None)).when(F.col("depth") == F.col("from") + 1, F.col("above")).otherwise(F.col("owner")).alias("parent"), "n_convs", children, (saved + zero("more_saved")).alias("saved"), F.col("more_leaves"))
    at_node = at_node.withColumn("leaves", zero("more_leaves") + (F.col("n_children") == 0).cast("long")).withColumn("block", F.floor(F.col("depth") / BLOCK))
    at_node, _ = held.cut(at_node, "trie-local")
    long_paths = at_node.where(F.col("length") >= BLOCK).groupBy("owner", "block").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    later = Window.partitionBy("owner").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    below = long_paths.select("owner", "block", F.sum("saved").over(later).alias("below_saved"), F.sum("leaves").over(later).alias("below_leaves"))
    down = Window.partitionBy("owner", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    told = at_node.select("owner", "block", "depth", "parent", "n_convs", "n_children", F.sum("leaves").over(down).alias("leaves"), F.sum("saved").over(down).alias("saved")).join(below, ["owner", "block"], "left")

    ends = ended.select(F.when(F.col("on.depth") == F.col("length"), F.col("on.owner")).otherwise(F.col("conv")).alias("owner"), F.col("length").alias("depth"), "conv")
    ends = ends.repartitionByRange("owner", "depth", "conv").sortWithinPartitions("owner", "depth", "conv")
    ids = digests(cut(ends, ["owner", "depth"], 1 << 14, "piece string", lambda held: (",".join(str(row[2]) for row in held),)), ["owner", "depth"], ",")
    out = told.join(ids, ["owner", "depth"], "left").select(
        F.col("owner").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", (F.col("leaves") + zero("below_leaves")).alias("n_leaves"),
        (F.col("saved") + zero("below_saved")).alias("saved_tokens"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
    return out, held
