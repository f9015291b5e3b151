"""Conversation structure repair: the cheapest edits that give every conversation the form of a chat.

A repaired conversation is empty or an optional system turn and then user and assistant in turn. Turns are kept, given
another role, deleted or inserted. The costs of all ways are a small dynamic programme over four states (nothing yet,
system, user or assistant was last). Conversations are dealt into buckets of like length; NumPy updates the state costs
of all conversations of a bucket turn by turn, from the last to the first, keeps them, and follows all edits together.

A conversation of any length is cut into pieces of some thousand turns. Each piece tells what it costs to pass from any
state to any other; from these few numbers a conversation's pieces learn their ends' costs and first states, and then
each piece is repaired on its own, with the same result as the whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pieces import Batches, by_batch, cut, digests
from .shared import Held

SPACE = " \t\n\x0b\x0c\r"
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: States: nothing yet, system, user, assistant. What follows an inserted or renamed turn, and what a kept turn of each kind (system, user, assistant, other) leads to; 4 is no state.
NEXT = np.array([2, 2, 3, 2, 4])
KEPT = np.array([[1, 4, 4, 4], [2, 2, 4, 2], [4, 4, 3, 4], [4, 4, 4, 4]])
DELETE, INSERT, RENAME = 3, 2, 2
FAR = 1 << 40
#: Costs after the last turn: what is still to be inserted.
DONE = (0, 2 * INSERT, INSERT, 0)
NAMES = ("", "system", "user", "assistant")
LEGAL = {(0, 1), (1, 2), (2, 1)}
STATES = [f"end{n}" for n in range(4)]


def kind_of(role: str) -> int:
    return "sua".find(role[0]) % 4 if role else 3


def _length(text: str) -> int:
    return 0 if text is None else len(text)


def coded(held: list[tuple]) -> tuple:
    """A piece's turns, roles, texts (null where the turn has to go) and one byte a turn: kind + 4 * fault. Rows: conv, turn, role, digest, kind, n, text."""
    turns, roles, texts, code, new = [], [], [], bytearray(), False
    for _, turn, role, _, kind, n, text in held:
        if not kind:  # a mark: the next row is the first with its role and text
            new = True
            continue
        bare = text.strip(SPACE)
        for copy in range(n):
            fault = BLANK if not bare else DUPLICATE if copy or not new else NONE if bare[-1] in ".!?" else TRUNCATED
            turns.append(turn)
            roles.append(role)
            texts.append(None if fault in (BLANK, DUPLICATE) else text)
            code.append(kind_of(role) + 4 * fault)
        new = False
    return turns, roles, texts, bytes(code)


def together(batches: Batches) -> Batches:
    """Equal rows of a batch as one, with their number: a turn that is repeated any number of times is then shared out among few rows. The columns stay, n is the last but one."""
    for batch in batches:
        found: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(*(batch.column(n).to_pylist() for n in (0, 1, 3)), strict=True)):
            found.setdefault(key, []).append(i)
        firsts = pa.array([at[0] for at in found.values()], pa.int64())
        out = batch.take(firsts)
        n = pa.array([len(at) for at in found.values()], pa.int64())
        at = out.schema.get_field_index("n")
        yield pa.RecordBatch.from_arrays([n if i == at else c for i, c in enumerate(out.columns)], schema=out.schema)


def padded(codes: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Buckets of like length: which pieces, their codes as [turn, piece] and their lengths."""
    length = np.array([len(c) for c in codes], np.int64)
    bucket = np.ceil(np.log2(np.maximum(length, 1))).astype(int)
    for b in np.unique(bucket):
        which = np.flatnonzero(bucket == b)
        tensor = np.zeros((int(length[which].max()), len(which)), np.uint8)
        for column, i in enumerate(which):
            tensor[: length[i], column] = np.frombuffer(codes[i], np.uint8)
        yield which, tensor, length[which]


def _actions(code: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cost of deleting, keeping and renaming one turn of every piece in every state: [piece, 4] each. after: the costs from the next turn on."""
    wide = np.concatenate([after, np.full((len(after), 1), FAR)], axis=1)
    kind, fault = code & 3, code >> 2
    must = ((fault == BLANK) | (fault == DUPLICATE))[:, None] * FAR
    late = (fault == TRUNCATED)[:, None].astype(np.int64)
    kept = np.take_along_axis(wide, KEPT[kind], axis=1) + late + must
    renamed = after[:, NEXT[:4]] + RENAME + late + must
    return after + DELETE, kept, renamed


def backward(code: np.ndarray, length: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Least cost from before each turn to the end, [turn + 1, piece, state]; ends: the costs after the last turn."""
    turns, n = code.shape
    costs = np.empty((turns + 1, n, 4), np.int64)
    costs[turns] = ends
    second = NEXT[NEXT[:4]]
    for t in range(turns - 1, -1, -1):
        best = np.minimum.reduce(_actions(code[t], costs[t + 1]))
        best = np.minimum.reduce([best, best[:, NEXT[:4]] + INSERT, best[:, second] + 2 * INSERT])
        costs[t] = np.where((t < length)[:, None], np.minimum(best, FAR), costs[t + 1])
    return costs


def traced(code: np.ndarray, length: np.ndarray, costs: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What is done at each turn (letters, [turn, piece]), how many turns are inserted before it, and the last states: of the cheapest edits those with the least letters."""
    turns, n = code.shape
    done, inserted, state, each = np.zeros((turns, n), np.uint8), np.zeros((turns, n), np.uint8), entry.copy(), np.arange(n)
    for t in range(turns):
        live = t < length
        deleted, kept, renamed = _actions(code[t], costs[t + 1])
        going = live
        while True:  # twice at most
            going = going & (deleted[each, state] != costs[t, each, state]) & (costs[t, each, NEXT[state]] + INSERT == costs[t, each, state])
            if not going.any():
                break
            inserted[t] += going
            state = np.where(going, NEXT[state], state)
        now = costs[t, each, state]
        drop = deleted[each, state] == now
        keep = ~drop & (kept[each, state] == now)
        done[t] = np.where(live, np.where(drop, ord("D"), np.where(keep, ord("K"), ord("R"))), 0)
        state = np.where(~live | drop, state, np.where(keep, KEPT[code[t] & 3, state], NEXT[state]))
    return done, inserted, state


def passages(codes: list[bytes]) -> np.ndarray:
    """[piece, from, to]: least cost to pass each piece from a state to another; nothing is inserted after its last turn."""
    out = np.empty((len(codes), 4, 4), np.int64)
    for which, code, length in padded(codes):
        for to in range(4):
            ends = np.full((len(which), 4), FAR)
            ends[:, to] = 0
            out[which, :, to] = backward(code, length, ends)[0]
    return out


def exits(codes: list[bytes], ends: np.ndarray) -> np.ndarray:
    """[piece, from]: the state in which each piece is left if it is entered in a state."""
    out = np.empty((len(codes), 4), np.int64)
    for which, code, length in padded(codes):
        costs = backward(code, length, ends[which])
        for entry in range(4):
            out[which, entry] = traced(code, length, costs, np.full(len(which), entry))[2]
    return out


def _edited(codes: list[bytes], roles: list, texts: list, ends: np.ndarray, entry: np.ndarray, last: np.ndarray) -> list[tuple]:
    """audit, cost and repaired turns of each piece."""
    out: list[tuple] = [()] * len(codes)
    for which, code, length in padded(codes):
        costs = backward(code, length, ends[which])
        done, inserted, final = traced(code, length, costs, entry[which])
        for column, i in enumerate(which):
            audit, turns, state = [], [], int(entry[i])
            for t in range(int(length[column])):
                for _ in range(int(inserted[t, column])):
                    state = int(NEXT[state])
                    audit.append("I")
                    turns.append({"role": NAMES[state], "text": ""})
                act = chr(done[t, column])
                audit.append(act)
                if act == "K":
                    state = int(KEPT[code[t, column] & 3, state])
                    turns.append({"role": roles[i][t], "text": texts[i][t]})
                elif act == "R":
                    state = int(NEXT[state])
                    turns.append({"role": NAMES[state], "text": texts[i][t]})
            cost = int(costs[0, column, entry[i]])
            if last[i]:
                while state in (1, 2):
                    state = int(NEXT[state])
                    audit.append("I")
                    turns.append({"role": NAMES[state], "text": ""})
            else:
                cost -= int(ends[i, final[column]])
            out[i] = ("".join(audit), cost, turns)
    return out


REPAIRED = "audit string, cost long, repaired array<struct<role:string,text:string>>, first long, last long, spots long, blank long, duplicate long, truncated long, illegal long"


def _finish(batch: pa.RecordBatch) -> list:
    """Pieces with their first state and ends' costs, repaired. Columns: conv, part, nth, open, turns, roles, texts, code, entry, is_last, seam, bad, end0 to end3."""
    *place, turns, roles, texts, code, entry, is_last, seam, bad, e0, e1, e2, e3 = batch.columns
    codes = code.to_pylist()
    edits = _edited(codes, roles.to_pylist(), texts.to_pylist(), _stacked(e0, e1, e2, e3), entry.to_numpy(), is_last.to_pylist())
    facts = []
    for c, when, joined, wrong in zip(codes, turns.to_pylist(), seam.to_pylist(), bad.to_pylist(), strict=True):
        kinds, faults = [x & 3 for x in c], [x >> 2 for x in c]
        known = [t for t in when if t is not None]
        pairs = sum(k not in LEGAL for k in zip(kinds, kinds[1:], strict=False))
        facts.append((known[0] if known else None, known[-1] if known else None, len(set(known)) - joined, *(faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)), pairs + wrong))
    return [*place, *zip(*edits, strict=True), *zip(*facts, strict=True)]


def _stacked(*columns: pa.Array) -> np.ndarray:
    return np.stack([c.to_numpy() for c in columns], axis=1)


def _ways(batch: pa.RecordBatch) -> list:
    """A piece's passages and its first and last kind. Columns: conv, part, nth, first, last, code."""
    *kept, code = batch.columns
    codes = code.to_pylist()
    return [*kept, [c[0] & 3 for c in codes], [c[-1] & 3 for c in codes], passages(codes).reshape(len(codes), 16).tolist()]


def _leads(batch: pa.RecordBatch) -> list:
    """Where a piece leads from each state. Columns: conv, part, nth, code, end0 to end3."""
    *kept, code, e0, e1, e2, e3 = batch.columns
    return [*kept, exits(code.to_pylist(), _stacked(e0, e1, e2, e3)).tolist()]


def _ends(pieces: pd.DataFrame) -> pd.DataFrame:
    """Costs after each piece of one conversation, from the pieces' passages; its seams with the piece before."""
    pieces = pieces.sort_values(["part", "nth"], ignore_index=True)
    n = len(pieces)
    ways = np.array(pieces["ways"].tolist(), np.int64).reshape(n, 4, 4)
    ends = np.empty((n, 4), np.int64)
    ends[-1] = DONE
    for i in range(n - 1, 0, -1):
        ends[i - 1] = np.minimum((ways[i] + ends[i]).min(axis=1), FAR)
    out = pieces[["conv", "part", "nth"]].copy()
    before = pieces["last"].shift(1)
    out["is_last"] = np.arange(n) == n - 1
    out["seam"] = (pieces["first"].notna() & (pieces["first"] == before)).astype(np.int64)
    kinds = list(zip(pieces["tail"].shift(1), pieces["head"], strict=True))
    out["bad"] = [int(i > 0 and k not in LEGAL) for i, k in enumerate(kinds)]
    for k, name in enumerate(STATES):
        out[name] = ends[:, k]
    return out


def _entries(pieces: pd.DataFrame) -> pd.DataFrame:
    """The state in which each piece of one conversation is entered."""
    pieces = pieces.sort_values(["part", "nth"], ignore_index=True)
    state, out = 0, []
    for leads in pieces["leads"]:
        out.append(state)
        state = int(leads[state])
    return pieces[["conv", "part", "nth"]].assign(entry=out)


def repair(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", rows: int = 1024) -> tuple[DataFrame, DataFrame, Held]:
    """Pieces of repaired conversations: those that are whole conversations, and those of conversations in several pieces; and the tables that they are read from, to be dropped in the end.

    Columns: conv, part, nth (their order), open, audit (a letter an edit: Keep, Rename, Delete, Insert), cost,
    repaired (role, text), first and last turn, spots (distinct turns), blank, duplicate, truncated, illegal. Sums over
    a conversation's pieces are the conversation's.

    Turns are ordered by turn (nulls first); rows of one turn by role and then by a digest of role and text. Null roles
    and texts are one space, so such a text is blank; a role that begins with none of s, u, a has to be renamed or
    deleted, an empty one too. Repeated rows are duplicates each. Null ids form one conversation. A turn is a duplicate
    if its role and text were seen earlier (told by SHA-256). Long texts are whole; a piece ends after so many rows, each
    thousand characters counting as one more. Empty tables give no rows. Other columns are not read.
    """
    held = Held()
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role_col, text_col))
    said = turns.select(F.col(id_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    said = said.select("conv", "turn", "role", digest.alias("digest"), F.lit(1).alias("kind"), F.lit(1).cast("long").alias("n"), "text")
    marks = said.groupBy("conv", "role", "digest").agg(F.min(F.struct("turn"))["turn"].alias("turn")).select("conv", "turn", "role", "digest", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("text"))
    order = ["conv", "turn", "role", "digest"]
    ordered = said.mapInArrow(together, said.schema).unionByName(marks).repartitionByRange(*order).sortWithinPartitions(*order, "kind")
    weight = lambda row: row[5] * (1 + _length(row[6]) // 1000)
    pieces, _ = held.cut(cut(ordered, ["conv"], rows, "turns array<long>, roles array<string>, texts array<string>, code binary", coded, weight), "repair-pieces")

    conv = dict(pieces.dtypes)["conv"]

    going = pieces.where("open")
    place = f"conv {conv}, part int, nth int"
    met = by_batch(going.select("conv", "part", "nth", F.array_min("turns").alias("first"), F.array_max("turns").alias("last"), "code"), f"{place}, first long, last long, head int, tail int, ways array<long>", _ways)
    ends, _ = held.cut(met.groupBy("conv").applyInPandas(lambda pdf: _ends(pdf), f"{place}, is_last boolean, seam long, bad long, {', '.join(s + ' long' for s in STATES)}"), "repair-ends")
    led = by_batch(going.select("part", "nth", "code").join(ends, ["part", "nth"]).select("conv", "part", "nth", "code", *STATES), f"{place}, leads array<long>", _leads)
    entries = led.groupBy("conv").applyInPandas(lambda pdf: _entries(pdf), f"{place}, entry long").select("part", "nth", "entry")
    known, _ = held.cut(ends.drop("conv").join(entries, ["part", "nth"]), "repair-known")

    columns = ["conv", "part", "nth", "open", "turns", "roles", "texts", "code", "entry", "is_last", "seam", "bad", *STATES]
    zero: list[Column] = [F.lit(0).cast("long").alias("entry"), F.lit(True).alias("is_last"), F.lit(0).cast("long").alias("seam"), F.lit(0).cast("long").alias("bad"), *(F.lit(c).cast("long").alias(s) for c, s in zip(DONE, STATES, strict=True))]
    parts = pieces.where("NOT open").select("*", *zero).select(*columns), going.join(known, ["part", "nth"]).select(*columns)
    whole, divided = (by_batch(p, f"{place}, open boolean, {REPAIRED}", _finish) for p in parts)
    return whole, divided, held


def summaries(whole: DataFrame, divided: DataFrame) -> DataFrame:
    """One row a conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, and repaired_sha256 of its repaired turns as lines role:text."""
    sums = ["blank", "duplicate", "truncated", "illegal", "cost"]
    gaps = F.coalesce(F.col("last") - F.col("first") + 1 - F.col("spots"), F.lit(0)).alias("gaps")
    shown = F.array_join(F.transform("repaired", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    told = whole.select("conv", gaps, *sums, "audit", F.sha2(shown, 256).alias("repaired_sha256"))
    parts = divided.groupBy("conv").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("spots").alias("spots"), *[F.sum(c).alias(c) for c in sums], F.sort_array(F.collect_list(F.struct("part", "nth", "audit"))).alias("audit"))
    parts = parts.select("conv", gaps, *sums, F.array_join(F.transform("audit", lambda x: x["audit"]), "").alias("audit"))
    texts = digests(divided.where(F.size("repaired") > 0).select("conv", "part", "nth", "open", shown.alias("piece")), ["conv"], "\n").withColumnRenamed("conv", "__c")
    more = parts.join(texts, F.col("conv").eqNullSafe(F.col("__c")), "left").select("conv", "gaps", *sums, "audit", F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
    return told.unionByName(more)
