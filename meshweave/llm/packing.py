"""Packing documents into training sequences by vector bin packing.

Every sequence is a bin with three limits: tokens, segments and loss-bearing tokens. Into an open bin goes, again
and again, the waiting piece whose demand has the largest dot product with the room that is left. Where none fits
whole, the largest is cut so that it fills the bin. Each task packs its own rows with a bounded pool of waiting
pieces; there is no shuffle, and at most one ragged end a task, which is cut into power-of-two sequences.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import tidy

TOKENIZER = "byte_bpe_50k.json"
POOL = 4096


@dataclass(frozen=True)
class Limits:
    """What a sequence may hold: tokens (also its padded length), pieces, and tokens that bear loss."""

    tokens: int = 1024
    segments: int = 256
    loss_tokens: int = 1024


@lru_cache(maxsize=4)
def encoder(tokenizer: str):
    """text -> uint32 ids of a tokenizers file, as tokenizers gives them without adding special tokens.

    Byte-level BPE whose ids are its merge ranks runs in tiktoken, about four times as fast and with equal ids
    (tests compare them); texts that hold one of the file's added tokens, and any other file, run in tokenizers itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = tokenizer if "/" in tokenizer else public_tokenizers.path(tokenizer)
    plain = Tokenizer.from_file(path)
    exact = lambda text: np.array(plain.encode(text, add_special_tokens=False).ids, dtype="<u4")
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and spec["model"].get("type") == "BPE":
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(shown))}
        special = tuple(x["content"] for x in spec.get("added_tokens", []))
        ranks = {bytes(byte[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
        fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        probe = "Größe of 1234 words,\n\n  it's  señor …\t naïve—ok 😀"
        if fast.encode_ordinary(probe) == exact(probe).tolist():
            del spec, ranks, byte
            tidy()
            return lambda text: exact(text) if any(x in text for x in special) else np.array(fast.encode_ordinary(text), dtype="<u4")
    return exact


class Packer:
    """Packs (key, ids, first loss-bearing position) and yields rows (key, start, length, crc32, ids in all, sequence, offset, padded length)."""

    def __init__(self, limits: Limits, first_sequence: int, keep_ids: bool = False):
        self.limits, self.next, self.keep = limits, first_sequence, keep_ids
        self.items: list[list] = []  # key, ids, start, prompt
        self.rows: list[tuple] = []

    def loss(self, item: list) -> int:
        return max(0, len(item[1]) - 1 - max(item[2], item[3]))

    def longest(self, item: list, tokens: int, loss: int) -> int:
        """The most ids from the item's start that fit: its last id, the separator, bears no loss."""
        n = len(item[1]) - item[2]
        free = max(0, item[3] - item[2]) + loss
        return min(tokens, n if free >= n - 1 else free)

    def piece(self, item: list, length: int, offset: int, padded: int) -> None:
        key, ids, start, _ = item
        part = ids[start : start + length]
        self.rows.append((key, start, length, zlib.crc32(part.tobytes()), len(ids), self.next, offset, padded) + ((part.tobytes(),) if self.keep else ()))
        item[2] = start + length

    def add(self, key, ids: np.ndarray, prompt: int) -> None:
        item = [key, ids, 0, prompt]
        cap = self.limits
        while len(ids) - item[2] >= cap.tokens and self.longest(item, cap.tokens, cap.loss_tokens) == cap.tokens:
            self.piece(item, cap.tokens, 0, cap.tokens)
            self.next += 1
        if item[2] < len(ids):
            self.items.append(item)
        if len(self.items) >= POOL:
            self.pack(False)

    def pack(self, last: bool) -> None:
        """Close bins until less than a bin is waiting, or nothing."""
        cap = self.limits
        tokens = np.array([len(x[1]) - x[2] for x in self.items], dtype=np.int64)
        loss = np.array([self.loss(x) for x in self.items], dtype=np.int64)
        left = int(tokens.sum())
        while left and (last or left >= cap.tokens):
            size = cap.tokens
            if left < size:  # the ragged end: a power of two at a time
                size = min(size, max(32, 1 << (left.bit_length() - 1)))
            room, segments, bearing, parts = size, cap.segments, cap.loss_tokens, []
            while room and segments:
                fits = (tokens > 0) & (tokens <= room) & (loss <= bearing)
                if fits.any():
                    score = tokens * (room / cap.tokens**2) + loss * (bearing / max(1, cap.loss_tokens) ** 2) + segments / cap.segments**2
                    n = int(np.where(fits, score, -1.0).argmax())
                    take = int(tokens[n])
                else:
                    n = int(tokens.argmax())
                    take = self.longest(self.items[n], room, bearing) if tokens[n] else 0
                    if take <= 0:
                        break
                parts.append((n, take))
                # what is taken leaves the arrays at once; the rows follow when the bin is closed
                item = self.items[n]
                before = self.loss(item)
                item[2] += take
                room, segments, bearing, left = room - take, segments - 1, bearing - (before - self.loss(item)), left - take
                item[2] -= take
                parts[-1] = (n, take, item[2])
                item[2] += take
                tokens[n] -= take
                loss[n] = self.loss(item)
            used = size - room
            if not used:
                raise ValueError("the limits leave no room for any token")
            padded = used if used == cap.tokens else min(cap.tokens, 1 << (used - 1).bit_length())
            offset = 0
            for n, take, start in parts:
                item, end = self.items[n], self.items[n][2]
                item[2] = start
                self.piece(item, take, offset, padded)
                item[2] = max(end, start + take)
                offset += take
            self.next += 1
        self.items = [x for x, n in zip(self.items, tokens, strict=True) if n]


def pack_documents(df: DataFrame, limits: Limits = Limits(), tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text", prompt_tokens_col: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pack every row's ids, followed by id 0, into sequences; one row for each piece.

    prompt_tokens_col: how many leading ids of a row bear no loss (instruction data); the closing id never bears any.
    Null text counts as empty: it is the single id 0. Rows with the same or a null id are packed one by one. Very
    long texts are cut into full sequences first. Other columns, of whatever name, are not read. An empty table
    gives no rows. Ties go to the row that comes first, so that a task that runs again packs alike.
    """
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_to long" + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        packer = Packer(limits, TaskContext.get().partitionId() << 40, with_ids)
        end = np.zeros(1, "<u4")
        names = None

        def out() -> pa.RecordBatch:
            columns = list(zip(*packer.rows, strict=True)) or [()] * (8 + with_ids)
            packer.rows = []
            types = [names, *[pa.int64()] * 7, *[pa.binary()] * with_ids]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["key", "start", "length", "crc", "n", "sequence", "offset", "padded", "ids"][: 8 + with_ids])

        for batch in batches:
            names = batch.schema.field(0).type
            texts, keys, prompts = batch.column(1), batch.column(0), batch.column(2)
            for n in range(batch.num_rows):
                ids = np.concatenate([encode(texts[n].as_py() or ""), end])
                packer.add(keys[n].as_py(), ids, prompts[n].as_py() or 0)
                if len(packer.rows) >= 20_000:
                    yield out()
        if names is not None:
            packer.pack(True)
            yield out()
        del packer
        tidy()

    source = df.select(F.col(id_col), F.col(text_col).cast("string"), (F.col(prompt_tokens_col) if prompt_tokens_col else F.lit(0)).cast("long"))
    return source.mapInArrow(run, schema)
