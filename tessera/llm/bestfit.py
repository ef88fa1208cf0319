"""Best-fit packing: partitions pack locally, underfull bins merge up a tree.

Every text is tokenised once, in place. A document of more than `capacity` tokens is
cut into whole sequences and a shorter first piece; first pieces are the items. A task packs
the items of its partition (units of at most UNIT documents) by best fit, largest
first: each goes to the fullest bin that still holds it. Best fit leaves no two bins
of a unit that fit together, so at most one bin of a unit is no more than half full.

Bins that nothing left anywhere can fit are done. The others go up a tree as items:
each round joins FAN units, packs their bins by best fit, and emits what has become
nearly full. Bins of one fill are interchangeable, and a round can only fill as many as there
are items of at most half a bin, one a unit; so of each fill a unit sends no more than there are units, which changes
no result and bounds what a task of the tree reads by the number of units, not of documents.
A bin that moves takes its pieces along: only (bin, new bin, offset) is written, at
most one row a unit and round, and joined to the pieces at the end.

Defined cases: a null or empty text is the end token alone; repeated rows, ids and
null ids are packed row by row; columns of other names are not read; an empty table
gives no piece.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, sliced, table
from tessera.sources.shared import spread

CAPACITY, END_ID = 2048, 0
#: Documents of a unit at most; units that one task of the tree joins; tokens short of full that count as full.
UNIT, FAN, NEARLY = 1 << 18, 32, 4
#: Bins of a unit have numbers unit << _BITS and on.
_BITS = 32
#: Most rows of the table of moved bins that are broadcast; above, it is joined by shuffle.
BROADCAST_ROWS = 200_000
_MEMO_WORDS, _MEMO_CHARS = 800_000, 48
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long"
#: Fixed value: the pattern that byte-level vocabularies cut texts by.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary() -> str:
    """Path of the default vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteTokens:
    """Token ids of whole texts by a byte-level vocabulary, from a bounded memo of words.

    White space starts a word's pre-tokens and never ends them, so a text whose words
    are parted by single spaces or line ends is the ids of its words in turn, each with
    the space before it. All other texts, and those with special tokens, go through the
    library whole. Words new to the memo are merged by tiktoken over the same
    vocabulary, where its ids are the order of its merges; otherwise by the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        wide = self.tokenizer.get_vocab_size() > 65536
        self.kind, self.code = np.dtype("<u4" if wide else "<u2"), "I" if wide else "H"
        self.special = [t["content"] for t in described.get("added_tokens") or ()]
        split = described.get("pre_tokenizer") or {}
        self.byte_level = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not described.get("normalizer")
        ranks = self._ranks(described["model"]) if self.byte_level else None
        self.fast = None
        if ranks:
            import tiktoken

            self.fast = tiktoken.Encoding("bytes", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        outer = self

        class Memo(dict):
            def __missing__(self, word: str) -> bytes:
                if not word or word[-1].isspace() or any(s in word for s in outer.special):
                    raise KeyError(word)
                found = array(outer.code, outer._word(word)).tobytes()
                if len(word) <= _MEMO_CHARS:
                    if len(self) >= _MEMO_WORDS:
                        self.clear()
                    self[word] = found
                return found

        self.memo = Memo()

    @staticmethod
    def _ranks(model: dict) -> dict[bytes, int] | None:
        """Bytes of each token by id, if ids follow the order of the merges."""
        vocab, merges = model["vocab"], model["merges"]
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in printable]
        of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        merged = [vocab.get(a + b) for a, b in pairs]
        if None in merged or any(a >= b for a, b in zip(merged, merged[1:], strict=False)) or any(vocab[c] >= min(merged, default=256) for c in of):
            return None
        return {bytes(of[c] for c in token): i for token, i in vocab.items() if all(c in of for c in token)}

    def _library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _word(self, word: str) -> list[int]:
        # A key that begins with a space is a text's first word, without it; one with a line end has no space before.
        text = word[1:] if word[0] == " " else word if word[0] == "\n" else " " + word
        return self.fast.encode_ordinary(text) if self.fast else self._library(text)

    def encode(self, text: str | None) -> bytes:
        """Little-endian ids of a text."""
        if not text:
            return b""
        if self.byte_level:
            words = text.replace("\n", " \n").split(" ")
            if words[0]:  # else the text begins with white space
                words[0] = " " + words[0]
                try:
                    return b"".join(itemgetter(*words)(self.memo)) if len(words) > 1 else self.memo[words[0]]
                except KeyError:
                    pass
        return array(self.code, self._library(text)).tobytes()


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each size, which come largest first: the fullest bin that holds it, the latest of those equally full."""
    room: list[int] = []  # free tokens that some bin has, ascending
    of_room: dict[int, list[int]] = {}
    bins, offsets, many = [], [], 0
    for size in sizes:
        at = bisect_left(room, size)
        if at == len(room):
            free, k, many = capacity, many, many + 1
        else:
            free = room[at]
            held = of_room[free]
            k = held.pop()
            if not held:
                del of_room[free], room[at]
        bins.append(k)
        offsets.append(capacity - free)
        left = free - size
        if left:
            if left not in of_room:
                insort(room, left)
                of_room[left] = []
            of_room[left].append(k)
    return bins, offsets


def packed_locally(docs: DataFrame, path: str, capacity: int, end_id: int, unit: int = UNIT) -> DataFrame:
    """All pieces of docs with a bin of their unit; `fill` tells what the bin holds on the row of its first piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = ByteTokens(path)
        end, width = np.array([end_id], tokens.kind).tobytes(), tokens.kind.itemsize
        task, n_unit = TaskContext.get().partitionId(), 0
        ids, counts, crcs = [], [], []

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal n_unit
            base = ((task << 12) + n_unit) << _BITS
            n_unit += 1
            n = np.array(counts, np.int64)
            pieces = -(-n // capacity)
            first = n - (pieces - 1) * capacity
            order = np.argsort(-first, kind="stable")
            bins, offsets = best_fit(first[order].tolist(), capacity)
            of, offset = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
            of[order], offset[order] = bins, offsets
            fill = np.bincount(of, first, minlength=1).astype(np.int64)
            row = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            head = piece == 0
            length = np.where(head, first[row], capacity)
            # A whole sequence is a bin of its own, numbered after those of the items.
            bin_ = np.where(head, of[row], len(fill) + np.cumsum(~head) - 1) + base
            opens = head & (offset[row] == 0) & (fill[of[row]] < capacity)
            columns = [pa.array(ids, pa.int64()).take(pa.array(row)), piece.astype(np.int32), np.where(head, 0, first[row] + (piece - 1) * capacity), length, np.concatenate(crcs) if crcs else np.zeros(0, np.int64),
                       bin_, np.where(head, offset[row], 0), pa.array(fill[of[row]], mask=~opens)]
            whole = pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "fill"])
            for k in range(0, whole.num_rows, 1 << 16):
                yield whole.slice(k, 1 << 16)
            ids.clear(), counts.clear(), crcs.clear()

        for batch in batches:
            for part in sliced(iter([batch])):
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    held = tokens.encode(text) + end
                    n = len(held) // width
                    wide = memoryview(np.frombuffer(held, tokens.kind).astype("<u4").tobytes())
                    first = n - (n - 1) // capacity * capacity
                    ids.append(doc)
                    counts.append(n)
                    crcs.append(np.array([zlib.crc32(wide[4 * a : 4 * z]) for a, z in zip([0, *range(first, n, capacity)], [first, *range(first + capacity, n + 1, capacity)], strict=True)], np.int64))
                    if len(ids) == unit:
                        yield from out()
        if ids:
            yield from out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _PIECE + ", fill long")


def merged(spark: SparkSession, bins: DataFrame, scratch: Scratch, capacity: int, fan: int = FAN, nearly: int = NEARLY) -> DataFrame:
    """bin, into, shift of every bin that moved into another, over all rounds. bins: bin, fill, unit."""
    moves = spark.createDataFrame([], "bin long, into long, shift long")
    units = [r.unit for r in bins.select("unit").distinct().collect()]  # one number per unit, i.e. per task
    n = len(units)
    ranked = spark.createDataFrame(list(zip(sorted(units), range(n), strict=True)), "unit long, node long")
    live = bins.join(F.broadcast(ranked), "unit").select("node", "bin", "fill")

    def round_(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["fill", "bin"], ascending=[False, True])
        fills, ids = group["fill"].tolist(), group["bin"].tolist()
        into, offsets = best_fit(fills, capacity)
        opened: dict[int, int] = {}
        for k, b in zip(into, ids, strict=True):
            opened.setdefault(k, b)
        total = np.bincount(into, fills).astype(np.int64)
        return pd.DataFrame({"node": group["node"] // fan, "bin": ids, "into": [opened[k] for k in into], "shift": offsets, "fill": total[into]})

    level = 0
    while n > 1:
        # What nothing left can fit, or is nearly full, is done; of each fill no more go on than there are units.
        low = live.agg(F.min("fill")).first()[0]
        if low is None:
            break
        going = live.where((capacity - F.col("fill") >= low) & (capacity - F.col("fill") > nearly))
        going = scratch.table(_some_of_each(going, n), f"live{level}")
        groups = going.withColumn("of", F.expr(f"node div {fan}")).groupBy("of")
        done = scratch.table(groups.applyInPandas(round_, "node long, bin long, into long, shift long, fill long"), f"round{level}")
        stepped = done.where("bin <> into").select("bin", "into", "shift")
        # A bin that moved before and whose target moves now moves on with it.
        then = stepped.select(F.col("bin").alias("into"), F.col("into").alias("further"), F.col("shift").alias("more"))
        carried = moves.join(then, "into", "left").select("bin", F.coalesce("further", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
        moves = scratch.table(carried.unionByName(stepped), f"moves{level}")
        live, n, level = done.where("bin = into").select("node", "bin", "fill"), -(-n // fan), level + 1
    return moves


def _some_of_each(live: DataFrame, most: int) -> DataFrame:
    """Of each node and fill the `most` first bins: the rest could never be used, as bins of one fill are alike."""
    place = F.row_number().over(Window.partitionBy("node", "fill").orderBy("bin"))
    return live.withColumn("place", place).where(F.col("place") <= most).drop("place")


def pack_best_fit(spark: SparkSession, docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, unit: int = UNIT) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    scratch = Scratch(spark)
    pieces = scratch.table(packed_locally(docs, path or vocabulary(), capacity, end_id, unit), "pieces")
    bins = pieces.where("fill IS NOT NULL").select("bin", "fill", F.expr(f"shiftright(bin, {_BITS})").alias("unit"))
    moves = merged(spark, bins, scratch, capacity)
    moves = F.broadcast(moves) if moves.count() <= BROADCAST_ROWS else moves
    placed = pieces.join(moves, "bin", "left").withColumn("offset", F.col("offset") + F.coalesce("shift", F.lit(0)))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("into", "bin").alias("sequence_id"), "offset")


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_best_fit(spark, spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
