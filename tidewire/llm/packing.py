"""Best-fit packing of documents into sequences of several permitted lengths.

Documents are cut into pieces of at most the largest permitted length; pieces of just that length are sequences of
their own. The others are dealt to shards of bounded size and packed there, longest first, each into the open bin that
it fills best. Which length a new bin opens with is decided jointly for the shard. In the first trial each new bin is
filled with the longest pieces left that fit, at each permitted length, and opens at the length that costs least a
token that it takes; in one further trial a length, all pieces that it holds open with it (longer ones open the next
length that holds them) and are placed best-fit. Every bin is downsized to the least permitted length that holds its
contents, and the trial of the least total cost wins, so no single length would cost less. A bin costs its length and a
fixed ``bin_cost``, in tokens.

Shards are dealt by a hash of the row, so a hot source or a repeated row can't fill one, and their number grows with
the rows; what is wasted at the end of a shard is less than a bin.

Defined cases: null, empty and blank texts have no tokens and no piece; rows with equal ids are packed each for
itself; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import words, written

#: Permitted sequence lengths, in tokens.
LENGTHS = (256, 512, 1024, 2048, 4096)
#: Pieces in a shard, on average.
SHARD_PIECES = 4096


def best_fit(pieces: Sequence[int], opening: int, lengths: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """Packs ``pieces`` (in this order): bin of each piece, its offset there, and the contents of each bin.

    A piece goes to the bin with the least room that holds it; where none does, a bin of ``opening`` opens, or of the
    least permitted length that holds the piece.
    """
    rooms: list[int] = []  # distinct rooms of open bins, ascending
    by_room: dict[int, list[int]] = {}
    length, filled, bins, offsets = [], [], [], []
    for n in pieces:
        at = bisect.bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            bin_ = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
        else:
            bin_, room = len(length), opening if n <= opening else lengths[bisect.bisect_left(lengths, n)]
            length.append(room)
            filled.append(0)
        bins.append(bin_)
        offsets.append(filled[bin_])
        filled[bin_] += n
        if left := room - n:
            if left not in by_room:
                bisect.insort(rooms, left)
                by_room[left] = []
            by_room[left].append(bin_)
    return bins, offsets, filled


def least_cost(pieces: Sequence[int], lengths: Sequence[int], bin_cost: int) -> tuple[list[int], list[int], list[int]]:
    """Packs ``pieces``, given longest first, as ``best_fit`` does, opening each bin at the length that costs least a token."""
    queues: dict[int, list[int]] = {}
    for k in range(len(pieces) - 1, -1, -1):
        queues.setdefault(pieces[k], []).append(k)
    sizes = sorted(queues)  # distinct lengths of the pieces left
    bins, offsets, filled = [0] * len(pieces), [0] * len(pieces), []
    while sizes:
        best = None
        for length in lengths:
            if length < sizes[-1]:
                continue
            room, taken, used = length, [], 0
            at = bisect.bisect_right(sizes, room) - 1
            while at >= 0 and room:
                times = min(len(queues[sizes[at]]), room // sizes[at])
                if times:
                    taken.append((sizes[at], times))
                    room -= times * sizes[at]
                    used += times * sizes[at]
                at = min(at, bisect.bisect_right(sizes, room)) - 1
            capacity = lengths[bisect.bisect_left(lengths, used)]
            cost = (capacity + bin_cost) / used
            if best is None or cost < best[0]:
                best = cost, taken
        at, bin_ = 0, len(filled)
        for size, times in best[1]:
            for _ in range(times):
                k = queues[size].pop()
                bins[k], offsets[k] = bin_, at
                at += size
            if not queues[size]:
                del queues[size]
                sizes.pop(bisect.bisect_left(sizes, size))
        filled.append(at)
    return bins, offsets, filled


def pack_shard(pieces: np.ndarray, lengths: Sequence[int], bin_cost: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, capacity and contents of each bin, at the least cost over all trials."""
    permitted = np.array(lengths)
    best, given = None, pieces.tolist()
    for opening in (None, *lengths):
        bins, offsets, filled = least_cost(given, lengths, bin_cost) if opening is None else best_fit(given, opening, lengths)
        capacity = permitted[np.searchsorted(permitted, filled)]
        cost = int(capacity.sum()) + bin_cost * len(filled)
        if best is None or cost < best[0]:
            best = cost, np.array(bins), np.array(offsets), capacity, np.array(filled)
    return best[1:]


def pack(docs: DataFrame, lengths: Sequence[int] = LENGTHS, bin_cost: int = 16, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """A row for each piece: doc_id, piece (from 0), start and length in the document, bin_id, bin_capacity, bin_offset.

    ``tokens``: the number of tokens of a row; by default its words.
    """
    lengths = sorted(lengths)
    largest = lengths[-1]
    tokens = F.size(words(F.col(text_col))) if tokens is None else tokens
    rows = docs.select(F.col(id_col).alias("doc_id"), tokens.cast("long").alias("n")).filter("n > 0")
    # a written table keeps the row numbers, so tasks that run again deal out alike
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "token-counts")
    shards = max(1, -(-rows.count() // shard_pieces))
    full = (
        rows.filter(F.col("n") >= largest)
        .select("doc_id", "row", F.explode(F.sequence(F.lit(0), (F.floor(F.col("n") / largest) - 1).cast("int"))).alias("piece"))
        .select("doc_id", "piece", (F.col("piece").cast("long") * largest).alias("start"), F.lit(largest).cast("long").alias("length"), F.concat_ws("-", F.lit("f"), "row", "piece").alias("bin_id"), F.lit(largest).alias("bin_capacity"), F.lit(0).cast("long").alias("bin_offset"))
    )
    rest = rows.withColumn("piece", F.floor(F.col("n") / largest).cast("int")).withColumn("length", F.col("n") % largest).filter("length > 0")
    rest = rest.select("doc_id", "row", "piece", (F.col("piece").cast("long") * largest).alias("start"), "length", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("long").alias("shard"))

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "row"], ascending=[False, True], kind="stable")
        bins, offsets, capacity, _ = pack_shard(group["length"].to_numpy(), lengths, bin_cost)
        name = f"s-{group['shard'].iloc[0]}-"
        return pd.DataFrame({"doc_id": group["doc_id"], "piece": group["piece"], "start": group["start"], "length": group["length"], "bin_id": [f"{name}{b}" for b in bins], "bin_capacity": capacity[bins], "bin_offset": offsets})

    kind = dict(docs.dtypes)[id_col]
    fitted = rest.groupBy("shard").applyInPandas(packed, f"doc_id {kind}, piece int, start long, length long, bin_id string, bin_capacity int, bin_offset long")
    return full.unionByName(fitted)


def waste(packed: DataFrame) -> DataFrame:
    """One row: bins, tokens, capacity and the share of the capacity that is left empty."""
    bins = packed.groupBy("bin_id").agg(F.max("bin_capacity").alias("capacity"), F.sum("length").alias("tokens"))
    return bins.agg(F.count("*").alias("bins"), F.sum("tokens").alias("tokens"), F.sum("capacity").alias("capacity"), (1 - F.sum("tokens") / F.sum("capacity")).alias("empty_share"))
