"""Suffix-array dedup: a logarithmic family of sorted suffix tables that new batches of documents are merge-scanned against.

A byte is removed if a string of ``width`` bytes that covers it also starts earlier: in an earlier batch, in a smaller
id of the same batch, or further ahead in the same document. Documents are UTF-8 bytes and strings never cross them.

**Sparse suffixes.** Each string of ``width`` bytes is assigned to one suffix that starts within it: the one whose first
``gram`` bytes hash least (the first of equals). The choice depends on the string alone, so equal strings choose alike.
Neighbouring strings choose the same suffix mostly; together they are its *stretch*, about one in (width - gram) / 2
bytes. A suffix table has a row a stretch: ``h`` (hash of the suffix's first bytes), ``c`` (hash of the whole stretch)
and its place. Tables lie in ranges of (h, c, place), sorted: equal suffixes are neighbours, and equal stretches too.

**Levels.** A batch's rows and those of all levels are merged in one range-partitioned sort and read once in order. A
stretch equal to the one before it is covered as a whole. Where a suffix has several different stretches, their texts
are fetched and their strings compared one by one; so are suffixes at the edge of a range, whose neighbours are in
another task. A caller who needs the spans of all batches together compares once, after the last. Levels of equal size merge: like the digits of a binary counter, one table of size 2^k stands for 2^k
batches, and what the merged table keeps are the first rows of equal stretches in that same scan.

No task holds more than a range of rows: equal stretches spread over ranges, and a suffix with more than
``HOT_STRETCHES`` different stretches is compared by rows of strings with partial minima instead of in one task.

Defined cases: null texts are empty; a null id counts as the largest; rows of one id with different texts are
documents of their own, in order of a hash of the text; rows that are equal in id and text are one document, and each
gets its result; texts below ``width`` bytes lose nothing; an empty table gives none; further columns stay in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from tidewire.llm.common import if_small, released, written

#: Rows of a range partition on average, and stretches of a suffix that one task compares at most (some 150 MB of hashes).
PARTITION_ROWS, HOT_STRETCHES = 400_000, 20_000
#: Bytes that are hashed at once, which bounds a worker's memory; a string belongs to the piece that it starts in.
PIECE = 1 << 18
#: The id that null counts as.
LAST = 2**63 - 1

_PLACE = "age int, id long, t long, q int, n int"
_ORDER = ["h", "c", "age", "id", "t", "q"]
_SPAN = "id long, t long, start int, stop int"


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random odd number for each byte, and the powers of a base and of its inverse modulo 2^64."""
    base = 0x9E3779B97F4A7C15
    of_byte = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    powers = []
    for b in (base, pow(base, -1, 2**64)):
        factors = np.full(1 << 20, b, dtype=np.uint64)
        factors[0] = 1
        powers.append(np.multiply.accumulate(factors))
    return of_byte, *powers


def _prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """S and P such that ``(S[j] - S[i]) * P[i]`` is a hash of ``data[i:j]`` that doesn't depend on i."""
    of_byte, up, down = _tables()
    if len(data) >= len(up):
        up, down = (np.multiply.accumulate(np.r_[p[:1], np.full(len(data), p[1])]) for p in (up, down))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(of_byte[data] * down[: len(data)], out=sums[1:])
    return sums, up


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    span = 1
    while 2 * span <= size:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (size - span)], x[size - span :]) if span < size else x


def stretches(data: np.ndarray, ends: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """h, c, first string and number of strings of each stretch of ``data``, in which documents end at ``ends``; strings start in the first PIECE bytes."""
    n = min(len(data) - width + 1, PIECE)
    none = np.empty(0, dtype=np.int64)
    if n <= 0:
        return none, none, none, none
    data = data[: n + width - 1]
    sums, powers = _prefix_sums(data)
    grams = _mixed((sums[gram:] - sums[:-gram]) * powers[: len(data) - gram + 1])
    bits = np.uint64(22)  # of a place in the piece
    least = _sliding_min(grams >> bits << bits | np.arange(len(grams), dtype=np.uint64), width - gram + 1)
    suffix = (least & np.uint64((1 << 22) - 1)).astype(np.int64)
    lengths = np.diff(np.r_[0, np.minimum(ends, len(data))])
    whole = np.arange(n) + width <= np.repeat(ends, lengths)[:n]
    q = np.flatnonzero(whole)
    if not len(q):
        return none, none, none, none
    suffix = suffix[q]
    new = np.flatnonzero(np.r_[True, (suffix[1:] != suffix[:-1]) | (q[1:] != q[:-1] + 1)])
    first, count = q[new], np.diff(np.r_[new, len(q)])
    stop = first + count - 1 + width
    whole_hash = _mixed((sums[stop] - sums[first]) * powers[first] + count.astype(np.uint64))
    return grams[suffix[new]].view(np.int64), whole_hash.view(np.int64), first, count


def _text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array of bytes, and where each ends."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets[1:] - offsets[0]


def suffix_rows(docs: DataFrame, age: int, width: int, gram: int) -> DataFrame:
    """h, c, age, id, t, q, n for each stretch of ``docs`` (id, t, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ts = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("id", "t"))
            data, ends = _text_bytes(batch.column("text"))
            starts = np.r_[0, ends[:-1]]
            for at in range(0, len(data), PIECE):
                lo = np.searchsorted(ends, at, "right")
                hi = np.searchsorted(ends, at + PIECE, "left") + 1
                h, c, first, n = stretches(data[at : at + PIECE + width - 1], ends[lo:] - at, width, gram)
                if not len(h):
                    continue
                doc = lo + np.searchsorted(ends[lo:hi] - at, first, "right")
                yield pa.RecordBatch.from_pydict({"h": h, "c": c, "age": np.full(len(h), age, dtype=np.int32), "id": ids[doc], "t": ts[doc], "q": (first + at - starts[doc]).astype(np.int32), "n": n.astype(np.int32)})

    return docs.select("id", "t", "text").mapInArrow(rows, f"h long, c long, {_PLACE}")


def _scan(now: int, merged_from: int):
    """The pass over a sorted range: ``covered`` rows of the batch, rows ``kept`` in the new level, and rows to ``compare``."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if whole is None:
            return
        h, c, age = (whole[k].to_numpy() for k in ("h", "c", "age"))
        new_h = np.r_[True, h[1:] != h[:-1]]
        first = new_h | np.r_[True, c[1:] != c[:-1]]
        run = np.cumsum(new_h) - 1
        several, touched = np.bincount(run, first) > 1, np.bincount(run, age == now) > 0
        several[[0, -1]] = touched[[0, -1]] = True  # these may go on in a neighbour
        compare = first & several[run] & touched[run]
        covered, kept = ~first & (age == now), first & (age >= merged_from)
        some = compare | covered | kept
        flags = {"covered": covered, "kept": kept, "compare": compare}
        for name, x in flags.items():
            whole = whole.append_column(name, pa.array(x))
        yield from whole.filter(pa.array(some)).to_batches(max_chunksize=50_000)

    return scanned


def _fetched(width: int):
    """Texts of stretches, from the texts of their documents."""

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, places = batch.column("text"), batch.column("places")
            owner = np.repeat(np.arange(len(places)), places.value_lengths().to_numpy(zero_copy_only=False))
            flat = places.flatten()
            fields = {k: flat.field(k).to_numpy(zero_copy_only=False) for k in ("h", "age", "q", "n")}
            out, at, data = [], -1, b""
            for i, q, n in zip(owner.tolist(), fields["q"].tolist(), fields["n"].tolist(), strict=True):
                if i != at:
                    at, data = i, texts[i].as_py().encode()
                out.append(data[q : q + n - 1 + width])
            ids = {k: batch.column(k).to_numpy(zero_copy_only=False)[owner] for k in ("id", "t")}
            for lo in range(0, len(out), 20_000):
                part = slice(lo, lo + 20_000)
                yield pa.RecordBatch.from_pydict({"h": fields["h"][part], "age": fields["age"][part], "id": ids["id"][part], "t": ids["t"][part], "q": fields["q"][part], "stretch": pa.array(out[part], pa.binary())})

    return fetched


def _strings(batch: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, offset and hash of every string of the stretches of ``batch``."""
    lengths = np.array([len(x) for x in batch["stretch"].to_pylist()], dtype=np.int64)
    data = np.frombuffer(b"".join(batch["stretch"].to_pylist()), dtype=np.uint8)
    starts = np.cumsum(lengths) - lengths
    count = lengths - width + 1
    row = np.repeat(np.arange(len(lengths)), count)
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    sums, powers = _prefix_sums(data)
    at = starts[row] + offset
    return row, offset, ((sums[at + width] - sums[at]) * powers[at]).view(np.int64)


def _compared(since: int, width: int):
    """Spans of strings, of batches from ``since`` on, that occur earlier within their suffix; a partition has all rows of its suffixes, in order."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        whole = pa.Table.from_batches(found).combine_chunks()
        h, age, ids, ts, q0 = (whole[k].to_numpy() for k in ("h", "age", "id", "t", "q"))
        edges = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        # whole suffixes together, some thousand stretches a part
        cuts = [0, *(int(e) for e, before in zip(edges[1:], edges[:-1], strict=True) if e // 5_000 != before // 5_000), len(h)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            row, offset, hashed = _strings(whole.slice(lo, hi - lo), width)
            row += lo
            order = np.lexsort((np.arange(len(row)), hashed, h[row]))
            same = (h[row[order]][1:] == h[row[order]][:-1]) & (hashed[order][1:] == hashed[order][:-1])
            again = np.zeros(len(row), dtype=bool)
            again[order[1:]] = same
            again &= age[row] >= since
            at = np.flatnonzero(again)
            if not len(at):
                continue
            runs = np.r_[True, (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])]
            first, last = at[runs], at[np.r_[np.flatnonzero(runs)[1:] - 1, len(at) - 1]]
            r = row[first]
            yield pa.RecordBatch.from_pydict({"id": ids[r], "t": ts[r], "start": (q0[r] + offset[first]).astype(np.int32), "stop": (q0[r] + offset[last] + width).astype(np.int32)})

    return compared


def _string_rows(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2_000):
                part = pa.Table.from_batches([batch.slice(lo, 2_000)])
                row, offset, hashed = _strings(part, width)
                of = {k: part[k].to_numpy()[row] for k in ("h", "age", "id", "t", "q")}
                yield pa.RecordBatch.from_pydict(of | {"q": (of["q"] + offset).astype(np.int32), "w": hashed})

    return rows


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of each document in order; those that overlap or touch are one."""
    for batch in batches:
        found = batch.column("found")
        owner = np.repeat(np.arange(len(found)), found.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        flat = found.flatten()
        start, stop = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "stop"))
        order = np.lexsort((start, owner))
        owner, start, stop = owner[order], start[order], stop[order]
        apart = stop.max(initial=0) + 1  # so that the running maximum begins anew with each document
        reach = np.maximum.accumulate(stop + owner * apart)
        new = np.flatnonzero(np.r_[True, start[1:] + owner[1:] * apart > reach[:-1]]) if len(start) else np.empty(0, dtype=np.int64)
        ends = np.r_[new[1:] - 1, len(start) - 1] if len(new) else new
        offsets = np.searchsorted(owner[new], np.arange(len(found) + 1)).astype(np.int32)
        fields = [pa.array(start[new].astype(np.int32)), pa.array((reach[ends] - owner[new] * apart).astype(np.int32))]
        spans = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, ["start", "stop"]))
        yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "t": batch.column("t"), "spans": spans})


class SuffixIndex:
    """Levels of suffix tables over the documents of earlier batches; ``scan`` gives a batch's repeats, ``add`` takes it in as well.

    Batches are tables of id, t (0, or a hash of the text where an id has several rows) and text, one row for each
    (id, t), and stay readable. ``levels`` has each level's table by the number of its first batch; there are at most
    log2 of the batches.
    """

    def __init__(self, spark: SparkSession, width: int = 100, gram: int = 32) -> None:
        if not 0 < gram <= width:
            raise ValueError("gram must be positive, and at most width")
        self.spark, self.width, self.gram = spark, width, gram
        self.batches: list[DataFrame] = []
        self.levels: dict[int, DataFrame] = {}

    def scan(self, docs: DataFrame) -> DataFrame:
        """id, t, spans: in each document of the batch that repeats something earlier, the repeating spans in order, apart."""
        return self._judged(docs, keep=False)

    def add(self, docs: DataFrame) -> DataFrame:
        """As ``scan``; the batch becomes a level, and levels of its size merge with it, then levels of that size."""
        return self._judged(docs, keep=True)

    def close(self) -> None:
        """Deletes the levels."""
        released(*self.levels.values())
        self.levels = {}

    def _judged(self, docs: DataFrame, keep: bool) -> DataFrame:
        now = len(self.batches)
        texts = [*self.batches, docs]
        covered, places = self.merge_scan(docs, keep)
        spans = self.settled([covered], [places], texts, now)
        released(covered, places)
        return spans

    def merge_scan(self, docs: DataFrame, keep: bool) -> tuple[DataFrame, DataFrame]:
        """Spans that whole stretches cover (id, t, spans), and the places of stretches that are still to be compared."""
        now = len(self.batches)
        # as many levels merge as the number of batches ends in one bits
        merged_from = now & (now + 1) if keep else now + 1
        rows = written(suffix_rows(docs, now, self.width, self.gram), "suffixes")
        both = reduce(DataFrame.unionByName, (level.filter("kept").select(rows.columns) for level in self.levels.values()), rows)
        parts = self._parts(both, PARTITION_ROWS)
        flagged = f"h long, c long, {_PLACE}, covered boolean, kept boolean, compare boolean"
        scanned = written(both.repartitionByRange(parts, *_ORDER).sortWithinPartitions(*_ORDER).mapInArrow(_scan(now, merged_from), flagged), "suffix-level")
        released(rows)
        spans = scanned.filter("covered").select("id", "t", F.col("q").alias("start"), (F.col("q") + F.col("n") - 1 + self.width).alias("stop"))
        covered = written(self._united(spans), "covered")
        places = written(scanned.filter("compare").select("h", "age", "id", "t", "q", "n"), "stretch-places")
        if keep:
            released(*(self.levels.pop(age) for age in [a for a in self.levels if a >= merged_from]))
            self.levels[merged_from] = scanned
            self.batches.append(docs)
        else:
            released(scanned)
        return covered, places

    def settled(self, covered: list[DataFrame], places: list[DataFrame], texts: list[DataFrame], since: int = 0) -> DataFrame:
        """id, t, spans of batches from ``since`` on, of what was covered and what is found by comparing the stretches of ``places`` in ``texts``."""
        union = lambda tables: reduce(DataFrame.unionByName, tables)
        compared, used = self._compare(union(places).distinct() if len(places) > 1 else places[0], union([x.select("id", "t", "text") for x in texts]), since)
        spans = written(self._united(union(covered).select("id", "t", F.inline("spans")).unionByName(compared)), "spans")
        released(*used)
        return spans

    @staticmethod
    def _united(spans: DataFrame) -> DataFrame:
        return spans.groupBy("id", "t").agg(F.collect_list(F.struct("start", "stop")).alias("found")).mapInArrow(_united, "id long, t long, spans array<struct<start int, stop int>>")

    def _parts(self, rows: DataFrame, most: int) -> int:
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // most))

    def _compare(self, places: DataFrame, texts: DataFrame, since: int) -> tuple[DataFrame, list[DataFrame]]:
        """Spans of strings that repeat within suffixes of several stretches, and the tables behind them."""
        by_document = places.groupBy("id", "t").agg(F.collect_list(F.struct("h", "age", "q", "n")).alias("places"))
        found = texts.join(by_document, ["id", "t"]).select("id", "t", "text", "places")
        cut = written(found.mapInArrow(_fetched(self.width), "h long, age int, id long, t long, q int, stretch binary"), "stretches")
        hot = written(cut.groupBy("h").count().filter(F.col("count") > HOT_STRETCHES).select("h"), "hot-suffixes")
        any_hot = not hot.isEmpty()
        cold = cut.join(if_small(hot), "h", "left_anti") if any_hot else cut
        out = cold.repartition(self._parts(cut, PARTITION_ROWS // 8), "h").sortWithinPartitions("h", "age", "id", "t", "q").mapInArrow(_compared(since, self.width), _SPAN)
        if any_hot:
            rows = cut.join(if_small(hot), "h", "left_semi").mapInArrow(_string_rows(self.width), "h long, age int, id long, t long, q int, w long")
            place = F.struct("age", "id", "t", "q")
            firsts = rows.groupBy("h", "w").agg(F.min(place).alias("first"), F.count("*").alias("rows")).filter("rows > 1").drop("rows")
            again = rows.join(firsts, ["h", "w"]).filter((F.col("age") >= since) & (place > F.col("first")))
            out = out.unionByName(again.select("id", "t", F.col("q").alias("start"), (F.col("q") + self.width).alias("stop")))
        return out, [cut, hot]


@F.pandas_udf(StructType([StructField("kept", BinaryType()), StructField("n_removed", LongType()), StructField("n_spans", LongType())]))
def _cut(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
    def one(t: str, found) -> tuple:
        data, at, out, removed = t.encode(), 0, [], 0
        for x in found:
            out.append(data[at : x["start"]])
            at, removed = x["stop"], removed + x["stop"] - x["start"]
        return b"".join([*out, data[at:]]), removed, len(found)

    return pd.DataFrame([(None, 0, 0) if t is None else one(t, found) for t, found in zip(text, spans, strict=True)], columns=["kept", "n_removed", "n_spans"])


def remove_repeats(docs: DataFrame, width: int = 100, gram: int = 32, batches: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (a struct of a row's own columns), kept (its remaining bytes), n_bytes, n_removed and n_spans (maximal removed runs) for every row.

    The documents go through an index in ``batches`` ranges of ids, each about as many documents; the last is scanned
    only, and strings are compared once, when all have been scanned.
    """
    spark = docs.sparkSession
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    again = written(own.groupBy("id").count().filter("count > 1").select("id", F.lit(True).alias("again")), "repeated-ids")
    if again.isEmpty():
        own = own.withColumn("t", F.lit(0).cast("long"))
        single = own.select("id", "t", "text")
    else:
        own = own.join(if_small(again), "id", "left").withColumn("t", F.when(F.col("again"), F.xxhash64("text")).otherwise(F.lit(0)))
        single = own.filter("again is null").select("id", "t", "text").unionByName(own.filter("again").select("id", "t", "text").dropDuplicates(["id", "t"]))
    index = SuffixIndex(spark, width, gram)
    quantiles = own.stat.approxQuantile("id", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    cuts = sorted({min(int(x), LAST) for x in quantiles})  # as a double, LAST is one more
    within = [F.lit(True)] if not cuts else [F.col("id") <= cuts[0], *((F.col("id") > a) & (F.col("id") <= b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)), F.col("id") > cuts[-1]]
    found = [index.merge_scan(single.filter(some), keep=k < len(within) - 1) for k, some in enumerate(within)]
    index.close()
    spans = index.settled([x[0] for x in found], [x[1] for x in found], [single])
    released(*(x for pair in found for x in pair))
    joined = own.join(if_small(spans), ["id", "t"], "left")
    lost = F.col("spans").isNotNull()
    out = joined.withColumn("cut", _cut(F.when(lost, F.col("text")), "spans"))
    zero = F.lit(0).cast("long")
    return out.select(
        "row",
        F.when(lost, F.col("cut.kept")).otherwise(F.encode("text", "utf-8")).alias("kept"),
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.when(lost, F.col("cut.n_removed")).otherwise(zero).alias("n_removed"),
        F.when(lost, F.col("cut.n_spans")).otherwise(zero).alias("n_spans"),
    )
