"""Line dedup over a range-partitioned table of line hashes.

Lines become rows (128-bit hash of the key, document, position). The rows are range-partitioned by hash, document and
position and sorted so, later documents first; a hash that half of the documents hold therefore spreads over as many
partitions as it has rows for. Each partition is streamed: within a run of equal hashes the first document is the one
that keeps its lines, and from the third document on it is settled that the others lose theirs. Only a partition's
first and last run may go on in a neighbour; their rows are passed on undecided with the hash, and are decided by the
sums of these runs, at most two a partition. The result is a bitmap per document, in compressed form, rather than text.

A key is a line without the blanks at its ends and with A-Z in lower case. Keys of ``min_chars`` code points or more
that ``min_docs`` documents or more hold lose all their lines but those in the largest document id.

Defined cases: a null or empty text is one empty line and is kept as such; a line that repeats within a document
counts as one document and is kept or dropped as a whole; a null document id loses and holds nothing; rows with equal
ids are one document to the counts, but each text of an id has a bitmap of its own; an empty table gives an empty
result; further columns are ignored, or kept in the struct ``row`` of ``apply_bitmaps``, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from tidewire.llm.common import if_small, lines, lower_ascii, written

#: Rows of a range partition, on average (40 bytes each).
PARTITION_ROWS = 500_000


def line_key(line: Column) -> Column:
    """What lines are compared by."""
    return lower_ascii(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")))


def line_rows(docs: DataFrame, min_chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """h1, h2, doc_id, text (a hash of the whole text) and pos for every line whose key is long enough."""
    # long enough lines only can have long enough keys
    found = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text"), F.posexplode(lines(F.col(text_col))).alias("pos", "line")).filter(F.length("line") >= min_chars)
    found = found.select("doc_id", "text", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    return found.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "doc_id", "text", "pos")


_STREAMED = "doc_id long, text long, pos int, open boolean, h1 long, h2 long"


def stream_runs(min_docs: int):
    """The pass over a sorted partition: yields rows that are dropped for sure, and those of its first and last run as open."""

    def out(doc, text, pos, open_, h1, h2) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"doc_id": doc.astype(np.int64), "text": text.astype(np.int64), "pos": pos.astype(np.int32), "open": np.full(len(doc), open_), "h1": h1.astype(np.int64), "h2": h2.astype(np.int64)})

    def decided(h1, h2, doc, text, pos) -> pa.RecordBatch:
        """Rows of whole runs, of which some aren't the first in the partition and none is the last."""
        new_run = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        new_doc = new_run | np.r_[True, doc[1:] != doc[:-1]]
        run, nth = np.cumsum(new_run) - 1, np.cumsum(new_doc)
        first_doc = nth[new_run]
        docs_in_run = np.r_[first_doc[1:], nth[-1] + 1] - first_doc
        lost = (docs_in_run[run] >= min_docs) & (nth > first_doc[run])
        return out(doc[lost], text[lost], pos[lost], False, h1[lost], h2[lost])

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows of the run that isn't over, unless it is the first
        at, first = None, True
        for batch in batches:
            h1, h2, doc, text, pos = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("h1", "h2", "doc_id", "text", "pos"))
            if not len(h1):
                continue
            starts = np.flatnonzero(np.r_[(h1[0], h2[0]) != at, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            part = lambda i, j: (h1[i:j], h2[i:j], doc[i:j], text[i:j], pos[i:j])  # noqa: E731, B023
            head = starts[0] if len(starts) else len(h1)
            if at is None:
                head = starts[1] if len(starts) > 1 else len(h1)
            if first and head:  # the first run goes on
                yield out(doc[:head], text[:head], pos[:head], True, h1[:head], h2[:head])
            elif head:
                held.append(part(0, head))
            tail = starts[-1] if len(starts) and starts[-1] >= head else None
            if tail is not None:
                whole = [*held, part(head, tail)]
                joined = [np.concatenate(x) for x in zip(*whole, strict=True)]
                if len(joined[0]):
                    yield decided(*joined)
                held, first = [part(tail, len(h1))], False
            at = (h1[-1], h2[-1])
        for h1, h2, doc, text, pos in held:
            yield out(doc, text, pos, True, h1, h2)

    return streamed


def dropped_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (a hash of the whole text) and pos of every line that is lost."""
    rows = written(line_rows(docs, min_chars, id_col, text_col), "line-hashes")
    parts = max(1, -(-rows.count() // PARTITION_ROWS))
    parts = max(parts, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["h1", "h2", F.col("doc_id").desc(), "text", "pos"]
    streamed = written(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(stream_runs(min_docs), _STREAMED), "streamed-lines")
    open_ = streamed.filter("open")
    by_doc = open_.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
    runs = by_doc.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc_id").alias("keeper")).filter(F.col("docs") >= min_docs)
    lost = open_.join(if_small(written(runs, "open-runs")), ["h1", "h2"]).filter("doc_id <> keeper")
    return streamed.filter("not open").select("doc_id", "text", "pos").unionByName(lost.select("doc_id", "text", "pos"))


@F.pandas_udf(BinaryType())
def _bitmap(n_lines: pd.Series, dropped: pd.Series) -> pd.Series:
    def one(n: int, lost) -> bytes:
        keep = np.ones(-(-n // 8) * 8, dtype=np.uint8)  # whole bytes; lines past the last bit are kept
        keep[np.asarray(lost)] = 0
        return zlib.compress(np.packbits(keep).tobytes())

    return pd.Series([one(n, lost) for n, lost in zip(n_lines, dropped, strict=True)], dtype=object)


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (a hash of the whole text), n_dropped and keep (zlib-compressed bits, first line first) for each text of a document that loses a line."""
    lost = dropped_lines(docs, min_chars, min_docs, id_col, text_col).groupBy("doc_id", "text").agg(F.sort_array(F.collect_set("pos")).alias("lost"))
    return lost.select("doc_id", "text", F.size("lost").cast("long").alias("n_dropped"), _bitmap(F.element_at("lost", -1) + 1, "lost").alias("keep"))


@F.pandas_udf(StringType())
def _kept_text(text: pd.Series, keep: pd.Series) -> pd.Series:
    def one(t, bits) -> str:
        t = t or ""
        if bits is None:
            return t
        parts = t.split("\n")
        flags = np.unpackbits(np.frombuffer(zlib.decompress(bits), dtype=np.uint8))
        return "\n".join(x for i, x in enumerate(parts) if i >= len(flags) or flags[i])

    return pd.Series([one(t, b) for t, b in zip(text, keep, strict=True)], dtype=object)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (a struct of a row's own columns), kept_text (its kept lines) and n_dropped; Python gets the texts that lose a line only.

    Texts are shuffled only where the bitmaps are too large to be broadcast.
    """
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("whole"))
    bits = if_small(written(bitmaps, "bitmaps"))
    joined = own.join(bits, (F.col("id") == F.col("doc_id")) & (F.xxhash64("whole") == F.col("text")), "left")
    lost = F.col("keep").isNotNull()
    kept = F.when(~lost, F.coalesce("whole", F.lit(""))).otherwise(_kept_text(F.when(lost, F.col("whole")), "keep"))
    return joined.select("row", kept.alias("kept_text"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"))
