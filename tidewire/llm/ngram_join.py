"""Jaccard join of documents on word shingles, exact up to 64-bit hashing, with its classes.

1. A document's set is that of the hashes of its distinct shingles. Equal sets are one kind, with its copies.
2. First look: of each set the least ``n - ceil(0.75 n) + 1 + n / SPARE`` hashes are looked at. Two sets that link share
   all but ``n - ceil(0.75 n)`` of those of the set whose look ends first, and the other has them in its look as well,
   so a kind of which too few are in another kind's look has no partner. One aggregation by hash with partial minima
   tells; what is left is a small part of a corpus: copies, and texts made of common passages.
3. The whole sets of those are made again and counted by hash; a set of which more than a quarter is in no other is
   done with as well.
4. The rest are indexed by their prefix: in an order of all hashes that has the rarest first, two sets that link share
   one of the first ``n - ceil(0.75 n) + 1`` of either. Common passages come last and are hardly ever looked up.
5. First pass: the kinds of a hash are put in one of ``ORDERS`` random orders and neighbours are verified, which links
   up large groups of near copies with few comparisons. Second pass: of the pairs that share a prefix hash, those in
   different components so far are left. A hash that few kinds share hands on its pairs; the kinds of any other meet
   in tiles by hash, size band (sizes in a ratio of 3/4, so a band meets itself and the next) and, where a hash has
   more than ``TILE`` of them, parts of it.
6. In a tile, bitmap signatures of hashed shingles are compared: the bits in which two differ are at most the size of
   their symmetric difference, so they bound the overlap from above. Pairs that pass are bounded by wider signatures,
   and what passes those is intersected exactly, as sorted arrays.

No group is expanded into all its pairs: within a component nothing is compared any more. The tiles of one group have
much the same kinds, so the second pass begins with the tiles of ``FIRST_HASHES`` hashes a kind, then takes all, and
leaves out pairs that were tested before. A tile gives out ``PARTNERS`` pairs a kind that its bound allows; where a kind
has more, the pass is made again with the components that these gave and with more partners, until no kind has. So each
pair that shares a prefix hash is verified, or bounded away, or inside one component. No bucket or partner is capped.

Defined cases: null, empty and blank texts have an empty set and link with nothing; texts of fewer than five words have
one shingle, all their words; a row is a document, also where ids repeat; a null id is the least of no class that has
other ids; an empty table gives an empty result; further columns are ignored, or kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import if_small, lower_ascii, released, words, written
from tidewire.llm.components import connected_components
from tidewire.llm.text_stats import windows

#: Words of a shingle, and the similarity from which documents link, in hundredths.
WORDS, LINK = 5, 75
#: The first look takes a part of 1 / SPARE of a set beyond its prefix.
SPARE = 8
#: Random orders in the first pass, kinds in a tile of the second, and kinds of a hash that hands on all its pairs.
ORDERS, TILE, FEW = 16, 4096, 8
#: Pairs of a kind that a tile gives out at first (each further second pass allows sixteen times as many), and hashes of a kind whose tiles come first.
PARTNERS, FIRST_HASHES = 64, 4
#: Bits of the signatures that tiles compare, at most.
TILE_BITS = 2048
#: Pairs that a task gathers from small tiles before it passes them on.
OUT_PAIRS = 100_000


def with_sets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with set (the distinct shingles of its text as sorted hashes), n (their number), sig1 and sig2 (of the whole set).

    Words and sets are columns of their own, so that each is made once a row.
    """
    w = F.col("_words")
    out = docs.withColumn("_words", words(lower_ascii(F.coalesce(F.col(text_col), F.lit("")))))
    found = F.when(F.size(w) >= WORDS, windows(w, WORDS)).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumn("set", F.sort_array(F.array_distinct(found)))
    return out.withColumns({"n": F.size("set").cast("long"), "sig1": F.xxhash64("set"), "sig2": F.xxhash64(F.lit("second"), F.col("set"))}).drop("_words")


def _needed(n: Column) -> Column:
    """Elements of a set that a partner has at least."""
    return F.floor((n * LINK + 99) / 100)


def _allowed(n: Column) -> Column:
    """Elements of a set that a partner may lack."""
    return n - _needed(n)


def _look(n: Column) -> Column:
    """Elements that the first look takes."""
    return (_allowed(n) + 1 + F.floor(n / SPARE)).cast("int")


def _possible(sets: DataFrame, kinds: DataFrame) -> DataFrame:
    """n, sig1, sig2 and rep of the kinds of which enough looked-at elements are in another kind's look."""
    held = sets.select("sig1", F.explode("look").alias("h")).groupBy("h").agg(F.min("sig1").alias("lo"), F.max("sig1").alias("hi"))
    alone = held.filter("lo = hi").groupBy(F.col("lo").alias("sig1")).agg(F.count("*").alias("alone"))
    # a partner may be smaller by a quarter, and so may be what its look has to spare
    shared = _look(F.col("n")) - F.coalesce("alone", F.lit(0))
    return kinds.join(alone, "sig1", "left").filter(shared >= 1 + F.floor(_needed(F.col("n")) / SPARE)).select("n", "sig1", "sig2", "rep")


def width(n: int) -> int:
    """Bits of a signature for sets of ``n``: a power of two of at least 4 n, so that few elements share a bit."""
    return min(1 << 18, max(256, 1 << int(4 * n - 1).bit_length()))


def signature(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bitmap of a set, as 64-bit words."""
    flags = np.zeros(bits, dtype=np.uint8)
    flags[(hashes & (bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags).view(np.uint64)


def folded(words_: np.ndarray, bits: int) -> np.ndarray:
    """A signature as it would be at a lesser width: an element's bit is the lower part of its hash."""
    while len(words_) * 64 > bits:
        half = len(words_) // 2
        words_ = words_[:half] | words_[half:]
    return words_


def may_link(n_a, n_b, differing):
    """Whether sets of these sizes whose signatures differ in so many bits can link: overlap is at most (n_a + n_b - differing) / 2."""
    overlap = (n_a + n_b - differing) // 2
    return 100 * overlap >= LINK * (n_a + n_b - overlap)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        bits = [signature(s, width(len(s))) for s in batch["set"]]
        yield batch.assign(bits=[b.tobytes() for b in bits], mark=[folded(b, TILE_BITS).tobytes() for b in bits])


def _bounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keep = []
        for n1, n2, b1, b2 in zip(batch["n1"], batch["n2"], batch["b1"], batch["b2"], strict=True):
            x, y = np.frombuffer(b1, dtype=np.uint64), np.frombuffer(b2, dtype=np.uint64)
            bits = 64 * min(len(x), len(y))
            keep.append(may_link(n1, n2, int(np.bitwise_count(folded(x, bits) ^ folded(y, bits)).sum())))
        yield batch.loc[np.array(keep, dtype=bool), ["a", "b"]]


def _exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        common = np.array([overlap(x, y) for x, y in zip(batch["s1"], batch["s2"], strict=True)], dtype=np.int64)
        sizes = np.array([len(x) + len(y) for x, y in zip(batch["s1"], batch["s2"], strict=True)], dtype=np.int64)
        yield batch.loc[100 * common >= LINK * (sizes - common), ["a", "b"]]


def verified(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """The pairs (a, b: rep of ``full``) that link: first by the bound of their signatures, then exactly."""
    side = lambda k, what: full.select(F.col("rep").alias("ab"[k - 1]), *(F.col(c).alias(f"{c[0]}{k}") for c in what))
    signed = pairs.join(side(1, ["n", "bits"]), "a").join(side(2, ["n", "bits"]), "b").select("a", "b", "n1", "n2", "b1", "b2")
    left = written(signed.mapInPandas(_bounded, "a long, b long"), "bounded-pairs")
    both = left.join(side(1, ["set"]), "a").join(side(2, ["set"]), "b").select("a", "b", "s1", "s2")
    links = written(both.mapInPandas(_exact, "a long, b long"), "links")
    released(left)
    return links


def _named(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """Those of ``full`` that ``pairs`` (a written table) name, where these are few; they are broadcast if they are small."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rep"))
    few = if_small(ends)
    return full if few is ends else if_small(written(full.join(few, "rep", "left_semi"), "named-sets"))


def _within(reach: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of kinds at most ``reach`` places apart within a hash, in the order given, in different components and of sizes that allow a link."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, dtype=np.int64)] * 4
        for batch in batches:
            before = len(held[0])
            h, rep, n, comp = (np.r_[old, batch.column(k).to_numpy(zero_copy_only=False)] for old, k in zip(held, ("h", "rep", "n", "comp"), strict=True))
            for d in range(1, min(reach, len(h) - 1) + 1):
                small, large = np.minimum(n[d:], n[:-d]), np.maximum(n[d:], n[:-d])
                ok = (h[d:] == h[:-d]) & (comp[d:] != comp[:-d]) & (100 * small >= LINK * large)
                ok[: max(0, before - d)] = False  # both were in an earlier batch
                a, b = rep[d:][ok], rep[:-d][ok]
                yield pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b)})
            held = [x[-reach:] for x in (h, rep, n, comp)]

    return pairs


def _chosen(a: np.ndarray, b: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs are among the ``limit`` of their ``a`` that come first by a hash of the pair, and whether their ``a`` has more."""
    mixed = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    order = np.lexsort((mixed, a))
    start = np.r_[True, a[order][1:] != a[order][:-1]][: len(a)]
    run = np.cumsum(start) - 1
    first = np.flatnonzero(start)
    size = np.diff(np.r_[first, len(a)])
    nth, more = np.empty(len(a), dtype=np.int64), np.empty(len(a), dtype=bool)
    nth[order], more[order] = np.arange(len(a)) - first[run], size[run] > limit
    return nth < limit, more


def _pairs_between(n, comp, wide, left, right, chosen: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Pairs of the rows ``left`` with the rows ``right`` (indices) in different components that may link, by way of ``chosen``.

    Rows of the component that most of them are in are compared with the other components' only. All pairs are
    bounded by signatures folded to a quarter, and those that pass by the whole ones.
    """
    sig = wide
    while sig.shape[1] > max(4, wide.shape[1] // 4):
        sig = sig[:, : sig.shape[1] // 2] | sig[:, sig.shape[1] // 2 :]
    _, code, count = np.unique(comp, return_inverse=True, return_counts=True)
    main = code == count.argmax()
    out = [np.zeros((3, 0), dtype=np.int64)]
    for some, others in ((left[~main[left]], right), (left[main[left]], right[~main[right]])):
        if not len(some) or not len(others):
            continue
        step = max(1, 2_000_000 // (len(others) * sig.shape[1]))
        for k in range(0, len(some), step):
            i = some[k : k + step]
            differing = np.bitwise_count(sig[i][:, None, :] ^ sig[others][None, :, :]).sum(2, dtype=np.int64)
            x, y = np.nonzero((code[i][:, None] != code[others][None, :]) & may_link(n[i][:, None], n[others][None, :], differing))
            if len(x) and sig is not wide:
                narrow = np.concatenate([np.bitwise_count(wide[i[x[s : s + 8192]]] ^ wide[others[y[s : s + 8192]]]).sum(1, dtype=np.int64) for s in range(0, len(x), 8192)])
                passed = may_link(n[i[x]], n[others[y]], narrow)
                x, y = x[passed], y[passed]
            out.append(chosen(i[x], others[y]))
    return np.concatenate(out, axis=1)


def _level(n: np.ndarray) -> np.ndarray:
    """Size band of a set."""
    return np.floor(np.log(n) / np.log(100 / LINK) + 1e-9).astype(np.int64)


def _tested_keys(row: np.ndarray, tested: np.ndarray) -> np.ndarray:
    """``i * len(row) + j`` of the pairs of a tile's rows (indices) that were tested before: ``tested`` has a list of other rows, or None, for each."""
    lists = [np.zeros(0, dtype=np.int64) if t is None else np.asarray(t, dtype=np.int64) for t in tested]
    others, i = np.concatenate(lists), np.repeat(np.arange(len(row)), [len(t) for t in lists])
    order = np.argsort(row, kind="stable")
    at = np.minimum(np.searchsorted(row[order], others), len(row) - 1)
    here = row[order][at] == others
    return np.unique(i[here] * len(row) + order[at[here]])


def tile_pairs(row: np.ndarray, n: np.ndarray, comp: np.ndarray, marks: list[bytes], tested: np.ndarray, limit: int, left: np.ndarray | None = None, home: np.ndarray | None = None) -> np.ndarray:
    """Pairs of a tile in different components that may link and weren't tested, ``limit`` a row, and whether a row had more.

    With ``left`` and ``home`` it is a part of a band: rows given as left with the others, of which those of the band
    are at home. Without, it is all of a hash, whose bands each meet themselves and the next.
    """

    def between(i: np.ndarray, j: np.ndarray, home_: np.ndarray) -> np.ndarray:
        used = np.union1d(i, j)
        bits = 8 * min(len(marks[k]) for k in used)
        wide = np.stack([folded(np.frombuffer(marks[k], dtype=np.uint64), bits) for k in used])
        known = _tested_keys(row[used], tested[used])

        def chosen(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            a, b = row[used[x]], row[used[y]]
            # rows of the band meet in both orders
            new = (~home_[used[y]] | (a < b)) & ~np.isin(x * len(used) + y, known)
            a, b = a[new], b[new]
            some, more = _chosen(a, b, limit)
            return np.stack([np.minimum(a, b), np.maximum(a, b), more])[:, some]

        return _pairs_between(n[used], comp[used], wide, np.searchsorted(used, i), np.searchsorted(used, j), chosen)

    if left is not None:
        return between(np.flatnonzero(left), np.flatnonzero(~left), home)
    level = _level(n)
    return np.concatenate([between(np.flatnonzero(level == b), np.flatnonzero((level == b) | (level == b + 1)), level == b) for b in np.unique(level)], axis=1)


_TILE_KEY = ["h", "band", "i", "j"]


def _tiles(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``tile_pairs`` of each tile; rows come sorted by tile. A tile's rows are held together, up to four times TILE on average."""

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        made: list[np.ndarray] = []
        at = None

        def done() -> None:
            rep, n, comp, mark, tested, left, home = (np.concatenate(x) for x in zip(*held, strict=True))
            whole = at[1] < 0
            made.append(tile_pairs(rep, n, comp, list(mark), tested, limit, None if whole else left.astype(bool), None if whole else home.astype(bool)))
            held.clear()

        def out() -> pa.RecordBatch:
            a, b, more = np.unique(np.concatenate([*made, np.zeros((3, 0), dtype=np.int64)], axis=1), axis=1)
            made.clear()
            return pa.RecordBatch.from_pydict({"a": a, "b": b, "more": more})

        for batch in batches:
            if not batch.num_rows:
                continue
            column = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
            key = np.stack([column[c].astype(np.int64) for c in _TILE_KEY], axis=1)
            starts = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, len(key)]
            values = [column[c] for c in ("rep", "n", "comp", "mark", "tested", "left", "home")]
            for i, j in zip(starts[:-1], starts[1:], strict=True):
                now = tuple(key[i])
                if held and now != at:
                    done()
                    if sum(x.shape[1] for x in made) > OUT_PAIRS:
                        yield out()
                at = now
                held.append([v[i:j] for v in values])
        if held:
            done()
        yield out()

    return tiles


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _first_pass(prefix: DataFrame) -> DataFrame:
    shuffled = prefix.select("h", "rep", "n", F.col("rep").alias("comp"), F.xxhash64("rep", F.pmod("h", F.lit(ORDERS))).alias("o"))
    ordered = shuffled.repartitionByRange(_parts(prefix), "h", "o", "rep").sortWithinPartitions("h", "o", "rep")
    return ordered.mapInArrow(_within(1), "a long, b long").distinct()


def _dealt(entries: DataFrame) -> DataFrame:
    """The rows of tiles: those of a hash together, or those of a hash with more than TILE of them dealt out by band and part."""
    columns = ["rep", "n", "comp", "mark", "tested"]
    zero, none = F.lit(0), F.lit(False)
    whole = entries.filter(F.col("kinds") <= TILE).select("h", F.lit(-1).cast("long").alias("band"), zero.alias("i"), zero.alias("j"), none.alias("left"), none.alias("home"), *columns)
    # a band's tile has its own rows and those of the next band
    banded = entries.filter(F.col("kinds") > TILE).withColumn("level", F.floor(F.log(F.col("n").cast("double")) / np.log(100 / LINK) + 1e-9).cast("long"))
    placed = banded.select("h", "level", *columns, F.explode(F.array(zero, F.lit(1))).alias("below")).filter("level >= below").select("h", (F.col("level") - F.col("below")).alias("band"), (F.col("below") == 0).alias("home"), *columns)
    tiles = placed.groupBy("h", "band").agg(F.count("*").alias("rows"), F.count_if("home").alias("homes"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    tiles = tiles.filter("lo <> hi and homes > 0").select("h", "band", F.ceil(F.col("rows") / TILE).cast("int").alias("k"))
    part, every = F.pmod(F.xxhash64("rep"), F.col("k")).cast("int"), F.sequence(zero, F.col("k") - 1)
    spread = lambda left, i, j: F.transform(every, lambda x: F.struct(i(x).alias("i"), j(x).alias("j"), F.lit(left).alias("left")))
    roles = F.concat(F.when(F.col("home"), spread(True, lambda x: part, lambda x: x)).otherwise(F.array().cast("array<struct<i:int,j:int,left:boolean>>")), spread(False, lambda x: x, lambda x: part))
    parts = placed.join(tiles, ["h", "band"]).select("h", "band", "home", *columns, F.explode(roles).alias("r")).select("h", "band", "r.i", "r.j", "r.left", "home", *columns)
    return whole.unionByName(parts)


def _merged(component: DataFrame | None, links: DataFrame) -> DataFrame:
    """``component`` (node, component; None: no links so far) with the ``links`` added: only the components that these join are gone over."""
    if component is None:
        return written(connected_components(links), "components")
    of = lambda x: component.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = written(connected_components(ends), "components")
    moved = component.join(joined.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return written(moved.unionByName(joined.join(component, "node", "left_anti")), "components")


def _apart(pairs: DataFrame, component: DataFrame) -> DataFrame:
    """The pairs (a, b) of different components: those of one don't come up any more."""
    of = lambda x: component.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    return written(pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"), "tested")


def _open(prefix: DataFrame, component: DataFrame) -> DataFrame:
    """The rows of ``prefix`` of the hashes that different components share, with comp and the kinds of the hash."""
    label = component.select(F.col("node").alias("rep"), "component")
    now = prefix.join(label, "rep", "left").select("h", "rep", "n", F.coalesce("component", "rep").alias("comp"))
    of_hash = now.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("kinds")).filter("lo <> hi").select("h", "kinds")
    return written(now.join(of_hash, "h"), "open-prefixes")


def _second_pass(open_: DataFrame, full: DataFrame, tested: DataFrame, limit: int, first: bool) -> DataFrame:
    """Pairs (a, b) that share a prefix hash and may link, of different components, and whether a kind had more than ``limit`` of them in a tile."""
    hot = open_.filter(F.col("kinds") > FEW)
    if first:
        hot = hot.withColumn("nth", F.row_number().over(Window.partitionBy("rep").orderBy("h"))).filter(F.col("nth") <= FIRST_HASHES)
    both = F.explode(F.array(F.struct(F.col("a").alias("rep"), F.col("b").alias("other")), F.struct(F.col("b").alias("rep"), F.col("a").alias("other"))))
    before = tested.select(both.alias("x")).select("x.*").groupBy("rep").agg(F.collect_list("other").alias("tested"))
    marks = written(full.select("rep", "mark").join(before, "rep", "left"), "marks")
    many = _dealt(hot.join(if_small(marks), "rep")).repartition(_parts(open_), *_TILE_KEY).sortWithinPartitions(*_TILE_KEY).mapInArrow(_tiles(limit), "a long, b long, more long")
    if first:
        few = open_.filter(F.col("kinds") <= FEW).repartition(_parts(open_), "h").sortWithinPartitions("h", "rep").mapInArrow(_within(FEW - 1), "a long, b long")
        many = many.unionByName(few.join(if_small(tested), ["a", "b"], "left_anti").withColumn("more", F.lit(0).cast("long")))
    found = written(many.groupBy("a", "b").agg(F.max("more").alias("more")), "tile-pairs")
    released(marks)
    return found


def _classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, text1 and text2 (hashes of the text), n, label (of the class) and component_id (its least id) for each row of ``docs``."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    described = with_sets(plain).select("doc_id", F.xxhash64("text").alias("text1"), F.xxhash64(F.lit("second"), "text").alias("text2"), "n", "sig1", "sig2", F.slice("set", F.lit(1), F.when(F.col("n") > 0, _look(F.col("n"))).otherwise(0)).alias("look"))
    looked = written(described.withColumn("row", F.monotonically_increasing_id()), "looks")
    rows = written(looked.drop("look"), "rows")
    some = rows.filter("n > 0")
    kinds = written(some.groupBy("n", "sig1", "sig2").agg(F.min("row").alias("rep"), F.min("doc_id").alias("least")), "kinds")
    possible = written(_possible(looked.filter("n > 0"), kinds), "possible")
    released(looked)
    # the whole sets of those that are left, each from its first document
    some_kinds = if_small(possible)
    ids = written(some.join(some_kinds.select(F.col("rep").alias("row")), "row", "left_semi").select(F.col("doc_id").alias("of")), "ids")
    chosen = with_sets(plain.join(if_small(ids), plain["doc_id"].eqNullSafe(ids["of"]), "left_semi")).select("n", "sig1", "sig2", "set").join(some_kinds, ["n", "sig1", "sig2"]).select("rep", "n", "set")
    sets = written(chosen, "sets")
    if sets.count() > possible.count():  # copies that share an id
        again, sets = sets, written(sets.dropDuplicates(["rep"]), "sets")
        released(again)
    held = written(sets.select("rep", F.explode("set").alias("h")).groupBy("h").agg(F.count("*").alias("df"), F.min("rep").alias("rep")), "held")
    alone = held.filter("df = 1").groupBy("rep").agg(F.count("*").alias("alone"))
    left = written(sets.select("rep", "n").join(alone, "rep", "left").filter(F.coalesce("alone", F.lit(0)) <= _allowed(F.col("n"))).select("rep"), "left")
    full = written(sets.join(if_small(left), "rep", "left_semi").mapInPandas(_signed, "rep long, n long, set array<bigint>, bits binary, mark binary"), "full-sets")
    # prefixes in the common order, rarest first
    shared = full.select("rep", "n", F.explode("set").alias("h")).join(held.filter("df > 1").select("h", "df"), "h")
    of_kind = Window.partitionBy("rep")
    shared = shared.withColumns({"place": F.row_number().over(of_kind.orderBy("df", "h")), "n_shared": F.count("*").over(of_kind)})
    prefix = written(shared.filter(F.col("place") + F.col("n") - F.col("n_shared") <= _allowed(F.col("n")) + 1).select("h", "rep", "n"), "prefixes")
    released(sets, held, left)
    tested = written(_first_pass(prefix), "neighbours")
    new, component, open_ = verified(tested, full), None, None
    limit, first = PARTNERS, True
    while True:
        # a pass without links leaves the components, and what is open, as they are
        if new is not None:
            component = _merged(component, new)
            tested = _apart(tested, component)
            if open_ is not None:
                released(open_)
            open_ = _open(prefix, component)
        found, new = _second_pass(open_, full, tested, limit, first), None
        more = first or not found.filter("more = 1").isEmpty()
        if not found.isEmpty():
            links = verified(found.select("a", "b"), _named(found, full))
            tested = tested.union(found.select("a", "b"))
            new = None if links.isEmpty() else links
        if not more:
            break
        limit, first = limit if first else 16 * limit, False
    if new is not None:
        component = _merged(component, new)
    released(full, prefix, open_)
    labelled = kinds.join(component.withColumnRenamed("node", "rep"), "rep", "left").select("n", "sig1", "sig2", "least", F.coalesce("component", "rep").alias("label"))
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    labelled = written(labelled.join(least, "label").select("n", "sig1", "sig2", "label", "component_id"), "labelled")
    return rows.join(labelled, ["n", "sig1", "sig2"], "left").select("row", "doc_id", "text1", "text2", "n", F.coalesce("label", "row").alias("label"), F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (least id of the class), row (a number of the input row) and label (of the class)."""
    return _classes(docs, id_col, text_col).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "row", "label")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, of each class the one of the least id (null last), and of the least text hash where rows share that.

    Rows are told apart by id and text, so rows that share an id only stay or go each for itself; of rows that share
    both, one stays. Rows without words all stay.
    """
    classes = written(_classes(docs, id_col, text_col).filter("n > 0"), "classes")
    rank = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text1", "text2")
    best = written(classes.groupBy("label").agg(F.min(rank).alias("best"), F.count("*").alias("members")).filter("members > 1"), "best")
    members = classes.join(best, "label").withColumn("kept", rank == F.col("best"))
    keys = ["doc_id", "text1", "text2"]
    lost = written(members.filter("not kept").select(*keys).distinct(), "lost")
    again = written(members.filter("kept").groupBy(*keys).agg(F.count("*").alias("times")).filter("times > 1").select(*keys), "repeated")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    keyed = docs.select(row, F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text1"), F.xxhash64(F.lit("second"), F.col(text_col)).alias("text2"))

    def of(table: DataFrame, how: str) -> DataFrame:
        on = keyed["doc_id"].eqNullSafe(table["doc_id"]) & (keyed["text1"] == table["text1"]) & (keyed["text2"] == table["text2"])
        return keyed.join(if_small(table), on, how)

    if again.isEmpty():
        return of(lost, "left_anti").select("row.*")
    once = of(again, "left_semi").dropDuplicates(keys).select("row.*")
    return of(written(lost.unionByName(again), "lost-or-repeated"), "left_anti").select("row.*").unionByName(once)
