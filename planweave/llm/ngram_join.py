"""N-gram Jaccard self-join by T-occurrence search.

Two documents link when their sets of word shingles overlap by the threshold; documents with equal sets
are one class first, so copies are never paired. Then:

1. Routing. A class is posted under its smallest shingle hashes, as many as a prefix filter needs,
   at most `route`. Hashes are random, so the first `route` hashes of the union of two sets that link
   miss their common part with probability (1 - threshold) ** route: 2.6e-13 for 18 and 0.8;
   sets of up to 85 shingles are routed exactly.
2. Candidates. In each cell (classes that share a posted shingle) T-occurrence search over sketches
   (the `sketch` smallest hashes, 64 bits each, the whole set if it is no larger) finds the classes that have a
   partner. A pair belongs to the cell of its smallest common shingle. For larger sets the required
   count is 24 of 64 (3 of 8 of the sketch), more than eight standard deviations below what a link gives.
3. Links. The same search over the whole sets of those classes, with the exact threshold.

With route=None every class is posted under the whole prefix, with sketch=None sketches are whole sets: then
nothing is left to chance but 64-bit hashes of shingles.

T-occurrence (DivideSkip): the inverted lists of a cell are divided; short lists are merged by
counting, long lists are skipped, and only documents whose merged count can still reach T with all of
the query's long lists are probed there (by binary search, or as a matrix product where most are).
In step 3 queries inside the largest component of their cell are left out: links among its members join
nothing, and a link to another component is found from there. So a cell emits fewer links than members.
If links are to be counted, all queries run over the whole sets; a pair counts in the cell of its smallest
common shingle only, and a cell emits one number per member, weighted by class sizes, but no pairs.

Cells of more than `block` classes, or in step 3 of more than `block_shingles` shingles in all, are cut twice: by size
(classes whose sizes are in a ratio below the threshold cannot link; a class goes to the band of its size and to the one
below, and a pair belongs to the lower of its members' bands, so rows from the band above do not meet each other), and into pairs of blocks, each a group of its own. Classes that share
an earlier large cell are blocks of a kind, and blocks of the same kind do not meet, as their pairs belong to that cell or one
before. So a group of near copies, which share nearly all of their cells, is solved in about one of them, and a worker holds two
blocks.

Links become components by star contraction. Edge cases: a text that is null or without words has no
shingles and links with nothing; fewer words than `k` are one shingle; repeated rows are equal sets; a
null id takes part but is never the smallest unless its whole component is null, and between equal ids the smaller hash
of id and text is first; a text of any length is read whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planweave.llm.common import at_work, row_keys, ship, stored
from planweave.llm.components import components
from planweave.llm.words import HASHES

_MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text (bytes.lower() and bytes.split() know
    ASCII only, which is what the definition of words asks for)."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
    width = min(k, len(words))
    n = len(words) - width + 1
    h = np.full(n, width, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            h = (h ^ w[i : i + n]) * _MIX1
            h ^= h >> np.uint64(29)
        h *= _MIX2
        h ^= h >> np.uint64(32)
    return np.unique(h)


class _Lists:
    """Inverted lists of the documents of a cell."""

    def __init__(self, sets: list[np.ndarray]):
        self.m = m = len(sets)
        owner = np.repeat(np.arange(m), [len(s) for s in sets])
        flat = np.concatenate(sets)
        _, token = np.unique(flat, return_inverse=True)
        df = np.bincount(token)
        self.token, self.start = token, np.concatenate(([0], np.cumsum([len(s) for s in sets])))
        order = np.argsort(token, kind="stable")
        self.docs, self.first, self.df = owner[order], np.concatenate(([0], np.cumsum(df))), df
        self.long = df >= max(16, m // 16)
        rank = np.full(len(df), -1)
        rank[self.long] = np.arange(int(self.long.sum()))
        held = rank[token]
        self.n_long = np.bincount(owner[held >= 0], minlength=m)
        self.probe_keys = np.sort(held[held >= 0].astype(np.int64) * m + owner[held >= 0])
        self.rank = rank
        self.dense: np.ndarray | None = None
        self.where = (held, owner)

    def _dense(self) -> np.ndarray:
        if self.dense is None:
            held, owner = self.where
            self.dense = np.zeros((self.m, int(self.long.sum())), np.float32)
            self.dense[owner[held >= 0], held[held >= 0]] = 1
        return self.dense

    def search(self, queries: np.ndarray, need: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Boolean (query, document): the overlap reaches need(queries)[query, document]."""
        m, nq = self.m, len(queries)
        t = np.concatenate([self.token[self.start[q] : self.start[q + 1]] for q in queries])
        who = np.repeat(np.arange(nq), [self.start[q + 1] - self.start[q] for q in queries])
        short = ~self.long[t] & (self.df[t] > 1)
        ts, ws = t[short], who[short]
        sizes = self.df[ts]
        # merge: all places of the short lists, one after the other
        offset = np.repeat(self.first[ts] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
        places = np.arange(int(sizes.sum())) + offset
        count = np.bincount(np.repeat(ws, sizes) * m + self.docs[places], minlength=nq * m).reshape(nq, m)
        wanted = need(queries)
        # long lists are probed only where they can still decide; a query's own short lists of one count nothing
        could = count + np.minimum(self.n_long[queries][:, None], self.n_long[None, :]) >= wanted
        could[np.arange(nq), queries] = False
        if self.long.any():
            if could.sum() > 0.02 * could.size and self.m * int(self.long.sum()) <= 50_000_000:
                dense = self._dense()
                count = count + (dense[queries] @ dense.T).astype(np.int64)
            else:
                qi, di = np.nonzero(could)
                held = self.rank[t]
                for q in np.unique(qi):
                    lists = held[(who == q) & (held >= 0)].astype(np.int64)
                    docs = di[qi == q]
                    if len(lists):
                        keys = (lists[:, None] * m + docs[None, :]).ravel()
                        at = np.minimum(np.searchsorted(self.probe_keys, keys), len(self.probe_keys) - 1)
                        count[q, docs] += (self.probe_keys[at] == keys).reshape(len(lists), len(docs)).sum(0)
        return could & (count >= wanted)


def _tops(n: np.ndarray, percent: int) -> Callable[[np.ndarray], np.ndarray]:
    """Overlap that two sets of n shingles need: percent * union <= 100 * overlap."""
    return lambda q: -(-percent * (n[q][:, None] + n[None, :]) // (100 + percent))


def _fits(a: int, b: int) -> bool:
    """Whether rows with sides a and b make a pair of this group: of one block or of different ones, and not both
    from the band above (those are the pairs of that band)."""
    return (a & 3 == 2 or a & 3 != b & 3) and not a & b & 4


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """_fits() of all a with all b."""
    one, two, above = a[:, None] & 3, b[None, :] & 3, (a[:, None] & 4) & (b[None, :] & 4)
    return ((one == 2) | (one != two)) & (above == 0)


def candidates(sets: list[np.ndarray], place: np.ndarray, n: np.ndarray, side: np.ndarray, percent: int, sketch: int | None) -> np.ndarray:
    """Which rows of a cell have a partner that belongs to this cell. sets: sketches in hash order;
    place: where the cell's shingle stands in each; side: bit 0 and 1 tell the blocks a row stands for, bit 2 that
    it is here for the band above its own."""
    m = len(sets)
    has = np.zeros(m, bool)

    if m <= 12:
        own, at = [set(s.tolist()) for s in sets], side.tolist()
        for a in range(m):
            for b in range(a + 1, m):
                big, small = max(n[a], n[b]), min(n[a], n[b])
                if 100 * small < percent * big or not _fits(at[a], at[b]) or (has[a] and has[b]):
                    continue
                need = -(-percent * (big + small) // (100 + percent)) if sketch is None or big <= sketch else min(3 * sketch // 8, -(-percent * big // 100))
                if len(own[a] & own[b]) >= need and own[a].isdisjoint(sets[b][: place[b]].tolist()):
                    has[a] = has[b] = True
        return has
    lists, exact = _Lists(sets), _tops(n, percent)

    def need(q: np.ndarray) -> np.ndarray:
        big = np.maximum(n[q][:, None], n[None, :])
        small = np.minimum(n[q][:, None], n[None, :])
        w = exact(q) if sketch is None else np.where(big <= sketch, exact(q), np.minimum(3 * sketch // 8, -(-percent * big // 100)))
        w = np.where(100 * small < percent * big, 1 << 30, w)
        return np.where(_apart(side[q], side), w, 1 << 30)

    # does a pair share a shingle before this cell's? the same merge over what stands before it
    before = [s[:p] for s, p in zip(sets, place, strict=True)]
    early = _Lists(before) if any(len(b) for b in before) else None
    step = max(1, min(256, 4_000_000 // m))
    for low in range(0, m, step):
        q = np.arange(low, min(m, low + step))
        hit = lists.search(q, need)
        if early is not None and hit.any():
            hit &= ~early.search(q, lambda q: np.ones((len(q), m), np.int64))
        has[q] |= hit.any(1)
        has |= hit.any(0)
    return has


def links(sets: list[np.ndarray], n: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links of a cell that join its components, found with the exact threshold."""
    m = len(sets)
    root = list(range(m))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out: list[tuple[int, int]] = []

    def union(a: int, b: int) -> None:
        ra, rb = find(a), find(b)
        if ra != rb:
            root[max(ra, rb)] = min(ra, rb)
            out.append((a, b))

    if m <= 12:
        own = [set(s.tolist()) for s in sets]
        for a in range(m):
            for b in range(a + 1, m):
                if find(a) != find(b):
                    common = len(own[a] & own[b])
                    if 100 * common >= percent * (len(own[a]) + len(own[b]) - common):
                        union(a, b)
        return out
    lists, need = _Lists(sets), _tops(n, percent)
    todo = np.arange(m)
    step = max(1, min(64, 4_000_000 // m))
    while len(todo):
        q, todo = todo[:step], todo[step:]
        for a, b in zip(*np.nonzero(lists.search(q, need)), strict=True):
            union(int(q[a]), int(b))
        roots = np.array([find(x) for x in range(m)])
        largest = np.bincount(roots).argmax()
        todo = todo[roots[todo] != largest]
    return out


def link_counts(sets: list[np.ndarray], n: np.ndarray, side: np.ndarray, weight: np.ndarray, cell: int, percent: int) -> np.ndarray:
    """For each class of a cell the weight of the classes it links with, by the exact threshold; only pairs
    whose smallest common shingle is the cell's, and that belong to this group (side as in candidates)."""
    m = len(sets)
    out = np.zeros(m, np.int64)
    if m <= 12:
        own, at = [set(s.tolist()) for s in sets], side.tolist()
        for a in range(m):
            for b in range(a + 1, m):
                if _fits(at[a], at[b]):
                    both = own[a] & own[b]
                    if 100 * len(both) >= percent * (len(own[a]) + len(own[b]) - len(both)) and min(both) == cell:
                        out[a] += weight[b]
                        out[b] += weight[a]
        return out
    lists, need = _Lists(sets), _tops(n, percent)
    before = [s[: np.searchsorted(s, np.uint64(cell))] for s in sets]
    early = _Lists(before) if any(len(b) for b in before) else None
    # as many queries at a time as merge about 2 million places
    merged = np.where(lists.long | (lists.df < 2), 0, lists.df)[lists.token]
    work = np.concatenate(([0], np.cumsum(np.add.reduceat(merged, lists.start[:-1]))))
    step, low = max(1, min(256, 2_000_000 // m)), 0
    while low < m:
        high = min(m, low + step, max(low + 1, int(np.searchsorted(work, work[low] + 2_000_000, "right")) - 1))
        q, low = np.arange(low, high), high
        hit = lists.search(q, need)
        hit &= _apart(side[q], side)
        if early is not None and hit.any():
            hit &= ~early.search(q, lambda q: np.ones((len(q), m), np.int64))
        out[q] = hit @ weight
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of equal leading columns in sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy() for i in range(keys)]
        change = np.zeros(b.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            key = tuple(c[lo] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _arrays(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def classes_of(docs: DataFrame, k: int, percent: int, route: int | None, sketch: int | None, id_col: str, text_col: str) -> DataFrame:
    """One row per document: id, k1, k2, n, fp (fingerprint of the set), posted (hashes), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("shingles")
        for b in batches:
            n, fp, posted, sk = [], [], [], []
            for x in b.column(3).cast(pa.binary()):
                s = shingles(x.as_py(), k)
                n.append(len(s))
                fp.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                prefix = len(s) + percent * len(s) // -100 + 1 if len(s) else 0
                posted.append(s[: prefix if route is None else min(route, prefix)].view(np.int64))
                sk.append(s[:sketch].tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(posted, pa.list_(pa.int64())), pa.array(sk, pa.binary())],
                ["id", "k1", "k2", "n", "fp", "posted", "sketch"],
            )

    out = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(c, t) for c, t in (("k1", T.LongType()), ("k2", T.LongType()), ("n", T.LongType()), ("fp", T.BinaryType()), ("posted", T.ArrayType(T.LongType())), ("sketch", T.BinaryType())))])
    return docs.select(F.col(f"`{id_col}`").alias("id"), *row_keys(id_col, text_col), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, out)


def dealt(posted: DataFrame, percent: int, block: int, shingles: int | None, broadcast_rows: int) -> DataFrame:
    """posted(cell, place, fp, n, ...) with band, low, high, side: the groups that a row goes to. Cells of one class are
    gone. Large cells are at most a `block`th of the rows; their list is broadcast up to `broadcast_rows`."""
    names = [c for c in posted.columns if c != "cell"]
    weight = F.sum("n") if shingles else F.lit(0).cast("long")
    per_cell = stored(posted.groupBy("cell").agg(F.count(F.lit(1)).alias("df"), weight.alias("all")).filter("df > 1"), "cells")  # a table, so that the joins may split a hot cell
    large = (F.col("df") > block) | (F.col("all") > (shingles or 0)) if shingles else F.col("df") > block
    zero = F.lit(0)
    small = posted.join(per_cell.filter(~large).select("cell"), "cell").select("cell", zero.alias("band"), zero.alias("low"), zero.alias("high"), F.lit(2).alias("side"), *names)
    cut = per_cell.filter(large).select("cell")
    n_cut = cut.count()
    if not n_cut:
        return small
    spread = lambda df: F.broadcast(df) if n_cut <= broadcast_rows else df
    own = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + 1e-9).cast("int")  # sizes of two bands or more apart cannot link
    first = F.first(F.struct("place", "cell")).over(Window.partitionBy("fp").orderBy("place"))
    big = posted.join(spread(cut), "cell").withColumn("first", first)
    # Classes of this cell that share an earlier large cell: their pairs belong there or before, not here.
    big = big.withColumn("told", F.when(F.col("first.place") < F.col("place"), F.col("first.cell")))
    big = stored(big.withColumn("own", own).withColumn("band", F.explode(F.array("own", F.col("own") - 1))).drop("first").withColumn("above", F.col("own") != F.col("band")), "large")
    sized = big.groupBy("cell", "band", "above", "told").agg(F.count(F.lit(1)).alias("rows"), weight.alias("all"))
    sized = sized.withColumn("kind", F.when((F.col("rows") > block) | (F.col("all") > (shingles or 0)) if shingles else F.col("rows") > block, F.col("told")))
    kinds = stored(sized.groupBy("cell", "band", "above", "kind").agg(F.sum("rows").alias("rows"), F.sum("all").alias("all")), "kinds")
    parts = F.ceil(F.greatest(F.col("rows") / block, F.col("all") / (shingles or 1), F.lit(1))).cast("int")
    kinds = kinds.select("cell", "band", "above", "kind", parts.alias("parts"))
    each = F.transform("list", lambda x: F.transform(F.sequence(F.lit(0), x["parts"] - 1), lambda i: F.struct(x["above"].alias("above"), x["kind"].alias("kind"), i.alias("i"))))
    blocks = kinds.groupBy("cell", "band").agg(F.sort_array(F.collect_list(F.struct("above", "kind", "parts"))).alias("list")).select("cell", "band", "list", F.flatten(each).alias("blocks"))
    rows = big.join(spread(blocks), ["cell", "band"])
    # A row's kind is the large cell it was told of, if many rows were; the rest are one kind. Rows from the band above are apart.
    kind = F.when(F.exists("list", lambda x: (x["above"] == F.col("above")) & x["kind"].eqNullSafe(F.col("told"))), F.col("told"))
    rows = rows.withColumn("kind", kind)
    n_parts = F.get(F.filter("list", lambda x: (x["above"] == F.col("above")) & x["kind"].eqNullSafe(F.col("kind"))), F.lit(0))["parts"]
    rows = rows.withColumn("mine", F.array_position("blocks", F.struct(F.col("above").alias("above"), F.col("kind").alias("kind"), F.pmod(F.xxhash64("fp"), n_parts).cast("int").alias("i"))).cast("int"))
    to = F.array_compact(F.transform("blocks", lambda b, i: F.when(~(b["above"] & F.col("above")) & (F.col("kind").isNull() | b["kind"].isNull() | (b["kind"] != F.col("kind"))), i + 1)))
    rows = rows.withColumn("other", F.explode(to))
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1) + F.when(F.col("above"), 4).otherwise(0)
    return small.unionByName(rows.select("cell", "band", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), side.alias("side"), *names))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, route: int | None = 18, sketch: int | None = 64, block: int = 1024, block_shingles: int = 2_000_000, broadcast_rows: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text", count_links: bool = False) -> DataFrame:
    """id, row_key (128 bits of hash of id and text), n_shingles, component_id (smallest id of the component), class_id
    (smallest id with an equal set), first_key (of the component: its smallest id's smallest row_key);
    with count_links also n_links (the other rows that the row links with, those of its class included)."""
    ship(docs.sparkSession)
    rows = stored(classes_of(docs, k, percent, route, sketch, id_col, text_col), "sketches")
    key = F.struct("k1", "k2")
    found = rows.filter("n > 0")
    classes = stored(found.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", key.alias("row_key"))).alias("least"), F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"), F.first("posted").alias("posted"), F.first("sketch").alias("sketch")), "classes")
    posted = classes.select("fp", "n", F.posexplode("posted").alias("place", "cell"))  # of a class, in order of hashes
    keys = ["cell", "band", "low", "high"]
    entries = dealt(posted, percent, block, None, broadcast_rows).join(classes.select("fp", "sketch"), "fp").select(*keys, "side", "place", "n", "fp", "sketch")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("shingles")
        for t in _groups(batches, 4):
            if t.num_rows > 1:
                has = candidates(_arrays(t["sketch"], np.uint64), t["place"].to_numpy(), t["n"].to_numpy(), t["side"].to_numpy(), percent, sketch)
                if has.any():
                    yield from t.select(["cell", "place", "fp", "n"]).filter(pa.array(has)).combine_chunks().to_batches()

    kinds = "cell long, place int, fp binary, n long"
    hot = stored(entries.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(find, kinds).distinct(), "candidates")
    # Whole sets, of the classes that are left only, from one of their texts.
    left = hot.select("fp").distinct().join(classes.select("fp", F.col("least.row_key.k1").alias("l1"), F.col("least.row_key.k2").alias("l2")), "fp").select("l1", "l2").distinct()
    if left.count() <= broadcast_rows:  # 16 bytes a row
        left = F.broadcast(left)
    chosen = docs.select(*row_keys(id_col, text_col), F.col(f"`{text_col}`").alias("text")).join(left, (F.col("k1") == F.col("l1")) & (F.col("k2") == F.col("l2")), "left_semi")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("shingles")
        for b in batches:
            sets = [shingles(x.as_py(), k).tobytes() for x in b.column(0).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], ["fp", "set"])

    sets = chosen.select("text").mapInArrow(whole, "fp binary, set binary").groupBy("fp").agg(F.first("set").alias("set")).join(classes.select("fp", "rows"), "fp")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("shingles")
        for t in _groups(batches, 4):
            own = _arrays(t["set"], np.uint64)
            if len(own) < 2:
                continue
            n = np.array([len(x) for x in own], np.int64)
            pairs = links(own, n, percent)
            fp = t["fp"].combine_chunks()
            fp = fp.chunk(0) if isinstance(fp, pa.ChunkedArray) else fp
            if pairs:
                yield pa.RecordBatch.from_arrays([fp.take(pa.array([a for a, _ in pairs])), fp.take(pa.array([b for _, b in pairs])), pa.nulls(len(pairs), pa.int64())], ["a", "b", "n"])
            if count_links:
                cell = int(t["cell"][0].as_py()) & 0xFFFFFFFFFFFFFFFF
                counts = link_counts(own, n, t["side"].to_numpy(), t["rows"].to_numpy(), cell, percent)
                yield pa.RecordBatch.from_arrays([fp, pa.nulls(len(own), pa.binary()), pa.array(counts, pa.int64())], ["a", "b", "n"])

    solved = dealt(hot, percent, block, block_shingles, broadcast_rows).join(sets, "fp").select(*keys, "side", "fp", "set", "rows").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(solve, "a binary, b binary, n long")
    solved = stored(solved, "solved") if count_links else solved
    edges = solved.filter("b is not null").select("a", "b")
    roots = components(edges)
    known = classes.select("fp", "least").join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    first = known.groupBy("root").agg(F.min("least").alias("first"))
    known = known.join(first, "root").select("fp", F.col("least.id").alias("class_id"), F.col("first.id").alias("component_id"), F.col("first.row_key").alias("first_key"))
    if count_links:
        counted = solved.filter("b is null").groupBy(F.col("a").alias("fp")).agg(F.sum("n").alias("linked"))
        per_class = classes.select("fp", "rows").join(counted, "fp", "left")
        known = known.join(per_class.select("fp", (F.coalesce("linked", F.lit(0)) + F.col("rows") - 1).alias("n_links")), "fp")
    out = rows.select("id", key.alias("row_key"), "n", "fp").join(known, "fp", "left")
    alone = F.col("n") == 0
    return out.select(
        F.col("id").alias(id_col), "row_key", F.col("n").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.col("row_key")).otherwise(F.col("first_key")).alias("first_key"),
        *([F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links")] if count_links else []),
    )
