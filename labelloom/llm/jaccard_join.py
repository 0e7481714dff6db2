"""Operator 5, n-gram Jaccard join with signature trees.

1. Every text becomes its set of word shingles, as 64-bit hashes. Per row stay its size, a fingerprint of the
   set, a bitmap that each shingle sets one bit of, and the head of the set: its first shingles in one order of all
   shingles, as many as two similar sets cannot both spare. Rows with one fingerprint are one class; its smallest
   doc_id stands for it, so copies cost a row each, no pairs.
2. The root of the trees has a child for each shingle: the sets with it in their heads. Two similar sets have a
   head's shingle in common, so they meet under one child at least; none is missed. The order puts shingles that many
   heads hold behind all others, so that a passage or line of many documents gathers few of them under a child.
3. Below, nodes hold the OR of their bitmaps and their range of sizes. Children of over ``GROUP`` sets are cut into
   nodes by size; their pairs are dropped or kept in a join of the table of nodes. Within a pair of nodes a task goes
   down both trees at once. A pair of nodes is dropped if its largest possible overlap is too small, its sizes are
   too far apart, or it is one component already.
4. The first descent returns no more pairs than join a child's sets to each other; they are checked by exact shingles
   and give components. The second descent, over children that still hold several components, returns every pair
   of sets that is left, for the same check. Pairs of large sets, which fill the trees' bitmaps, pass a wider one first. So copies with small changes take pairs in proportion to their number.

Nothing of all documents reaches the driver; joins on ids and keys are sort-merge joins, which adaptive execution
splits where a key is hot, or broadcasts behind a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, forget, in_arrow, quoted, settle, sized, slices, table, written
from .components import components

SHINGLE, SIMILARITY = 5, (3, 4)
#: Bits of the trees' bitmaps; sets of over WIDE shingles, which fill those, also have one of half a bit to a bit a shingle.
BITS, WIDE = 2048, 1536
#: Sets of a node that one task descends from, and children of a node below it.
GROUP, FAN = 1024, 16
#: A shingle in more heads than HOT goes behind the others, the most frequent MAX_HOT of them (8 MB); any choice gives the same links.
HOT, MAX_HOT = 256, 1_000_000
#: Bits of the map that tells which shingles may stand in two heads (8 MB); fewer let more through to the join that decides.
FILTER = 1 << 26

_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, 65)], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; a bijection."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; a text of fewer words is one shingle, one without words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(size, len(words))
    total = np.full(len(h) - k + 1, len(words) if len(words) < size else 0, dtype=np.uint64)
    for j in range(k):
        total += h[j : len(h) - k + 1 + j] * _POWERS[j]
    return np.unique(_mix(total))


def head(tokens: np.ndarray, hot: np.ndarray | None = None) -> np.ndarray:
    """The first shingles of a set, by hash, those of the sorted ``hot`` behind all others.

    A set of n shingles overlaps with a similar one in at least SIMILARITY * n of them, so it can spare all but the head
    of the rest and one: were two heads apart, the smaller rest could not hold the whole overlap.
    """
    num, den = SIMILARITY
    if hot is not None and len(hot) and len(tokens):
        common = hot[np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)] == tokens
        tokens = np.concatenate([tokens[~common], tokens[common]])
    return tokens[: len(tokens) + num * len(tokens) // -den + 1] if len(tokens) else tokens


def bitmap(tokens: np.ndarray, size: int = BITS) -> np.ndarray:
    bits = np.zeros(size, dtype=np.uint8)
    bits[(tokens & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def wide_bitmap(tokens: np.ndarray) -> bytes | None:
    """Of as many bits as the next power of two; of two such bitmaps the larger, its halves laid over each other, has the smaller one's bits."""
    return bitmap(tokens, 1 << len(tokens).bit_length()).tobytes() if len(tokens) > WIDE else None


def enough(common, a, b):
    """Whether an overlap of ``common`` makes sets of sizes a and b similar."""
    num, den = SIMILARITY
    return den * common >= num * (a + b - common)


def needed(total: np.ndarray) -> np.ndarray:
    """The least overlap with which sets of so many shingles together are similar."""
    num, den = SIMILARITY
    return -(-num * total // (num + den))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    """A column of lists of longs from arrays."""
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*rows, np.zeros(0, np.uint64)]).view(np.int64)))


def sets(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n, hi, lo (fingerprint), head, sig (bitmap), wide (bitmap of large sets). Empty sets have no head."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            tokens = [shingles(text) for text in b.column(1).to_pylist()]
            marks = np.array([np.frombuffer(xxhash.xxh3_128_digest(t.tobytes()), dtype="<i8") for t in tokens], dtype=np.int64).reshape(-1, 2)
            sig = [bitmap(t).view(np.uint64) for t in tokens]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n": pa.array([len(t) for t in tokens], pa.int64()), "hi": marks[:, 0].copy(), "lo": marks[:, 1].copy(), "head": _lists([head(t) for t in tokens]), "sig": _lists(sig), "wide": pa.array([wide_bitmap(t) for t in tokens], pa.binary())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return in_arrow(rows, measure, "doc_id long, n long, hi long, lo long, head array<long>, sig array<long>, wide binary")


def _bits(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).view(np.uint64).reshape(len(column), BITS // 64)


def may_link(na, sa, nb, sb) -> np.ndarray:
    """False where bitmaps or sizes show that sets can't be similar: each bit in one map alone is a shingle of one set alone."""
    num, den = SIMILARITY
    apart = np.bitwise_count(sa ^ sb).sum(axis=-1, dtype=np.int64)
    total = na + nb
    return (total - apart >= 2 * needed(total)) & (num * np.maximum(na, nb) <= den * np.minimum(na, nb))


def _near(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) but those of large sets whose wide bitmaps differ too much, written."""
    side = lambda k: reps.where("wide is not null").select(F.col("rep").alias(k), F.col("n").alias(f"n{k}"), F.col("wide").alias(f"w{k}")).hint("merge")
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").select("a", "b", "na", "nb", "wa", "wb")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ok = []
            for na, nb, p, q in zip(*(x.column(k).to_pylist() for k in range(2, 6)), strict=True):
                if p is None or q is None:
                    ok.append(True)
                    continue
                a, b = (np.frombuffer(y, np.uint64) for y in (p, q))
                while len(a) != len(b):
                    a, b = sorted((a, b), key=len)
                    b = b[: len(b) // 2] | b[len(b) // 2 :]
                ok.append(bool(na + nb - np.bitwise_count(a ^ b).sum(dtype=np.int64) >= 2 * needed(na + nb)))
            yield x.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return written(in_arrow(both, keep, "a long, b long"), "near")


def _texts(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, text of the ``ids``, a row an id: of rows that share a doc_id any of the largest text stands for it.

    Only texts of ids that several rows have are shuffled to be compared.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sized(ids), "doc_id", "left_semi")
    twice = written(rows.groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    if not twice.head(1):
        return rows
    several = rows.join(sized(twice), "doc_id", "left_semi").groupBy("doc_id").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("text"))
    return rows.join(sized(twice), "doc_id", "left_anti").unionByName(several)


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of doc_ids that are linked, by exact shingles of the whole texts."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_pydict({"id": b.column(0), "t": pa.array([shingles(x).tobytes() for x in b.column(1).to_pylist()], pa.binary())})

    known = written(in_arrow(_texts(ids, docs), tokens, "id long, t binary"), "tokens")
    side = lambda k: known.select(F.col("id").alias(k), F.col("t").alias(f"t{k}")).hint("merge")
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices(batches):
            ok = []
            for p, q in zip(x.column(2).to_pylist(), x.column(3).to_pylist(), strict=True):
                a, b = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                ok.append(bool(enough(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b))))
            yield x.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    out = written(in_arrow(both, check, "a long, b long"), "links")
    for done in (ids, known):
        forget(done)
    return out


class Tree:
    """A signature tree over rows of one node: levels from the rows up, FAN children to a node, ``height`` levels at least."""

    def __init__(self, label: np.ndarray, n: np.ndarray, sig: np.ndarray, height: int = 1):
        excess = n - np.bitwise_count(sig).sum(axis=1, dtype=np.int64)
        # low, high: sizes; more: shingles beyond one a bit; one: the only component of the node, or -1 for several.
        self.levels = [{"low": n, "high": n, "more": excess, "sig": sig, "one": label}]
        while len(self.levels[-1]["low"]) > FAN or len(self.levels) < height:
            x = self.levels[-1]
            cut = np.arange(0, len(x["low"]), FAN)
            low, high = np.minimum.reduceat(x["one"], cut), np.maximum.reduceat(x["one"], cut)
            self.levels.append({"low": np.minimum.reduceat(x["low"], cut), "high": np.maximum.reduceat(x["high"], cut), "more": np.maximum.reduceat(x["more"], cut), "sig": np.bitwise_or.reduceat(x["sig"], cut, axis=0), "one": np.where(low == high, low, -1)})


def _open(x: dict, y: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether nodes i of a level and j of another tree's level can hold a similar pair of two components."""
    num, den = SIMILARITY
    common = np.bitwise_count(x["sig"][i] & y["sig"][j]).sum(axis=1, dtype=np.int64) + np.minimum(x["more"][i], y["more"][j])
    most = np.minimum(common, np.minimum(x["high"][i], y["high"][j]))
    fits = (num * x["low"][i] <= den * y["high"][j]) & (num * y["low"][j] <= den * x["high"][i])
    return fits & (most >= needed(x["low"][i] + y["low"][j])) & ((x["one"][i] != y["one"][j]) | (x["one"][i] < 0))


def tree_pairs(one: Tree, two: Tree) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of two trees of one height that no bound rules out, in parts; for a tree and itself each pair once."""
    top, same = len(one.levels) - 1, one is two
    i, j = (x.ravel() for x in np.indices((len(one.levels[top]["low"]), len(two.levels[top]["low"]))))
    stack = [(top, i[i <= j], j[i <= j]) if same else (top, i, j)]
    while stack:
        level, i, j = stack.pop()
        if len(i) > 1 << 14:
            half = len(i) // 2
            stack += [(level, i[half:], j[half:]), (level, i[:half], j[:half])]
            continue
        x, y = one.levels[level], two.levels[level]
        go = _open(x, y, i, j)
        i, j = i[go], j[go]
        if not level:
            ok = may_link(x["low"][i], x["sig"][i], y["low"][j], y["sig"][j]) & ((i < j) if same else True)
            if ok.any():
                yield i[ok], j[ok]
            continue
        step = np.arange(FAN)
        ci = np.repeat(i[:, None] * FAN + step, FAN, axis=1).ravel()
        cj = np.tile(j[:, None] * FAN + step, (1, FAN)).ravel()
        ok = (ci < len(one.levels[level - 1]["low"])) & (cj < len(two.levels[level - 1]["low"]))
        if same:
            ok &= ci <= cj
        stack.append((level - 1, ci[ok], cj[ok]))


def joining_pairs(rep: np.ndarray, n: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Of the pairs of a node's rows that no bound rules out as many as join them, and whether they are all of them.

    The row of the smallest id comes with all that it reaches, then a forest of the rest.
    """
    root = int(np.argmin(rep))
    near = np.flatnonzero(may_link(n[root], sig[root], n, sig))
    near = near[near != root]
    up = np.arange(len(n))
    up[near] = root
    got, whole = [(root, x) for x in near.tolist()], len(near) < 2

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    if len(near) < len(n) - 1:
        order = np.lexsort((n, up))
        tree = Tree(up[order], n[order], sig[order])
        for i, j in tree_pairs(tree, tree):
            for a, b in zip(order[i].tolist(), order[j].tolist(), strict=True):
                x, y = find(a), find(b)
                whole &= x != y
                if x != y:
                    up[max(x, y)] = min(x, y)
                    got.append((a, b))
    pairs = np.array(got, dtype=np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1], whole


def _descend(rows: DataFrame, every: bool) -> DataFrame:
    """a, b, key from the trees over each (key, p, q) of rows key, p, q, side, rep, label, n, sig, written.

    Rows a, b are every pair, or those that join rows; in the second case a row with a key says that pairs of it are left.
    """

    def pairs(t: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        rep, side, label, n, sig = np.asarray(t.column("rep")), np.asarray(t.column("side")), np.asarray(t.column("label")), np.asarray(t.column("n")), _bits(t.column("sig"))
        if not every:
            i, j, whole = joining_pairs(rep, n, sig)
            yield rep[i], rep[j], whole
            return
        k = int((side == 0).sum())
        if k == len(rep):
            one = two = Tree(label, n, sig)
        else:
            height = max(len(Tree(label[x], n[x], sig[x]).levels) for x in (slice(0, k), slice(k, None)))
            one, two = (Tree(label[x], n[x], sig[x], height) for x in (slice(0, k), slice(k, None)))
        first = 0 if one is two else k
        yield from ((rep[i], rep[j + first], True) for i, j in tree_pairs(one, two))

    names = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64())])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            if t.num_rows > 1:
                for a, b, whole in pairs(t):
                    if not whole:
                        yield pa.RecordBatch.from_pydict({"a": [None], "b": [None], "key": t.column("key").slice(0, 1)}, names)
                    if len(a):
                        yield pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b), "key": pa.nulls(len(a), pa.int64())}, names)

        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.stack([np.asarray(batch.column(k)) for k in ("key", "p", "q")], axis=1).astype(np.int64)
            cut = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1).tolist(), len(ids)]
            for a, b in zip(cut, cut[1:], strict=False):
                if held and tuple(ids[a]) != last:
                    yield from done(held)
                    held = []
                held.append(batch.slice(a, b - a))
                last = tuple(ids[a])
        if held:
            yield from done(held)

    columns = ["key", "p", "q", "side", "rep", "label", "n", "sig"]
    ordered = rows.select(columns).repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "side", "label", "n", "rep")
    return written(in_arrow(ordered, grow, "a long, b long, key long").where("key is not null or a <> b").distinct(), "near")


def _hot(counts: DataFrame) -> DataFrame | None:
    """key: the shingles in the most heads, those of over HOT, or of over as many as leave MAX_HOT at most; None if there are none."""
    power = F.floor(F.log2("c")).cast("int").alias("power")
    by_power = sorted(counts.where(F.col("c") > HOT).groupBy(power).count().collect(), reverse=True)  # a row a power of two
    taken, least = 0, None
    for p, k in by_power:
        taken += k
        if taken > MAX_HOT:
            break
        least = p
    return None if least is None else counts.where((F.col("c") > HOT) & (power >= least)).select("key")


def _reordered(reps: DataFrame, keys: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rep, n, head, sig of the rows of ``reps`` with a shingle of ``keys`` in their heads, with heads in the order that has those last; and the ids of such rows."""
    ids = written(reps.select("rep", F.explode("head").alias("key")).join(F.broadcast(keys), "key", "left_semi").select(F.col("rep").alias("doc_id")).distinct(), "hot")
    hot = np.sort(keys.toArrow().column("key").to_numpy().astype(np.int64).view(np.uint64))
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            tokens = [shingles(text) for text in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"rep": b.column(0), "n": pa.array([len(t) for t in tokens], pa.int64()), "head": _lists([head(t, shared.value) for t in tokens]), "sig": _lists([bitmap(t).view(np.uint64) for t in tokens]), "wide": pa.array([wide_bitmap(t) for t in tokens], pa.binary())})

    return written(in_arrow(_texts(ids, docs), measure, "rep long, n long, head array<long>, sig array<long>, wide binary"), "heads"), ids


def may_meet(reps: DataFrame, keys: DataFrame) -> DataFrame:
    """rep, key of the shingles in heads whose bit is set in a map of ``keys``: all that are among them and few others.

    Most shingles stand in one head alone; those are not to be shuffled to a join only to be dropped there.
    """
    bit = F.col("key").bitwiseAND(F.lit(FILTER - 1))
    words = keys.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(key & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(FILTER // 64, dtype=np.uint64)
    bits[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    shared = reps.sparkSession.sparkContext.broadcast(bits)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads = b.column(1)
            key = np.asarray(heads.flatten()).view(np.uint64)
            rep = np.repeat(np.asarray(b.column(0)), np.asarray(heads.value_lengths()))
            on = (shared.value[((key & np.uint64(FILTER - 1)) >> np.uint64(6)).astype(np.int64)] >> (key & np.uint64(63)) & np.uint64(1)).astype(bool)
            yield pa.RecordBatch.from_pydict({"rep": rep[on], "key": key[on].view(np.int64)})

    return in_arrow(reps.select("rep", "head"), keep, "rep long, key long")


def children(reps: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """key, rep, c of the root's children that hold two sets or more, one child for all with the same sets; and rep, n, sig, wide of the sets."""
    heads = lambda r: r.select("rep", F.explode("head").alias("key"))
    counted = lambda r: written(heads(r).groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "counts")
    counts = counted(reps)
    hot = _hot(counts)
    if hot is not None:
        late, ids = _reordered(reps, hot, docs)
        cold = reps.join(sized(ids.withColumnRenamed("doc_id", "rep")), "rep", "left_anti").select("rep", "n", "head", "sig", "wide")
        reps = cold.unionByName(late)
        settle(reps.sparkSession)
        counts = counted(reps)
        settle(reps.sparkSession)
    keys = counts.select("key")
    if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        met = heads(reps).join(F.broadcast(keys), "key", "left_semi")
    else:
        met = may_meet(reps, keys).join(keys.hint("merge"), "key", "left_semi")
    if reps.groupBy("rep").count().where("count > 1").head(1):
        met = met.distinct()  # an id of several texts stands once under a child
    met = written(met, "met")
    # Children with the same sets have the same count and sums of hashes: one of them stands for all.
    marks = met.groupBy("key").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "rep")).alias("y")).where("c > 1")
    own = written(marks.groupBy("c", "x", "y").agg(F.min("key").alias("key")).select("key", "c"), "own")
    out = written(met.join(sized(own), "key"), "children")
    for done in (met, own, counts):
        forget(done)
    settle(reps.sparkSession)
    return out, reps.select("rep", "n", "sig", "wide")


def _nodes(rows: DataFrame) -> DataFrame:
    """rows with ``node``: a child of up to GROUP sets is one node; a larger one is cut by size, and by hash where many have one size."""
    num, den = SIMILARITY
    small = rows.where(F.col("c") <= GROUP).withColumn("node", F.lit(0).cast("long"))
    size = F.floor(F.ln("n") / F.lit(float(np.log(den / num)))).cast("long")
    large = rows.where(F.col("c") > GROUP).withColumn("size", size)
    counted = written(large.groupBy("key", "size").agg(F.count("*").alias("m")), "sizes")
    large = large.join(counted.hint("merge"), ["key", "size"])
    part = F.pmod(F.xxhash64("rep"), F.ceil(F.col("m") / GROUP).cast("long"))
    return small.unionByName(large.withColumn("node", F.shiftleft(F.col("size") + 1, 40) + part).drop("size", "m"))


def _size_class(node: str) -> Column:
    return F.shiftright(node, 40)


def _node_pairs(rows: DataFrame) -> DataFrame:
    """key, p, q of the pairs of nodes of a child that can hold a similar pair of two components, by their bitmaps, sizes and components."""
    num, den = SIMILARITY
    word = lambda k: F.bit_or(F.get("sig", F.lit(k)))
    ones = F.aggregate("sig", F.lit(0), lambda acc, x: acc + F.bit_count(x))
    nodes = rows.groupBy("key", "node").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("label").alias("l"), F.max("label").alias("m"), F.max(F.col("n") - ones).alias("more"), F.array(*[word(k) for k in range(BITS // 64)]).alias("sig"))
    nodes = written(nodes, "nodes")
    a, b = nodes.alias("a"), nodes.alias("b")
    both = a.join(b.hint("merge"), (F.col("a.key") == F.col("b.key")) & (F.col("a.node") <= F.col("b.node")) & (_size_class("b.node") - _size_class("a.node") <= 2))
    common = F.aggregate(F.zip_with("a.sig", "b.sig", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda acc, x: acc + x) + F.least("a.more", "b.more")
    most = F.least(common, "a.high", "b.high")
    fits = (num * F.col("a.low") <= den * F.col("b.high")) & (num * F.col("b.low") <= den * F.col("a.high"))
    several = F.least("a.l", "b.l") < F.greatest("a.m", "b.m")
    return both.where(fits & several & ((num + den) * most >= num * (F.col("a.low") + F.col("b.low")))).select(F.col("a.key").alias("key"), F.col("a.node").alias("p"), F.col("b.node").alias("q"))


def similar(reps: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b: links between the sets of ``reps`` (rep, n, head, sig, wide) that give the components of all links."""
    under, known = children(reps, docs)
    sigs = known.select("rep", "n", "sig")
    rows = under.join(sigs.hint("merge"), "rep")
    first = _nodes(rows).select("key", F.col("node").alias("p"), F.col("node").alias("q"), F.lit(0).alias("side"), "rep", F.col("rep").alias("label"), "n", "sig")
    near = _descend(first, every=False)
    pairs = written(near.where("key is null").select("a", "b"), "near")
    links = _verified(_near(pairs, known), docs)
    settle(docs.sparkSession)

    # Left are children of several components of which not all pairs were returned.
    label = components(links).withColumnRenamed("node", "rep")
    some = near.where("key is not null").select("key").unionByName(under.where(F.col("c") > GROUP).select("key")).distinct()
    told = under.join(written(some, "some").hint("merge"), "key", "left_semi").join(label.hint("merge"), "rep", "left")
    told = written(told.withColumn("label", F.coalesce("label", "rep")), "told")
    open_ = told.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    left = told.join(written(open_, "open").hint("merge"), "key", "left_semi").join(sigs.hint("merge"), "rep")
    left = written(_nodes(left), "left")
    nodes = written(_node_pairs(left), "pairs")
    one = left.join(nodes.withColumn("node", F.col("p")).hint("merge"), ["key", "node"]).withColumn("side", F.lit(0))
    two = left.join(nodes.where("p <> q").withColumn("node", F.col("q")).hint("merge"), ["key", "node"]).withColumn("side", F.lit(1))
    rest = _descend(one.unionByName(two), every=True).select("a", "b").join(pairs.hint("merge"), ["a", "b"], "left_anti")
    out = links.unionByName(_verified(_near(rest, known), docs))
    for done in (told, left, near, pairs):
        forget(done)
    settle(docs.sparkSession)
    return out


def jaccard_components(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id that links reach).

    Null and empty texts have an empty set and are linked with nothing. Rows that repeat a doc_id are one node of
    the links; each is returned with the size of its own set. A row without doc_id takes the component of rows with
    its very set, or null. An empty table gives no rows. Columns other than doc_id and text are not read.
    """
    rows = written(sets(docs), "sets")
    reps = rows.where("n > 0 and doc_id is not null").groupBy("hi", "lo", "n").agg(F.min("doc_id").alias("rep"), F.first("head").alias("head"), F.first("sig").alias("sig"), F.first("wide").alias("wide"))
    reps = written(reps, "reps")
    ids = written(rows.select("doc_id", "n", "hi", "lo"), "ids")
    forget(rows)
    settle(docs.sparkSession)
    final = components(similar(reps, docs)).withColumnRenamed("node", "rep")
    named = reps.select("hi", "lo", "n", "rep").join(final.hint("merge"), "rep", "left").select("hi", "lo", "n", F.coalesce("label", "rep").alias("label"))
    # Copies of one set are many rows of one key: a written table of names is a side to whose rows they can be joined in parts.
    out = ids.join(written(named, "named").hint("merge"), ["hi", "lo", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose component has a smaller doc_id, or that repeat a doc_id; rows without doc_id stay. Same columns."""
    told = written(jaccard_components(docs).select("doc_id", "component_id"), "components")
    gone = written(told.where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    twice = written(told.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "twice")
    rows = docs.join(sized(gone), "doc_id", "left_anti").select(quoted(docs.columns))
    if not twice.head(1):
        return rows
    once = rows.join(sized(twice), "doc_id", "left_anti").select(quoted(docs.columns))
    return once.unionByName(rows.join(sized(twice), "doc_id", "left_semi").select(quoted(docs.columns)).dropDuplicates(["doc_id"]))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
