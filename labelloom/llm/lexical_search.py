"""Operator 12, ranked lexical search: term-at-a-time for short lists, document-at-a-time over long ones.

A first pass over whole texts writes what the items' terms have in each document; the corpus's counts (N, L, df) are
aggregations of that table. A second pass ranks it: a task takes its documents in blocks, inverts a block into lists by
term and takes each item in turn. The item's short lists are summed term at a time into accumulators. The accumulators
then are one iterator with a bound, their largest sum, beside the long lists with theirs. Document at a time, only
iterators that can lift a document into the ten best propose documents; the others are skipped to the proposed ones, from
the largest bound to the smallest, and a document goes as soon as its sum and the bounds left cannot reach the tenth
score. That score rises from block to block of a task. A task gives ten documents an item, Spark the ten best of all.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_arrow, slices, table, written

#: Characters of items that are ranked together (their terms are sent to every task); more items take more passes.
ITEM_CHARS = 8_000_000
#: Documents that are inverted at once, and the share of them from which a list is long.
BLOCK, LONG = 32_768, 1 / 16
TOP = 10
#: Lower-cases A-Z and turns every other ASCII sign that is no digit or letter into a blank.
_FOLD = bytes(ord(chr(c).lower()) if c >= 128 or chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))


def terms(raw: bytes) -> list[bytes]:
    """The terms of a UTF-8 text: maximal runs of digits, letters and signs beyond ASCII."""
    return raw.translate(_FOLD).split()


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), terms and tfs (the vocabulary's terms there and how often) of documents with terms."""

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.get
        for b in slices(batches):
            ids, n, ends, ks, tfs = [], [], [0], [], []
            for doc_id, raw in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = terms(raw or b"")
                if words:
                    found = Counter(filter(None, map(number, words)))
                    ids.append(doc_id)
                    n.append(len(words))
                    ks += found.keys()
                    tfs += found.values()
                    ends.append(len(ks))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (ks, tfs)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_arrow(rows, invert, "doc_id long, n long, terms array<int>, tfs array<int>")


class Block:
    """The lists of some documents by term, with each posting's part of a score."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, sizes: np.ndarray, ks: np.ndarray, tfs: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        self.ids = ids
        m = 25 + (75 * n * n_docs) // n_terms
        doc = np.repeat(np.arange(len(ids)), sizes)
        order = np.argsort(ks, kind="stable")
        ks, self.doc = ks[order], doc[order]
        tf = tfs[order].astype(np.int64)
        self.part = weights[ks] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[self.doc]))
        self.at = np.searchsorted(ks, np.arange(len(weights) + 1))

    def rank(self, item: dict[int, int], least: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of documents that may be among the item's best: all whose score is ``least`` or more, and is among the block's ten highest or tied with them."""
        lists = sorted((self.at[k + 1] - self.at[k], k) for k in item if self.at[k + 1] > self.at[k])
        sums = np.zeros(len(self.ids), np.int64)
        iterators = []
        for size, k in lists:
            own = slice(self.at[k], self.at[k + 1])
            if size <= LONG * len(self.ids):
                sums[self.doc[own]] += item[k] * self.part[own]
            else:
                iterators.append((int(self.part[own].max()) * item[k], self.doc[own], self.part[own] * item[k]))
        held = np.flatnonzero(sums)
        if len(held):
            iterators.append((int(sums.max()), held, sums[held]))
        if not iterators:
            return held, sums[held]
        # Sums of short lists and parts of single long lists are scores at least: the tenth highest of either is a floor.
        least = max([least, *(int(np.partition(p, -TOP)[-TOP]) for _, _, p in iterators if len(p) >= TOP)])
        iterators.sort(key=lambda x: x[0])
        reach = np.cumsum([x[0] for x in iterators])  # what iterators 0 to k can give together
        lead = int(np.searchsorted(reach, least))  # those before it cannot lift a document to the floor
        total = np.zeros(len(self.ids), np.int64)
        for _, doc, part in iterators[lead:]:
            total[doc] += part
        docs = np.flatnonzero(total)
        total = total[docs]
        for k in range(lead - 1, -1, -1):
            left = total + reach[k] >= least
            docs, total = docs[left], total[left]
            if not len(docs):
                break
            _, doc, part = iterators[k]
            place = np.minimum(np.searchsorted(doc, docs), len(doc) - 1)
            total += np.where(doc[place] == docs, part[place], 0)
            if len(total) >= TOP:
                least = max(least, int(np.partition(total, -TOP)[-TOP]))
        left = total >= max(least, 1)
        return docs[left], total[left]


def ranked(lists: DataFrame, items: list[tuple], weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """item (its number), doc_id, score: the ten best documents of each task. ``items``: (item_id, {term: times})."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, float, int | None]]] = [[] for _ in items]
        waiting, held = [], 0

        def take() -> None:
            b = pa.Table.from_batches(waiting).combine_chunks()
            col = lambda k: b.column(k).combine_chunks() if isinstance(b.column(k), pa.ChunkedArray) else b.column(k)
            ks, tfs = col(2), col(3)
            sizes = np.diff(ks.offsets.to_numpy())
            no_id = np.asarray(col(0).is_null())
            ids = np.asarray(col(0).fill_null(0))
            block = Block(ids, col(1).to_numpy(), sizes, ks.flatten().to_numpy(), tfs.flatten().to_numpy(), weights, n_docs, n_terms)
            for i, (_, wanted) in enumerate(items):
                own = best[i]
                docs, scores = block.rank(wanted, -own[-1][0] if len(own) == TOP else 1)
                if len(docs):
                    own += zip((-scores).tolist(), no_id[docs].tolist(), ids[docs].tolist(), strict=True)
                    own.sort()
                    del own[TOP:]

        for b in batches:
            waiting.append(b)
            held += b.num_rows
            if held >= BLOCK:
                take()
                waiting, held = [], 0
        if held:
            take()
        rows = [(i, None if no_id else doc_id, -low) for i, own in enumerate(best) for low, no_id, doc_id in own]
        i, doc_id, score = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(doc_id, pa.int64()), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return in_arrow(lists, search, "item int, doc_id long, score long")


def _search(docs: DataFrame, items: list[tuple]) -> DataFrame:
    """The ten best documents of items that fit one pass: (item_id, Counter of terms)."""
    spark = docs.sparkSession
    number: dict[bytes, int] = {}
    for _, wanted in items:
        for t in wanted:
            number.setdefault(t, len(number) + 1)  # 0 is no term's: filter(None, ...) drops it
    lists = written(postings(docs, number), "postings")
    n_docs, n_terms = lists.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(number) + 1, np.int64)
    for k, n in lists.select(F.explode("terms").alias("k")).groupBy("k").count().collect():  # a row a term of the items
        df[k] = n
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(n) + 1))) for n in df], np.int64)
    numbered = [(item_id, {number[t]: n for t, n in wanted.items()}) for item_id, wanted in items]
    found = ranked(lists, numbered, weights, n_docs, max(1, n_terms))
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = found.withColumn("rank", place).where(F.col("rank") <= TOP)
    ids = spark.createDataFrame([(k, item_id) for k, (item_id, _) in enumerate(items)], "item int, item_id long")
    return best.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score: for each item the ten documents with the highest scores above 0, ties by doc_id.

    Null and empty texts have no terms, on either side; an item without terms, or whose terms stand nowhere, has no
    rows. Rows of ``benchmark`` that repeat an item_id are one item with all their terms. Rows of ``docs`` that repeat a
    doc_id are documents of their own; those without a doc_id come last among ties. Texts of any length count whole, and
    columns other than ids and texts are not read. Items of more than ``ITEM_CHARS`` characters take several passes.
    """
    texts = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    chars = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    passes = max(1, math.ceil(chars / ITEM_CHARS))
    out = None
    for k in range(passes):
        wanted: dict[int | None, Counter] = {}
        for item_id, text in texts.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k).collect():  # about ITEM_CHARS characters
            wanted.setdefault(item_id, Counter()).update(terms(text.encode("utf-8", "surrogatepass")))
        part = _search(docs, sorted(wanted.items(), key=lambda x: (x[0] is None, x[0] or 0)))
        out = part if out is None else out.unionByName(part)
    return out


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
tf AS (SELECT doc_id, t, count(*) AS tf FROM words GROUP BY 1, 2),
n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY 1),
c AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM n),
i AS (SELECT item_id, t, count(*) AS q FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY 1, 2),
w AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM tf WHERE t IN (SELECT t FROM i) GROUP BY 1), c),
s AS (SELECT i.item_id, tf.doc_id, CAST(sum(i.q * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (25 + (75 * n.n * c.n_docs) // c.n_terms)))) AS BIGINT) AS score
  FROM i JOIN w ON i.t = w.t JOIN tf ON tf.t = i.t JOIN n ON n.doc_id = tf.doc_id, c GROUP BY 1, 2)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM s WHERE score > 0) WHERE r <= 10
"""
