"""Ranked lexical search over a K2-treap of the term-document grid.

The documents are indexed in blocks (document ranges).  A block is a grid: its
rows are the terms of the block, frequent ones first, its columns the documents
by id, and a cell holds the impact of a term in a document.  The grid is cut
into four quadrants again and again; every quadrant that is not empty is a node
with the largest impact inside.  The nodes stand level by level: four bits say
which children a node has (:class:`Treap`), a child's maximum is stored as its
distance from the parent's, in byte planes.

A search follows the rows of an item's terms down together.  A state is a range
of documents with one node per row, those whose quadrants hold the row and the
range; the weighted sum of their maxima bounds the score of every document
there.  The states with the best bounds are split first, some at a time; one
column is a document with its score.  States whose bound is below the k-th best
score so far, in this block or in earlier ones of the same task, are dropped.
Nothing is approximate.

Passes: (1) documents and terms of the corpus are counted, since impacts depend
on the average length; (2) every partition writes its blocks to the shared
folder, a block as a few compressed byte strings: the JVM never holds its terms
as values, and a worker holds the numbers of its words, not its texts; (3) the
document frequencies of the items' terms are summed from the lists kept in the
blocks, which a worker hands on some at a time; (4) the items, in blocks of a
bounded number of terms, are sent to the index, one block of items after the
other.  A task keeps at most k documents an item; the best k of all tasks are
ranked by a limited window, which pre-selects in every task.

Defined results: null and wordless texts have no terms; null and wordless items
have no result; repeated items are ranked each on their own, repeated documents
are results each; equal scores by ascending id, null ids last; empty tables give
no rows.  Only the columns named are used.
"""

from __future__ import annotations

import contextlib
import heapq
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import Scratch, give_back, stored
from .decontaminate import words

#: Documents of a block (columns of its grid), and bytes of text.
BLOCK_DOCS = 1 << 12
BLOCK_BYTES = 1 << 24
#: Terms of the items that are searched for in one pass.
QUERY_TERMS = 200_000
#: Cells looked at in one step of a search.
STEP_CELLS = 1 << 12
#: Terms with their frequencies that a worker hands on at once.
LIST_ROWS = 1 << 14
#: Bytes of a row group of the index: a block or two.
INDEX_GROUP = 1 << 23

#: Fixed values of the contract: words, and the constants of the impact.
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SCALE, _TF, _LENGTH = 1_000_000_000, 1000, 12
_PLAIN, _SLOPE = 100, 25

#: Byte strings are compressed (:func:`packed`): ids (those of the last ``unnamed``
#: documents are null), terms one after the other, their lengths and frequencies.
_INDEX = ("docs binary, unnamed int, terms binary, lengths binary, df binary, height int, children binary, maxima binary")
#: Children before one of the four places, for each set of children.
_BEFORE = np.array([[bin(s & ((1 << q) - 1)).count("1") for q in range(4)] for s in range(16)], np.int32)
_COUNT = np.array([bin(s).count("1") for s in range(16)], np.uint8)


# --- the grid of one block ----------------------------------------------------------

def _spread_bits(x: np.ndarray) -> np.ndarray:
    """The bits of numbers below 2^31, with a zero between any two."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                        (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def compressed(rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray, height: int) -> tuple[bytes, bytes]:
    """The children sets (two a byte) and the maxima (as distances from the
    parent, in three byte planes) of the tree, level by level from the root."""
    at = _spread_bits(rows)
    at <<= np.uint64(1)
    at |= _spread_bits(columns)
    order = np.argsort(at, kind="stable")
    at, top = at[order], impacts[order].astype(np.int32)
    del order
    sets: list[np.ndarray] = []
    below: list[np.ndarray] = []
    for _ in range(height):
        place = np.left_shift(1, (at & np.uint64(3)).astype(np.uint8), dtype=np.uint8)
        at >>= np.uint64(2)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        sets.append(np.bitwise_or.reduceat(place, first))
        most = np.maximum.reduceat(top, first)
        below.append(np.repeat(most, np.diff(first, append=len(at))) - top)
        at, top = at[first], most
    distances = np.concatenate([top, *below[::-1]])
    del below
    packed_sets = np.concatenate(sets[::-1]) if sets else np.zeros(0, np.uint8)
    packed_sets = np.append(packed_sets, np.zeros(len(packed_sets) % 2, np.uint8))
    planes = np.empty((3, len(distances)), np.uint8)
    for i in range(3):
        planes[i] = distances >> 8 * i & 255
    return (packed_sets[0::2] | packed_sets[1::2] << 4).tobytes(), planes.tobytes()


class Treap:
    """The tree in memory.  Node 0 stands for an empty quadrant, 1 is the
    root, the children of a node are consecutive."""

    def __init__(self, height: int, children: bytes, maxima: bytes):
        self.height = height
        pairs = np.frombuffer(children, np.uint8)
        # node 0 has no children; a last byte may hold half a pair too many
        self.sets = np.zeros(1 + 2 * len(pairs), np.uint8)
        self.sets[1::2], self.sets[2::2] = pairs & 15, pairs >> 4
        counts = _COUNT[self.sets]
        self.first = np.zeros(len(counts), np.int32)
        self.first[1:2] = 2
        np.cumsum(counts[1:-1], dtype=np.int32, out=self.first[2:])
        self.first[2:] += 2
        planes = np.frombuffer(maxima, np.uint8).reshape(3, -1)
        self.top = np.zeros(planes.shape[1] + 1, np.int32)
        distances = self.top[1:]
        for plane in planes[::-1]:
            distances <<= 8
            distances |= plane
        # the distances give way to the maxima, level by level
        begin, end = 1, 2
        for _ in range(height):
            below = np.repeat(self.top[begin:end], counts[begin:end])
            np.subtract(below, self.top[end:end + len(below)], out=self.top[end:end + len(below)])
            begin, end = end, end + len(below)

    def best(self, rows: np.ndarray, weights: np.ndarray, k: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Columns and scores of at least the k best columns that score
        ``least`` or more (all, if fewer)."""
        q = len(rows)
        step = max(8, STEP_CELLS // max(1, q))
        nodes = np.full((1, q), 1, np.int32)
        depth, start = np.zeros(1, np.int32), np.zeros(1, np.int64)
        bound = self.top[nodes].astype(np.int64) @ weights
        columns, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        leading = np.zeros(0, np.int64)
        if not self.height:
            return (start, bound) if bound[0] >= least else (columns[0], scores[0])
        while len(bound):
            if len(bound) > step:
                chosen = np.argpartition(-bound, step)[:step]
                rest = np.ones(len(bound), bool)
                rest[chosen] = False
            else:
                chosen, rest = np.arange(len(bound)), np.zeros(len(bound), bool)
            shift = self.height - 1 - depth[chosen]
            parents = nodes[chosen]
            sets, first = self.sets[parents], self.first[parents]
            quadrant = ((rows >> shift[:, None]) & 1) << 1
            new = []
            for half in (0, 1):
                place = quadrant + half
                child = np.where(sets >> place & 1, first + _BEFORE[sets, place], 0)
                new.append((child, depth[chosen] + 1, start[chosen] + (half << shift.astype(np.int64)),
                            self.top[child].astype(np.int64) @ weights))
            made = [np.concatenate(parts) for parts in zip(*new)]
            good = made[3] >= least
            done = good & (made[1] == self.height)
            if done.any():
                columns.append(made[2][done])
                scores.append(made[3][done])
                leading = np.concatenate((leading, made[3][done]))
                if len(leading) >= k:
                    leading = np.partition(leading, len(leading) - k)[-k:]
                    least = max(least, int(leading.min()))
            good &= made[1] < self.height
            kept = rest & (bound >= least)
            good &= made[3] >= least
            nodes, depth, start, bound = (np.concatenate((old[kept], part[good]))
                                          for old, part in zip((nodes, depth, start, bound), made))
        return np.concatenate(columns), np.concatenate(scores)


def block_of(docs: Iterable[tuple], n_docs: int, n_terms: int) -> tuple | None:
    """The ids, terms, document frequencies and tree of the documents
    ``(doc_id, text)`` of one range.  Of a text only the numbers of its words
    are kept while the others are read."""
    vocabulary: defaultdict = defaultdict()
    vocabulary.default_factory = vocabulary.__len__
    ids, named = [], []
    for doc, text in docs:
        found = words(text)
        if found:
            ids.append(np.fromiter(map(vocabulary.__getitem__, found), np.int32, len(found)))
            named.append(doc)
    if not named:
        return None
    width = len(named)
    by_id = sorted(range(width), key=lambda i: (named[i] is None, named[i] or 0))
    named, ids = [named[i] for i in by_id], [ids[i] for i in by_id]
    lengths = [len(x) for x in ids]
    cells = np.concatenate(ids).astype(np.int64)
    del ids
    cells *= width
    cells += np.repeat(np.arange(width, dtype=np.int32), lengths)
    cells.sort()
    first = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
    tf = np.diff(first, append=len(cells))
    cells = cells[first]
    del first
    term = (cells // width).astype(np.int32)
    cells %= width
    column = cells.astype(np.int32)
    del cells
    df = np.bincount(term, minlength=len(vocabulary))
    # frequent terms share quadrants with frequent ones
    order = np.argsort(-df, kind="stable")
    row = np.empty(len(order), np.int32)
    row[order] = np.arange(len(order))
    m = np.array([_PLAIN - _SLOPE + _SLOPE * n * n_docs // n_terms for n in lengths], np.int64)
    below = m[column]
    below *= _LENGTH
    below += _TF * tf
    tf *= _SCALE
    tf //= below
    impact = tf.astype(np.int32)
    del tf, below
    some = impact > 0
    height = max(len(vocabulary) - 1, width - 1).bit_length()
    terms = list(vocabulary)
    del vocabulary
    if some.any():
        children, maxima = compressed(row[term[some]], column[some], impact[some], height)
    else:
        height, children, maxima = 0, b"", bytes(3)
    return named, [terms[i] for i in order], df[order].tolist(), height, children, maxima


def packed(data: bytes) -> bytes:
    """The length of ``data``, and ``data`` compressed."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpacked(data: pa.Scalar) -> bytes:
    data = data.as_buffer()
    return pa.decompress(data[8:], int.from_bytes(data[:8].to_pybytes(), "little"), codec="zstd", asbytes=True)


def _lists(terms: pa.Scalar, lengths: pa.Scalar) -> pa.StringArray:
    """The terms of a block."""
    ends = np.cumsum(np.frombuffer(unpacked(lengths), np.int32), dtype=np.int32)
    offsets = np.concatenate((np.zeros(1, np.int32), ends))
    return pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(unpacked(terms)))


def _part(first: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
    """The rows of one block, the first of which is already read."""
    n = size = 0
    for doc, text in chain((first,), rows):
        yield doc, text
        n, size = n + 1, size + len(text)
        if n == BLOCK_DOCS or size >= BLOCK_BYTES:
            return


def _indexed(n_docs: int, n_terms: int):
    names = [c.split()[0] for c in _INDEX.split(", ")]

    def row_of(named, terms, df, height, children, maxima) -> pa.RecordBatch:
        ids = np.array([doc or 0 for doc in named], np.int64)
        lengths, df = np.array([len(t) for t in terms], np.int32), np.array(df, np.int32)
        values = (packed(ids.tobytes()), sum(doc is None for doc in named), packed(b"".join(terms)), packed(lengths.tobytes()),
                  packed(df.tobytes()), height, packed(children), packed(maxima))
        return pa.RecordBatch.from_arrays(
            [pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int32()) for v in values], names)

    def run(batches):
        rows = ((doc.as_py(), text.as_py()) for batch in batches for doc, text in zip(batch.column("doc_id"), batch.column("text")))
        for first in rows:
            if block := block_of(_part(first, rows), n_docs, n_terms):
                row = row_of(*block)
                del block
                give_back()
                yield row
        give_back()
    return run


@contextlib.contextmanager
def _row_by_row(spark: SparkSession):
    """Index rows are megabytes each: one of them in a batch of Parquet's
    reader and in an Arrow batch."""
    names = "spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = [spark.conf.get(name) for name in names]
    for name in names:
        spark.conf.set(name, "1")
    try:
        yield
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, int]:
    """The index of all documents, a table in the shared folder with one row
    per block, and the number of documents with terms."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).where("text is not null")
    n = F.regexp_count("text", F.lit(_TERM)).cast("long")
    n_docs, n_terms = rows.select(n.alias("n")).agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    path = scratch_path(spark, "search-index")
    # Parquet looks at the size of a row group and of a page only every so many rows
    (rows.mapInArrow(_indexed(n_docs, n_terms), _INDEX).write.option("compression", "none")
     .option("parquet.enable.dictionary", False).option("parquet.block.size", INDEX_GROUP)
     .option("parquet.block.size.row.check.min", 1).option("parquet.page.size.row.check.min", 1).parquet(path))
    return spark.read.schema(_INDEX).parquet(path), n_docs


# --- items ---------------------------------------------------------------------------

def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(_TERM), F.lit(0))


def _frequencies(batches):
    """``term, df`` of every block."""
    for batch in batches:
        for terms, lengths, df in zip(*batch.columns):
            rows = pa.RecordBatch.from_arrays(
                [_lists(terms, lengths), pa.array(np.frombuffer(unpacked(df), np.int32))], ["term", "df"])
            for begin in range(0, len(rows), LIST_ROWS):
                yield rows.slice(begin, LIST_ROWS)
    give_back()


def _weighted(items: DataFrame, index: DataFrame, n_docs: int, scratch: Scratch) -> DataFrame:
    """``item, terms, weights`` of the items, repeats of a term summed, terms
    that weigh nothing left out."""
    asked = scratch.stored(items.select("item", F.explode(terms_of(F.col("text"))).alias("term"))
                           .groupBy("item", "term").agg(F.count("*").alias("times")), "search-terms")
    # the distinct terms are written, so that a join is chosen by their measured size
    wanted = scratch.stored(asked.select("term").distinct(), "search-wanted")
    lists = index.select("terms", "lengths", "df").mapInArrow(_frequencies, "term string, df int")
    with _row_by_row(items.sparkSession):
        df = scratch.stored(lists.join(wanted, "term").groupBy("term").agg(F.sum("df").alias("df")), "search-df")
    weight = F.floor(1000 * F.ln(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1))).cast("long")
    return scratch.stored(
        asked.join(df, "term").select("item", "term", (weight * F.col("times")).alias("weight")).where("weight > 0")
        .groupBy("item").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("q"))
        .select("item", F.col("q.term").alias("terms"), F.col("q.weight").alias("weights")), "search-items")


def _searched(shared, k: int):
    def run(batches):
        asked = shared.value
        number: defaultdict = defaultdict()
        number.default_factory = number.__len__
        items = [(np.array([number[t] for t in names], np.int32), np.array(weights, np.int64)) for _, names, weights in asked]
        wanted = pa.array(list(number), pa.string())
        del number
        found: list[list[tuple]] = [[] for _ in asked]      # (score, null id, -id) heaps of the k best
        for batch in batches:
            for block, unnamed, terms, lengths, height, children, maxima in zip(*batch.columns):
                docs = np.frombuffer(unpacked(block), np.int64)
                named = len(docs) - unnamed.as_py()
                row = pc.fill_null(pc.index_in(wanted, value_set=_lists(terms, lengths)), -1).to_numpy()
                tree = Treap(height.as_py(), unpacked(children), unpacked(maxima))
                for heap, (names, weights) in zip(found, items):
                    rows = row[names]
                    here = rows >= 0
                    if not here.any():
                        continue
                    least = heap[0][0] if len(heap) == k else 1
                    columns, scores = tree.best(rows[here], weights[here], k, least)
                    for c, doc, s in zip(columns.tolist(), docs[columns].tolist(), scores.tolist()):
                        entry = (s, 1, -doc) if c < named else (s, 0, 0)
                        if len(heap) < k:
                            heapq.heappush(heap, entry)
                        elif entry > heap[0]:
                            heapq.heapreplace(heap, entry)
                del tree
                give_back()
        rows = [(item, -doc if some else None, s) for heap, (item, _, _) in zip(found, asked) for s, some, doc in heap]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows) if rows else ((), (), ()))],
                                         ["item", "doc_id", "score"])
    return run


def search(index: DataFrame, n_docs: int, items: DataFrame, item_id: str = "item_id", text: str = "text",
           k: int = 20, query_terms: int = QUERY_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of every item."""
    spark = index.sparkSession
    scratch = Scratch(spark)
    # the numbers of the items are written, so they stay what they are
    named = stored(items.select(F.monotonically_increasing_id().alias("item"), F.col(f"`{item_id}`").alias("item_id"),
                                F.col(f"`{text}`").cast("string").alias("text")), "search-named")
    asked = _weighted(named.where("text is not null"), index, n_docs, scratch)
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-total // query_terms))
    found = None
    for b in range(blocks):
        part = [tuple(r) for r in asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()]
        shared = spark.sparkContext.broadcast(part)
        with _row_by_row(spark):
            # one task per file at least: a block is a unit of work
            best = stored(index.select("docs", "unnamed", "terms", "lengths", "height", "children", "maxima").mapInArrow(
                _searched(shared, k), "item bigint, doc_id bigint, score bigint"), "search-found")
        shared.destroy()
        found = best if found is None else found.unionByName(best)
    scratch.clear()
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(named.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
