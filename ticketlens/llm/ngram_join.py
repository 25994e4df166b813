"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document is its set of word n-grams, ordered by estimated corpus frequency
(rarest first).  Two sets that reach the threshold must share at least ``l``
tokens within their prefixes of ``size - least overlap + l`` tokens.  Every
document picks its own ``l`` by estimated cost: a longer prefix reads more
postings but leaves fewer candidates, since a pair must then share the smaller
``l`` of the two.  What remains is verified exactly on the whole texts.

The frequencies come from a sketch of fixed size over all documents.  It only
orders tokens and weighs costs; the result does not depend on its errors.

Groups of copies.  Equal sets are one node (named by two 64-bit hashes, then
numbered), so exact copies cost one row per task.  Candidates are made in two
rounds.  In the first every document meets the *leaders* (one node, by hash) of
its prefix tokens, each token apart by size window, and is verified with the
``LEADERS`` of them whose bitmaps are nearest; that is linear in the postings
and joins the members of a large group that is dense.  In the second the
documents of a token meet, but only across the components found so far (a pair
inside one component can change nothing), and are candidates if they share as
many prefix tokens as the smaller extension asks and enough tokens follow the
first of them in both to reach the overlap that their sizes ask for.  The first round only spares the second one work: no link between
components is lost, and no cap exists.

Before any text is fetched, a pair passes a bitmap filter: every token flips
one of a few hundred bits, so two sets differ in at least as many tokens as
their bitmaps differ in bits.

Defined results: a text with fewer words than an n-gram has is one token of
all its words; without words or with null text the set is empty and links with
nothing; equal texts always link; documents with a null id take part and have
the smallest id of their component, null where there is none; repeated ids are
documents of their own; ids may be of any type that has an order; an empty table
gives an empty result; only the two columns named are used.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, give_back, release, stored
from .components import connected_components
from .hashing import mix, words_of

SKETCH_BITS = 20
_CHUNK = 1 << 14
#: Prefix extensions considered, and the cost of a verification in postings read.
MAX_EXTENSION = 6
VERIFY_COST = 8.0
#: Leaders that a node is verified with in the first round.
LEADERS = 2
#: A Bloom filter: bits of a piece, bits per number, pieces at most (128 MB).
BLOOM_PIECE = 19
BLOOM_SHARE = 16
BLOOM_PIECES = 1 << 11
#: 64-bit words of the bitmap of a set.
BITMAP_WORDS = 6
#: Bytes of text turned into tokens at once; nodes a task remembers.
SLICE = 1 << 18
SEEN = 1 << 18

#: A-Z fold to a-z; the characters 9-13 and 32 separate words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
_PLACE = np.random.default_rng(41).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Jaccard:
    """Links: ``per * intersection >= share * union`` on word n-grams."""
    words: int = 5
    share: int = 80
    per: int = 100

    def least_overlap(self, size: int) -> int:
        return -(-self.share * size // self.per)

    def overlap(self, a: Column, b: Column) -> Column:
        """The common tokens that two sets of these sizes need."""
        return F.ceil(((a + b) * self.share) / (self.share + self.per))

    def size_window(self, size: Column) -> Column:
        """Number of the size window of a set: two sets whose sizes can link
        lie in the same or in neighbouring windows."""
        # a hair less than a step, so that rounding cannot part two sizes at the limit
        step = F.log(size) / math.log(self.per / self.share) * 0.999999 if self.share < self.per else size
        return F.floor(step).cast("long")

    def may_link(self, a: Column, b: Column, flipped: Column) -> Column:
        """Can sets of these sizes link if they differ in so many tokens?"""
        return flipped + self.overlap(a, b) * 2 <= a + b

    def sizes_fit(self, a: Column, b: Column) -> Column:
        return F.least(a, b) * self.per >= F.greatest(a, b) * self.share

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        if self.per * min(len(a), len(b)) < self.share * max(len(a), len(b)):
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both > 0 and self.per * both >= self.share * (len(a) + len(b) - both)


def token_sets(texts: list[str | None], n: int):
    """The sorted distinct n-gram hashes of each text."""
    part: list[bytes] = []
    size = 0
    for t in texts:
        part.append(t.encode("utf-8", "surrogatepass").translate(_FOLD) if t else b"")
        size += len(part[-1])
        if size >= SLICE:
            yield from _sets(part, n)
            part, size = [], 0
    yield from _sets(part, n)


def _sets(texts: list[bytes], n: int):
    h, offsets = words_of(texts)
    if len(h) >= n:
        grams = np.zeros(len(h) - n + 1, np.uint64)
        for i in range(n):
            grams += h[i:len(h) - n + 1 + i] * _PLACE[i]
        grams = mix(grams)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= n:
            yield np.unique(grams[a:b - n + 1])
        elif b > a:
            whole = sum(int(h[a + i]) * int(_PLACE[i]) for i in range(b - a)) + (b - a) * 0x632BE59BD9B4E019
            yield mix(np.array([whole % (1 << 64)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def _name(tokens: np.ndarray) -> tuple[int, int]:
    """The name of a set: two independent 64-bit hashes, as signed numbers."""
    data = tokens.tobytes()
    return (xxhash.xxh3_64_intdigest(data, seed=len(tokens)) - (1 << 63),
            xxhash.xxh64_intdigest(data, seed=0x5EED) - (1 << 63))


# --- first pass: sets and the frequency sketch ---------------------------------

def _scan(n: int):
    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.int32)
        for batch in batches:
            names, sizes = [], []
            for tokens in token_sets(batch["text"].tolist(), n):
                names.append(_name(tokens) if len(tokens) else (None, None))
                sizes.append(len(tokens))
                np.add.at(counts, (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            yield pd.DataFrame({"id": batch["id"].astype(object).where(batch["id"].notna(), None), "k1": batch["k1"].array, "k2": batch["k2"].array,
                                "n1": pd.array([x for x, _ in names], "Int64"), "n2": pd.array([x for _, x in names], "Int64"),
                                "size": sizes, "chunk": pd.array([None] * len(sizes), "Int32"), "counts": [None] * len(sizes)})
        chunks = counts.reshape(-1, _CHUNK)
        used = np.flatnonzero(chunks.any(axis=1))
        none = pd.array([None] * len(used), "Int64")
        yield pd.DataFrame({"id": pd.Series([None] * len(used), dtype=object), "k1": none, "k2": none, "n1": none, "n2": none,
                            "size": np.zeros(len(used), np.int64), "chunk": pd.array(used, "Int32"),
                            "counts": [chunks[i].tobytes() for i in used]})
        del counts, chunks
        give_back()
    return run


def _summed(batches):
    """Sums of the chunks of one partition, as a stream."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch["chunk"], batch["counts"]):
            got = np.frombuffer(counts, np.int32)
            total[chunk] = total[chunk] + got if chunk in total else got.astype(np.int64)
    yield pd.DataFrame({"chunk": np.array(list(total), np.int32), "counts": [v.tobytes() for v in total.values()]})


def _sketch(scan: DataFrame) -> np.ndarray:
    """The summed counts: a fixed 2^SKETCH_BITS numbers, whatever the input."""
    chunks = (1 << SKETCH_BITS) // _CHUNK
    rows = (scan.where(F.col("chunk").isNotNull()).select("chunk", "counts").repartition(chunks, "chunk")
            .mapInPandas(_summed, "chunk int, counts binary").collect())
    counts = np.zeros((chunks, _CHUNK), np.int64)
    for r in rows:
        counts[r["chunk"]] = np.frombuffer(r["counts"], np.int64)
    return counts.ravel()


# --- second pass: prefixes -----------------------------------------------------

def choose_extension(frequency: np.ndarray, size: int, least: int) -> int:
    """The ``l`` of least estimated cost; ``frequency`` is in token order."""
    options = min(MAX_EXTENSION, least)
    read = np.cumsum(frequency)
    best, cost = 1, None
    for ext in range(1, options + 1):
        postings = read[size - least + ext - 1]
        now = postings * (1 + VERIFY_COST / ext)
        if cost is None or now < cost:
            best, cost = ext, now
    return best


def _bitmap(tokens: np.ndarray) -> np.ndarray:
    """The parity of the tokens in each of 64 * BITMAP_WORDS cells."""
    cells = np.bincount((tokens % np.uint64(64 * BITMAP_WORDS)).astype(np.int64), minlength=64 * BITMAP_WORDS)
    return np.packbits((cells & 1).astype(np.uint8)).view(np.int64)


def _flipped(a: Column, b: Column) -> Column:
    """Bits in which two bitmaps differ."""
    out = F.lit(0)
    for i in range(BITMAP_WORDS):
        out = out + F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))))
    return out


def _prefixes(jaccard: Jaccard, shared):
    def run(batches):
        counts = shared.value
        usual = counts.mean()
        noise = usual + 3 * np.sqrt(usual)          # other tokens in the same cell
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            out = []
            for tokens in token_sets(batch["text"].tolist(), jaccard.words):
                if not len(tokens) or (name := _name(tokens)) in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(name)
                size, least = len(tokens), jaccard.least_overlap(len(tokens))
                about = counts[(tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                order = np.lexsort((tokens, about))
                ext = choose_extension(np.maximum(about[order] - noise, 0.0), size, least)
                prefix = tokens[order[:size - least + ext]]
                out.append((*name, size, ext, _bitmap(tokens), prefix.view(np.int64)))
            yield pd.DataFrame(out, columns=["n1", "n2", "size", "need", "bitmap", "tokens"])
        del seen
        give_back()
    return run


# --- candidates ----------------------------------------------------------------

def _bits(ids: np.ndarray, pieces: int) -> tuple[np.ndarray, np.ndarray]:
    """The piece of the filter that each number belongs to, and its four bits there."""
    h = mix(np.asarray(ids, np.int64).view(np.uint64))
    piece = (mix(h + np.uint64(0x9E3779B97F4A7C15)) & np.uint64(pieces - 1)).astype(np.int64)
    return piece, np.stack([(h >> np.uint64(s)) & np.uint64((1 << BLOOM_PIECE) - 1) for s in (0, 13, 26, 39)]).astype(np.int64)


def _bloom_filter(ids: DataFrame) -> np.ndarray:
    """Packed bits of a Bloom filter over a column of numbers, one row a
    piece.  Its size follows their count, up to BLOOM_PIECES; beyond that it
    only gets less selective.  Each task fills the pieces dealt to it."""
    n = ids.count()
    pieces = min(BLOOM_PIECES, 1 << max(0, math.ceil(math.log2(max(1, n) * BLOOM_SHARE)) - BLOOM_PIECE))

    @F.pandas_udf("int")
    def piece_of(numbers: pd.Series) -> pd.Series:
        return pd.Series(_bits(numbers.to_numpy(), pieces)[0].astype(np.int32))

    def filled(batches):
        bits: dict[int, np.ndarray] = {}
        for batch in batches:
            at, places = _bits(batch["id"].to_numpy(), pieces)
            order = np.argsort(at, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                if len(part):
                    bits.setdefault(int(at[part[0]]), np.zeros(1 << BLOOM_PIECE, bool))[places[:, part].ravel()] = True
        yield pd.DataFrame({"piece": np.array(list(bits), np.int32), "bits": [np.packbits(b).tobytes() for b in bits.values()]})

    packed = np.zeros((pieces, (1 << BLOOM_PIECE) // 8), np.uint8)
    dealt = ids.toDF("id").repartition(pieces, piece_of("id"))
    for r in dealt.mapInPandas(filled, "piece int, bits binary").toLocalIterator():
        packed[r["piece"]] |= np.frombuffer(r["bits"], np.uint8)
    return packed


def _maybe_in(packed: np.ndarray, ids: np.ndarray) -> np.ndarray:
    piece, at = _bits(ids, len(packed))
    return ((packed[piece, at >> 3] >> (7 - (at & 7))) & 1).all(axis=0)


def _wanted_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, text`` for the documents in ``wanted(node, k1, k2)``; the filter
    spares most other texts the shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(_bloom_filter(wanted.select("k1")))

    @F.pandas_udf("boolean")
    def maybe(keys: pd.Series) -> pd.Series:
        return pd.Series(_maybe_in(shared.value, keys.to_numpy()))

    # a repeated row has one name, and its text is needed once
    texts = docs.select("k1", "k2", "text").where(maybe("k1")).dropDuplicates(["k1", "k2"])
    return wanted.join(texts, ["k1", "k2"]).select("node", "text")


def _common_tokens(prefixes: DataFrame, jaccard: Jaccard, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``node, size, need, pos, token``: the prefix tokens that at least two
    nodes have, and the pairs ``a, b`` of a node and a leader: one of the nodes
    of a meeting (a token and a size window), by hash."""
    counts = prefixes.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    repeated = scratch.stored(counts.where("n > 1").select("token"), "jaccard-repeated")
    release(prefixes.sparkSession)
    shared = prefixes.sparkSession.sparkContext.broadcast(_bloom_filter(repeated))

    @F.pandas_udf("array<int>")
    def positions(tokens: pd.Series) -> pd.Series:
        """Where a prefix has tokens that may be repeated."""
        return pd.Series([np.flatnonzero(_maybe_in(shared.value, np.asarray(t))).astype(np.int32) for t in tokens])

    rows = (prefixes.select("node", "size", "need", "tokens", F.explode(positions("tokens")).alias("pos"))
            .withColumn("token", F.get("tokens", F.col("pos"))).drop("tokens"))
    common = scratch.stored(rows.join(repeated, "token"), "jaccard-common")
    scratch.drop("jaccard-repeated")
    meeting = common.select("node", F.xxhash64("token", jaccard.size_window(F.col("size"))).alias("meet"))
    # every meeting has a leader of its own, so a group gets many of them
    heads = scratch.stored(meeting.groupBy("meet").agg(
        F.min_by("node", F.xxhash64("node", "meet")).alias("lead"), F.count("*").alias("n"))
        .where("n > 1").select("meet", "lead"), "jaccard-heads")
    led = scratch.stored(meeting.join(heads, "meet").where("node != lead")
                         .select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct(), "jaccard-led")
    scratch.drop("jaccard-heads")
    return common, led


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, jaccard: Jaccard, scratch: Scratch, name: str) -> DataFrame:
    """The pairs ``(a, b)`` of nodes that reach the threshold."""
    pairs = scratch.stored(pairs.select("a", "b"), f"{name}-pairs")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = scratch.stored(nodes.join(ends, "node").select("node", "k1", "k2"), f"{name}-wanted")
    texts = scratch.stored(_wanted_texts(docs, wanted), f"{name}-texts")
    release(docs.sparkSession)

    @F.pandas_udf("boolean")
    def links(a: pd.Series, ta: pd.Series, b: pd.Series, tb: pd.Series) -> pd.Series:
        kept: dict[int, np.ndarray] = {}
        for ids, found in ((a, ta), (b, tb)):
            new = dict(zip(ids, found))
            kept.update(zip(new, token_sets(list(new.values()), jaccard.words)))
        return pd.Series([jaccard.linked(kept[x], kept[y]) for x, y in zip(a, b)], dtype=bool)

    # few texts stand on the right (leaders, or one side of a component)
    right = scratch.stored(pairs.select("b").distinct(), f"{name}-right")
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("tb")).join(right, "b", "left_semi")
    both = pairs.join(one, "a").join(two, "b")
    found = scratch.stored(both.where(links("a", "ta", "b", "tb")).select("a", "b"), f"{name}-links")
    scratch.drop(f"{name}-pairs", f"{name}-wanted", f"{name}-texts", f"{name}-right")
    return found


def _met_first(live: DataFrame, jaccard: Jaccard) -> DataFrame:
    """``a, b, need`` for each meeting of two sets of different components at a
    token that may be the first one they share."""
    side = lambda s: live.select(*[F.col(c).alias(f"{c}_{s}") for c in live.columns])
    a, b = side("a"), side("b")
    # the smaller set comes first; a set meets those of its own window, and of
    # the one below as the larger set
    a = a.withColumn("meet_a", F.xxhash64("token_a", jaccard.size_window(F.col("size_a"))))
    window = jaccard.size_window(F.col("size_b"))
    b = b.withColumn("meet_b", F.explode(F.array(F.xxhash64("token_b", window), F.xxhash64("token_b", window - 1))))
    sizes = (F.col("size_a"), F.col("size_b"))
    across = ((F.col("component_a") != F.col("component_b"))
              & ((sizes[0] < sizes[1]) | ((sizes[0] == sizes[1]) & (F.col("node_a") < F.col("node_b"))))
              & jaccard.sizes_fit(*sizes) & jaccard.may_link(*sizes, _flipped(F.col("bitmap_a"), F.col("bitmap_b"))))
    # the first token that a linked pair shares leaves enough after it in both
    # sets: a pair meets at no other token, and no set at its last ones
    least = jaccard.overlap(*sizes)
    early = (F.col("pos_a") + least <= sizes[0]) & (F.col("pos_b") + least <= sizes[1])
    # tokens stand in one order, so a first token of one set that is among the
    # first two of the other is the first they share; if none is known, the pair
    # comes with every token it shares that early
    among = lambda t: F.coalesce((t == F.col("t0_b")) | (t == F.coalesce("t1_b", "t0_b")), F.lit(False))
    common_first = F.when(among(F.col("t0_a")), F.col("t0_a")).when(among(F.col("t1_a")), F.col("t1_a"))
    return a.join(b, (F.col("meet_a") == F.col("meet_b")) & (F.col("token_a") == F.col("token_b")) & across & early
                    & (F.coalesce(common_first, F.col("token_a")) == F.col("token_a"))).select(
        F.col("node_a").alias("a"), F.col("node_b").alias("b"), F.least("need_a", "need_b").alias("need"))


def _across(common: DataFrame, bitmaps: DataFrame, joined: DataFrame, jaccard: Jaccard, scratch: Scratch) -> DataFrame:
    """Candidate pairs of different components, each once: the sets share as
    many prefix tokens as the smaller extension asks, and after the first of
    them enough tokens are left in both."""
    placed = scratch.stored(common.select("node", "size", "need", "pos", "token").join(
        joined.select(F.col("id").alias("node"), "component"), "node", "left")
        .withColumn("component", F.coalesce("component", "node")), "jaccard-placed")
    scratch.drop("jaccard-common")
    spans = scratch.stored(placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
                           .where("lo < hi").select("token"), "jaccard-open")
    met = scratch.stored(placed.join(spans, "token"), "jaccard-met")
    scratch.drop("jaccard-placed", "jaccard-open")
    # the first two of a set's tokens tell most pairs their first common one
    firsts = met.groupBy("node").agg(F.min(F.struct("pos", "token")).alias("f")).select("node", F.col("f.token").alias("t0"), F.col("f.pos").alias("p0"))
    seconds = met.join(firsts, "node").where(F.col("pos") > F.col("p0")).groupBy("node").agg(F.min(F.struct("pos", "token")).alias("f"))
    heads = firsts.join(seconds.select("node", F.col("f.token").alias("t1")), "node", "left").drop("p0")
    leading = met.where(F.col("pos") * jaccard.per <= F.col("size") * (jaccard.per - jaccard.share))
    live = scratch.stored(leading.join(scratch.stored(heads.join(bitmaps.select("node", "bitmap"), "node"), "jaccard-firsts"), "node"), "jaccard-live")
    scratch.drop("jaccard-firsts")
    pairs = scratch.stored(_met_first(live, jaccard).groupBy("a", "b").agg(F.max("need").alias("need")), "jaccard-candidates")
    scratch.drop("jaccard-live")
    # all shared prefix tokens, for the candidates only
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    lists = scratch.stored(met.join(ends, "node").groupBy("node").agg(F.collect_set("token").alias("tokens")), "jaccard-lists")
    scratch.drop("jaccard-met")
    listed = lambda s: lists.select(F.col("node").alias(s), F.col("tokens").alias(f"tokens_{s}"))
    return (pairs.join(listed("a"), "a").join(listed("b"), "b")
            .where(F.size(F.array_intersect("tokens_a", "tokens_b")) >= F.col("need")).select("a", "b"))


def near_duplicates(documents: DataFrame, jaccard: Jaccard = Jaccard(), doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, key, key2, n_shingles, node,
    component, component_id``.  ``key, key2`` are ``row_key`` of the row; rows of
    one component (equal ``component``; null without words) are linked."""
    spark = documents.sparkSession
    docs = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    of = docs.schema["doc_id"].dataType
    k1, k2 = row_key(F.col("doc_id"), F.col("text"))
    docs = docs.select(F.col("doc_id").cast("string").alias("id"), "text", k1.alias("k1"), k2.alias("k2"))
    scratch = Scratch(spark)
    scan = stored(docs.mapInPandas(_scan(jaccard.words), "id string, k1 bigint, k2 bigint, n1 bigint, n2 bigint, size bigint, "
                                   "chunk int, counts binary"), "jaccard-scan")
    shared = spark.sparkContext.broadcast(_sketch(scan))
    sets = scan.where(F.col("chunk").isNull()).select(F.col("id").cast(of).alias("doc_id"), "k1", "k2", "n1", "n2", "size")
    nodes = stored(sets.where("n1 is not null").groupBy("n1", "n2").agg(
        F.min(F.struct("k1", "k2")).alias("k"), F.min("doc_id").alias("first_id")).select(
        "n1", "n2", "k.k1", "k.k2", "first_id", F.monotonically_increasing_id().alias("node")), "jaccard-nodes")

    found = docs.select("text").mapInPandas(
        _prefixes(jaccard, shared), "n1 bigint, n2 bigint, size int, need int, bitmap array<bigint>, tokens array<bigint>")
    # the same set, found by several tasks, has one number
    prefixes = scratch.stored(found.dropDuplicates(["n1", "n2"]).join(nodes.select("n1", "n2", "node"), ["n1", "n2"])
                              .drop("n1", "n2"), "jaccard-prefixes")
    release(spark)
    common, led = _common_tokens(prefixes, jaccard, scratch)
    bitmaps = scratch.stored(prefixes.select("node", "size", "bitmap"), "jaccard-bitmaps")
    scratch.drop("jaccard-prefixes")

    # first round: every node with the nearest leaders of its tokens
    side = lambda s: bitmaps.select(*[F.col(c).alias(s if c == "node" else f"{c}_{s}") for c in bitmaps.columns])
    sizes = (F.col("size_a"), F.col("size_b"))
    near = led.join(side("b"), "b").join(side("a"), "a").withColumn("flipped", _flipped(F.col("bitmap_a"), F.col("bitmap_b")))
    near = near.where(jaccard.sizes_fit(*sizes) & jaccard.may_link(*sizes, F.col("flipped")))
    chosen = F.slice(F.sort_array(F.collect_list(F.struct("flipped", "b"))), 1, LEADERS)
    first = near.groupBy("a").agg(chosen.alias("chosen")).select("a", F.explode("chosen.b").alias("b"))
    links = _verified(first, docs, nodes, jaccard, scratch, "jaccard-first")
    scratch.drop("jaccard-led")
    joined = connected_components(links, "jaccard-components")

    # second round: across those components
    across = _across(common, bitmaps, joined, jaccard, scratch)
    more = _verified(across, docs, nodes, jaccard, scratch, "jaccard-second")
    done = connected_components(links.unionByName(more), "jaccard-components")

    scratch.clear()
    named = nodes.join(done.withColumnRenamed("id", "node"), "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    member = stored(named.select("n1", "n2", "node", "component").join(least, "component"), "jaccard-members")
    out = sets.join(member, ["n1", "n2"], "left")
    return out.select("doc_id", F.col("k1").alias("key"), F.col("k2").alias("key2"), F.col("size").alias("n_shingles"), "node",
                      "component", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def row_key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """Names a document by id and text: two 64-bit hashes."""
    return F.xxhash64(doc_id, text), F.xxhash64(F.lit(2), doc_id, text)
