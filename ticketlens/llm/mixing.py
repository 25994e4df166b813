"""Mixing sources to target weights, in DataFrame functions only.

The words of each source, document after document in a hashed order, are cut
into blocks of a fixed number of words.  Every slot of an output shard draws
its source with the target shares as odds, so the counts per shard are
multinomial; draws beyond a source's quota pass to the sources still short of
theirs.  The n-th slot of a source takes the block with number
``permutation(n mod blocks)``, a keyed permutation of the block numbers, so a
source is gone through once before any of its blocks repeats.  Slots and
blocks are joined by source and block number.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and
share all words; no target exceeds ``max_repeats`` times its source, what is
over is shared anew by weight.  Everything is a hash of seed and position, so
reruns agree.

No step gathers a source: documents are numbered through prefix sums over
hashed buckets (:func:`running_start`), and every window covers one bucket;
sources are numbered and added up through sorted partitions
(:func:`ordering.in_order`).  A document is named by two hashes of id and text.
Rows that are equal in both are one entry with a number of copies, at most
``COPIES`` of them at a time, so the same id, null or not, in a third of all
rows is spread over many buckets, and a recomputed task gives the same places:
nothing but id, text, size and number decides them.  Every step is written
before the next one reads it.

Defined results: null texts have size 0; documents without words have no
block and take part with 0; an empty table gives an empty mix; repeated rows
are documents of their own; only the columns named are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, stored
from .ordering import in_order

#: The weights of consecutive sources.
WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 128
SHARD_SLOTS = 1024
#: Rows of one window: buckets of documents, and the fan-in of prefix sums.
BUCKET_ROWS = 128
FAN_IN = 256
ROUNDS = 4
#: Copies of one document that lie side by side.
COPIES = 256
_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]+"
_CELLS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def running_start(rows: DataFrame, keys: list[str], order: str, value: str, top: int) -> DataFrame:
    """``keys, order, start``: the sum of ``value`` over smaller ``order``
    numbers (0 .. top, unique per key) of the same keys.  Numbers go up a tree
    of fan-in FAN_IN, so no window holds more than FAN_IN rows."""
    if top <= FAN_IN:
        below = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.select(*keys, order, F.coalesce(F.sum(value).over(below), F.lit(0)).cast("long").alias("start"))
    group = f"_{order}_group"
    grouped = rows.withColumn(group, F.floor(F.col(order) / FAN_IN))
    sums = grouped.groupBy(*keys, group).agg(F.sum(value).alias("_sum"))
    starts = running_start(sums, keys, group, "_sum", top // FAN_IN).withColumnRenamed("start", "_before")
    below = Window.partitionBy(*keys, group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inside = grouped.withColumn("_inside", F.coalesce(F.sum(value).over(below), F.lit(0)).cast("long"))
    return inside.join(starts, [*keys, group]).select(
        *keys, order, (F.col("_before") + F.col("_inside")).alias("start"))


def source_targets(sized: DataFrame, weights=WEIGHTS, max_repeats: float = 3.0) -> DataFrame:
    """One row per source: ``source, src`` (its number), ``source_size,
    target``, written.  A source is capped where filling all up to its own
    ratio of cap to weight would not use up the words there are."""
    scratch = Scratch(sized.sparkSession)
    n = len(weights)
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = in_order(totals, [F.col("source").asc_nulls_last()], scratch, "mix-totals").withColumnRenamed("place", "src")
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("src") % n + 1).cast("int"))
    ranked = (named.withColumn("weight", weigh).withColumn("cap", F.lit(float(max_repeats)) * F.col("source_size"))
              .withColumn("ratio", F.col("cap") / F.col("weight")))
    filling = scratch.stored(in_order(ranked, ["ratio", "src"], scratch, "mix-ratios", {"caps": "cap", "weights": "weight"}), "mix-filling")
    words, weight = (x or 0.0 for x in filling.agg(F.sum("source_size").cast("double"), F.sum("weight")).first())
    filled = F.col("caps") + F.col("cap") + F.col("ratio") * (F.lit(weight) - F.col("weights") - F.col("weight"))
    capped = filled <= F.lit(words)
    used, odds = filling.agg(F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0.0)),
                             F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(1.0))).first()
    target = F.when(capped, F.col("cap")).otherwise(F.lit(words - used) * F.col("weight") / F.lit(odds))
    done = stored(filling.select("source", "src", "source_size", target.alias("target")), "mix-sources")
    scratch.clear()
    return done


def _placed(named: DataFrame, documents: int) -> DataFrame:
    """Documents with words, each copy with its ``start`` in the words of its
    source: ``src, k1, k2, doc_id, size, copies, start``."""
    buckets = max(1, documents // BUCKET_ROWS)
    entries = named.where(F.col("size") > 0).groupBy("src", "k1", "k2").agg(
        F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.count("*").alias("copies"))
    # the copies of an entry, some at a time
    run = F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES)))
    rows = (entries.withColumn("_run", run)
            .withColumn("_here", F.least(F.lit(COPIES), F.col("copies") - F.col("_run") * COPIES))
            .withColumn("_at", F.xxhash64("k1", "k2", "_run", F.lit("order")))
            .withColumn("_bucket", F.pmod(F.xxhash64("_at"), F.lit(buckets))))
    sums = rows.groupBy("src", "_bucket").agg(F.sum(F.col("size") * F.col("_here")).alias("_sum"))
    starts = running_start(sums, ["src"], "_bucket", "_sum", buckets).withColumnRenamed("start", "_before")
    below = (Window.partitionBy("src", "_bucket").orderBy("_at", "k1", "k2", "_run")
             .rowsBetween(Window.unboundedPreceding, -1))
    inside = rows.withColumn("_inside", F.coalesce(F.sum(F.col("size") * F.col("_here")).over(below), F.lit(0)).cast("long"))
    return (inside.join(starts, ["src", "_bucket"])
            .withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_here") - 1)))
            .select("src", "k1", "k2", "doc_id", "size", "copies",
                    (F.col("_before") + F.col("_inside") + F.col("_copy") * F.col("size")).alias("start")))


def _with_text(placed: DataFrame, texts: DataFrame) -> DataFrame:
    """The places with the texts of their documents.  A text that several rows
    have is written once and then met by its copies, which adaptive execution
    splits where they are many."""
    single = placed.where("copies = 1").join(texts, ["k1", "k2"])
    keys = placed.where("copies > 1").select("k1", "k2").distinct()
    if keys.isEmpty():
        return single
    several = stored(texts.join(keys, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]), "mix-repeated")
    return single.unionByName(placed.where("copies > 1").join(several, ["k1", "k2"]))


def _blocks(placed: DataFrame, block_words: int, text: str | None) -> DataFrame:
    """``src, block, pieces``: the parts of documents in each block, in order
    (a block holds at most ``block_words`` of them)."""
    first = F.floor(F.col("start") / block_words)
    last = F.floor((F.col("start") + F.col("size") - 1) / block_words)

    def cut(words):
        """The parts of one document by block; ``words`` are split once."""
        def part(block):
            begin = F.greatest(block * block_words, F.col("start")) - F.col("start")
            end = F.least((block + 1) * block_words - F.col("start"), F.col("size"))
            fields = [F.col("start"), F.col("doc_id"), F.col("size"), begin.alias("from_word"), (end - begin).alias("n_words")]
            if text:
                fields.append(F.array_join(F.slice(words, (begin + 1).cast("int"), (end - begin).cast("int")), " ").alias("text"))
            return F.struct(block.alias("block"), F.struct(*fields).alias("piece"))
        return F.transform(F.sequence(first, last), part)

    words = F.filter(F.split(F.col(text), _SPACE), lambda w: w != "") if text else F.lit(0)
    parts = placed.select("src", F.explode(F.flatten(F.transform(F.array(words), cut))).alias("p"))
    return parts.groupBy("src", "p.block").agg(F.sort_array(F.collect_list("p.piece")).alias("pieces"))


def _permuted(x: Column, n: Column, key: Column) -> Column:
    """A keyed permutation of 0 .. n - 1: a Feistel network on a rectangle of
    at least n cells, repeated while it leaves the range.  Fewer than width
    cells are outside, and a walk meets none twice: 64 steps are enough up to
    4,096 numbers, and beyond each further step has odds under 1 : 64.  A walk
    that has not ended by then stops the job; no slot is ever dropped."""
    width = F.ceil(F.sqrt(n)).cast("long")
    height = F.ceil(n / width).cast("long")

    def once(v: Column) -> Column:
        a, b = F.floor(v / height), v % height
        for r in range(ROUNDS):
            if r % 2 == 0:
                a = F.pmod(a + F.pmod(F.xxhash64(key, F.lit(r), b), width), width)
            else:
                b = F.pmod(b + F.pmod(F.xxhash64(key, F.lit(r), a), height), height)
        return (a * height + b).cast("long")

    steps = F.sequence(F.lit(1), F.lit(64))
    walked = F.aggregate(steps, once(x), lambda v, _: F.when(v < n, v).otherwise(once(v)))
    return F.when(once(x) < n, once(x)).when(walked < n, walked).otherwise(
        F.raise_error(F.lit("the index permutation left its range")).cast("long"))


def _with_interval(points: DataFrame, intervals: DataFrame, at: str, total: Column, cells: int) -> DataFrame:
    """Join each point to the interval [lo, hi) that holds it, by equality on
    a grid cell, then by the exact bounds."""
    cell = lambda x: F.floor(x * cells / total)
    spread = (intervals.where(F.col("hi") > F.col("lo"))
              .withColumn("_cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi") - 1)))))
    return (points.withColumn("_cell", cell(F.col(at))).join(spread, "_cell")
            .where((F.col(at) >= F.col("lo")) & (F.col(at) < F.col("hi"))).drop("_cell", "lo", "hi"))


def _slots(sources: DataFrame, block_words: int, shard_slots: int, seed: int) -> DataFrame:
    """``shard, position, src, block``: what every output slot takes, written."""
    spark = sources.sparkSession
    scratch = Scratch(spark)
    quota = sources.where(F.col("source_size") > 0).select(
        "src", F.ceil(F.col("source_size") / block_words).cast("long").alias("blocks"), "source_size", "target")
    quota = quota.select("src", "blocks", F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long").alias("quota"))
    quota = scratch.stored(in_order(quota, ["src"], scratch, "mix-order", {"lo": "quota"})
                           .select("src", "blocks", "quota", "lo", (F.col("lo") + F.col("quota")).alias("hi")), "mix-quota")
    slots, named = quota.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.count("*")).first()
    shards, cells = max(1, -(-slots // shard_slots)), max(_CELLS, 4 * named)

    # every slot draws its source: one of ``slots`` tickets
    drawn = spark.range(slots).select(
        F.floor(F.col("id") / shard_slots).alias("shard"), (F.col("id") % shard_slots).alias("position"),
        F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(max(1, slots))).alias("ticket"))
    drawn = scratch.stored(_with_interval(drawn, quota.select("src", "lo", "hi"), "ticket", F.lit(max(1, slots)), cells)
                           .select("shard", "position", "src"), "mix-drawn")
    counts = scratch.stored(drawn.groupBy("src", "shard").agg(F.count("*").alias("n")), "mix-counts")
    before = scratch.stored(running_start(counts, ["src"], "shard", "n", shards), "mix-before")
    rank = F.row_number().over(Window.partitionBy("src", "shard").orderBy("position")) - 1
    numbered = (drawn.withColumn("_rank", rank).join(before, ["src", "shard"])
                .select("shard", "position", "src", (F.col("start") + F.col("_rank")).alias("n")))

    # what a source drew beyond its quota passes to those short of theirs
    got = counts.groupBy("src").agg(F.sum("n").alias("got"))
    balance = quota.join(got, "src", "left").select("src", "blocks", "quota", F.coalesce("got", F.lit(0)).alias("got"))
    balance = balance.withColumns({"over": F.greatest(F.col("got") - F.col("quota"), F.lit(0)),
                                   "short": F.greatest(F.col("quota") - F.col("got"), F.lit(0))})
    balance = scratch.stored(in_order(balance, ["src"], scratch, "mix-got", {"over_lo": "over", "short_lo": "short"}), "mix-balance")
    moved = balance.agg(F.coalesce(F.sum("over"), F.lit(0))).first()[0]
    known = scratch.stored(numbered.join(balance.select("src", "blocks", "quota", "over_lo"), "src"), "mix-numbered")
    kept = known.where(F.col("n") < F.col("quota")).select("shard", "position", "src", "n", "blocks")
    passed = known.where(F.col("n") >= F.col("quota")).select(
        "shard", "position", (F.col("over_lo") + F.col("n") - F.col("quota")).alias("rank"))
    takers = balance.select("src", "blocks", "got", F.col("short_lo").alias("lo"),
                            (F.col("short_lo") + F.col("short")).alias("hi"), F.col("short_lo").alias("_lo"))
    passed = _with_interval(passed, takers, "rank", F.lit(max(1, moved)), cells)
    passed = passed.select("shard", "position", "src", (F.col("got") + F.col("rank") - F.col("_lo")).alias("n"), "blocks")
    done = stored(kept.unionByName(passed).select(
        "shard", "position", "src",
        _permuted(F.col("n") % F.col("blocks"), F.col("blocks"), F.xxhash64(F.lit(seed), "src")).alias("block")), "mix-slots")
    scratch.clear()
    return done


def _named(docs: DataFrame, doc: str, text: str) -> dict[str, Column]:
    """Two hashes of id and text."""
    return {f"k{i}": F.xxhash64(F.lit(i), F.col(f"`{doc}`"), F.col(f"`{text}`")) for i in (1, 2)}


def size_documents(docs: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id, source, size, k1, k2``, written once, so that the texts are
    counted once and stay where they are."""
    return stored(docs.select(
        F.col(f"`{doc}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), word_count(F.col(f"`{text}`")).alias("size"),
        *[c.alias(k) for k, c in _named(docs, doc, text).items()]), "mix-sizes")


def texts_of(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``k1, k2, text`` of the documents, for :func:`blocks_and_slots`."""
    return docs.select(*[c.alias(k) for k, c in _named(docs, doc, text).items()], F.col(f"`{text}`").alias("text"))


def blocks_and_slots(sized: DataFrame, sources: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS,
                     seed: int = 17, texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The two sides of the mix, keyed by ``src, block``: the packed blocks
    (``pieces``: ``array<struct<start, doc_id, size, from_word, n_words>>``, and
    the words as ``text`` where ``texts`` are given) and the output slots
    (``shard, position``).  ``sized``, ``sources`` and ``texts`` come from
    :func:`size_documents`, :func:`source_targets` and :func:`texts_of`."""
    placed = stored(_placed(with_source_number(sized, sources), sized.count()), "mix-places")
    slots = _slots(sources, block_words, shard_slots, seed)
    if texts is not None:
        placed = _with_text(placed, texts)
    return _blocks(placed, block_words, None if texts is None else "text"), slots


def mix(blocks: DataFrame, slots: DataFrame) -> DataFrame:
    """The mix itself, one row per output slot: ``shard, position, src,
    block, pieces``."""
    return slots.join(blocks, ["src", "block"])


def words_taken(blocks: DataFrame, slots: DataFrame) -> DataFrame:
    """``src, start, doc_id, size, taken``: the words that the mix takes from
    each document with words, repeats counted; slots are counted per block
    before they meet its documents."""
    times = slots.groupBy("src", "block").agg(F.count("*").alias("times"))
    return (blocks.join(times, ["src", "block"], "left")
            .select("src", F.coalesce("times", F.lit(0)).alias("times"), F.explode("pieces").alias("p"))
            .groupBy("src", "p.start", "p.doc_id", "p.size")
            .agg(F.sum(F.col("p.n_words") * F.col("times")).alias("taken")))


def with_source_number(sized: DataFrame, sources: DataFrame) -> DataFrame:
    numbers = sources.select(F.col("source").alias("_source"), "src")
    return sized.join(numbers, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "source")
