"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a sequence of slots of equally many words.  Slot ``i`` is given to the source whose share of the unit interval
holds the golden-ratio point ``frac((i + 1) * phi)``, so every stretch of the mix is near the targets.  The k-th slot of a
source takes the k-th block of that source's stream: its documents in a fixed shuffled order, epoch after epoch, cut
into blocks of that size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidesearch.llm.shared import WORD, durable, gapless_rank, whole_row, word_count

#: Fractional part of the golden ratio, and of 2**20 times it.
PHI = 0.6180339887498949
PHI_20 = 0.6077874097973108
#: The unit interval is cut into so many cells to find the source of a point by an equi-join.
CELLS = 65536


def golden_point(i: Column) -> Column:
    """frac(i * phi) in [0, 1).  ``i`` is split at 20 bits, so the fraction keeps its digits for long schedules."""
    far = F.floor(i / F.lit(1 << 20)) * PHI_20
    x = (far - F.floor(far)) + (i % (1 << 20)) * PHI
    return x - F.floor(x)


def targets(sizes: DataFrame, weights: tuple[float, ...], max_epochs: int) -> DataFrame:
    """Adds ``target`` to a table (source, source_size): shares by weight, stopped at ``max_epochs`` times the size.

    Sources in code-point order, null last, take ``weights`` in turn.  What a stopped source leaves is shared again by weight.
    That ends at a level L with target = min(max_epochs * size, L * weight); sources stop in the order of cap / weight, so L follows
    from sums over those that stop earlier.  One row per source is all that meets in a task here.
    """
    named = sizes.withColumn("_rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    named = named.select("source", "source_size", w.alias("_w"), (F.col("source_size") * max_epochs).alias("_cap"))
    order = W.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    named = named.select(
        "*",
        F.sum("source_size").over(W.partitionBy()).alias("_all"),
        F.coalesce(F.sum("_cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_stopped"),
        F.sum("_w").over(order.rowsBetween(0, W.unboundedFollowing)).alias("_open"),
    )
    named = named.withColumn("_level", (F.col("_all") - F.col("_stopped")) / F.col("_open"))
    # The first source, in that order, whose cap is above its share at the level then reached sets the level for the rest.
    free = F.when(F.col("_level") * F.col("_w") < F.col("_cap"), F.struct((F.col("_cap") / F.col("_w")).alias("at"), F.col("source").isNull().alias("last"), "source", F.col("_level").alias("level")))
    named = named.withColumn("_free", F.min(free).over(W.partitionBy())["level"])
    return named.select("source", "source_size", F.when(F.col("_free").isNull(), F.col("_cap").cast("double")).otherwise(F.least(F.col("_cap").cast("double"), F.col("_free") * F.col("_w"))).alias("target"))


def block_words(total: int) -> int:
    """Words of a block: about 65,536 slots to a mix, blocks of 16 to 65,536 words."""
    return max(16, min(65536, total // 65536))


def schedule(spark, sources: DataFrame, slots: int) -> DataFrame:
    """(slot, source, k): the source of every slot, and the slot's rank among those of its source."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    upto = F.sum("target").over(order) / F.sum("target").over(W.partitionBy())
    shares = sources.where(F.col("target") > 0).select("source", upto.alias("_upto"))
    shares = shares.select("source", F.coalesce(F.lag("_upto").over(order), F.lit(0.0)).alias("_from"), F.when(F.lead("_upto").over(order).isNull(), 2.0).otherwise(F.col("_upto")).alias("_upto"))
    cell = lambda c: F.least(F.floor(c * CELLS), F.lit(CELLS - 1)).cast("int")
    shares = shares.select("*", F.explode(F.sequence(cell(F.col("_from")), cell(F.least(F.col("_upto"), F.lit(1.0))))).alias("_cell"))
    points = spark.range(slots).select(F.col("id").alias("slot"), golden_point(F.col("id") + 1).alias("_u")).withColumn("_cell", cell(F.col("_u")))
    given = points.join(shares, "_cell").where((F.col("_u") >= F.col("_from")) & (F.col("_u") < F.col("_upto")))
    return gapless_rank(given.select("slot", "source"), ["source"], ["slot"], "k", bucket=F.floor(F.col("slot") * 1024 / max(slots, 1)).cast("int"))


def mix_pieces(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3) -> tuple[DataFrame, DataFrame]:
    """(stream, pieces): what every document offers, and the mix itself.

    stream: doc_id, source, size, offset (words before it in its source's shuffled order), source_size, target.
    pieces: slot, doc_id, source, offset, epoch, first, length: slot ``slot`` of the mix holds ``length`` words of the document
    from its word ``first`` on.  A source's documents follow each other by a hash of their ids, the same in each epoch.
    """
    sized = durable(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    by_source = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    sources = durable(targets(by_source, weights, max_epochs), "mix-targets")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    b = block_words(total)
    slots = durable(schedule(docs.sparkSession, sources, -(-total // b)), "mix-slots")
    last = slots.groupBy(F.col("source").alias("_s")).agg(F.max("k").alias("_last"))
    per_source = sources.join(last, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    stream = gapless_rank(sized, ["source"], ["doc_id", "size"], "offset", weight="size", carry=per_source)
    stream = durable(stream, "mix-stream")
    turns = stream.where((F.col("size") > 0) & F.col("_last").isNotNull()).select("*", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("epoch"))
    turns = turns.withColumn("_at", F.col("epoch") * F.col("source_size") + F.col("offset")).where(F.col("_at") < (F.col("_last") + 1) * b)
    block = lambda c: F.floor(c / F.lit(b)).cast("long")
    blocks = turns.select("*", F.explode(F.sequence(block(F.col("_at")), F.least(block(F.col("_at") + F.col("size") - 1), F.col("_last")))).alias("_k"))
    first = F.greatest(F.col("_at"), F.col("_k") * b)
    blocks = blocks.select("doc_id", "source", "offset", "epoch", "_k", (first - F.col("_at")).alias("first"), (F.least(F.col("_at") + F.col("size"), (F.col("_k") + 1) * b) - first).alias("length"))
    s = slots.select("slot", F.col("source").alias("_s"), "k")
    pieces = blocks.join(s, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_k") == F.col("k")))
    return stream.drop("_last"), pieces.select("slot", "doc_id", "source", "offset", "epoch", "first", "length")


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """Per document: doc_id, source, size (words), source_size, target (words its source should give), taken (words the mix takes).

    Null text has size 0; a document without words is never taken.  A null source is a source.  Repeated rows are
    documents of their own.  Of an empty table nothing is taken.  Reruns give the same rows.
    """
    stream, pieces = mix_pieces(docs, weights, max_epochs)
    # An offset belongs to one document with words; those without words need no look at the mix.
    taken = pieces.groupBy(F.col("source").alias("_s"), F.col("offset").alias("_o")).agg(F.sum("length").cast("long").alias("taken"))
    with_words = stream.where("size > 0").join(taken, F.col("source").eqNullSafe(F.col("_s")) & (F.col("offset") == F.col("_o")), "left")
    out = with_words.drop("_s", "_o").unionByName(stream.where("size = 0").withColumn("taken", F.lit(0).cast("long")))
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "offset")


def take_mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """The mixed documents with the columns of ``docs``: a row for each epoch that takes a document.

    Where the mix ends inside a document (at most once a source) its row holds the words taken, joined by spaces.  Documents without words (null, empty)
    are never taken; a null source is a source; repeated rows are documents of their own; an empty table gives an empty one.  Columns may have any names.
    """
    mixed = mix_documents(docs, weights, max_epochs).where("taken > 0").select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_z"), "taken", F.row_number().over(W.partitionBy("doc_id", "source", "size").orderBy("offset")).alias("_n"))
    own = docs.select(whole_row(docs).alias("_row"), "doc_id", "source", "text", word_count(F.col("text")).alias("_z0"))
    own = own.withColumn("_n0", F.row_number().over(W.partitionBy("doc_id", "source", "_z0").orderBy("text")))
    on = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("_z0") == F.col("_z")) & (F.col("_n0") == F.col("_n"))
    drawn = own.join(mixed, on).withColumn("_left", F.explode(F.transform(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("_z")).cast("int") - 1), lambda e: F.col("taken") - e * F.col("_z"))))
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.col("_left").cast("int")), " ")
    text = F.when(F.col("_left") >= F.col("_z"), F.col("text")).otherwise(part)
    drawn = drawn.select("_row", text.alias("_taken_text"))
    new = {"text": F.col("_taken_text"), "n_chars": F.length("_taken_text").cast("long")}
    return drawn.select([new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
