"""Best-fit packing of token sequences in bulk-synchronous rounds.

Documents and gaps are sorted by length.  Documents of one length are interchangeable, and so are gaps of one size, so the tables
that a round sorts are run-length coded: they have at most ``capacity`` runs of documents and a few thousand of gaps, however large the
corpus is.  A round takes a class of the longest documents left and

* sweeps documents and gaps, sorted together, for the successor of each length (the smallest gap that holds it);
* resolves conflicts by rank: the documents that ask for the same gaps line up by length and rank, and those that come
  too late move on to the next larger gaps, as far as the running maximum of what was asked before pushes them;
* cuts the line at the borders of gaps and of lengths, which gives every range of ranks its range of sequences;
* puts the gaps back with what is left of them.

The largest gaps are the sequences not begun yet, so every document of a class finds a gap.  Rounds go on until no class is left.
Ranks among the documents of a length come from a distributed sweep over all documents, and one lookup then places every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidesearch.llm.shared import durable, gapless_rank
from tidesearch.llm.tokens import ids_crc32, token_batches

CAPACITY = 2048
#: A class of lengths is at most this part of the capacity wide: more levels are more rounds, and sequences nearer to those of one document at a time.
LEVELS = 32
#: Sequences not begun yet.
ENDLESS = 1 << 44
PIECE = ["doc_id", "piece", "start", "length", "ids_crc32"]


def length_classes(lengths: list[int], capacity: int = CAPACITY, levels: int = LEVELS) -> list[tuple[int, int]]:
    """(shortest, longest) of each round's documents, longest first: lengths that differ by less than ``capacity / levels``, by a factor below two, and,
    of long ones, that fit equally often in a sequence."""
    out: list[tuple[int, int]] = []
    for n in sorted(lengths, reverse=True):
        top = out[-1][1] if out else 0
        if out and top - n < capacity / levels and 2 * n > top and (16 * top < capacity or capacity // n == capacity // top):
            out[-1] = (n, top)
        else:
            out.append((n, n))
    return out


#: One round.  Its tables are run-length coded and so small that one task sorts them; what is large, the documents, is only ranked and looked up.
ROUND = """
WITH runs AS (SELECT length AS size, 0 AS kind, n, 0L AS seq FROM {docs} UNION ALL SELECT size, 1, n, seq FROM {gaps}),
  sides AS (SELECT /*+ COALESCE(1) */ * FROM runs),
  sided AS (SELECT *, IF(kind = 1, greatest(1, size div max(IF(kind = 0, size, NULL)) OVER ()), 0) AS side FROM sides),
  -- Successors: documents and gaps in one order, of equal size the document first.  The places in smaller gaps lie before the successor.
  swept AS (SELECT *, coalesce(sum(IF(kind = 0, n, 0)) OVER w, 0) AS ahead, coalesce(sum(n * side) OVER w, 0) AS at FROM sided WINDOW w AS (ORDER BY size, kind, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  -- Conflicts: a document stands behind all shorter ones, and not before its successor.
  lined AS (SELECT *, IF(kind = 1, at, ahead + max(IF(kind = 0, at - ahead, NULL)) OVER (ORDER BY size, kind, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS start FROM swept),
  -- Cuts of the line: a length begins or ends, or a run of gaps begins.
  cuts AS (SELECT cut.* FROM lined LATERAL VIEW explode(IF(kind = 1,
      array(struct(start AS pos, 2 AS kind, CAST(NULL AS STRUCT<length: BIGINT, start: BIGINT>) AS doc, struct(size, seq, side, at, at + n * side AS til) AS gap)),
      array(struct(start AS pos, 1 AS kind, struct(size AS length, start) AS doc, NULL AS gap), struct(start + n AS pos, 0 AS kind, struct(0L AS length, start) AS doc, NULL AS gap)))) AS cut),
  spans AS (SELECT pos, lead(pos) OVER (ORDER BY pos, kind) AS next, last(doc, true) OVER (ORDER BY pos, kind) AS doc, last(gap, true) OVER (ORDER BY pos, kind) AS gap FROM cuts),
  parts AS (SELECT coalesce(doc.length, 0) AS length, pos - doc.start AS rank, gap.size, gap.seq, gap.side, pos - gap.at AS a, coalesce(next, gap.til) - gap.at AS b FROM spans WHERE coalesce(next, gap.til) > pos),
  -- A part fills gaps, of which it may share the first and the last with other parts; one without documents (length 0) leaves whole gaps as they are.
  filled AS (SELECT length, rank + p.skip AS rank, p.n, seq + p.gap AS seq, p.gaps, side, size FROM parts LATERAL VIEW explode(CASE
      WHEN length = 0 THEN array(struct((a + side - 1) div side AS gap, b div side - (a + side - 1) div side AS gaps, b div side - (a + side - 1) div side AS n, 0L AS skip))
      WHEN a div side = b div side THEN array(struct(a div side AS gap, 1L AS gaps, b - a AS n, 0L AS skip))
      ELSE array(struct(a div side AS gap, 1L AS gaps, IF(a % side > 0, side - a % side, 0L) AS n, 0L AS skip),
        struct((a + side - 1) div side AS gap, b div side - (a + side - 1) div side AS gaps, (b div side - (a + side - 1) div side) * side AS n, (a + side - 1) div side * side - a AS skip),
        struct(b div side AS gap, 1L AS gaps, b % side AS n, b div side * side - a AS skip)) END) AS p WHERE p.n > 0),
  inside AS (SELECT *, coalesce(sum(length * n) OVER (PARTITION BY seq ORDER BY length, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
      lead(seq) OVER (PARTITION BY seq ORDER BY length, rank) IS NULL AS last FROM filled)
SELECT state.* FROM inside LATERAL VIEW explode(filter(array(
    IF(length > 0, struct(length, rank, n, seq, side, {capacity} - size + used AS offset, CAST(NULL AS BIGINT) AS size), NULL),
    IF(last AND size * gaps > used * gaps + length * n, struct(CAST(NULL AS BIGINT) AS length, CAST(NULL AS BIGINT) AS rank, gaps AS n, seq, CAST(NULL AS BIGINT) AS side, CAST(NULL AS BIGINT) AS offset, size - used - length * n div gaps AS size), NULL)), x -> x IS NOT NULL)) AS state
"""


def match_rounds(counts: DataFrame, capacity: int = CAPACITY, levels: int = LEVELS) -> DataFrame:
    """(length, rank, n, seq, side, offset): all matches for documents (length, n), by rounds; each is written before the next begins.

    A match puts documents ``rank`` to ``rank + n - 1`` of a length, ``side`` of them to a sequence, in sequences from ``seq`` on, the first at
    ``offset``.  Between rounds a run of gaps is ``n`` sequences from ``seq`` on with ``size`` tokens free.
    """
    spark = counts.sparkSession
    lengths = [r[0] for r in counts.select("length").collect()]  # at most `capacity` rows
    gaps, done = spark.range(1).selectExpr(f"{capacity}L AS size", "0L AS seq", f"{ENDLESS}L AS n").coalesce(1), []
    for shortest, longest in length_classes(lengths, capacity, levels):
        docs = counts.where(F.col("length").between(shortest, longest)).coalesce(1)
        state = durable(spark.sql(ROUND, docs=docs, gaps=gaps, capacity=capacity), "pack-round")
        done.append(state.where("length is not null").drop("size"))
        gaps = state.where("length is null").select("size", "seq", "n").coalesce(1)
    if not done:
        return spark.createDataFrame([], "length long, rank long, n long, seq long, side long, offset long")
    return reduce(DataFrame.unionByName, done)


def cut(docs: DataFrame, path: str, keep: list[str], capacity: int = CAPACITY) -> DataFrame:
    """``keep``, piece, start, length, ids_crc32 of each piece: longer documents are cut so that all pieces but the first are full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in token_batches(batches, path, keep):
            rows, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(b.column(len(keep))):
                ids = np.frombuffer(t.as_buffer(), dtype="<u2")
                at, k = 0, 0
                while at < len(ids):
                    n = (len(ids) - at - 1) % capacity + 1 if not k else capacity
                    rows.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(n)
                    crc.append(ids_crc32(ids[at : at + n]))
                    at, k = at + n, k + 1
            own = [b.column(c).take(pa.array(rows, pa.int64())) for c in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], [*keep, "piece", "start", "length", "ids_crc32"])

    rows = docs.select(*keep, F.col("text").alias("_text"))
    kinds = "".join(f"`{c}` {t}, " for c, t in rows.dtypes[:-1])
    return rows.mapInArrow(run, f"{kinds}piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document.

    A null or empty text is the end id alone.  Repeated rows are documents of their own.  An empty table gives an empty result.
    """
    cut_rows = durable(cut(docs, path, ["doc_id"], capacity), "pack-pieces")
    counts = durable(cut_rows.groupBy("length").agg(F.count("*").alias("n")).coalesce(1), "pack-lengths")  # at most `capacity` rows
    # One number orders the ranks of all lengths; a match is found by its first rank.  Matches are runs, so their number is bounded like lengths and gaps.
    plan = np.array([tuple(r) for r in match_rounds(counts, capacity).collect()], dtype=np.int64).reshape(-1, 6)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    key, first, sequence, side, offset = (plan[:, 0] << 48) + plan[:, 1], plan[:, 1], plan[:, 3], plan[:, 4], plan[:, 5]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            at = np.searchsorted(key, (length << 48) + rank, side="right") - 1
            k = rank - first[at]
            own = [b.column(b.schema.get_field_index(c)) for c in PIECE]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sequence[at] + k // side[at]), pa.array(offset[at] + k % side[at] * length)], [*PIECE, "sequence_id", "offset"])

    ranked = gapless_rank(cut_rows, ["length"], ["doc_id", "piece", "ids_crc32"], "_rank")
    kinds = ", ".join(f"`{c}` {t}" for c, t in cut_rows.select(*PIECE).dtypes)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")
