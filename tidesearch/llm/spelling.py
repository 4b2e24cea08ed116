"""Spelling variants: words one edit apart, grouped under the form that is far more frequent.

Letters are dealt into groups of about equal weight in the vocabulary.  A word's frequency vector is how many of its letters each group has, and
words are arranged in a trie by these counts, a level a group.  One inserted letter raises one count by one, a deleted one lowers one, a replaced one does both
or nothing; so the words near a given one are found by going down the trie with a budget of one surplus and one deficit.  Words at the leaves
reached are verified letter by letter.

Spark deals the trie out at its upper levels: a task has the subtree below one node and every word that reaches this node within the budget.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidesearch.llm.shared import durable, scratch

LETTERS = "A-Za-zÀ-ÿ"
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Levels of the trie, groups of twice the weight, levels that may be dealt out; words of one subtree that a task should have.
LEVELS, HEAVY, DEALT, SUBTREE = 15, 4, 5, 50_000
#: Distinct words a counting task holds before it hands their counts on; queries that go down the trie together; pairs verified together.
HELD, TOGETHER, PAIRS = 200_000, 4_096, 1 << 17


def count_words(docs: DataFrame, shortest: int = 7, share: int = 31, least: int = 2) -> DataFrame:
    """(word, n): runs of letters, A to Z in lower case, with a letter less in one of ``share`` (document, run) pairs; words of
    ``shortest`` letters that occur ``least`` times or more."""
    runs = re.compile(f"[{LETTERS}]{{{shortest},}}")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return rows

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                if text.is_valid:
                    mark = f"{key}:".encode()
                    for w, n in Counter(runs.findall(text.as_py().translate(LOWER))).items():
                        h = zlib.crc32(w.encode(), zlib.crc32(mark))
                        if h % share == 0:
                            at = h % len(w)
                            w = w[:at] + w[at + 1 :]
                        if len(w) >= shortest:
                            held[w] += n
                    if len(held) > HELD:
                        yield out()
        yield out()

    return docs.select("doc_id", "text").mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def letter_groups(words: DataFrame, levels: int = LEVELS) -> np.ndarray:
    """For each code point up to 255 the group of its letter, a level of the trie (level 0 counts all letters).

    The heaviest letter goes to the group that lacks most, again and again; the first ``HEAVY`` groups, by which the trie is dealt out, get twice the weight of others.
    Totals over all words are summed by Spark; there are as many rows as letters (90 at most)."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(256, dtype=np.int64)
        for b in batches:
            n += np.bincount(np.frombuffer("".join(b.column(0).to_pylist()).encode("latin-1"), np.uint8), minlength=256)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some], pa.int64())], ["letter", "n"])

    rows = words.select("word").mapInArrow(totals, "letter int, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect()
    group, weight = np.ones(256, dtype=np.int64), [0.0] * levels
    for r in sorted(rows, key=lambda r: (-r["n"], r["letter"])):
        g = min(range(1, levels), key=lambda k: (weight[k], k))
        group[r["letter"]] = g
        weight[g] += r["n"] / (2 if g <= HEAVY else 1)
    return group


def vectors(words: list[str], group: np.ndarray, levels: int = LEVELS) -> np.ndarray:
    """A row for each word: its length and the count of each group.

    Numbers beyond 255 are held as 255.  That brings two words nearer and never apart, so none is missed; they are told apart by their letters."""
    n = np.array([len(w) for w in words], dtype=np.int64)
    letters = group[np.frombuffer("".join(words).encode("latin-1"), np.uint8)]
    flat = np.bincount(np.repeat(np.arange(len(words)), n) * levels + letters, minlength=len(words) * levels).reshape(len(words), levels)
    flat[:, 0] = n
    return np.minimum(flat, 255)


def budgets(depth: int) -> np.ndarray:
    """How the first ``depth`` numbers may change on the way to a near word: for one of the same length nothing, a surplus, or a surplus and a deficit on a
    later level; for one that is longer nothing or a surplus.  Of two near words one reaches the other in this way; what is not spent yet is spent further down."""
    one = np.eye(depth, dtype=np.int64)
    spent = [0 * one[0], *one[1:]]
    both = [one[i] - one[j] for i in range(1, depth) for j in range(i + 1, depth)]
    return np.array(spent + both + [s + one[0] for s in spent])


class VectorTrie:
    """Words by their frequency vectors: a level's nodes are the distinct beginnings of the vectors, in order."""

    def __init__(self, counts: np.ndarray):
        self.order = np.lexsort(counts.T[::-1])
        node = np.zeros(len(counts), dtype=np.int64)
        self.keys = []  # a level's nodes as (parent, count)
        for level in counts[self.order].T:
            key = node * 256 + level
            new = np.append(True, key[1:] != key[:-1])
            self.keys.append(key[new])
            node = np.cumsum(new) - 1
        self.leaf = np.append(np.searchsorted(node, np.arange(len(self.keys[-1]))), len(counts))

    def reach(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, leaf, whether its counts are those of the query) of all leaves that a query reaches within its budget."""

        def down(k: int, front: tuple[np.ndarray, np.ndarray], change: int = 0) -> tuple[np.ndarray, np.ndarray]:
            q, node = front
            c = counts[q, k] + change
            key = node * 256 + c
            at = np.minimum(np.searchsorted(self.keys[k], key), len(self.keys[k]) - 1)
            there = np.flatnonzero((self.keys[k][at] == key) & (c >= 0) & (c < 256))
            return q[there], at[there]

        add = lambda *fronts: tuple(np.concatenate(x) for x in zip(*fronts))
        root = np.arange(len(counts)), np.zeros(len(counts), dtype=np.int64)
        none = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        # Same length: nothing spent, a surplus, both.  Longer: nothing yet, the surplus.
        same, plus, both, longer, done = down(0, root), none, none, down(0, root, 1), none
        for k in range(1, len(self.keys)):
            both = add(down(k, both), down(k, plus, -1))
            plus = add(down(k, plus), down(k, same, 1))
            done = add(down(k, done), down(k, longer, 1))
            same, longer = down(k, same), down(k, longer)
        q, leaf = add(same, plus, both, longer, done)
        return q, leaf, np.arange(len(q)) < len(same[0])

    def members(self, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``leaves``, word) for every word of each leaf."""
        n = self.leaf[leaves + 1] - self.leaf[leaves]
        at = np.repeat(np.arange(len(leaves)), n)
        return at, self.order[np.repeat(self.leaf[leaves] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced letter makes ``a`` to ``b``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


class Verifier:
    """``one_edit`` for many pairs of words at once."""

    WIDTH = 32

    def __init__(self, words: list[str]):
        self.words = words
        self.n = np.array([len(w) for w in words], dtype=np.int64)
        self.rows = np.zeros((len(words), self.WIDTH), dtype=np.uint8)
        flat = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        fits = at < self.WIDTH
        self.rows[np.repeat(np.arange(len(words)), self.n)[fits], at[fits]] = flat[fits]

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        swap = self.n[a] > self.n[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        x, y, more = self.rows[a], self.rows[b], self.n[b] - self.n[a]
        differ = x != y
        equal = differ.sum(axis=1)
        # After the first place that differs, what is left of the longer word without it must be the rest of the shorter one.
        shifted = (x[:, :-1] != y[:, 1:]) & (np.arange(self.WIDTH - 1) >= differ.argmax(axis=1)[:, None])
        out = np.where(more == 0, equal == 1, (more == 1) & ~shifted.any(axis=1))
        for k in np.flatnonzero(self.n[b] > self.WIDTH):
            out[k] = one_edit(self.words[a[k]], self.words[b[k]])
        return out


def subtree_matches(words: list[str], n: np.ndarray, counts: np.ndarray, stored: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, near words, the largest n of them, that word) of the near pairs of a word of ``asked`` and one of ``stored``, for both; numbers are places in ``words``."""
    total, best = np.zeros(len(words), dtype=np.int64), np.full(len(words), len(words))
    # The more frequent comes first, then the smaller: the least place is the best.
    place = np.empty(len(words), dtype=np.int64)
    by_place = np.array(sorted(range(len(words)), key=lambda k: (-n[k], words[k])), dtype=np.int64)
    place[by_place] = np.arange(len(words))
    trie, check = VectorTrie(counts[stored]), Verifier(words)
    for at in range(0, len(asked), TOGETHER):
        some = asked[at : at + TOGETHER]
        q, leaf, same = trie.reach(counts[some])
        size, k = np.cumsum(trie.leaf[leaf + 1] - trie.leaf[leaf]), 0
        while k < len(q):
            stop = max(k + 1, int(np.searchsorted(size, (size[k - 1] if k else 0) + PAIRS, side="right")))
            i, w = trie.members(leaf[k:stop])
            a, b = some[q[k:stop][i]], stored[w]
            once = ~same[k:stop][i] | (place[a] < place[b])  # two words of equal counts reach each other
            a, b = a[once], b[once]
            ok = check.near(a, b)
            a, b = np.concatenate([a[ok], b[ok]]), np.concatenate([b[ok], a[ok]])
            np.add.at(total, a, 1)
            np.minimum.at(best, a, place[b])
            k = stop
    hit = np.flatnonzero(total)
    top = by_place[best[hit]]
    return hit, total[hit], n[top], top


def near_words(words: DataFrame, levels: int = LEVELS, subtree: int = SUBTREE) -> DataFrame:
    """(word, n_near, best_n, best) of every word (word, n; unique) that has words one edit away: how many, and the most frequent of them, ties to the smaller.

    The depth at which the trie is dealt out is the least, up to ``DEALT``, whose largest subtree has at most ``subtree`` words.  Larger subtrees there
    are, with the queries that reach them, dealt out in blocks of words; nothing is left out.
    """
    group = letter_groups(words, levels)
    most = min(DEALT, levels)

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = vectors(b.column(0).to_pylist(), group, levels)[:, :most].astype(np.uint8) if b.num_rows else np.zeros((0, most), np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in c], pa.binary())], ["head"])

    heads = words.select("word").mapInArrow(head, "head binary").groupBy("head").agg(F.count("*").alias("n"))
    heads = durable(heads, "spelling-heads")
    sizes = {k: heads.groupBy(F.substring("head", 1, k).alias("node")).agg(F.sum("n").alias("n")) for k in range(1, most + 1)}
    largest = {k: sizes[k].agg(F.max("n")).first()[0] or 0 for k in range(1, most + 1)}
    depth = next((k for k in sorted(largest) if largest[k] <= subtree), most)
    # Nodes with more than `subtree` words: at most one for each `subtree` words of the vocabulary.
    blocks = {bytes(r["node"]): -(-r["n"] // subtree) for r in sizes[depth].where(F.col("n") > subtree).collect()} if largest[depth] > subtree else {}
    ways = budgets(depth)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A word for each node that it reaches; at its own node it is stored as well as asked."""
        for b in batches:
            names, n = b.column(0).to_pylist(), b.column(1)
            if not names:
                continue
            near = vectors(names, group, levels)[:, None, :depth] + ways[None]
            word, way = np.nonzero(((near >= 0) & (near < 256)).all(axis=2))
            nodes = [r.tobytes() for r in near[word, way].astype(np.uint8)]
            for part, key in _in_blocks(names, word, way, nodes, blocks):
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), b.column(0).take(part[0]), n.take(part[0]), part[1], part[2]], ["node", "word", "n", "stored", "asked"])

    def matched(t: pa.Table) -> pa.Table:
        names, n = t.column("word").to_pylist(), t.column("n").to_numpy()
        stored, asked = (np.flatnonzero(t.column(c).to_numpy(zero_copy_only=False)) for c in ("stored", "asked"))
        shape = ["word", "n_near", "best_n", "best"]
        if not len(stored):  # nobody is at home at this node
            return pa.table({c: pa.array([], pa.string() if c in ("word", "best") else pa.int64()) for c in shape})
        word, total, best_n, best = subtree_matches(names, n, vectors(names, group, levels), stored, asked)
        pick = lambda k: t.column("word").take(pa.array(k))
        return pa.table([pick(word), pa.array(total), pa.array(best_n), pick(best)], shape)

    spread = words.select("word", "n").mapInArrow(dealt, "node binary, word string, n long, stored boolean, asked boolean")
    met = spread.groupBy("node").applyInArrow(matched, "word string, n_near long, best_n long, best string")
    order = F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(order).alias("_b")).select("word", "n_near", (-F.col("_b.m")).alias("best_n"), F.col("_b.w").alias("best"))


def _in_blocks(names: list[str], word: np.ndarray, way: np.ndarray, nodes: list[bytes], blocks: dict[bytes, int]) -> Iterator[tuple[tuple[pa.Array, pa.Array, pa.Array], list[bytes]]]:
    """Rows (word, stored, asked) and their keys: node, block of stored words, block of asked words.

    A node that is not large and is reached by no large one is one task.  Else its stored words are in blocks, each repeated for every block of asked
    ones, and asked ones, in as many blocks as the largest node that they come from, are repeated for every block of stored words.
    """
    own = way == 0
    if not blocks:
        yield (pa.array(word), pa.array(own), pa.array(np.ones(len(word), dtype=bool))), nodes
        return
    depth = len(nodes[0])
    ways = budgets(depth)

    def around(node: bytes) -> int:
        near = np.frombuffer(node, np.uint8).astype(np.int64) - ways
        return max(blocks.get(r.astype(np.uint8).tobytes(), 1) for r in near[((near >= 0) & (near < 256)).all(axis=1)])

    known: dict[bytes, int] = {}
    rows: list[tuple[int, bool, bool]] = []
    keys: list[bytes] = []
    for w, mine, node in zip(word.tolist(), own.tolist(), nodes):
        b = blocks.get(node, 1)
        a = known.get(node) or known.setdefault(node, around(node))
        h = zlib.crc32(names[w].encode())
        for i in range(b):
            rows.append((w, False, True))
            keys.append(node + b"%d,%d" % (i, h % a))
        if mine:
            for j in range(a):
                rows.append((w, True, False))
                keys.append(node + b"%d,%d" % (h % b, j))
    w, s, q = zip(*rows)
    yield (pa.array(w, pa.int64()), pa.array(s), pa.array(q)), keys


def follow(forms: DataFrame) -> DataFrame:
    """(word, root) for a table (word, form) in which no word leads back to itself: from a word, forms to the last.

    Each round doubles the way that is followed, so a way of 18 forms, the most that tenfold counts in 64 bits allow, takes five."""
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = durable(at.join(step, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "spelling-roots")
        at = moved.select("word", "root")
        if moved.where("_moved").isEmpty():
            return at


def spelling_forms(docs: DataFrame, shortest: int = 7, share: int = 31, least: int = 2, times: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word (see ``count_words``).

    Words are near if one letter inserted, deleted or replaced makes one the other.  A word's form is its most frequent near word (ties to the smaller) if that is
    ``times`` as frequent or more; its root is the last form on the way from it, or itself.  A null or empty text has no words; a null id counts as "None"; repeated rows
    count each; an empty table gives no words; other columns are dropped.
    """
    with scratch(docs.sparkSession):
        words = durable(count_words(docs, shortest, share, least), "spelling-words")
        near = near_words(words)
        better = F.col("best_n") >= times * F.col("n")
        found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(better, F.col("best")).alias("form"), F.when(better, F.col("best_n")).alias("form_n"))
        found = durable(found, "spelling-forms")
        roots = follow(found.where("form is not null").select("word", "form"))
        out = found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        return durable(out, "spelling-out", keep=True)
