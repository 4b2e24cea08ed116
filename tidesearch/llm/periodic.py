"""Periodic runs of words, found on a grammar made by recompression.

The words of many texts, one after the other with a symbol of its own between two, are compressed in alternating rounds: a round of blocks
replaces every stretch of one symbol by a symbol for (symbol, length); a round of pairs deals the symbols at random into left and right
ones and replaces every left one with a right one behind it.  The rounds, kept from the words up to a round whose symbols all differ, are a
run-length grammar of the text.  Equal stretches are cut alike but at their ends, so the longest common extension of two places is found by
going up the rounds while their symbols agree and down again where they do not, a step or two a round; in either direction, many pairs of places at once.

A run of period p and length 4p or more holds a place i with i + 3p, for some i on the grid of multiples of 3p, that agrees with i + p.  So for
every p those places are tried (harmonically fewer for larger p), and their exact extensions are the runs.  No suffix array is needed.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text that one grammar holds (a longer text has one of its own), and grid places that are tried at once.
GRAMMAR_BYTES, PLACES = 1 << 21, 1 << 20
BLOCKS, PAIRS = 0, 1


class Grammar:
    """The rounds of a recompressed sequence; ``text``'s first and last symbol must occur nowhere else."""

    def __init__(self, text: np.ndarray, seed: int = 11):
        _, first = np.unique(text, return_inverse=True)
        self.symbols = [first.astype(np.int64)]
        self.begin: list[np.ndarray] = []  # of a round's symbol: its first part in the round below; one more at the end
        self.up: list[np.ndarray] = []  # of a part: the symbol that holds it
        self.kind: list[int] = []
        rng, kinds = np.random.default_rng(seed), int(first.max()) + 1
        while kinds < len(s := self.symbols[-1]):
            same = s[1:] == s[:-1]
            if same.any():
                kind, new = BLOCKS, np.append(True, ~same)
            else:
                kind, right = PAIRS, rng.random(kinds) < 0.5
                joined = ~right[s[:-1]] & right[s[1:]]
                if not joined.any():
                    continue
                new = np.append(True, ~joined)
            begin = np.append(np.flatnonzero(new), len(s))
            size = np.diff(begin)
            second = np.where(size > 1, size if kind == BLOCKS else s[np.minimum(begin[:-1] + 1, len(s) - 1)] + 2, 0)
            distinct, named = np.unique(s[begin[:-1]] * (int(second.max()) + 1) + second, return_inverse=True)
            self.kind.append(kind)
            self.begin.append(begin.astype(np.int32))
            self.up.append((np.cumsum(new) - 1).astype(np.int32))
            self.symbols.append(named)
            kinds = len(distinct)

    def extend(self, a: np.ndarray, b: np.ndarray, forward: bool = True) -> np.ndarray:
        """How many symbols agree from the places ``a`` and ``b`` on, these included; backwards: going to smaller places.  Never a[i] == b[i]."""
        step = 1 if forward else -1
        start, row = a, np.arange(len(a))
        stopped: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def whole(k: int, x: np.ndarray) -> np.ndarray:
            """Whether a part is the first (backwards: last) of its symbol."""
            return self.begin[k][self.up[k][x]] == x if forward else self.begin[k][self.up[k][x] + 1] - 1 == x

        def left(k: int, x: np.ndarray) -> np.ndarray:
            """Parts of its symbol from a part on."""
            return self.begin[k][self.up[k][x] + 1] - x if forward else x - self.begin[k][self.up[k][x]] + 1

        def agree(k: int, a: np.ndarray, b: np.ndarray, some: np.ndarray) -> np.ndarray:
            """Parts to pass where the parts are equal (``some``) and symbols end: one of a pair, of blocks what both have left."""
            return np.where(some, 1 if self.kind[k] == PAIRS else np.minimum(left(k, a), left(k, b)), 0).astype(np.int32)

        a, b = a.astype(np.int32), b.astype(np.int32)
        for k, s in enumerate(self.symbols):
            differ = s[a] != s[b]
            stopped.append((row[differ], a[differ], b[differ]))
            row, a, b = row[~differ], a[~differ], b[~differ]
            if k == len(self.kind) or not len(row):
                break
            passed = agree(k, a, b, ~(whole(k, a) & whole(k, b)))
            a, b = a + step * passed, b + step * passed
            apart = s[a] != s[b]  # blocks of different length, or what follows a pair
            ends = apart & ~(whole(k, a) & whole(k, b))
            stopped[-1] = tuple(np.concatenate([x, y[ends]]) for x, y in zip(stopped[-1], (row, a, b)))
            row, a, b = row[~ends], self.up[k][a[~ends]], self.up[k][b[~ends]]
        out = np.zeros(len(start), dtype=np.int64)
        row, a, b = stopped.pop()
        for k in range(len(stopped) - 1, -1, -1):
            s = self.symbols[k]
            if forward:
                a, b = self.begin[k][a], self.begin[k][b]
            else:
                a, b = self.begin[k][a + 1] - 1, self.begin[k][b + 1] - 1
            if len(row):
                passed = agree(k, a, b, s[a] == s[b])
                a, b = a + step * passed, b + step * passed
            row, a, b = (np.concatenate([x, y]) for x, y in zip((row, a, b), stopped[k]))
        out[row] = np.abs(a - start[row])
        return out


def grid(first: np.ndarray, words: np.ndarray, text: np.ndarray, repeats: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text's number, place, period) of the grid places whose word is that a period on; ``first``: place of each text's first word."""
    most = words // repeats
    number = np.repeat(np.arange(len(words)), most)
    period = np.arange(len(number)) - np.repeat(np.cumsum(most) - most, most) + 1
    tries = (words[number] - 1 - period) // ((repeats - 1) * period) + 1
    ends = np.cumsum(tries)
    at = 0
    while at < len(number):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PLACES, side="right")))
        n = tries[at:stop]
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        p = np.repeat(period[at:stop], n)
        d = np.repeat(number[at:stop], n)
        i = first[d] + k * (repeats - 1) * p
        hit = text[i] == text[i + p]
        yield d[hit], i[hit], p[hit]
        at = stop


def find_runs(ids: np.ndarray, words: np.ndarray, least: int = 6, repeats: int = 4) -> np.ndarray:
    """(text's number, start, length, period) of every run, by text, start and period; ``ids``: the words of all texts, ``words``: how many each has."""
    ends = np.cumsum(words)
    apart = np.append(ends - words, ends[-1]) + np.arange(len(words) + 1)  # places of the symbols between texts
    text = np.empty(len(ids) + len(words) + 1, dtype=np.int64)
    inner = np.ones(len(text), dtype=bool)
    inner[apart] = False
    text[inner] = ids
    text[apart] = -1 - np.arange(len(apart))
    first = apart[:-1] + 1
    grammar, found = None, [np.zeros((0, 4), dtype=np.int64)]
    for d, i, p in grid(first, words, text, repeats):
        if len(i):
            grammar = grammar or Grammar(text)
            right = grammar.extend(i, i + p)
            most = grammar.extend(i - 1, i + p - 1, forward=False)
            length = most + right + p
            long = length >= np.maximum(least, repeats * p)
            rows = np.stack([d, i - most - first[d], length, p], axis=1)[long]
            found.append(np.unique(rows, axis=0))
    runs = np.unique(np.concatenate(found), axis=0)
    # A run of period q is found for multiples of q as well.
    return runs[np.append(True, (runs[1:, :3] != runs[:-1, :3]).any(axis=1))] if len(runs) else runs


def planted(n: int, doc_id: int | None, share: int = 10, base: int = 3, wide: int = 8) -> np.ndarray | None:
    """Which original word stands at each of ``n`` places of a document that gets a periodic end; nothing for others."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % share or not n:
        return None
    g = h // share
    a = g % n
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % (1 + (n - a) // (base + g % wide)))


def periodic_runs(docs: DataFrame, least: int = 6, repeats: int = 4, plant: bool = True, spans: bool = False) -> DataFrame:
    """doc_id, n_runs, the longest run's start, length, period, exponent_milli, and digests of all runs and of the text without repetitions.

    A run is a stretch of words of smallest period q, ``least`` words and ``repeats`` periods long at least, that cannot be extended.  With
    ``plant`` a tenth of the documents, by id, get a periodic end first (a null id none).  With ``spans`` also ``runs`` (start, length, period) and ``collapsed``, the text.
    Null, empty and blank texts have no words and no runs; repeated rows are documents of their own; an empty table gives no rows; other columns are dropped.
    """
    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    schema += ", runs array<struct<start:long,length:long,period:long>>, collapsed string" if spans else ""
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def batch(keys: list, texts: list[bytes]) -> Iterator[tuple]:
        number: dict[bytes, int] = {}
        words, ids = [], []
        for key, text in zip(keys, texts):
            w = text.split()  # bytes: at space and tab to carriage return alone
            order = planted(len(w), key) if plant else None
            if order is not None:
                w = [w[k] for k in order.tolist()]
            ids += [number.setdefault(x, len(number)) for x in w]
            words.append(w)
        counts = np.array([len(w) for w in words])
        runs = find_runs(np.array(ids, dtype=np.int64), counts, least, repeats)
        edge = np.searchsorted(runs[:, 0], np.arange(len(words) + 1))
        for d, w in enumerate(words):
            mine = runs[edge[d] : edge[d + 1], 1:]
            if not len(mine):
                kept, best = b" ".join(w), (None,) * 4
            else:
                s, n, p = mine.T
                depth = np.zeros(len(w) + 1, dtype=np.int64)
                np.add.at(depth, s + p, 1)
                np.add.at(depth, s + n, -1)
                kept = b" ".join([w[k] for k in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()])
                top = np.lexsort((p, s, -n))[0]
                best = (int(s[top]), int(n[top]), int(p[top]), int(1000 * n[top] // p[top]))
            listed = b"".join(b"%d,%d,%d\n" % tuple(r) for r in mine.tolist())
            out = (keys[d], len(mine), *best, sha(listed), sha(kept))
            yield (*out, [dict(zip(("start", "length", "period"), r)) for r in mine.tolist()], kept.decode()) if spans else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = np.cumsum(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False))
            at = 0
            while at < b.num_rows:
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + GRAMMAR_BYTES, side="right")))
                some = b.slice(at, stop - at)
                rows = list(zip(*batch(some.column(0).to_pylist(), some.column(1).to_pylist())))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names)
                at = stop

    long, text = pa.int64(), pa.string()
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"] + (["runs", "collapsed"] if spans else [])
    types = [long] * 6 + [text] * 2 + ([pa.list_(pa.struct([(c, long) for c in ("start", "length", "period")])), text] if spans else [])
    whole = docs.selectExpr("doc_id", "cast(coalesce(text, '') as binary) as text")
    return whole.mapInArrow(run, schema)
