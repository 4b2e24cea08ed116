"""Which terms of a vocabulary texts hold, as substrings or by all of their words: many texts at once in numpy.

A run of letters has a number that follows from sums over the letters before its ends, whatever its length.  A text meets a term where it has the term's rarest run of ``SIZE`` letters, and where it
has the rarest of the term's words (rarest among the terms); there the number of the whole term, or the other words, are looked for.  Different runs may have one number, so what is found is compared letter by letter.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Letters of the runs that terms are looked for by (a shorter term is one run), and letters of texts that are searched at once.
SIZE, CHUNK = 5, 1 << 20
#: The base of the numbers, odd, and its inverse modulo 2 ** 64.
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)
CODES = 0x110000


def word_letters(spark: SparkSession) -> np.ndarray:
    """For each code point whether it is a letter of words, as Spark's regular expressions have it."""
    planes = [(k, "".join(" " if 0xD800 <= c < 0xE000 else chr(c) for c in range(k, k + (1 << 16)))) for k in range(0, CODES, 1 << 16)]
    rows = spark.createDataFrame(planes, "k int, letters string").select("k", F.regexp_replace("letters", r"[^\p{L}\p{N}_]", " ").alias("letters")).collect()
    return _codes("".join(r["letters"] for r in sorted(rows))) != ord(" ")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _spread(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, value) for each value of the ranges."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) + np.repeat(start - (np.cumsum(count) - count), count)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.cumprod(p, dtype=np.uint64)


class _Sums:
    """Letters with the numbers of their runs."""

    def __init__(self, letters: np.ndarray, powers: np.ndarray, inverse: np.ndarray) -> None:
        self.letters, self.inverse = letters, inverse
        self.sums = np.zeros(len(letters) + 1, np.uint64)
        np.cumsum((letters + np.uint32(1)) * powers[: len(letters)], dtype=np.uint64, out=self.sums[1:])

    def runs(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        n = (self.sums[start + length] - self.sums[start]) * self.inverse[start]
        return n ^ n >> np.uint64(32)

    def all_runs(self, size: int) -> np.ndarray:
        n = (self.sums[size:] - self.sums[:-size]) * self.inverse[: len(self.letters) - size + 1]
        n ^= n >> np.uint64(32)
        return n

    def same(self, start: np.ndarray, other: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the runs are those of so many letters (one at least) in another array."""
        if not len(start):
            return np.zeros(0, bool)
        owner, place = _spread(start, length)
        equal = self.letters[place] == other[place + (at - start)[owner]]
        return np.logical_and.reduceat(equal, np.cumsum(length) - length)


class _Numbers:
    """A sorted array of numbers, and for each of them the entries of a list."""

    def __init__(self, numbers: np.ndarray, *entries: np.ndarray) -> None:
        order = np.argsort(numbers, kind="stable")
        self.numbers, first, self.count = np.unique(numbers[order], return_index=True, return_counts=True)
        self.first, self.entries = first.astype(np.int64), tuple(e[order] for e in entries)
        self.mask = None

    def find(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, numbers of the entries): the numbers that are known, once for each of their entries."""
        if self.mask is None:  # in the task, as it is larger than the numbers
            self.mask = np.zeros(1 << min(22, max(12, (64 * len(self.numbers)).bit_length())), bool)
            self.mask[(self.numbers & np.uint64(len(self.mask) - 1)).view(np.int64)] = True
        place = np.flatnonzero(self.mask[(numbers & np.uint64(len(self.mask) - 1)).view(np.int64)])
        numbers = numbers[place]
        found = np.minimum(np.searchsorted(self.numbers, numbers), len(self.numbers) - 1)
        known = self.numbers[found] == numbers
        place, found = place[known], found[known]
        owner, entry = _spread(self.first[found], self.count[found])
        return place[owner], entry

    def __getstate__(self) -> dict:
        return self.__dict__ | {"mask": None}


class TermFinder:
    """``terms`` are different and not empty; ``words`` are those of each term; ``wordy`` tells letters of words."""

    def __init__(self, terms: Sequence[str], words: Sequence[Sequence[str]], wordy: np.ndarray) -> None:
        self.terms, self.wordy, self.powers = len(terms), wordy, None
        self.text = _codes("".join(terms))
        self.length = np.array([len(t) for t in terms], np.int64)
        self.at = np.cumsum(self.length) - self.length
        sums = self._sums(self.text)
        self.number = sums.runs(self.at, self.length)
        self.grams: dict[int, _Numbers] = {}
        for size in sorted(set(np.minimum(self.length, SIZE).tolist())):
            mine = np.flatnonzero(np.minimum(self.length, SIZE) == size)
            owner, place = _spread(self.at[mine], self.length[mine] - size + 1)
            gram = sums.runs(place, np.full(len(place), size))
            _, which, often = np.unique(gram, return_inverse=True, return_counts=True)
            score = often[which] << 33 | place  # the rarest, and of these the first
            least = np.minimum.reduceat(score, np.flatnonzero(np.diff(owner, prepend=-1))) & (1 << 33) - 1
            self.grams[size] = _Numbers(sums.runs(least, np.full(len(least), size)), mine, least - self.at[mine])
        # Words: terms with a word that no text can have are found as substrings alone.
        own = [(t, list(dict.fromkeys(w))) for t, w in enumerate(words)]
        own = [(t, w) for t, w in own if w and wordy[_codes("".join(w))].all()]
        often: dict[str, int] = {}
        for _, w in own:
            for x in w:
                often[x] = often.get(x, 0) + 1
        known = {w: k for k, w in enumerate(often)}
        self.words = len(known)
        self.word_text = _codes("".join(known))
        self.word_length = np.array([len(w) for w in known], np.int64)
        self.word_at = np.cumsum(self.word_length) - self.word_length
        self.word = _Numbers(self._sums(self.word_text).runs(self.word_at, self.word_length), np.arange(self.words)) if known else None
        lists = [[known[x] for x in sorted(w, key=lambda x: (often[x], -len(x), x))] for _, w in own]
        keys = np.array([k[0] for k in lists], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keyed = np.array([t for t, _ in own], np.int64)[order]  # terms by their rarest word
        self.keyed_count = np.bincount(keys, minlength=self.words)
        self.keyed_first = np.cumsum(self.keyed_count) - self.keyed_count
        self.others = np.zeros(self.terms, np.int64)  # how many other words a term has, and from where on they are
        self.others[[t for t, _ in own]] = [len(k) - 1 for k in lists]
        self.other_first = np.cumsum(self.others) - self.others
        self.other = np.array([x for k in lists for x in k[1:]], np.int64)

    def _sums(self, letters: np.ndarray) -> _Sums:
        if self.powers is None or len(self.powers[0]) <= len(letters):
            self.powers = tuple(_powers(b, max(CHUNK, len(letters)) + 1) for b in (BASE, INVERSE))
        return _Sums(letters, *self.powers)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"powers": None}

    def find(self, texts: pa.Array) -> pa.Array:
        """For each text the terms in it, in ascending order, as twice the term's place, plus one if it is a substring."""
        lengths = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        before, at, owners, found = np.append(0, np.cumsum(lengths)), 0, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while at < len(texts) and self.terms:
            stop = max(at + 1, int(np.searchsorted(before, before[at] + CHUNK, side="right")) - 1)
            sums = self._sums(_codes("".join(t or "" for t in texts[at:stop].to_pylist())))
            start = before[at:stop] - before[at]
            whole, said = self._whole(sums, start + lengths[at:stop]), self._said(sums, start, start + lengths[at:stop])
            own, term = np.divmod(np.union1d(whole, said), self.terms)
            owners.append(own + at)
            found.append(2 * term + np.isin(own * self.terms + term, whole))
            at = stop
        ends = np.append(0, np.cumsum(np.bincount(np.concatenate(owners), minlength=len(texts))))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found), pa.int64()))

    def _whole(self, sums: _Sums, end: np.ndarray) -> np.ndarray:
        """Texts and the terms that are substrings of them, as one number."""
        pairs = [np.zeros(0, np.int64)]
        for size, grams in self.grams.items():
            if len(sums.letters) >= size:
                place, entry = grams.find(sums.all_runs(size))
                term, start = grams.entries[0][entry], place - grams.entries[1][entry]
                inside = (start >= 0) & (start + self.length[term] <= len(sums.letters))
                term, start = term[inside], start[inside]
                alike = sums.runs(start, self.length[term]) == self.number[term]
                term, start = term[alike], start[alike]
                own = np.searchsorted(end, start, side="right")
                good = (start + self.length[term] <= end[own]) & sums.same(start, self.text, self.at[term], self.length[term])
                pairs.append(own[good] * self.terms + term[good])
        return np.unique(np.concatenate(pairs))

    def _said(self, sums: _Sums, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Texts and the terms all of whose words they have, as one number."""
        if not self.words or not len(sums.letters):
            return np.zeros(0, np.int64)
        wordy = self.wordy[sums.letters]
        first, last = wordy.copy(), wordy.copy()
        first[1:] &= ~wordy[:-1]
        last[:-1] &= ~wordy[1:]
        some = start[start < end]
        first[some], last[some[1:] - 1] = wordy[some], wordy[some[1:] - 1]  # a word ends where its text ends
        begin = np.flatnonzero(first)
        length = np.flatnonzero(last) + 1 - begin
        place, entry = self.word.find(sums.runs(begin, length))
        begin, length, word = begin[place], length[place], self.word.entries[0][entry]
        alike = length == self.word_length[word]
        begin, length, word = begin[alike], length[alike], word[alike]
        good = sums.same(begin, self.word_text, self.word_at[word], length)
        have = np.unique(np.searchsorted(end, begin[good], side="right") * self.words + word[good])
        own, word = np.divmod(have, self.words)
        owner, entry = _spread(self.keyed_first[word], self.keyed_count[word])
        own, term, done, k = own[owner], self.keyed[entry], [], 0
        while len(term):
            more = self.others[term] > k
            done.append(own[~more] * self.terms + term[~more])
            own, term = own[more], term[more]
            wanted = own * self.words + self.other[self.other_first[term] + k]
            has = have[np.minimum(np.searchsorted(have, wanted), len(have) - 1)] == wanted
            own, term, k = own[has], term[has], k + 1
        return np.unique(np.concatenate(done)) if done else np.zeros(0, np.int64)
