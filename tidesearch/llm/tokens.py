"""Token ids of whole texts with the ``tokenizers`` library, every distinct word encoded once a worker.

Byte-level BPE never merges across a single space or newline that has no other white space beside it, so a text may be cut
before each of these and its units (" word" or "\\nword") encoded on their own: the ids are the same.  So are those of a letter and a
full stop or comma at a unit's end.  Each Python worker remembers the ids of the units it has met, up to a bound.  Texts with
other runs of white space, or with the text of a special token, are encoded whole.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct units that a worker remembers before it starts afresh, and bytes of text worked on at once.
REMEMBER = 800_000
CHUNK_BYTES = 1 << 23
#: Texts that must be encoded whole: white space at either end or beside a space or newline, or a special token's text.
WHOLE = r"^[ \n]|[ \n]$|[\t-\r\x1c-\x20\x85\p{Z}][ \n]|[ \n][\t-\r\x1c-\x20\x85\p{Z}]|<\|"

_encoders: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """This worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def spans(at: np.ndarray, n: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The places at[i], at[i] + 1, ... (n[i] of them) one span after the other; ends: n summed up."""
    kind = np.int32 if max(int(ends[-1]), int(at.max()) + int(n.max())) < 1 << 31 else np.int64
    out = np.repeat((at - (ends - n)).astype(kind), n)
    out += np.arange(len(out), dtype=kind)
    return out


class Encoder:
    """Encodes arrays of texts to flat arrays of ids with a memo of words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        if max(vocabulary.values()) >= 1 << 16:
            raise ValueError(f"{path}: ids of 65,536 and more do not fit the 16 bits that ids are kept in")
        self.starts = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.starts[[i for t, i in vocabulary.items() if t.startswith("Ġ") or t == "Ċ"]] = True  # tokens that begin a unit
        self.marks = {c: self._ids([c])[0][0] for c in ".,"}
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.at, self.len, self.used = np.zeros(1 << 20, np.int32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, units: list[str], ids: np.ndarray, lens: np.ndarray) -> None:
        first, n = len(self.known), len(units)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while first + n > len(self.at):
            self.at, self.len = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.len))
        self.pool[self.used : self.used + len(ids)] = ids
        self.len[first : first + n] = lens
        self.at[first : first + n] = self.used + np.cumsum(lens) - lens
        self.used += len(ids)
        self.known.update(zip(units, range(first, first + n)))

    def _encode_units(self, units: list[str]) -> None:
        """Encode units many to a text; a token that begins with a space or is a newline begins a unit."""
        texts = ["".join([w if w[0] == "\n" else " " + w for w in units[k : k + 500]]) for k in range(0, len(units), 500)]
        ids = np.concatenate([np.array(x, dtype=np.int32) for x in self._ids(texts)])
        begin = np.flatnonzero(self.starts[ids])
        if len(begin) != len(units) or begin[0]:
            parts = [np.array(x, dtype=np.int32) for x in self._ids([w if w[0] == "\n" else " " + w for w in units])]
            self._keep(units, np.concatenate(parts), np.array([len(x) for x in parts]))
        else:
            self._keep(units, ids, np.diff(np.append(begin, len(ids))))

    def _remember(self, units: list[str]) -> None:
        marked = [w for w in units if w[-1] in ".," and len(w) > 1 and w[-2].isalpha()]
        plain = {w for w in units if not (w[-1] in ".," and len(w) > 1 and w[-2].isalpha())}
        plain.update(w[:-1] for w in marked)
        fresh = [w for w in plain if w not in self.known]
        if fresh:
            self._encode_units(fresh)
        if marked:
            stem = np.fromiter((self.known[w[:-1]] for w in marked), dtype=np.int64, count=len(marked))
            n = self.len[stem] + 1
            ends = np.cumsum(n)
            source = spans(self.at[stem], n, ends)
            source[ends - 1] = 0
            ids = self.pool[source]
            ids[ends - 1] = [self.marks[w[-1]] for w in marked]
            self._keep(marked, ids, n)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each); texts without nulls."""
        whole = pc.match_substring_regex(texts, WHOLE).to_numpy(zero_copy_only=False).astype(bool) | (pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0)
        counts, parts, order = np.zeros(len(texts), dtype=np.int64), [], []
        if whole.any():
            for i, x in zip(np.flatnonzero(whole), self._ids(texts.filter(pa.array(whole)).to_pylist())):
                counts[i] = len(x)
                parts.append(np.array(x, dtype=np.int32))
                order.append(i)
        plain = np.flatnonzero(~whole)
        if len(plain):
            split = pc.split_pattern(pc.replace_substring(texts if len(plain) == len(texts) else texts.take(pa.array(plain)), "\n", " \n"), " ")
            offsets = split.offsets.to_numpy().astype(np.int64)
            coded = split.flatten().dictionary_encode()
            if len(self.known) + len(coded.dictionary) // 2 > REMEMBER:
                self.forget()
            words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            number = np.fromiter(map(self.known.get, words, repeat(-1)), dtype=np.int64, count=len(words))
            new = np.flatnonzero(number < 0)
            if len(new):
                unknown = [words[i] for i in new]
                self._remember(unknown)
                number[new] = np.fromiter(map(self.known.__getitem__, unknown), dtype=np.int64, count=len(new))
            word = number[coded.indices.to_numpy()]
            at, n = self.at[word], self.len[word]
            # The first unit of a text has no space before it.
            heads = self._ids([words[k] for k in coded.indices.to_numpy()[offsets[:-1] - offsets[0]]])
            head_ids = np.concatenate([np.array(h, dtype=np.int32) for h in heads])
            head_n = np.array([len(h) for h in heads])
            first = offsets[:-1] - offsets[0]
            pool = np.concatenate([self.pool[: self.used], head_ids])
            at[first], n[first] = self.used + np.cumsum(head_n) - head_n, head_n
            ends = np.cumsum(n)
            flat = pool[spans(at, n, ends)]
            counts[plain] = np.add.reduceat(n, first)
            if not parts:
                return flat, counts
            bounds = np.cumsum(counts[plain])
            parts += np.split(flat, bounds[:-1])
            order += plain.tolist()
        if not parts:
            return np.zeros(0, np.int32), counts
        return np.concatenate([parts[k] for k in np.argsort(np.array(order), kind="stable")]), counts


def pieces(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) in pieces of about ``CHUNK_BYTES``; a longer text is a piece of its own."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + CHUNK_BYTES, side="right")))
        yield start, texts.slice(start, stop - start)
        start = stop


def token_batches(batches: Iterator[pa.RecordBatch], path: str, keep: list[str], end_id: int = 0) -> Iterator[pa.RecordBatch]:
    """Inside a task: the columns ``keep`` with ``tokens``, little-endian uint16 ids with the end id last, for batches with the text last.  Null texts are empty."""
    enc = encoder(path)
    for b in batches:
        for start, texts in pieces(b.column(len(keep))):
            flat, counts = enc.encode(texts)
            n = counts + 1
            ends = np.cumsum(n)
            ids = np.full(int(ends[-1]), end_id, dtype="<u2")
            inner = np.ones(len(ids), dtype=bool)
            inner[ends - 1] = False
            ids[inner] = flat
            raw = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.append(0, ends).astype(np.int64) * 2), pa.py_buffer(ids)])
            own = [b.column(i).slice(start, len(texts)) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*own, raw.cast(pa.binary())], [*keep, "tokens"])


def ids_crc32(ids: np.ndarray) -> int:
    """crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").data)
