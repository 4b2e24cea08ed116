"""Byte-pair encoding as a streaming transducer with bounded lookahead, and decoding as a byte-to-text state machine.

Merging by rank looks at a whole word, but its result can be read off from left to right.  The encoding of a prefix ends in one token,
and taking that token away leaves the encoding of a shorter prefix; a sequence of tokens is an encoding if and only if no merge would ever
join two neighbours across their boundary (``MergeList.crossing``).  So the last token of every prefix follows from those of shorter prefixes, and
a boundary that the last tokens of all prefixes within the longest token's length agree on is final: the tokens before it are emitted and
forgotten.  ``MergeList.lookahead`` is how many bytes on from a boundary that takes at most, read off the merge list alone.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidesearch.llm.tokens import Encoder, pieces, spans

#: Where words of a text are cut before encoding (the published pattern of this kind of tokenizer).
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
NEVER = 1 << 60
#: Pairs of tokens and words that a worker remembers, bytes of a word up to which it is remembered, bytes and ids handled at once.
REMEMBER, SHORT, BLOCK, IDS = 2_000_000, 64, 1024, 1 << 16


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary file: printable Latin-1 for itself, the others from code point 256 on in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class MergeList:
    """A tokenizer file's vocabulary and merges: how each token came about, and what follows from that."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, byte = spec["model"], byte_letters()
        if model["type"] != "BPE" or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["normalizer"] or spec["pre_tokenizer"]["add_prefix_space"] or model.get("ignore_merges"):
            raise ValueError(f"{path}: not a byte-level BPE without normaliser and prefix space")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = {i: bytes(byte[c] for c in t) for t, i in model["vocab"].items() if i not in self.special.values()}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.id = {b: i for i, b in self.bytes.items() if i not in self.special.values()}
        size = max(self.bytes) + 1
        #: When a token is made (-1: a byte, from the start), and of which two.
        self.born, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.rank: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (model["vocab"][t] for t in (pair if isinstance(pair, list) else pair.split(" ")))
            made = self.id[self.bytes[a] + self.bytes[b]]
            if self.born[made] >= 0:
                raise ValueError(f"{path}: two merges make {self.bytes[made]!r}")
            self.born[made], self.left[made], self.right[made] = rank, a, b
            self.rank[a << 20 | b] = rank
        # A token that its own text does not encode to is never met.
        whole = {i for i, b in self.bytes.items() if len(b) == 1}
        for i in sorted((i for i in self.id.values() if self.born[i] >= 0), key=self.born.__getitem__):
            if self.left[i] in whole and self.right[i] in whole and self.crossing(self.left[i], self.right[i]) == self.born[i]:
                whole.add(i)
        self.token = {b: i for b, i in self.id.items() if i in whole}
        self.longest = [1] * 256
        for b in self.token:
            self.longest[b[-1]] = max(self.longest[b[-1]], len(b))
        self.widest = max(self.longest)
        self.lookahead = self._lookahead()

    def crossing(self, a: int, b: int) -> int | None:
        """The rank of the first merge that would join something across the boundary of the tokens ``a`` and ``b``; none if they stay as they are.

        Going back in time, the token left of the boundary is split into its right part when it was made, the one right of it into its left part.
        Of equal pairs the leftmost merges first, so a pair loses to a merge of the same rank on its left, but not to one on its right.
        """
        found, gone_a, gone_b = None, NEVER, NEVER
        while True:
            m = self.rank.get(a << 20 | b)
            if m is not None and m < gone_a and m <= gone_b:
                found = m
            at, bt = self.born[a], self.born[b]
            if at < 0 and bt < 0:
                return found
            if at >= bt:
                gone_a, a = at, self.right[a]
            if bt >= at:
                gone_b, b = bt, self.left[b]

    def _lookahead(self) -> int:
        """Bytes after a boundary that may still move it.

        Text that is added can only move boundaries by a merge that takes a letter of it, which may prevent a later merge that overlaps it on
        the left, which may prevent or allow a still later one, and so on: a chain of ever later merges, each beginning left of the one before.
        The longest chain, in bytes, is found by going through the merges in order: a merge's text continues the longest chain of earlier ones
        that begin with one of its ends.
        """
        reach: dict[bytes, int] = {}  # beginning of a merge's text -> bytes of the longest chain from there
        longest = self.widest
        for i in sorted((i for i in self.token.values() if self.born[i] >= 0), key=self.born.__getitem__):
            text = self.bytes[i]
            span = max(len(text), max((reach[e] + len(text) - len(e) for k in range(1, len(text)) if (e := text[k:]) in reach), default=0))
            longest = max(longest, span)
            for k in range(1, len(text)):
                if span > reach.get(text[:k], 0):
                    reach[text[:k]] = span
        return longest + self.widest


class Transducer:
    """Encodes one word that comes in parts of any size.  It holds what is not final yet: at most ``lookahead`` and two blocks of bytes."""

    def __init__(self, merges: MergeList, joined: dict[int, bool]):
        self.merges, self.joined = merges, joined
        self.text, self.last, self.before = b"", [-1], -1  # bytes since the last final boundary, last token of each prefix of them, token before

    def _follows(self, a: int, b: int) -> bool:
        if a < 0:
            return True
        key = a << 20 | b
        ok = self.joined.get(key)
        if ok is None:
            if len(self.joined) > REMEMBER:
                self.joined.clear()
            ok = self.joined[key] = self.merges.crossing(a, b) is None
        return ok

    def read(self, part: bytes) -> None:
        """Finds the last token of each longer prefix."""
        done, self.text = len(self.text), self.text + part
        text, last, token, longest = self.text, self.last, self.merges.token, self.merges.longest
        for i in range(done + 1, len(text) + 1):
            for j in range(max(0, i - longest[text[i - 1]]), i):
                t = token.get(text[j:i])
                if t is not None and last[j] is not None and self._follows(self.before if j == 0 else last[j], t):
                    last.append(t)
                    break
            else:
                last.append(None)  # an encoding of a longer text has no boundary in reach here

    def _back(self, end: int) -> list[int]:
        out = []
        while end:
            out.append(self.last[end])
            end -= len(self.merges.bytes[self.last[end]])
        return out[::-1]

    def settle(self) -> list[int]:
        """The tokens that no further text can change."""
        n = len(self.text)
        ends = {k for k in range(max(0, n - self.merges.widest + 1), n + 1) if k == 0 or self.last[k] is not None}
        while len(ends) > 1:  # the furthest of them steps back over its last token, until all have met
            top = max(ends)
            ends.remove(top)
            ends.add(top - len(self.merges.bytes[self.last[top]]))
        at = ends.pop()
        out = self._back(at)
        if at:
            self.before, self.text, self.last = self.last[at], self.text[at:], [-1, *self.last[at + 1 :]]
        return out

    def feed(self, data: bytes) -> Iterator[int]:
        for k in range(0, len(data), BLOCK):
            self.read(data[k : k + BLOCK])
            if len(self.text) >= BLOCK:
                yield from self.settle()
                if len(self.text) > self.merges.lookahead + BLOCK:
                    raise AssertionError("the lookahead does not suffice")

    def finish(self) -> list[int]:
        out = self._back(len(self.text))
        self.text, self.last, self.before = b"", [-1], -1
        return out


class StreamEncoder(Encoder):
    """The word memo of ``tokens.Encoder``, with words encoded by the transducer instead of a library."""

    def __init__(self, path: str):
        self.merges = MergeList(path)
        self.joined: dict[int, bool] = {}
        self.words: dict[str, list[int]] = {}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.merges.special, key=len, reverse=True))) + ")") if self.merges.special else None
        self.marks = {c: self.encode_text(c)[0] for c in ".,"}
        self.forget()

    def encode_word(self, word: str) -> list[int]:
        ids = self.words.get(word)
        if ids is None:
            machine, data = Transducer(self.merges, self.joined), word.encode()
            ids = [*machine.feed(data), *machine.finish()]
            if len(data) <= SHORT:
                if len(self.words) > REMEMBER // 4:
                    self.words.clear()
                self.words[word] = ids
        return ids

    def stream(self, text: str) -> Iterator[int]:
        """The ids of a text, each as soon as it is known."""
        for part in self.special.split(text) if self.special and self.special.search(text) else [text]:
            if part in self.merges.special:
                yield self.merges.special[part]
            else:
                for m in WORDS.finditer(part):
                    yield from self.encode_word(m.group())

    def encode_text(self, text: str) -> list[int]:
        return list(self.stream(text))

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [self.encode_text(t) for t in texts]

    def _encode_units(self, units: list[str]) -> None:
        machine, ids, lens = Transducer(self.merges, self.joined), [], []
        for u in units:
            if u.isalpha() and len(u) < SHORT:  # one word with its space
                machine.read(b" " + u.encode())
                one = machine.finish()
            else:
                one = self.encode_text(u if u[0] == "\n" else " " + u)
            ids += one
            lens.append(len(one))
        self._keep(units, np.array(ids, dtype=np.int32), np.array(lens, dtype=np.int64))


#: States of the machine: 0 between characters; else what may follow, as (lowest byte, highest byte, state after it).
UTF8 = {1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0x80, 0xBF, 2), 4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}


def after_lead(b: int) -> int:
    """The state after a character's first byte."""
    if 0xC2 <= b <= 0xDF:
        return 1
    if 0xE0 <= b <= 0xEF:
        return {0xE0: 4, 0xED: 5}.get(b, 2)
    if 0xF0 <= b <= 0xF4:
        return {0xF0: 6, 0xF4: 7}.get(b, 3)
    return 0


class TextDecoder:
    """Text from token ids that come in parts of any size.  Between parts it holds the bytes of a character begun, three at most.

    Bytes that are no UTF-8 become the replacement character, one for each longest beginning of a character.
    """

    def __init__(self, table: dict[int, bytes]):
        size = max(table) + 1
        self.len = np.array([len(table.get(i, b"")) for i in range(size)])
        self.pool = np.frombuffer(b"".join(table.get(i, b"") for i in range(size)), np.uint8)
        self.at = np.cumsum(self.len) - self.len
        self.held = b""

    @staticmethod
    def begun(data: bytes) -> int:
        """How many bytes at the end are an unfinished character."""
        for k in range(1, min(3, len(data)) + 1):
            if data[-k] & 0xC0 != 0x80:  # the last byte that begins something
                state = after_lead(data[-k])
                for b in data[len(data) - k + 1 :]:
                    low, high, then = UTF8.get(state, (1, 0, 0))
                    state = then if low <= b <= high else 0
                return k if state else 0
        return 0

    def raw(self, ids: np.ndarray) -> bytes:
        n = self.len[ids]
        return self.pool[spans(self.at[ids], n, np.cumsum(n))].tobytes() if len(ids) else b""

    def feed(self, ids: np.ndarray) -> str:
        data = self.held + self.raw(ids)
        k = self.begun(data)
        self.held = data[len(data) - k :]
        return data[: len(data) - k].decode("utf-8", "replace")

    def finish(self) -> str:
        data, self.held = self.held, b""
        return data.decode("utf-8", "replace")


_machines: dict[str, tuple[StreamEncoder, TextDecoder]] = {}


def machines(path: str) -> tuple[StreamEncoder, TextDecoder]:
    """This worker's encoder and decoder for a tokenizer file."""
    if path not in _machines:
        enc = StreamEncoder(path)
        _machines[path] = enc, TextDecoder(enc.merges.bytes)
    return _machines[path]


def encode_documents(docs: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (little-endian unsigned 32-bit ids), decoded_sha256 (UTF-8 of the text decoded from them) of every document,
    and with ``ids`` the ids and the decoded text themselves (``ids array<int>``, ``decoded``).

    ``path`` is a byte-level BPE file that all workers see.  A null or empty text has no ids and decodes to the empty text; null ids and repeated rows are
    documents like others; an empty table gives no rows; other columns are dropped, whatever their names.  A task holds texts of about 8 MB, or one longer text.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if ids else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc, dec = machines(path)
        for b in batches:
            for start, texts in pieces(b.column(1)):
                flat, counts = enc.encode(texts)
                ends, of_ids, of_text, more = np.cumsum(counts), [], [], []
                for e, n in zip(ends.tolist(), counts.tolist()):
                    one, digest, said = flat[e - n : e], hashlib.sha256(), []
                    of_ids.append(hashlib.sha256(one.astype("<u4").tobytes()).hexdigest())
                    for k in range(0, n, IDS):
                        said.append(dec.feed(one[k : k + IDS]))
                        digest.update(said[-1].encode())
                        if not ids:
                            said.clear()
                    said.append(dec.finish())
                    digest.update(said[-1].encode())
                    of_text.append(digest.hexdigest())
                    if ids:
                        more.append((one, "".join(said)))
                columns = [b.column(0).slice(start, len(texts)), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)]
                if ids:
                    columns += [pa.array([m[0] for m in more], pa.list_(pa.int32())), pa.array([m[1] for m in more], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
