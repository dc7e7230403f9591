"""BPE encoding and decoding with content-defined chunk reuse.

A text is cut where a rolling hash of the last bytes says so, so equal passages of different
documents give equal chunks wherever they stand. Each worker encodes a chunk once and keeps it.
A cut may fall anywhere, so what stands beside it is wrong in either chunk. The join is repaired by
encoding again a window across the cut: it begins and ends some words into the chunks, and if its
first and last words don't get exactly the ids that the chunks have for them, it grows, up to the
whole of both chunks. What lies between the words that agree replaces the chunks' ids.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longweave.llm.common import as_bytes, small_batches, tidy

#: Bytes that the rolling hash sees.
WINDOW = 16
#: A cut every 2**CUT_BITS bytes on average.
CUT_BITS = 10
#: Bytes that a worker's chunks, and its pieces, take in each of two generations, objects included.
CHUNK_CACHE, PIECE_CACHE = 8 << 20, 28 << 20
#: Bytes of the longest piece that is kept, and of the texts that are encoded at a time.
LONGEST_KEPT, BATCH_BYTES = 200, 2 << 20
#: Words of either chunk that a window holds beside the one at the cut, at first.
GUARD = 1

_SPACE = re.compile(rb"[ \t\n\r]+")
_STOP = re.compile(rb"(?<=[a-z])([.,])(?=[ \t\n\r])")
#: What the words of a text may go through for them to be met one by one; fixed by the tokenizer's format.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


class Generations:
    """A dictionary of bounded size: when the young half is full it becomes the old one.

    An entry counts as the bytes of its key and value and OBJECTS for what Python needs around them.
    """

    OBJECTS = 220

    def __init__(self, most: int) -> None:
        self.most, self.size, self.young, self.old = most, 0, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value, size: int = 0) -> None:
        if self.size >= self.most:
            self.old, self.young, self.size = self.young, {}, 0
        self.young[key] = value
        self.size += self.OBJECTS + len(key) + size


def cuts(data: bytes, bits: int = CUT_BITS) -> np.ndarray:
    """Offsets at which a text is cut: the hash of the WINDOW bytes before has ``bits`` low zeros.

    The cut moves on to the next start of a UTF-8 character, which depends on content alone.
    """
    x = np.frombuffer(data, np.uint8)
    if len(x) <= WINDOW:
        return np.zeros(0, np.int64)
    h = np.zeros(len(x) - WINDOW + 1, dtype=np.uint32)
    for i in range(WINDOW):  # a polynomial of the window
        h = h * np.uint32(0x01000193) + x[i : i + len(h)]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    at = np.nonzero((h >> np.uint32(32 - bits)) == 0)[0] + WINDOW
    at = at[at < len(x)]
    while len(at) and (move := (x[at] & 0xC0) == 0x80).any():
        at = at + move
        at = at[at < len(x)]
    return np.unique(at)


def _proven(spec: dict) -> bool:
    """Whether white space parts words that are encoded alike alone and in a text, and A-Z are lowered."""
    normal, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [])
    return (
        normal.get("normalizers") == _NORMAL
        and [x["type"] for x in steps] == ["Split", "ByteLevel"]
        and steps[0]["pattern"] == {"Regex": _PATTERN}
        and steps[0]["behavior"] == "Removed"
        and not steps[1]["add_prefix_space"]
        and spec["model"]["type"] == "BPE"
        and not spec["model"].get("dropout")
        and spec.get("decoder") is None
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or _SPACE.search(t["content"].encode()) for t in spec["added_tokens"])
    )


class ChunkedCodec:
    """Encodes and decodes like the tokenizer at ``path``, reusing chunks and pieces; ids are packed in four bytes each."""

    def __init__(self, path: str, bits: int = CUT_BITS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one worker a core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            if not _proven(json.load(f)):
                raise ValueError("pieces between white space are proven for the normalizer and pre-tokenizer of word BPE without a decoder only")
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.bits = bits
        self.names = {i: t for t, i in self.tok.get_vocab(with_added_tokens=True).items()}
        self.digits = {i: str(i) for i in self.names}
        self.chunks, self.pieces = Generations(CHUNK_CACHE), Generations(PIECE_CACHE)
        self.encoded_bytes = self.grown = 0

    def _known(self, pieces: Iterable[bytes]) -> dict[bytes, bytes]:
        """The packed ids of all these pieces; those that aren't kept yet are encoded in one batch."""
        young, old = self.pieces.young, self.pieces.old
        known, new = {}, []
        for p in pieces:
            x = young.get(p)
            if x is None:
                x = old.get(p)
                if x is None:
                    new.append(p)
                else:
                    self.pieces.put(p, x, len(x))
            known[p] = x
        self.encoded_bytes += sum(map(len, new))
        put = self.pieces.put
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            for p, e in zip(part, self.tok.encode_batch_fast([p.decode("utf-8", "replace") for p in part], add_special_tokens=False), strict=True):
                known[p] = x = array("I", e.ids).tobytes()
                if len(p) <= LONGEST_KEPT:
                    put(p, x, len(x))
        return known

    def encode_batch(self, texts: list[bytes | None]) -> list[bytes]:
        """The packed ids of each text."""
        out: list[bytes] = []
        lo = 0
        while lo < len(texts):  # parts of bounded size
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi] or b"") <= BATCH_BYTES):
                size += len(texts[hi] or b"")
                hi += 1
            out += self._part(texts[lo:hi])
            lo = hi
        return out

    def _part(self, texts: list[bytes | None]) -> list[bytes]:
        plans = [_chunked(data or b"", self.bits) for data in texts]
        found: dict[bytes, bytes | None] = {}
        wanted: dict[bytes, list[bytes]] = {}
        for plan in plans:
            for chunk in plan:
                if chunk not in found:
                    found[chunk] = x = self.chunks.get(chunk)
                    if x is None:
                        wanted[chunk] = _words(chunk)
        known = self._known(dict.fromkeys(p for words in wanted.values() for p in words))
        for chunk, words in wanted.items():
            found[chunk] = x = b"".join([known[p] for p in words])
            self.chunks.put(chunk, x, len(x))
        joins = {(a, b) for plan in plans for a, b in zip(plan, plan[1:], strict=False)}
        repaired = self._repaired(joins, found)
        out = []
        for plan in plans:
            if len(plan) < 2:
                out.append(found[plan[0]] if plan else b"")
                continue
            parts, skip = [], 0
            for k, chunk in enumerate(plan):
                if k + 1 == len(plan):
                    parts.append(found[chunk][skip:])
                    break
                drop, middle, after = repaired[chunk, plan[k + 1]]
                own = found[chunk]
                if skip + drop > len(own):  # windows that meet inside a chunk: no cut of this text is used
                    parts = [self._known([data])[data] for data in [b"".join(plan)]]
                    break
                parts += [own[skip : len(own) - drop], middle]
                skip = after
            out.append(b"".join(parts))
        return out

    def _repaired(self, joins: set[tuple[bytes, bytes]], found: dict[bytes, bytes]) -> dict[tuple[bytes, bytes], tuple[int, bytes, int]]:
        """For each join (bytes of ids that go at the first chunk's end, the ids in their place, bytes that go at the second's start)."""
        out, guard = {}, GUARD
        while joins:
            ends = {(a, b): (_tail(a, guard), _head(b, guard)) for a, b in joins}
            windows = dict.fromkeys(b"".join((*x, *y)) for x, y in ends.values())
            words = dict.fromkeys(w for x, y in ends.values() for part in (*x, *y) for w in _words(part))
            known = self._known(windows | words)
            own = lambda part, known=known: b"".join([known[w] for w in _words(part)])
            again = set()
            for (a, b), (x, y) in ends.items():
                window = known[b"".join((*x, *y))]
                # a chunk that the window holds as a whole has no word left to agree with
                first, last = own(x[0]) if len(x) > 1 else b"", own(y[-1]) if len(y) > 1 else b""
                tail, head = first + own(x[-1]), own(y[0]) + last
                agree = window.startswith(first) and window.endswith(last) and len(window) >= len(first) + len(last)
                if agree and found[a].endswith(tail) and found[b].startswith(head):
                    out[a, b] = (len(tail) - len(first), window[len(first) : len(window) - len(last)], len(head) - len(last))
                elif len(x) == len(y) == 1:
                    out[a, b] = (len(found[a]), window, len(found[b]))
                else:
                    again.add((a, b))
            self.grown += len(again)
            joins, guard = again, guard * 4
        return out

    def encode(self, data: bytes | None) -> list[int]:
        return array("I", self.encode_batch([data])[0]).tolist()

    def spelled(self, ids: bytes) -> tuple[int, str, str]:
        """(number of ids, decimal ids joined by one space, decoded text)."""
        own = array("I", ids)
        return len(own), " ".join(map(self.digits.__getitem__, own)), " ".join(map(self.names.__getitem__, own))

    def decode(self, ids: Iterable[int]) -> str:
        """What the library's decode gives without skipping special tokens; unknown ids give nothing."""
        return " ".join(self.names[i] for i in ids if i in self.names)


def _chunked(data: bytes, bits: int) -> list[bytes]:
    """The chunks of a text. One in which no word stands apart from the windows at both ends joins the next one."""
    out, begin, prev, runs = [], 0, 0, 0
    for end in [*cuts(data, bits).tolist(), len(data)]:
        runs += len(_SPACE.findall(data, prev, end)) - (prev > begin)  # white space at a dropped cut counts once
        prev = end
        if end > begin and (runs >= 2 * GUARD + 2 or end == len(data)):
            out.append(data[begin:end])
            begin, last, runs = end, runs, 0
    if len(out) > 1 and last < 2 * GUARD + 2:
        out[-2:] = [out[-2] + out[-1]]
    return out


def _tail(chunk: bytes, words: int) -> tuple[bytes, ...]:
    """(first whole word, the rest) of a chunk's last ``words`` words and the one at its end; all of it if there are no more."""
    at = len(chunk)
    for _ in range(words + 1):
        at = max(chunk.rfind(c, 0, at) for c in (b" ", b"\t", b"\n", b"\r"))
        while at > 0 and chunk[at - 1] in b" \t\n\r":
            at -= 1
        if at <= 0:
            return (chunk,)
    found = _SPACE.match(chunk, at)
    end = _SPACE.search(chunk, found.end())
    return chunk[found.end() : end.start()], chunk[end.start() :]


def _head(chunk: bytes, words: int) -> tuple[bytes, ...]:
    """(what is before, last whole word) of a chunk's first ``words`` words and the one at its start; all of it if there are no more."""
    spaces = []
    for m in _SPACE.finditer(chunk):
        spaces.append(m)
        if len(spaces) == words + 1:
            return chunk[: spaces[-2].end()], chunk[spaces[-2].end() : m.start()]
    return (chunk,)


def _words(chunk: bytes) -> list[bytes]:
    """The words of a chunk as pieces.

    A full stop or comma between a letter and white space is a piece of its own, and A-Z are lower
    case: either is what the tokenizer makes of them, and more pieces are then alike.
    """
    if b"<|" in chunk:  # special tokens are met before letters are lowered
        return chunk.split()
    return _STOP.sub(rb" \1", chunk.lower()).split()


def encoded(docs: DataFrame, tokenizer: str, with_ids: bool = False, bits: int = CUT_BITS) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256; ``with_ids`` adds ids and decoded.

    tokenizer: path of a tokenizers file without a decoder, that executors can read. Whole texts are
    encoded, without begin or end tokens, truncation or padding. Null and empty texts give no ids.
    Repeated rows are kept, a null doc_id stays null; an empty table gives no rows; other columns are
    not read. Workers keep bounded caches, so memory doesn't grow with the input; a text without any
    white space is encoded as one piece.
    """
    small_batches(docs.sparkSession)
    kept = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ChunkedCodec(tokenizer, bits)
        for batch in batches:
            ids = codec.encode_batch(as_bytes(batch.column(1)))
            cols = [[], [], [], [], []]
            for own in ids:  # one row's strings at a time
                n, text, decoded = codec.spelled(own)
                row = (n, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                for col, x in zip(cols, row + ((array("I", own).tolist(), decoded) if with_ids else ()), strict=False):
                    col.append(x)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            own = [batch.column(0).cast(pa.int64()), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]]
            names = [c.split()[0] for c in kept.split(", ")]
            yield pa.RecordBatch.from_arrays(own[: len(names)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), kept)
