r"""Fill-in-the-middle by content-defined chunks: a text is cut at two unit boundaries and its parts are put in another order.

A unit is ``[\x20\x09-\x0D]*[^\x20\x09-\x0D]+`` (a word with the white space before it), or the white space at the end of a text. Cuts
follow from a hash of the document id: rerunning gives the same cuts, in any partitioning.

A rolling hash over the last 32 bytes cuts a text into chunks where the hash ends in zeros, so passages that texts share fall into the
same chunks wherever they stand. A task keeps a bounded cache of chunks with their boundary summaries: code points, words,
and whether the chunk begins and ends in white space. A chunk found there is not scanned again; the cache compares whole chunks, not only
their hashes. Summaries combine from left to right (two chunks that meet inside a word have one word less), the running counts say in
which chunk a cut lies, and only that chunk is searched. Chunks end between code points; white space is ASCII, so bytes decide everything.

Every row is read and written once, without a shuffle; a lost task repeats its own rows only.

Defined results: a null or empty text, and one that holds a mark, stays plain. A null id hashes like an empty one. Rows with equal ids are cut
by the same numbers. Texts of any length work, chunk by chunk. An empty table gives an empty result. Extra columns pass through; names of results that are
taken get underscores in front.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.llm.text import free_name

SEED = 42
FIM_PERCENT, SPM_PERCENT = 50, 80
# The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output")

WINDOW = 32  # bytes under the rolling hash, one bit of it each
LEAST, BITS, MOST = 64, 8, 4_096  # bytes of a chunk; it ends on average 2 ** BITS bytes behind LEAST
STRIP = 1 << 20
CACHE_BYTES = 16 << 20  # of each of two generations
ROWS_AT_ONCE = 256  # rows of an output batch

_GEAR = np.random.default_rng(SEED).integers(0, 1 << 32, 256, dtype=np.uint32)
_INSIDE = bytes(range(0x80, 0xC0))  # bytes that continue a code point
_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_WORD_END = re.compile(rb"[^\x20\x09-\x0D](?=[\x20\x09-\x0D])")


def candidates(data: bytes) -> list[int]:
    """Places behind which the rolling hash ends in BITS zeros and a code point begins."""
    out = []
    for s in range(0, len(data), STRIP):
        lead = min(s, WINDOW - 1)
        raw = np.frombuffer(data, np.uint8, min(STRIP, len(data) - s) + lead, s - lead)
        h, width = _GEAR[raw], 1
        while width < WINDOW:  # the hash of twice as many bytes from those of two neighbouring halves
            h[width:] += h[:-width] << np.uint32(width)
            width *= 2
        at = np.flatnonzero((h[lead:] >> np.uint32(32 - BITS)) == 0) + s + 1
        out += [c for c in at.tolist() if c < len(data) and data[c] & 0xC0 != 0x80]
    return out


def chunk_ends(data: bytes, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks: candidates at least ``least`` bytes apart, and cuts by length where there is none for ``most`` bytes."""
    if len(data) <= least:
        return [len(data)] if data else []
    ends, start = [], 0
    for c in [*candidates(data), len(data)]:
        while c - start > most:
            cut = start + most
            while cut > start + 1 and data[cut] & 0xC0 == 0x80:
                cut -= 1
            ends.append(start := cut)
        if c - start >= least:
            ends.append(start := c)
    if start < len(data):
        ends.append(len(data))
    return ends


def summary(chunk: bytes) -> tuple[int, int, bool, bool]:
    """Code points, words, and whether the first and the last byte are white space."""
    return len(chunk.translate(None, _INSIDE)), len(chunk.split()), chunk[0] in _SPACE, chunk[-1] in _SPACE


class Memo:
    """Summaries by content, in two generations: the older one goes when the newer one is full."""

    def __init__(self, most: int = CACHE_BYTES) -> None:
        self.young: dict[bytes, tuple] = {}
        self.old: dict[bytes, tuple] = {}
        self.most, self.size, self.asked, self.found = most, 0, 0, 0

    def __call__(self, chunk: bytes) -> tuple[int, int, bool, bool]:
        self.asked += 1
        known = self.young.get(chunk)
        if known is not None:
            self.found += 1
            return known
        known = self.old.get(chunk)
        if known is None:
            known = summary(chunk)
        else:
            self.found += 1
        self.size += len(chunk)
        if self.size > self.most:
            self.young, self.old, self.size = {}, self.young, len(chunk)
        self.young[chunk] = known
        return known


class Units:
    """The units of one text, counted from the summaries of its chunks."""

    def __init__(self, data: bytes, memo: Memo, ends: list[int] | None = None) -> None:
        self.data = data
        self.ends = chunk_ends(data) if ends is None else ends
        starts = [0, *self.ends[:-1]]
        parts = [memo(data[a:b]) for a, b in zip(starts, self.ends)]
        # word ends in each chunk: all its words but the last one where the text goes on inside that word
        word_ends = [
            words - (not last_space and i + 1 < len(parts) and not parts[i + 1][2]) for i, (_, words, _, last_space) in enumerate(parts)
        ]
        self.upto = list(accumulate(word_ends))
        self.chars = list(accumulate(p[0] for p in parts))
        self.words = self.upto[-1] if parts else 0
        self.n = self.words + bool(parts and parts[-1][3])

    def cut(self, k: int) -> tuple[int, int]:
        """Bytes and code points up to the end of unit ``k``."""
        if k == 0:
            return 0, 0
        if k >= self.n:
            return len(self.data), self.chars[-1] if self.chars else 0
        i = bisect_left(self.upto, k)
        start = self.ends[i - 1] if i else 0
        chunk, nth = self.data[start : self.ends[i]], k - (self.upto[i - 1] if i else 0)
        inner = next(islice(_WORD_END.finditer(chunk), nth - 1, None), None)
        size = inner.end() if inner else len(chunk)  # the last word end may be that of the chunk
        return start + size, (self.chars[i - 1] if i else 0) + len(chunk[:size].translate(None, _INSIDE))


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def rearranged(doc_id: int | None, data: bytes, memo: Memo, seed: int, fim_percent: int, spm_percent: int) -> tuple:
    """``(n, form, prefix_chars, middle_chars, output)`` of one text."""
    units = Units(data, memo)
    h1, h2, h3, h4 = draws(doc_id, seed)
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if not data or h3 % 100 >= fim_percent or p in data or s in data or m in data:
        return units.n, PLAIN, None, None, data
    first, second = sorted((h1 % (units.n + 1), h2 % (units.n + 1)))
    (a, a_chars), (b, b_chars) = units.cut(first), units.cut(second)
    spm = h4 % 100 < spm_percent
    output = b"".join((s, data[b:], p, data[:a], m, data[a:b]) if spm else (p, data[:a], s, data[b:], m, data[a:b]))
    return units.n, SPM if spm else PSM, a_chars, b_chars - a_chars, output


def transform(docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """``docs`` without text, with ``n`` units, ``form``, ``prefix_chars``, ``middle_chars`` (null where plain) and ``output``."""
    kept = [c for c in docs.columns if c != "text"]
    names = [free_name(docs, c) for c in RESULTS]
    plain = [f"c{i}" for i in range(len(kept))]  # columns travel by place, whatever their names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                rows = [
                    rearranged(d, t or b"", memo, seed, fim_percent, spm_percent)
                    for d, t in zip(part.column("id").to_pylist(), part.column("data").to_pylist())
                ]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
                made = [pa.array(list(values), kind) for values, kind in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in plain), *made], names=[*plain, *RESULTS])

    types = ("long", "string", "long", "long", "binary")
    schema = ", ".join([f"{p} {docs.schema[c].dataType.simpleString()}" for p, c in zip(plain, kept)] + [f"{c} {t}" for c, t in zip(RESULTS, types)])
    sent = [F.col(f"`{c}`").alias(p) for p, c in zip(plain, kept)] + [F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("data")]
    made = docs.select(*sent).mapInArrow(run, schema).withColumn("output", F.col("output").cast("string"))
    return made.toDF(*kept, *names)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    p = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)  # a text that holds a mark is never rearranged
    return F.when(form == SPM, F.concat(p[2], p[3], p[1])).when(form == PSM, F.concat(p[1], p[3], p[2])).otherwise(output)
