"""Packing documents into fixed-length token sequences along a Hilbert curve.

Each document's tokens are hashed into a short count vector, the vector is projected to three dimensions and its cell
becomes a Hilbert key. Documents are range-sorted by that key, so neighbours on the curve have similar
content, and a running sum of token counts along the curve lays them end to end: piece k of the corpus lies at
position k modulo the sequence length. Documents are cut at sequence ends only, so no sequence but the last is padded.

Tokenization happens once; token ids are written to the shared folder as packed integers. Only ``(key, id, count)`` is sorted.
The running sum is kept per range partition and joined with one total per partition.

Defined results: a null or empty text is the end id alone. Rows with equal ids are separate documents. An empty table gives no pieces. Extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.session import cut

LENGTH = 1024
END = 0
#: Byte-level BPE; the file with ranks gives the same ids as ``byte_bpe_50k.json`` and is read by the faster library.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.tiktoken")
SPECIAL = {"<|endoftext|>": 50256}
DIMS, BITS, BUCKETS = 3, 16, 64


@lru_cache(maxsize=4)
def encoder(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of each row of integer coordinates below ``2 ** bits``."""
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:  # undo the curve's rotations, high bits first
        for i in range(n):
            on = (x[:, i] & q) != 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, i]) & (q - 1))
            x[:, 0] ^= np.where(on, q - 1, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[:, n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):  # interleave
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def cells(vectors: np.ndarray) -> np.ndarray:
    """Hashed count vectors to grid cells: root, unit length, fixed random projection, ``BITS`` bits an axis."""
    roots = np.sqrt(vectors)
    norms = np.linalg.norm(roots, axis=1, keepdims=True)
    unit = np.divide(roots, norms, out=np.zeros_like(roots), where=norms > 0)
    axes = np.random.default_rng(20).standard_normal((BUCKETS, DIMS))
    axes -= axes.mean(axis=0)  # all buckets alike is the middle of the grid
    z = np.tanh(unit @ axes) / 2 + 0.5
    return np.minimum((z * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def tokenized(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END) -> DataFrame:
    """``(rid, doc_id, key, n, ids)`` per row: curve position, token count and the ids as 16- or 32-bit integers."""

    def tokenize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        kind = np.dtype("<u2" if enc.n_vocab <= 1 << 16 else "<u4")
        for pdf in batches:
            packed, counts, vectors = [], [], np.zeros((len(pdf), BUCKETS))
            for i, text in enumerate(pdf["text"]):
                ids = enc.encode_to_numpy(text or "", allowed_special="all", disallowed_special=()).astype(np.int64)
                vectors[i] = np.bincount((ids * 2654435761 >> 7) % BUCKETS, minlength=BUCKETS)
                packed.append(np.append(ids, end).astype(kind).tobytes())
                counts.append(len(ids) + 1)
            yield pd.DataFrame({"rid": pdf["rid"], "doc_id": pdf["doc_id"], "key": hilbert_keys(cells(vectors)), "n": counts, "ids": packed, "width": kind.itemsize})

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    return cut(rows.mapInPandas(tokenize, f"rid long, doc_id {kind}, key long, n long, ids binary, width int"))


def starts(tokens: DataFrame) -> DataFrame:
    """``(rid, at)``: the place of each document's first token on the whole curve."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, sofar = TaskContext.get().partitionId(), 0
        for pdf in batches:
            upto = pdf["n"].cumsum() + sofar
            yield pd.DataFrame({"part": part, "rid": pdf["rid"], "n": pdf["n"], "local": upto - pdf["n"]})
            sofar = int(upto.iloc[-1]) if len(upto) else sofar

    order = ["key", "doc_id", "rid"]
    placed = cut(tokens.select("rid", "key", "doc_id", "n").repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(run, "part int, rid long, n long, local long"))
    totals = placed.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # one row per partition
    sofar, offsets = 0, []
    for r in totals:
        offsets.append((r["part"], sofar))
        sofar += r["n"]
    table = placed.sparkSession.createDataFrame(offsets, "part int, base long")
    return placed.join(F.broadcast(table), "part").select("rid", (F.col("base") + F.col("local")).alias("at"))


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str = TOKENIZER, end: int = END) -> DataFrame:
    """``(doc_id, start, length, doc_tokens, sequence_id, offset, ids)`` per piece; ``ids`` are
    little-endian unsigned 32-bit integers."""
    tokens = tokenized(docs, tokenizer, end)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, n, at, raw, width in zip(pdf["doc_id"], pdf["n"], pdf["at"], pdf["ids"], pdf["width"]):
                ids = np.frombuffer(raw, dtype=f"<u{width}").astype("<u4")
                edges = [0, *range(length - at % length, n, length), n]
                out += [(doc, a, b - a, n, (at + a) // length, (at + a) % length, ids[a:b].tobytes()) for a, b in zip(edges, edges[1:])]
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]).astype({"doc_id": pdf["doc_id"].dtype})

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return tokens.join(starts(tokens), "rid").select("doc_id", "n", "at", "ids", "width").mapInPandas(pieces, schema)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
