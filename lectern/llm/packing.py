"""Packing documents into sequences of tokens: shortest-pack-first over the histogram of lengths."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import keep, numbered, running_totals

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LIMIT = 1024
_encoders: dict[str, Encoder] = {}


def _bytes_of_characters() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 stands for
    itself, the other bytes for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids of texts as little-endian uint32 bytes, for a byte-level BPE vocabulary file (strings of
    special tokens are ordinary text)."""

    def __init__(self, path: str):
        vocabulary = json.load(open(path, encoding="utf-8"))
        special = {t["content"] for t in vocabulary["added_tokens"]}
        of = _bytes_of_characters()
        ranks = {bytes(of[c] for c in t): i for t, i in vocabulary["model"]["vocab"].items() if t not in special}
        self._bpe = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        return self._bpe.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


def _cut(path: str, limit: int, end: int | None):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(text, and more) to pieces with the rest of the row: full ones and what is left of each document."""
        encoder = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
        tail = b"" if end is None else np.array([end], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                doc, start, ids, whole = [], [], [], []
                for i, text in enumerate(part.column(0).to_pylist()):
                    code = encoder.encode(text or "") + tail
                    for k in range(0, len(code), 4 * limit):
                        doc.append(i)
                        start.append(k // 4)
                        ids.append(code[k : k + 4 * limit])
                        whole.append(len(code) // 4)
                at_rows = pa.array(doc, pa.int64())
                yield pa.RecordBatch.from_arrays([*[c.take(at_rows) for c in part.columns[1:]], pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(whole, pa.int64()), pa.array(ids, pa.binary())], [*part.schema.names[1:], "start", "length", "doc_tokens", "ids"])

    return go


def token_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, limit: int = LIMIT, end: int | None = 0, carry: Sequence[str] = ()) -> DataFrame:
    """Tokenizes whole texts (null: empty), ends each document with the id ``end``, and cuts it into
    pieces of at most ``limit`` ids: key, the columns ``carry``, ``start``, ``length``, ``doc_tokens``, ``ids`` (little-endian
    uint32).  Every row is a document of its own, whatever its key; other columns are left out."""
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (key, *carry))
    return docs.select(F.col(text).cast("string").alias("_text"), key, *carry).mapInArrow(_cut(vocabulary, limit, end), f"{kinds}, start long, length long, doc_tokens long, ids binary")


def shortest_pack_first(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[int, list[int]]]:
    """Patterns (how often, lengths) that place every length of the histogram.

    Lengths are placed longest first.  All packs of one pattern are one entry, kept under the room
    they have left; a length goes to the shortest packs (most room) that it fits in, as often as
    there are packs or pieces, and opens new packs for what remains.
    """
    packs: dict[int, list[tuple[int, list[int]]]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r in packs if r >= length), default=limit)
            if room in packs:
                count, pattern = packs[room].pop()
                if not packs[room]:
                    del packs[room]
                used = min(count, left)
                if count > used:
                    packs.setdefault(room, []).append((count - used, pattern))
            else:
                used, pattern = left, []
            packs.setdefault(room - length, []).append((used, [*pattern, length]))
            left -= used
    return [p for room in sorted(packs) for p in packs[room]]


def place_pieces(pieces: DataFrame, key: str = "doc_id", limit: int = LIMIT, order: Sequence[str] = ()) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (key, start, length, and more; ids are better left out).
    The pieces are read twice, so pieces that are dear to make come from a kept table.  Pieces of one
    length are placed by the columns of ``order``, then by key and start.

    Only the histogram (at most ``limit`` numbers) reaches the driver, where patterns are counted.
    Pieces are ranked within their length by global prefix counts (a length may hold
    a third of all pieces); a pattern's uses of a length are an interval of ranks, and joining
    pieces to intervals by length and rank gives pack and offset.
    """
    spark = pieces.sparkSession
    ranked = keep(running_totals(pieces, ["length"], [*order, key, "start"]).drop("sum_before"))
    histogram = {r[0]: r[1] for r in ranked.groupBy("length").count().collect()}
    if any(not 0 < n <= limit for n in histogram):
        raise ValueError(f"lengths are from 1 to {limit}")
    taken, spans, sequence = dict.fromkeys(histogram, 0), [], 0
    for count, pattern in shortest_pack_first(histogram, limit):
        offset = 0
        for length in pattern:
            spans.append((length, taken[length], taken[length] + count, sequence, offset))
            taken[length] += count
            offset += length
        sequence += count
    spans = spark.createDataFrame(spans, "_length long, _low long, _high long, _sequence long, _offset long")
    joined = ranked.join(F.broadcast(spans), (F.col("length") == F.col("_length")) & (F.col("rows_before") >= F.col("_low")) & (F.col("rows_before") < F.col("_high")))  # patterns over at most limit lengths
    return joined.select(*pieces.columns, (F.col("_sequence") + F.col("rows_before") - F.col("_low")).alias("sequence_id"), F.col("_offset").alias("offset"))


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, limit: int = LIMIT, end: int | None = 0) -> DataFrame:
    """Every document's pieces (key, ``start``, ``length``, ``doc_tokens``, ``ids``) with ``sequence_id`` and ``offset``.  Rows are
    numbered first, so that null and repeated keys are documents of their own."""
    rows = numbered(docs.select(key, text))
    pieces = keep(token_pieces(rows, key, text, vocabulary, limit, end, ["_row"]))
    placed = place_pieces(pieces.drop("ids"), key, limit, ["_row"]).select(F.col("_row").alias("_at"), F.col("start").alias("_start"), "sequence_id", "offset")
    return pieces.join(placed, (F.col("_row") == F.col("_at")) & (F.col("start") == F.col("_start"))).drop("_row", "_at", "_start")
