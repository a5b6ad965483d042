"""Language identification by bit-sliced Bloom filters of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import keep, map_batches, release
from lectern.llm.words import mix

GRAM = 4
#: Places of the filters, and hash functions for each gram.
SLOTS, HASHES = 1 << 20, 3
#: The filters are fitted on about so many documents, dealt by a hash.
FIT_ROWS = 20_000
#: A language holds a gram if the share of its documents with the gram is at least this part of the
#: largest share among the languages, and so many of its documents have it.
PART, LEAST_DOCS = 0.5, 2
UNKNOWN = "und"

_letter: np.ndarray | None = None
_WEIGHTS = np.random.default_rng(11).integers(0, 2**63, GRAM, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _is_letter() -> np.ndarray:
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letter


def grams(text: str | None) -> np.ndarray:
    """Hashes of all runs of GRAM characters of the lower-cased text, in which every stretch of other
    characters than letters is one blank, with a blank at both ends; none if there are no letters."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _is_letter()[code]
    if not letter.any():
        return np.empty(0, np.uint64)
    code = np.where(letter, code, 32)
    code = code[letter | np.concatenate([[False], letter[:-1]])]
    code = np.concatenate([[32], code, [32]] if code[-1] != 32 else [[32], code]).astype(np.uint64)
    if len(code) < GRAM:
        code = np.concatenate([code, np.full(GRAM - len(code), 32, np.uint64)])
    n = len(code) - GRAM + 1
    out = code[:n] * _WEIGHTS[0]
    for i in range(1, GRAM):
        out += code[i : n + i] * _WEIGHTS[i]
    return mix(out)


def _places(hashes: np.ndarray) -> list[np.ndarray]:
    return [(hashes >> np.uint64(20 * i)) % np.uint64(SLOTS) for i in range(HASHES)]


class LanguageFilters:
    """One Bloom filter for each language, stored by place: bit l % 64 of ``masks[p, l // 64]`` is place p of language
    l's filter, so HASHES reads tell all languages that hold a gram.  8 MB for each 64 languages."""

    def __init__(self, languages: list[str], masks: np.ndarray):
        self.languages, self.masks = languages, masks
        self.false = np.array([self._bit(masks, i).mean() ** HASHES for i in range(len(languages))])

    @classmethod
    def of(cls, members: dict[str, np.ndarray]) -> LanguageFilters:
        """Filters that hold the grams given for each language."""
        masks = no_masks(len(members))
        for i, hashes in enumerate(members.values()):
            for p in _places(hashes):
                masks[p, i // 64] |= np.uint64(1 << i % 64)
        return cls(list(members), masks)

    @staticmethod
    def _bit(masks: np.ndarray, i: int) -> np.ndarray:
        return (masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language that holds the most grams of the text, less what chance hits would be, and the
        share of grams that it holds."""
        g = grams(text)
        if not len(g) or not self.languages:
            return UNKNOWN, 0.0
        found = np.bitwise_and.reduce([self.masks[p] for p in _places(g)])
        hits = np.array([int(self._bit(found, i).sum()) for i in range(len(self.languages))])
        true = (hits - len(g) * self.false) / np.maximum(1 - self.false, 1e-9)
        best = int(true.argmax())
        return self.languages[best], float(min(1.0, max(0.0, true[best] / len(g))))


def no_masks(languages: int) -> np.ndarray:
    return np.zeros((SLOTS, max(1, -(-languages // 64))), np.uint64)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, gram, docs); gram 0 counts the documents themselves."""
    for batch in batches:
        by: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            by.setdefault(lang, []).append(np.unique(grams(text)))
        for lang, sets in by.items():
            gram, docs = np.unique(np.concatenate([*sets, np.zeros(len(sets), np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(gram.view(np.int64)), pa.array(docs.astype(np.int64))], ["lang", "gram", "docs"])


def held_out(key: Column) -> Column:
    """One document in five, by the checksum of its key as text."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def dealt(rows: int, total: int, *columns: str) -> Column:
    """True for about so many of the rows, dealt by a hash of the columns (equal rows go together)."""
    return F.xxhash64(*columns).bitwiseAND(F.lit(2**63 - 1)) < F.lit(min(2**63 - 1, 2**63 * rows // max(total, 1)))


def shares(counts: dict[str, int], rows: int) -> dict[str, int]:
    """How many of the rows of each language are fitted: equal shares, where small languages give what they
    don't need to the others."""
    out, left = {}, rows
    for i, (name, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[name] = min(n, left // (len(counts) - i))
        left -= out[name]
    return out


def fit_language_filters(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = FIT_ROWS) -> LanguageFilters:
    """Fits filters to about ``rows`` documents that name a language, dealt by a hash in equal shares to the languages, so
    that rare ones stay: executors count the documents of each language that have a gram, find the languages
    that hold it, and set the bits; the driver gets one number for each place of the filters, whatever
    the lengths of the texts.  Null texts and languages are left out; no documents give filters without languages.  Rows
    that share a key are documents of their own, but equal rows are dealt together."""
    named = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    counts = {r[0]: r[1] for r in named.groupBy("lang").count().collect()}  # a row for each language
    if sum(counts.values()) > rows:
        wanted = shares(counts, rows)
        part = F.create_map(*[F.lit(x) for name, n in counts.items() for x in (name, min(2**63 - 1, 2**63 * wanted[name] // n))])
        named = named.where(F.xxhash64("key", "text").bitwiseAND(F.lit(2**63 - 1)) < part[F.col("lang")])
    seen = keep(named.select("lang", "text").mapInArrow(_count_grams, "lang string, gram long, docs long").groupBy("lang", "gram").agg(F.sum("docs").alias("docs")).where((F.col("docs") >= LEAST_DOCS) | (F.col("gram") == 0)))  # most grams are one document's
    total = {r.lang: r.docs for r in seen.where("gram = 0").orderBy("lang").collect()}
    if not total:
        return LanguageFilters.of({})
    number, of = F.create_map(*[F.lit(x) for i, name in enumerate(total) for x in (name, i)]), F.create_map(*[F.lit(x) for name, n in total.items() for x in (name, n)])
    held = seen.where("gram <> 0").select("gram", F.struct((F.col("docs") / of[F.col("lang")]).alias("share"), number[F.col("lang")].alias("i")).alias("s"))
    held = held.groupBy("gram").agg(F.collect_list("s").alias("all"), F.max("s.share").alias("top"))  # a struct for each language
    held = held.select("gram", F.explode(F.filter("all", lambda s: s["share"] >= PART * F.col("top"))).alias("s")).select("gram", "s.i")
    place = F.explode(F.array(*[F.shiftrightunsigned("gram", 20 * h).bitwiseAND(F.lit(SLOTS - 1)) for h in range(HASHES)]))
    bits = held.select(place.alias("place"), F.expr("i div 64").alias("word"), F.expr("shiftleft(1L, i % 64)").alias("bit")).groupBy("place", "word").agg(F.bit_or("bit").alias("mask")).toPandas()
    release(seen)
    masks = no_masks(len(total))
    masks[bits.place.to_numpy(np.int64), bits.word.to_numpy(np.int64)] = bits["mask"].to_numpy(np.int64).view(np.uint64)
    return LanguageFilters(list(total), masks)


def identify_languages(docs: DataFrame, filters: LanguageFilters, text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (0 to 1) to every row, from the whole text.

    ``und`` and 0 for null texts and texts without letters.  Ties go to the first language by name.  Every
    row is judged for itself, also repeated ones; no rows: no rows.  Columns of these names are replaced."""
    rest = docs.drop("lang_pred", "score")
    at = rest.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # 8 MB for each 64 languages, whatever the corpus

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [shared.value.predict(t) for t in batch.column(at).to_pylist()]
            columns = [*batch.columns, pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "lang_pred", "score"])

    return map_batches(rest, go, "lang_pred string, score double")
