"""Near-duplicate embeddings by spherical-cap filters: random product codes, list decoding, verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import keep, partitions, release, runs
from lectern.llm.components import components, smallest
from lectern.llm.vectors import as_double, element, matrix, usable

#: Filters that a random vector exceeds on average, and the best ones that any vector gets at least.
FILTERS, LEAST_FILTERS = 8, 16
#: Vectors of a filter, on average: so many filters are laid out in all.
CELL = 512
#: Vectors of a bucket (the filters that share their first words) that a task holds at most, and at least where there are
#: more tasks; larger buckets are cut into blocks.
BLOCK, LEAST_BLOCK = 131_072, 1024
#: Rows that are multiplied with each other at once.
TILE = 2048
_codes: dict[tuple[int, int], ProductCode] = {}


class ProductCode:
    """Filter directions of ``dim`` dimensions: a random rotation cuts a vector into ``parts``, and a
    direction is a choice of one of ``words`` random unit vectors for each part.  A vector passes the
    filters whose inner product with it is at least ``alpha``."""

    def __init__(self, dim: int, words: int, parts: int = 4, seed: int = 5):
        rng = np.random.default_rng([seed, dim, words])
        self.parts, self.words = min(parts, dim), words
        self._turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self._cut = np.array_split(np.arange(dim), self.parts)
        self._code = [c / np.linalg.norm(c, axis=1, keepdims=True) / np.sqrt(self.parts) for c in (rng.standard_normal((words, len(i))) for i in self._cut)]
        sample = rng.standard_normal((64, dim))
        self.alpha = self._threshold(self._scores(sample / np.linalg.norm(sample, axis=1, keepdims=True)))

    def _threshold(self, sample: np.ndarray) -> float:
        """The inner product that the sample's vectors reach with FILTERS filters on average: found by halving,
        with the filters above a value counted from the sums of each half of the parts, so that memory
        follows the square root of the number of filters."""
        halves = [(np.sort(self._all(s[: self.parts // 2])), np.sort(self._all(s[self.parts // 2 :]))) for s in sample]
        wanted = FILTERS * len(sample)
        low, high = min(a[0] + b[0] for a, b in halves), max(a[-1] + b[-1] for a, b in halves)
        if wanted >= len(sample) * self.words**self.parts:
            return float(low)
        for _ in range(60):
            middle = (low + high) / 2
            if sum(int((len(b) - np.searchsorted(b, middle - a)).sum()) for a, b in halves) >= wanted:
                low = middle
            else:
                high = middle
        return float(low)

    def _scores(self, x: np.ndarray) -> np.ndarray:
        turned = x @ self._turn
        return np.stack([turned[:, i] @ c.T for i, c in zip(self._cut, self._code, strict=True)], axis=1)

    @staticmethod
    def _all(scores: np.ndarray) -> np.ndarray:
        out = np.zeros(1)
        for s in scores:
            out = (out[:, None] + s[None, :]).ravel()
        return out

    def _best(self, scores: np.ndarray) -> np.ndarray:
        """The numbers of the LEAST_FILTERS best filters.  Only the best of the partial sums can be
        completed to one of them, so no more are carried from part to part."""
        number, total = np.zeros(1, np.int64), np.zeros(1)
        for s in scores:
            words = np.argsort(-s, kind="stable")[:LEAST_FILTERS]
            total = (total[:, None] + s[words][None, :]).ravel()
            number = (number[:, None] * self.words + words[None, :]).ravel()
            stay = np.argsort(-total, kind="stable")[:LEAST_FILTERS]
            number, total = number[stay], total[stay]
        return number

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """For each unit vector the sorted numbers of its filters.  Partial sums that can't reach alpha with
        the best of the other parts are dropped on the way; a vector that passes fewer than
        LEAST_FILTERS takes its best ones (see _best)."""
        out = []
        for scores in self._scores(x):
            best = [s.max() for s in scores]
            number, total = np.zeros(1, np.int64), np.zeros(1)
            for i, s in enumerate(scores):
                at = (total[:, None] + s[None, :]).ravel()
                stay = at + sum(best[i + 1 :]) >= self.alpha
                number = (number[:, None] * self.words + np.arange(self.words)[None, :]).ravel()[stay]
                total = at[stay]
            if len(number) < LEAST_FILTERS:
                number = self._best(scores)
            out.append(np.sort(number))
        return out


def _units(x: np.ndarray) -> np.ndarray:
    """Divided by their lengths, in double precision (first by their largest component, so that squares stay finite)."""
    x = x.astype(float)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _coded(kind: str, words: int, depth: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(class, n, id, label, vector) to the same with ``filters`` (little-endian int64) and ``buckets``."""
        for batch in batches:
            filters: list[bytes] = [b""] * batch.num_rows
            buckets: list[np.ndarray] = [np.empty(0, np.int64)] * batch.num_rows
            size = pc.list_value_length(batch.column(4)).to_numpy()
            for dim in np.unique(size):
                code = _codes.get((int(dim), words)) or _codes.setdefault((int(dim), words), ProductCode(int(dim), words))
                at = np.flatnonzero(size == dim)
                x = _units(matrix(batch.column(4).take(pa.array(at)), kind))
                for i, found in zip(at, code.decode(x), strict=True):
                    filters[i] = found.astype("<i8").tobytes()
                    buckets[i] = np.unique(found // words ** max(code.parts - depth, 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size, pa.int32()), pa.array(filters, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))], [*batch.schema.names, "dim", "filters", "buckets"])

    return go


def _meet_first(filters: list[np.ndarray], here: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of pairs of rows that share filter ``here``: do they share no smaller one?  ``filters``: of each row, sorted."""
    smaller = [f[: np.searchsorted(f, here)] for f in filters]
    n = np.array([len(f) for f in smaller])
    if len(a) * max(1, int(n.max())) ** 2 <= 1 << 22:
        wide = np.full((2, len(filters), max(1, int(n.max()))), -1)
        wide[1] = -2
        for side in wide:
            side[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = np.concatenate([*smaller, np.empty(0, np.int64)])
        out = np.empty(len(a), bool)
        step = max(1, (1 << 22) // wide.shape[2] ** 2)
        for at in range(0, len(a), step):
            out[at : at + step] = ~(wide[0][a[at : at + step], :, None] == wide[1][b[at : at + step], None, :]).any(axis=(1, 2))
        return out
    # one bit for each filter of several rows, the commonest first, so that the first word settles most pairs
    _, at, count = np.unique(np.concatenate(smaller), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
    row, bit = np.repeat(np.arange(len(n)), n)[count[at] > 1], rank[at][count[at] > 1]
    bits = np.zeros((len(filters), max(1, -(-int((count > 1).sum()) // 64))), np.uint64)
    np.add.at(bits, (row, bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
    left = np.arange(len(a))
    for word in bits.T:
        left = left[(word[a[left]] & word[b[left]]) == 0]
    out = np.zeros(len(a), bool)
    out[left] = True
    return out


def _links(kind: str, words: int, depth: int, cosine: float):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of bucket blocks, sorted, to (class, links, least): how many vectors are linked to the class by pairs
        whose first common filter lies in this bucket, and the smallest class of its component here (over all
        pairs that are linked in these blocks)."""
        for t in runs(batches, ["place", "i", "j"]):
            if t.num_rows < 2:
                continue
            i, j, bucket, dim = (t[c][0].as_py() for c in ("i", "j", "bucket", "dim"))
            block, name, weight = (t[c].to_numpy() for c in ("block", "class", "n"))
            x = _units(matrix(t["vector"], kind))
            filters = [np.frombuffer(f, "<i8") for f in t["filters"].to_pylist()]
            below = words ** max(min(4, dim) - depth, 0)
            own = [f[slice(*np.searchsorted(f, [bucket * below, (bucket + 1) * below]))] for f in filters]
            cell, row = np.concatenate(own), np.repeat(np.arange(len(own)), [len(f) for f in own])
            order = np.argsort(cell, kind="stable")
            cell, row = cell[order], row[order]
            edge = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]])
            links, joined = np.zeros(t.num_rows, np.int64), []
            for low, high in zip(edge[:-1], edge[1:], strict=True):
                here, at = int(cell[low]), row[low:high]
                left = at if i == j else at[block[at] == i]
                right = at if i == j else at[block[at] == j]
                for p in range(0, len(left), TILE):
                    for q in range(p if i == j else 0, len(right), TILE):
                        u, v = left[p : p + TILE], right[q : q + TILE]
                        near = x[u] @ x[v].T >= cosine
                        a, b = (np.triu(near, 1) if i == j and p == q else near).nonzero()
                        if not len(a):
                            continue
                        both = np.concatenate([u, v])
                        new = _meet_first([filters[r] for r in both], here, a, b + len(u))
                        a, b = u[a], v[b]
                        joined.append(np.stack([both, both[smallest(np.arange(len(both)), *_at(both, a, b))]]))
                        np.add.at(links, a[new], weight[b[new]])
                        np.add.at(links, b[new], weight[a[new]])
            if joined:
                a, b = np.concatenate(joined, axis=1)
                least = smallest(name, a, b)
                seen = np.zeros(t.num_rows, bool)
                seen[a[a != b]] = seen[b[a != b]] = True
                yield pa.RecordBatch.from_arrays([pa.array(name[seen]), pa.array(links[seen]), pa.array(least[seen])], ["class", "links", "least"])

    return go


def _at(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the rows a and b first stand in ``rows``."""
    order = np.argsort(rows, kind="stable")
    return order[np.searchsorted(rows[order], a)], order[np.searchsorted(rows[order], b)]


def near_embeddings(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.98) -> DataFrame:
    """Links vectors of equal label with a cosine of at least ``cosine``; returns for each row the key,
    ``n_links`` (other vectors linked directly), ``component_id``, ``kept``.

    Equal vectors of a label (by 128 bits of hash) are one class, with its count as weight.  Every class gets the filters that
    it exceeds (the number of filters follows the number of classes, so that filters hold some ``CELL`` vectors each).
    A filter is a choice of words for four parts; filters that share their first words are one bucket, and
    a vector travels once to each of its buckets (three or four where one word makes a bucket), not once to each
    filter.  There, vectors that share a filter are multiplied in tiles, in double precision.  A pair counts in its first
    common filter alone, so links are counted without listing pairs.  For the components each
    block is reduced to its own components: a member passes on the smallest class of the one it is in.

    Null labels, and vectors that are null, empty, zero or hold null or non-finite components, link
    with nothing, as do vectors of different lengths.  Rows with a null key are returned without a component,
    kept, and count as links.  Rows that share a key are vectors of their own, with a component each.  No rows: no
    rows.  Other columns are not looked at, whatever their names.  Pairs at exactly 0.98 may share no filter (the
    README has the measured share); pairs of a higher cosine do so less often.
    """
    spark, kind = df.sparkSession, element(df, vector)
    rows = df.select(F.col(key).alias("id"), as_double(df, vector).alias("vector"), F.col(label).cast("string").alias("label"))
    rows = rows.withColumn("usable", usable(F.col("vector")) & F.col("label").isNotNull())
    rows = rows.withColumn("high", F.when(F.col("usable"), F.xxhash64("label", "vector"))).withColumn("low", F.when(F.col("usable"), F.xxhash64(F.lit(1), "vector", "label")))
    classes = rows.where("usable").groupBy("high", "low").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.count("*").alias("n"), F.min("id").alias("id"))
    classes = keep(classes.withColumn("class", F.monotonically_increasing_id()))  # the write fixes the numbers
    count = classes.count()
    words = max(4, int(np.ceil((LEAST_FILTERS * count / CELL) ** 0.25)))
    depth = next((d for d in (1, 2, 3) if 3.5 * 2 ** (d - 1) * count <= BLOCK * words**d), 4)  # about so many buckets a vector, by depth
    floats = "float" if kind == "<f4" else "double"
    names = classes.schema["id"].dataType.simpleString()
    coded = classes.select("class", "n", "id", "label", "vector").repartition(partitions(spark))
    coded = keep(coded.mapInArrow(_coded(kind, words, depth), f"class long, n long, id {names}, label string, vector array<{floats}>, dim int, filters binary, buckets array<long>"))
    met = coded.select("class", "n", "label", "vector", "dim", "filters", F.explode("buckets").alias("bucket"))
    ends = ["label", "dim", "bucket"]
    sizes = coded.select("label", "dim", F.explode("buckets").alias("bucket")).groupBy(*ends).agg(F.count("*").alias("size")).where("size > 1")
    sizes = keep(sizes.withColumn("place", F.monotonically_increasing_id()))
    block = min(BLOCK, max(LEAST_BLOCK, (sizes.agg(F.sum("size")).first()[0] or 0) // partitions(spark)))
    blocks = F.ceil(F.col("size") / block).cast("int")
    met = met.join(sizes, ends).withColumn("block", F.pmod(F.xxhash64("class"), blocks).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = met.select("place", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "bucket", "dim", "class", "n", "vector", "filters")
    met = met.repartition(partitions(spark), "place", "i", "j").sortWithinPartitions("place", "i", "j")
    found = keep(met.mapInArrow(_links(kind, words, depth, cosine), "class long, links long, least long"))
    whole = components(found.select(F.col("class").alias("a"), F.col("least").alias("b")))
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    told = classes.select("high", "low", "class", "id", "n").join(whole.withColumnRenamed("node", "class"), "class", "left").join(links, "class", "left")
    told = keep(told.withColumn("component", F.coalesce("component", "class")))
    release(coded, sizes, found, whole)
    least = keep(told.groupBy("component").agg(F.min("id").alias("least")))
    answer = keep(told.join(least, "component").select("high", "low", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "least"))
    release(classes, told, least)
    out = rows.select("id", "high", "low").join(answer, ["high", "low"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("least", "id"))
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
