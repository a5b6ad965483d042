"""Toxicity: a linear classifier whose scores must not depend on which group a text mentions."""

from __future__ import annotations

import logging
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import keep, map_batches, release
from lectern.llm.language import dealt
from lectern.llm.words import Words

#: About so many labelled documents are fitted, dealt by a hash of their ids.
FIT_ROWS = 20_000
#: Features: words, and beginnings of words of so many bytes.
STEMS = (4, 5, 6)
#: A feature is a candidate if so many toxic documents have it, and a share of them that is LIFT times the share of others.
LEAST_DOCS, LIFT = 3, 3.0
#: Identity terms that may stand for each other, by kind, in the languages of the corpus (fixed values).
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual"), ("immigrants", "citizens", "refugees"),
    ("old", "young"), ("deaf", "blind", "disabled"),
    ("femmes", "hommes"), ("femme", "homme"), ("filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"), ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée"),
    ("noirs", "blancs", "asiatiques"), ("lesbiennes", "hétérosexuels", "homosexuels", "bisexuels"), ("immigrés", "citoyens", "réfugiés"), ("sourds", "aveugles", "handicapés"),
    ("frauen", "männer"), ("frau", "mann"), ("mädchen", "jungen"),
    ("muslime", "christen", "juden", "buddhisten", "atheisten"), ("muslimisch", "christlich", "jüdisch", "buddhistisch"),
    ("schwarze", "weiße", "asiaten"), ("schwule", "lesben", "bisexuelle"), ("einwanderer", "bürger", "flüchtlinge"), ("gehörlose", "blinde", "behinderte"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"), ("negros", "blancos", "asiáticos"),
    ("lesbianas", "heterosexuales", "homosexuales", "bisexuales"), ("inmigrantes", "ciudadanos", "refugiados"), ("sordos", "ciegos", "discapacitados"),
)
#: Weight of the squared score change under a swap, and of the squared weights.
SWAP_PENALTY, L2 = 1.0, 1e-4

_outside = np.ones(256, bool)
_outside[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_log = logging.getLogger(__name__)


class Swaps:
    """Replaces each identity term by the next of its kind."""

    def __init__(self, terms: Sequence[Sequence[str]] = IDENTITY_TERMS):
        self.terms = terms
        self._next: dict[str, str] = {}
        for kind in terms:
            for i, t in enumerate(kind):
                self._next.setdefault(t, kind[(i + 1) % len(kind)])
        self._pairs = [(a, b) for kind in terms for a, b in zip(kind, [*kind[1:], kind[0]], strict=True) if a != b]
        self._found = re.compile(rf"\b({'|'.join(map(re.escape, sorted(self._next)))})\b" if self._next else "(?!)", re.IGNORECASE)

    def mentioned(self, text: str) -> bool:
        return self._found.search(text) is not None

    def swapped(self, text: str) -> str:
        return self._found.sub(lambda m: self._next.get(m[0].lower(), m[0]), text)

    def inserted(self, text: str) -> tuple[str, str]:
        """The text with two terms of a kind put behind it, by its checksum; without terms: twice the text."""
        if not self._pairs:
            return text, text
        a, b = self._pairs[zlib.crc32(text.encode("utf-8", "surrogatepass")) % len(self._pairs)]
        return f"{text} {a}", f"{text} {b}"

    def features(self) -> np.ndarray:
        """The hashes of the terms as words."""
        return np.concatenate([np.empty(0, np.uint64), *(Words(t.lower(), _outside).hashes() for kind in self.terms for t in kind)]).view(np.int64)


def features(text: str | None) -> np.ndarray:
    """Sorted distinct hashes (int64) of the words of the whole text and of their beginnings."""
    w = Words((text or "").lower(), _outside)
    if not len(w):
        return np.empty(0, np.int64)
    out = [w.hashes()]
    for i, n in enumerate(STEMS):
        long = w.end - w.start > n
        out.append(w.hashes(w.start[long], w.start[long] + n) + np.uint64(i + 1))
    return np.unique(np.concatenate(out)).view(np.int64)


class ToxicityModel:
    def __init__(self, names: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(names)
        self.names, self.weights, self.bias = names[order], weights[order], bias
        self._seen = np.zeros(1 << 18, bool)  # most features are none of ours
        self._seen[self.names & (len(self._seen) - 1)] = True

    def places(self, found: np.ndarray) -> np.ndarray:
        """Numbers of those of our features that are among the ones found."""
        found = found[self._seen[found & (len(self._seen) - 1)]]
        at = np.searchsorted(self.names, found)
        at[at == len(self.names)] = 0
        return at[self.names[at] == found] if len(self.names) else at[:0]

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[self.places(features(text))].sum(), -30, 30))))


def _fit(rows: list[np.ndarray], toxic: np.ndarray, swaps: list[tuple[np.ndarray, np.ndarray]], size: int, penalty: float = SWAP_PENALTY, steps: int = 300, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Logistic regression on binary features by Adam, plus ``penalty`` times the mean squared change
    of the raw score between a text and its swapped form (over the pairs that change at all)."""
    swaps = [(a, b) for a, b in swaps if not np.array_equal(a, b)]
    flat = np.concatenate([*rows, np.empty(0, int)]).astype(int)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    changed = np.concatenate([np.setdiff1d(x, y) for pair in swaps for x, y in (pair, pair[::-1])] or [np.empty(0, int)]).astype(int)
    sides = np.array([len(np.setdiff1d(x, y)) for pair in swaps for x, y in (pair, pair[::-1])], int)
    swap = np.repeat(np.arange(len(sides)) // 2, sides)
    sign = np.repeat(1.0 - 2.0 * (np.arange(len(sides)) % 2), sides)  # 1: only in the text, -1: only in its swapped form
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        z = np.bincount(of, w[flat], len(rows)) + w[size]
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic) / len(rows)
        grad = np.append(np.bincount(flat, g[of], size), g.sum())
        grad[:size] += L2 * w[:size]
        if len(swaps):
            change = 2 * penalty / len(swaps) * np.bincount(swap, sign * w[changed], len(swaps))
            grad[:size] += np.bincount(changed, sign * change[swap], size)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:size], float(w[size])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) to (feature, toxic, docs)."""
    for batch in batches:
        by: dict[int, list[np.ndarray]] = {}
        for text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            by.setdefault(toxic, []).append(features(text))
        for toxic, sets in by.items():
            name, docs = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(np.full(len(name), toxic, np.int32)), pa.array(docs.astype(np.int64))], ["feature", "toxic", "docs"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = FIT_ROWS, terms: Sequence[Sequence[str]] = IDENTITY_TERMS, penalty: float = SWAP_PENALTY) -> ToxicityModel:
    """Fits the classifier to about ``rows`` of the labelled documents (0 or 1; others are left out), with counterfactual
    pairs whose scores should not differ.

    Features are those of several toxic documents that are LIFT times as frequent there (executors count and choose them), and the
    identity terms.  Each labelled text is fitted twice: as it is, and in a counterfactual form.  A text that mentions terms is paired
    with its swapped form; another one, with two terms of a kind (by a checksum of the text) that are put behind it, one in either
    member of the pair.  The second form has the label of the first, and the penalty holds the scores of a pair together.  The
    driver gets the numbers of features of each document fitted.  The model tells how many texts were ``swapped`` and
    in how many terms were ``inserted``.

    A key with several labels is toxic if one of them says so; of several texts of a key the first by
    value is fitted; null keys and labels are left out.  Null texts count as empty.  No labelled document: a model that scores all texts
    alike, below 0.5.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    chosen = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    total = known.count()
    if total > rows:  # the same hash keeps the other texts out of the join
        known, chosen = (df.where(dealt(rows, total, "_id")) for df in (known, chosen))
    train = keep(chosen.join(known, "_id").groupBy("_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"))
    counts = {r[0]: r[1] for r in train.groupBy("toxic").count().collect()}  # two rows
    n_pos, n_neg = max(1, counts.get(1, 0)), max(1, counts.get(0, 0))
    of = lambda label: F.sum(F.when(F.col("toxic") == label, F.col("docs")).otherwise(0))
    seen = train.mapInArrow(_count, "feature long, toxic int, docs long").groupBy("feature").agg(of(1).alias("pos"), of(0).alias("neg"))
    told = seen.where((F.col("pos") >= LEAST_DOCS) & (F.col("pos") / n_pos >= LIFT * (F.col("neg") + 0.5) / n_neg)).select("feature").toPandas()
    change = Swaps(terms)
    names = np.unique(np.concatenate([told.feature.to_numpy(np.int64), change.features()]))
    empty = ToxicityModel(names, np.zeros(len(names)), 0.0)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(text, toxic) to (toxic, own, one, other): the features of the text, and of a counterfactual pair: the text and its
        swapped form if it mentions a term, or else with one of two terms put behind it."""
        for batch in batches:
            texts = batch.column(0).to_pylist()
            out: list[list] = [[], [], [], []]
            for t in texts:
                a, b = (t, change.swapped(t)) if (swap := change.mentioned(t)) else change.inserted(t)
                for column, value in zip(out, (*(empty.places(features(x)).astype("<i4").tobytes() for x in (t, a, b)), swap), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(1), *[pa.array(c, pa.binary()) for c in out[:3]], pa.array(out[3], pa.bool_())], ["toxic", "own", "one", "other", "swap"])

    fitted = train.mapInArrow(rows_of, "toxic int, own binary, one binary, other binary, swap boolean").toPandas()
    own, one, other = ([np.frombuffer(x, "<i4") for x in fitted[c]] for c in ("own", "one", "other"))
    pairs = [(a, b) for a, b in zip(one, other, strict=True) if not np.array_equal(a, b)]
    toxic = fitted.toxic.to_numpy(float)
    model = ToxicityModel(names, *(_fit(own + one, np.concatenate([toxic, toxic]), pairs, len(names), penalty) if len(own) else (np.zeros(len(names)), -5.0)))
    model.swapped = int(fitted.swap.sum())
    model.inserted = len(fitted) - model.swapped if change.terms else 0
    _log.info("%d of %d labelled texts were swapped, terms were put behind %d", model.swapped, len(own), model.inserted)
    release(train)
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) to every row, from the whole text; null and
    empty texts get the score of a text without known features.  Every row is scored for itself, also repeated
    ones; no rows: no rows.  Columns of these names are replaced."""
    rest = docs.drop("score", "predicted")
    at = rest.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the documents fitted

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(t) for t in batch.column(at).to_pylist()]
            columns = [*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "score", "predicted"])

    return map_batches(rest, go, "score double, predicted int")
