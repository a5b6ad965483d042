"""URL filters: a dated block list joined to captures as of their fetch times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import keep, release


def validity_intervals(entries: DataFrame, pattern: str = "pattern", action: str = "action", at: str = "listed_at") -> DataFrame:
    """Dated entries ('add' or 'remove') to ``pattern, valid_from, valid_to`` (not included; null: still
    valid).  Repeated adds make adjoining intervals; of several entries of one moment the last
    by name ('remove') counts.  Entries without pattern, time or known action are left out."""
    known = entries.select(F.lower(pattern).alias("pattern"), F.col(action).alias("action"), F.col(at).alias("valid_from"))
    known = known.where("pattern is not null and valid_from is not null and action in ('add', 'remove')")
    known = known.groupBy("pattern", "valid_from").agg(F.max("action").alias("action"))
    ordered = Window.partitionBy("pattern").orderBy("valid_from")
    return known.withColumn("valid_to", F.lead("valid_from").over(ordered)).where("action = 'add'").drop("action")


def path_depths(patterns: DataFrame, pattern: str = "pattern") -> list[int]:
    """The numbers of path segments that patterns have, without 0 (as many numbers as there are depths)."""
    depth = F.size(F.split(pattern, "/")) - 1
    return sorted(patterns.where(depth > 0).agg(F.collect_set(depth)).first()[0])


def lookup_keys(url: Column, depths: Sequence[int]) -> Column:
    """All patterns that would cover the URL: its host and the parent domains of two or more labels,
    and the host with the first path segments, as many as in ``depths``."""
    low = F.lower(url)
    host = F.regexp_extract(low, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    path = F.regexp_extract(low, r"^[^:]+://[^/?#]*(/[^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    below = F.transform(F.array(*map(F.lit, depths)).cast("array<int>"), lambda i: F.when(i <= F.size(parts), F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/"))))
    return F.when(host != "", F.filter(F.concat(parents, below), lambda k: k.isNotNull()))


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """Adds to each capture ``blocked``, ``n_entries`` (entries active at its fetch time that cover it),
    ``pattern`` and ``listed_from`` (of the longest of them; ties: the first by name).

    The list becomes validity intervals; captures are looked up under every key that could cover
    them (paths to the depths that the list has), by equality and ``valid_from <= fetched < valid_to``.  Verdicts are made once for each
    distinct (URL, time) and joined back; only covered ones are grouped, and both joins split
    large keys.  Null or unparsable URLs and null times match nothing.  Each capture gets a verdict of its own, also
    repeated ones; no captures: no rows, no entries: none blocked.  Columns that are named like the new ones are replaced; all
    other names may stand among the captures' columns.
    """
    rows = captures.drop("blocked", "n_entries", "pattern", "listed_from")
    names = rows.columns
    rows = rows.toDF(*[f"c{i}" for i in range(len(names))])  # so that no name clashes below
    link, when = (F.col(f"c{names.index(c)}") for c in (url, fetched))
    asked = rows.select(link.alias("_url"), when.alias("_at")).where("_url is not null and _at is not null").distinct()
    valid = keep(validity_intervals(entries))
    keyed = asked.select("_url", "_at", F.explode(lookup_keys(F.col("_url"), path_depths(valid))).alias("_key"))
    hits = keyed.join(valid, (F.col("_key") == F.col("pattern")) & (F.col("_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("_at") < F.col("valid_to"))))
    best = F.min(F.struct((-F.length("pattern")).alias("l"), F.col("pattern"), F.col("valid_from")))
    verdicts = keep(hits.groupBy("_url", "_at").agg(F.count("*").alias("n"), best.alias("best")))
    release(valid)
    out = rows.join(verdicts, (link == F.col("_url")) & (when == F.col("_at")), "left")
    out = out.select(*rows.columns, F.col("n").isNotNull(), F.coalesce("n", F.lit(0)), F.col("best.pattern"), F.col("best.valid_from"))
    return out.toDF(*names, "blocked", "n_entries", "pattern", "listed_from")
