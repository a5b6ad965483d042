"""A Merkle manifest of a table: content-addressed records of a digest tree, and proofs by descent from its root."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import keep, keep_last, release, running_totals

#: Children of a node at most, and their numbers in a path (fixed values).
FANOUT, DIGITS = 16, "0123456789abcdef"
#: Characters of a digest.
WIDTH = 64


def leaf_digest(*fields: str) -> Column:
    """Of columns in order: each '-' if null, else the number of its UTF-8 bytes, a colon and its value as text."""
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (F.col(f).cast("string") for f in fields)]
    return F.sha2(F.concat(*parts), 256)


def _digest(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, ""), 256)


@dataclass
class Manifest:
    """leaves: (group, key, leaf, *carry, path, subroot); records: (digest, children), a row for each digest; root: None without
    leaves.  Both tables are kept; ``delete()`` when no result that reads them is needed."""

    leaves: DataFrame
    records: DataFrame
    root: str | None

    def delete(self) -> None:
        release(self.leaves, self.records)


def _grow(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Nodes (tree, nth, n, digest) of whole trees, n of a tree, to the kept levels above them, and the roots (tree, digest)."""
    levels, roots, now = [], nodes.where("n = 1").select("tree", "digest"), nodes.where("n > 1")
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        most = -(-most // FANOUT)
        runs = now.groupBy("tree", F.expr(f"nth div {FANOUT}").alias("up"), "n").agg(F.array_sort(F.collect_list(F.struct("nth", "digest"))).alias("run"))  # 16 rows at most
        runs = runs.select("tree", F.col("up").alias("nth"), F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"), F.transform("run", lambda x: x["digest"]).alias("children"))
        levels.append(keep(runs.withColumn("digest", _digest(F.col("children")))))
        roots = roots.unionByName(levels[-1].where("n = 1").select("tree", "digest"))
        now = levels[-1].where("n > 1").select("tree", "nth", "n", "digest")
    return levels, roots


def _path(nth: Column, n: Column) -> Column:
    """The digits of a place among n, from the root down; '' if it is the only one."""
    return F.when(n > 1, F.lpad(F.lower(F.hex(nth)), F.length(F.hex(n - 1)), "0")).otherwise("")


def build_manifest(leaves: DataFrame, group: str, key: str, leaf: str = "leaf", carry: Sequence[str] = ()) -> Manifest:
    """Trees of 16-fold nodes over the leaves of each group, in the order of their keys, and one tree over the groups' roots
    in the order of groups (null first, by UTF-8 bytes).  While a level has several nodes, 16 consecutive ones (the last
    run may have fewer) become the digest of their digests; a lone leaf is its tree's root.

    Places come from running totals over ranges, so one group may hold most rows; no node gathers more than 16 rows, and a
    level has a sixteenth of the rows of the one below.  Rows are told apart by key and leaf: rows alike in both
    take neighbouring places, in an arbitrary order.  Null keys come first.  No leaves: no records, root None.
    """
    rows = leaves.select(F.col(group).alias("_tree"), F.col(key).alias("_key"), F.col(leaf).alias("_leaf"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    placed = keep_last(lambda: running_totals(rows, ["_tree"], ["_key", "_leaf"], total=True).drop("sum_before"))
    levels, roots = _grow(placed.select(F.col("_tree").alias("tree"), F.col("rows_before").alias("nth"), F.col("rows_total").alias("n"), F.col("_leaf").alias("digest")))
    ranked = keep_last(lambda: running_totals(roots, [], ["tree"], total=True).drop("sum_before"))
    above, top = _grow(ranked.select(F.lit(0).alias("tree"), F.col("rows_before").alias("nth"), F.col("rows_total").alias("n"), "digest"))
    root = top.select("digest").first()
    start = ranked.select(F.col("tree").alias("_of"), F.col("digest").alias("subroot"), _path(F.col("rows_before"), F.col("rows_total")).alias("_head"))
    known = placed.join(start, F.col("_tree").eqNullSafe(F.col("_of")))
    known = keep(known.select(
        F.col("_tree").alias(group), F.col("_key").alias(key), F.col("_leaf").alias("leaf"), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)],
        F.concat("_head", _path(F.col("rows_before"), F.col("rows_total"))).alias("path"), "subroot",
    ))
    every = [t.select("digest", "children") for t in [*levels, *above]]
    if not every:
        every = [known.limit(0).select(F.col("leaf").alias("digest"), F.array("leaf").alias("children"))]
    records = keep(reduce(DataFrame.unionByName, every).groupBy("digest").agg(F.first("children").alias("children")))
    release(placed, ranked, *levels, *above)
    return Manifest(known, records, root[0] if root else None)


def prove(records: DataFrame, root: str | None, requests: DataFrame) -> DataFrame:
    """Adds to requests (rows with a ``path``) ``siblings``: for each level from the leaf up to the root, the digests of the other
    children as one text.

    All requests descend together: at each level the distinct beginnings of their paths (no more nodes than requests) take the
    child of their last digit at the node above, collect the children not chosen, and look up its record by
    digest.  At the end a request takes the segments of its last node, reversed.  Requests without a digit (a
    manifest of one leaf) have no siblings; repeated ones are answered each; no requests: no rows.
    """
    depth = requests.agg(F.max(F.length("path"))).first()[0] or 0
    if not depth:
        return requests.withColumn("siblings", F.array().cast("array<string>"))
    opened = []
    for d in range(depth):
        wanted = requests.where(F.length("path") > d).select(F.substring("path", 1, d).alias("prefix")).distinct()
        if not d:
            here = wanted.select("prefix", F.lit(root).alias("_digest"), F.array().cast("array<string>").alias("above"))
        else:
            here = _below(wanted, "prefix", opened[-1]).select("prefix", F.get("_children", "_digit").alias("_digest"), F.concat("_above", F.array(_others(F.col("_children"), F.col("_digit")))).alias("above"))
        opened.append(keep(here.join(records, F.col("_digest") == F.col("digest")).select("prefix", "children", "above")))
    found = _below(requests, "path", reduce(DataFrame.unionByName, opened))
    mine = F.concat(F.array(_others(F.col("_children"), F.col("_digit"))), F.reverse("_above"))
    return found.select(*requests.columns, mine.alias("siblings"))


def _below(rows: DataFrame, path: str, nodes: DataFrame) -> DataFrame:
    """Rows joined to the nodes that their paths lead to but for the last digit, ``_digit``."""
    nodes = nodes.select(F.col("prefix").alias("_at"), F.col("children").alias("_children"), F.col("above").alias("_above"))
    digit = F.instr(F.lit(DIGITS), F.substring(F.col(path), -1, 1)) - 1
    return rows.withColumn("_digit", digit).join(nodes, F.col("_at") == F.expr(f"substring({path}, 1, length({path}) - 1)"))


def _others(children: Column, digit: Column) -> Column:
    return F.array_join(F.filter(children, lambda _, i: i != digit), "")


def fold(leaf: Column, path: Column, siblings: Column) -> Column:
    """The root that a leaf gives with its siblings from the leaf up, by the digits of its path from the end."""
    digits = F.transform(F.filter(F.split(F.reverse(path), ""), lambda c: c != ""), lambda c: F.instr(F.lit(DIGITS), c) - 1)
    steps = F.arrays_zip(siblings.alias("others"), digits.alias("digit"))
    put = lambda below, s: F.sha2(F.concat(F.substring(s["others"], F.lit(1), s["digit"] * WIDTH), below, F.substring(s["others"], s["digit"] * WIDTH + 1, F.length(s["others"]))), 256)
    return F.aggregate(steps, leaf, put)
