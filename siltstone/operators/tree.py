"""The directory tree: paths, listings and searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import contains_ascii, glob_regex, type_letter
from siltstone.operators.common import cut

#: Deeper than any path that a file system allows; a longer chain is a cycle. Levels that one job builds.
DEEPEST, TOGETHER = 4096, 3


def paths(dirents: DataFrame) -> DataFrame:
    """snap_id, node_id, path and depth of each directory entry.

    Level by level, from the roots, but over directories alone: those that have entries. All other entries
    are joined once, with the paths of their directories. Entries whose parent is missing keep their bare
    names, and what is under them is named from there.
    """
    inner = _directories(dirents)
    ids = inner.select("snap_id", F.col("node_id").alias("parent_node")).distinct()
    # those whose parent is none: that of roots is 0, those of orphans aren't there
    tops = inner.join(ids, ["snap_id", "parent_node"], "left_anti")
    up = _levels(inner, tops.select("snap_id", "node_id", F.col("name").alias("path"), F.lit(1).cast("long").alias("depth")))
    up = up.select("snap_id", F.col("node_id").alias("parent_node"), F.col("path").alias("up"), "depth")
    placed = dirents.join(up, ["snap_id", "parent_node"], "left")
    return placed.select("snap_id", "node_id", F.concat_ws("/", "up", "name").alias("path"), (F.coalesce("depth", F.lit(0)) + 1).alias("depth"))


def paths_below(dirents: DataFrame, parent: int | F.Column, prefix: str) -> DataFrame:
    """The same of what lies under one directory, whose path is ``prefix``: nothing else is walked."""
    top = dirents.where(F.col("parent_node") == parent)
    depth = prefix.count("/") + 2
    entries = top.select("snap_id", "node_id", F.concat(F.lit(prefix + "/"), "name").alias("path"), F.lit(depth).cast("long").alias("depth"))
    inner = _directories(dirents)
    parents = inner.select("snap_id", "node_id").distinct()
    return entries.union(_under(dirents, _levels(inner, entries.join(parents, ["snap_id", "node_id"], "left_semi"))))


def _directories(dirents: DataFrame) -> DataFrame:
    """Entries of directories that have entries, of which there are few beside the entries."""
    parents = dirents.select("snap_id", F.col("parent_node").alias("node_id")).distinct()
    return cut(dirents.select("snap_id", "parent_node", "node_id", "name").join(parents, ["snap_id", "node_id"], "left_semi"))


def _levels(inner: DataFrame, level: DataFrame) -> DataFrame:
    """The directories of ``level`` and all below them, a few levels in a job."""
    out = None
    for _ in range(0, DEEPEST, TOGETHER):
        steps = level.withColumn("_step", F.lit(0))
        for i in range(1, TOGETHER + 1):
            level = _under(inner, level)
            steps = steps.union(level.withColumn("_step", F.lit(i)))
        steps = cut(steps)
        done = steps.where(F.col("_step") < TOGETHER).drop("_step")
        out = done if out is None else out.union(done)
        level = steps.where(F.col("_step") == TOGETHER).drop("_step")
        if level.isEmpty():
            break
    return out


def _under(dirents: DataFrame, above: DataFrame) -> DataFrame:
    """The entries of directories whose paths are known, with theirs."""
    up = above.select("snap_id", F.col("node_id").alias("parent_node"), F.col("path").alias("up"), "depth")
    return dirents.join(up, ["snap_id", "parent_node"]).select("snap_id", "node_id", F.concat("up", F.lit("/"), "name").alias("path"), (F.col("depth") + 1).alias("depth"))


def children(dirents: DataFrame, nodes: DataFrame, parent: int | F.Column) -> DataFrame:
    """What a directory has in it: no paths are built for that."""
    return dirents.where(F.col("parent_node") == parent).join(nodes, ["snap_id", "node_id"])


def with_children_flag(entries: DataFrame, dirents: DataFrame) -> DataFrame:
    """``entries`` with whether each has entries of its own."""
    parents = dirents.select("snap_id", F.col("parent_node").alias("node_id"), F.lit(True).alias("_is")).distinct()
    return entries.join(parents, ["snap_id", "node_id"], "left").withColumn("has_children", F.coalesce("_is", F.lit(False))).drop("_is")


def of_type(letter: str) -> F.Column:
    """f, d, l, p, c or b; f takes hard links too, and any other letter takes everything."""
    # Node types of the letters.
    kinds = {"f": [1, 4], "d": [2], "l": [3], "p": [5], "c": [6], "b": [7]}.get(letter)
    return F.col("type").isin(kinds) if kinds else F.lit(True)


def named(glob: str, column: str = "name") -> F.Column:
    return F.col(column).rlike(glob_regex(glob))


def search(dirents: DataFrame, nodes: DataFrame, needle: str) -> DataFrame:
    """Entries whose name has ``needle``, A-Z and a-z alike, with how many there are in their snapshot."""
    hits = dirents.where(contains_ascii(F.col("name"), needle)).join(nodes.select("snap_id", "node_id", "type", "size"), ["snap_id", "node_id"])
    totals = hits.groupBy("snap_id").agg(F.count("*").alias("total"))
    return hits.join(totals, "snap_id").select("snap_id", "node_id", "name", type_letter(F.col("type")).alias("kind"), "size", "total")


def grep(files: DataFrame, pattern: str) -> DataFrame:
    """Lines of texts (path, text) that match an expression; files with a NUL in them are passed over."""
    from siltstone.functions.text import extended_regex

    lines = files.where(~F.contains("text", F.lit("\0"))).select("path", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.where(F.col("line").rlike(extended_regex(pattern))).select("path", (F.col("i") + 1).cast("long").alias("line_no"), "line")
