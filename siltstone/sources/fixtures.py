"""The repository's relations, derived from the driver's tables: each as a DataFrame and as SQL for the oracle.

``Repo(spark, sf_dir)`` gives DataFrames; ``cte(*names)`` the WITH clause that defines the same relations, and
all that they need, in DuckDB's SQL.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.tree import paths

REGULAR, DIRECTORY, LINK = 1, 2, 3
PACK_BYTES = 1 << 18
#: Ids of directories begin above those of files.
DIRECTORY_BASE = 1 << 48
#: Ids of symbolic links.
LINK_BASE = 1 << 50


def text_hash(c: F.Column | str) -> F.Column:
    return F.sha2(F.col(c).cast("binary") if isinstance(c, str) else c.cast("binary"), 256)


def directory_id(path: F.Column) -> F.Column:
    return F.conv(F.substring(F.md5(path), 1, 10), 16, 10).cast("long") + F.lit(DIRECTORY_BASE)


class Repo:
    """Relations of one scale factor. Each property is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def files(self) -> DataFrame:
        """Files of two snapshots, with their content."""
        d = self.table("documents").select("doc_id", "lang", "source", "text")
        first = d.where("doc_id % 10 <> 0").select(F.lit(1).cast("long").alias("snap_id"), "*", F.lit(33188).cast("long").alias("mode"))
        second = d.where("doc_id % 10 <> 3").select(
            F.lit(2).cast("long").alias("snap_id"), "doc_id", "lang", "source",
            F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" v2"))).otherwise(F.col("text")).alias("text"),
            F.when(F.col("doc_id") % 5 == 1, 33184).otherwise(33188).cast("long").alias("mode"),
        )
        both = first.unionByName(second)
        return both.withColumn("parent", F.concat_ws("/", F.lit("home"), "lang", "source")).withColumn("name", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))

    @cached_property
    def file_paths(self) -> DataFrame:
        """Regular files by their first names, with their metadata."""
        return self.files.select(
            F.concat_ws("/", "parent", "name").alias("path"), "snap_id", (F.col("doc_id") + 1).alias("node_id"), F.lit(REGULAR).cast("long").alias("type"), "mode", F.lit(1000).cast("long").alias("uid"), (F.col("doc_id") % 3 + 100).alias("gid"),
            F.octet_length("text").cast("long").alias("size"), (F.col("doc_id") + 1700000000).alias("mtime_sec"), F.when(F.col("doc_id") % 17 == 4, F.col("snap_id") * 1000).otherwise(0).cast("long").alias("mtime_nsec"), text_hash("text").alias("content_hash"),
            F.when(F.col("doc_id") % 4 == 0, text_hash(F.concat(F.lit("xattr:"), F.when((F.col("doc_id") % 8 == 0) & (F.col("snap_id") == 2), F.col("source")).otherwise(F.col("lang"))))).alias("xattr_hash"), F.when(F.col("doc_id") % 9 == 0, text_hash(F.concat(F.lit("acl:"), "source"))).alias("acl_hash"),
            F.when(F.col("doc_id") % 50 == 7, 2).otherwise(1).cast("long").alias("link_count"), (F.col("doc_id") * 31 + 17).alias("inode_identity"),
        )

    @cached_property
    def links(self) -> DataFrame:
        """Symbolic links beside some files; some lead elsewhere in the second snapshot."""
        f = self.files.where("doc_id % 25 = 3 OR doc_id % 25 = 4")
        target = F.concat(F.col("doc_id").cast("string"), F.when((F.col("snap_id") == 2) & (F.col("doc_id") % 50 == 4), ".new").otherwise(".txt"))
        return f.select("snap_id", (F.col("doc_id") + LINK_BASE).alias("node_id"), directory_id(F.col("parent")).alias("parent_node"), F.concat(F.lit("sym-"), F.col("doc_id").cast("string")).alias("name"), target.alias("target"))

    @cached_property
    def nodes(self) -> DataFrame:
        """Files, directories and symbolic links, without paths."""
        f = self.file_paths.drop("path")
        none = [F.lit(None).cast("string").alias(c) for c in ("xattr_hash", "acl_hash")]
        long = lambda x, name: (F.lit(x) if isinstance(x, int) else x).cast("long").alias(name)
        # one directory has another mode in the second snapshot
        mode = F.when((F.col("snap_id") == 2) & (F.col("name") == "src2"), 16832).otherwise(16877)
        d = self.directories.select(
            "snap_id", "node_id", long(DIRECTORY, "type"), long(mode, "mode"), long(0, "uid"), long(0, "gid"), long(0, "size"),
            long(1700000000, "mtime_sec"), long(0, "mtime_nsec"), F.lit(None).cast("string").alias("content_hash"), *none, long(1, "link_count"), F.col("node_id").alias("inode_identity"),
        )
        s = self.links.select(
            "snap_id", "node_id", long(LINK, "type"), long(41471, "mode"), long(1000, "uid"), long(100, "gid"), long(F.octet_length("target"), "size"),
            long(1700000000, "mtime_sec"), long(0, "mtime_nsec"), text_hash("target").alias("content_hash"), *none, long(1, "link_count"), F.col("node_id").alias("inode_identity"),
        )
        return f.unionByName(d).unionByName(s)

    @cached_property
    def tree(self) -> DataFrame:
        """All names of both snapshots with their paths and nodes: what snapshots are compared by."""
        return paths(self.dirents).join(self.nodes, ["snap_id", "node_id"])

    @cached_property
    def directories(self) -> DataFrame:
        f = self.files.select("snap_id", "lang", "source").distinct()
        levels = f.select("snap_id", F.explode(F.array(
            F.struct(F.lit("home").alias("path"), F.lit("").alias("up"), F.lit("home").alias("name")),
            F.struct(F.concat(F.lit("home/"), "lang").alias("path"), F.lit("home").alias("up"), F.col("lang").alias("name")),
            F.struct(F.concat_ws("/", F.lit("home"), "lang", "source").alias("path"), F.concat(F.lit("home/"), "lang").alias("up"), F.col("source").alias("name")),
        )).alias("e")).select("snap_id", "e.*").distinct()
        return levels.select("snap_id", directory_id(F.col("path")).alias("node_id"), F.when(F.col("up") == "", 0).otherwise(directory_id(F.col("up"))).cast("long").alias("parent_node"), "name")

    @cached_property
    def dirents(self) -> DataFrame:
        """Directory entries; some files have a second name in their directory."""
        f = self.files.select("snap_id", directory_id(F.col("parent")).alias("parent_node"), (F.col("doc_id") + 1).alias("node_id"), "name", "doc_id")
        links = f.where("doc_id % 50 = 7").withColumn("name", F.concat(F.lit("link-"), F.col("doc_id").cast("string")))
        return self.directories.select("snap_id", "parent_node", "node_id", "name").unionByName(f.drop("doc_id")).unionByName(links.drop("doc_id")).unionByName(self.links.drop("target"))

    @cached_property
    def objects(self) -> DataFrame:
        d = self.table("documents").select(text_hash("text").alias("hash"), "doc_id", F.octet_length("text").cast("long").alias("uncompressed_size"))
        d = d.groupBy("hash").agg(F.min("doc_id").alias("k"), F.max("uncompressed_size").alias("uncompressed_size"))
        return d.select(
            "hash", (F.col("k") % 4 + 1).alias("type"), (F.col("k") % 3).alias("compression"), F.when(F.col("k") % 6 == 0, 1).otherwise(0).cast("long").alias("pack_skip_ver"), "uncompressed_size",
            F.expr("uncompressed_size * (40 + k % 61) div 100").alias("compressed_size"), F.when(F.col("k") % 3 == 0, "loose").otherwise("pack").alias("storage"),
        )

    @cached_property
    def payloads(self) -> DataFrame:
        """hash and payload of the objects; some payloads are damaged."""
        d = self.table("documents").groupBy(text_hash("text").alias("hash")).agg(F.min_by("text", "doc_id").alias("text"), F.min("doc_id").alias("k"))
        return d.select("hash", F.when(F.col("k") % 97 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary").alias("payload"))

    @cached_property
    def snapshots(self) -> DataFrame:
        """A long history of snapshots, from orders."""
        o = self.table("orders")
        return o.select((F.col("o_orderkey") + 1).alias("snap_id"), F.col("o_orderdate").alias("created"), (F.col("o_orderpriority") == "1-URGENT").alias("preserved"), (F.col("o_orderkey") % 16).alias("gfs_flags"), F.floor("o_totalprice").cast("long").alias("logical_bytes"))

    @cached_property
    def journal(self) -> DataFrame:
        e = self.table("events").where("event_id % 2 = 0 OR event_type <> 'error'")
        done = F.col("event_id") % 2 == 1
        return e.select(
            F.col("event_id").alias("line_no"), F.expr("event_id div 2").alias("op_id"), F.when(done, "completed").otherwise("started").alias("state"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"), F.col("ts"),
            F.when(~done, F.col("event_type")).alias("operation"), F.when(F.col("user_id") % 3 == 0, "cli").when(F.col("user_id") % 3 == 1, "api").otherwise("task").alias("source"), F.col("user_id"),
            F.when(done, F.when(F.col("event_id") % 5 == 0, "failed").when(F.col("event_id") % 7 == 0, "cancelled").otherwise("success")).alias("result"), F.when(done, F.floor("value").cast("long")).alias("duration_ms"),
        )

    @cached_property
    def tasks(self) -> DataFrame:
        """Background tasks: every seventh operation of the journal."""
        s = self.journal.where("state = 'started' AND op_id % 7 = 0").select("op_id", F.concat(F.lit("t"), F.col("op_id").cast("string")).alias("task_id"), F.col("operation").alias("command"), F.col("ts").alias("started"))
        c = self.journal.where("state = 'completed'").select("op_id", F.col("ts").alias("ended"), "result")
        state = F.when(F.col("result").isNull(), "running").when(F.col("result") == "success", "completed").otherwise("failed")
        return s.join(c, "op_id", "left").select("task_id", "command", "started", "ended", state.alias("state"))

    @cached_property
    def tags(self) -> DataFrame:
        o = self.table("orders").where("o_orderkey % 40 = 0")
        return o.select(F.concat(F.lit("v"), F.col("o_orderkey").cast("string"), F.lit("."), F.lower("o_orderstatus")).alias("name"), (F.expr("o_orderkey div 80 * 80") + 1).alias("snap_id"), (F.col("o_orderpriority") == "1-URGENT").alias("preserve"))

    @cached_property
    def notes(self) -> DataFrame:
        return self.table("conversations").where("turn = 0").select((F.col("conv_id") + 1).alias("snap_id"), "text")

    @cached_property
    def incoming(self) -> DataFrame:
        """Urls of pages as a second tree of names, one of them unsafe now and then."""
        path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
        return self.table("pages").select("page_id", F.when(F.col("page_id") % 13 == 0, F.concat(F.lit("/"), path)).when(F.col("page_id") % 17 == 0, F.concat(path, F.lit("/../x"))).otherwise(path).alias("path"), F.octet_length("html").cast("long").alias("size"))


_FILES = """SELECT 1::BIGINT AS snap_id, doc_id, lang, source, text, 33188::BIGINT AS mode FROM documents WHERE doc_id % 10 <> 0
UNION ALL SELECT 2, doc_id, lang, source, CASE WHEN doc_id % 7 = 0 THEN text || ' v2' ELSE text END, CASE WHEN doc_id % 5 = 1 THEN 33184 ELSE 33188 END FROM documents WHERE doc_id % 10 <> 3"""


def _dir(path: str) -> str:
    return f"(CAST('0x' || substr(md5({path}), 1, 10) AS BIGINT) + {DIRECTORY_BASE})"


SQL = {
    "files": ("", f"SELECT *, 'home/' || lang || '/' || source AS parent, doc_id || '.txt' AS name FROM ({_FILES})"),
    "directories": ("files", f"""SELECT DISTINCT snap_id, {_dir("path")} AS node_id, CASE WHEN up = '' THEN 0 ELSE {_dir("up")} END AS parent_node, name FROM (
      SELECT snap_id, 'home' AS path, '' AS up, 'home' AS name FROM files UNION SELECT snap_id, 'home/' || lang, 'home', lang FROM files
      UNION SELECT snap_id, 'home/' || lang || '/' || source, 'home/' || lang, source FROM files)"""),
    "links": ("files", f"""SELECT snap_id, doc_id + {LINK_BASE} AS node_id, {_dir("parent")} AS parent_node, 'sym-' || doc_id AS name, doc_id || CASE WHEN snap_id = 2 AND doc_id % 50 = 4 THEN '.new' ELSE '.txt' END AS target
      FROM files WHERE doc_id % 25 IN (3, 4)"""),
    "nodes": ("files directories links", """SELECT snap_id, doc_id + 1 AS node_id, 1::BIGINT AS type, mode, 1000::BIGINT AS uid, doc_id % 3 + 100 AS gid, CAST(octet_length(encode(text)) AS BIGINT) AS size,
      doc_id + 1700000000 AS mtime_sec, CASE WHEN doc_id % 17 = 4 THEN snap_id * 1000 ELSE 0 END::BIGINT AS mtime_nsec, sha256(text) AS content_hash,
      CASE WHEN doc_id % 4 = 0 THEN sha256('xattr:' || CASE WHEN doc_id % 8 = 0 AND snap_id = 2 THEN source ELSE lang END) END AS xattr_hash,
      CASE WHEN doc_id % 9 = 0 THEN sha256('acl:' || source) END AS acl_hash, CASE WHEN doc_id % 50 = 7 THEN 2 ELSE 1 END::BIGINT AS link_count, doc_id * 31 + 17 AS inode_identity FROM files
      UNION ALL SELECT snap_id, node_id, 2, CASE WHEN snap_id = 2 AND name = 'src2' THEN 16832 ELSE 16877 END, 0, 0, 0, 1700000000, 0, NULL, NULL, NULL, 1, node_id FROM directories
      UNION ALL SELECT snap_id, node_id, 3, 41471, 1000, 100, CAST(octet_length(encode(target)) AS BIGINT), 1700000000, 0, sha256(target), NULL, NULL, 1, node_id FROM links"""),
    "dirents": ("files directories links", f"""SELECT snap_id, parent_node, node_id, name FROM directories UNION ALL SELECT snap_id, {_dir("parent")}, doc_id + 1, name FROM files
      UNION ALL SELECT snap_id, {_dir("parent")}, doc_id + 1, 'link-' || doc_id FROM files WHERE doc_id % 50 = 7 UNION ALL SELECT snap_id, parent_node, node_id, name FROM links"""),
    "file_paths": ("files nodes", "SELECT f.parent || '/' || f.name AS path, n.* FROM files f JOIN nodes n ON n.snap_id = f.snap_id AND n.node_id = f.doc_id + 1"),
    "objects": ("", """SELECT hash, k % 4 + 1 AS type, k % 3 AS compression, CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END::BIGINT AS pack_skip_ver, n AS uncompressed_size, n * (40 + k % 61) // 100 AS compressed_size,
      CASE WHEN k % 3 = 0 THEN 'loose' ELSE 'pack' END AS storage FROM (SELECT sha256(text) AS hash, min(doc_id) AS k, CAST(max(octet_length(encode(text))) AS BIGINT) AS n FROM documents GROUP BY 1)"""),
    "payloads": ("", "SELECT hash, encode(CASE WHEN k % 97 = 0 THEN t || '!' ELSE t END) AS payload FROM (SELECT sha256(text) AS hash, min(doc_id) AS k, min(text) AS t FROM documents GROUP BY 1)"),
    "snapshots": ("", "SELECT o_orderkey + 1 AS snap_id, o_orderdate AS created, o_orderpriority = '1-URGENT' AS preserved, o_orderkey % 16 AS gfs_flags, CAST(floor(o_totalprice) AS BIGINT) AS logical_bytes FROM orders"),
    "journal": ("", """SELECT event_id AS line_no, event_id // 2 AS op_id, CASE WHEN event_id % 2 = 1 THEN 'completed' ELSE 'started' END AS state, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp, ts,
      CASE WHEN event_id % 2 = 0 THEN event_type END AS operation, CASE user_id % 3 WHEN 0 THEN 'cli' WHEN 1 THEN 'api' ELSE 'task' END AS source, user_id,
      CASE WHEN event_id % 2 = 1 THEN CASE WHEN event_id % 5 = 0 THEN 'failed' WHEN event_id % 7 = 0 THEN 'cancelled' ELSE 'success' END END AS result,
      CASE WHEN event_id % 2 = 1 THEN CAST(floor(value) AS BIGINT) END AS duration_ms FROM events WHERE event_id % 2 = 0 OR event_type <> 'error'"""),
    "tasks": ("journal", """SELECT 't' || s.op_id AS task_id, s.operation AS command, s.ts AS started, c.ts AS ended, CASE WHEN c.result IS NULL THEN 'running' WHEN c.result = 'success' THEN 'completed' ELSE 'failed' END AS state
      FROM journal s LEFT JOIN journal c ON c.op_id = s.op_id AND c.state = 'completed' WHERE s.state = 'started' AND s.op_id % 7 = 0"""),
    "tags": ("", "SELECT 'v' || o_orderkey || '.' || lower(o_orderstatus) AS name, o_orderkey // 80 * 80 + 1 AS snap_id, o_orderpriority = '1-URGENT' AS preserve FROM orders WHERE o_orderkey % 40 = 0"),
    "notes": ("", "SELECT conv_id + 1 AS snap_id, text FROM conversations WHERE turn = 0"),
    "incoming": ("", r"""SELECT page_id, CASE WHEN page_id % 13 = 0 THEN '/' || p WHEN page_id % 17 = 0 THEN p || '/../x' ELSE p END AS path, size FROM (
      SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS p, CAST(octet_length(encode(html)) AS BIGINT) AS size FROM pages)"""),
    "paths": ("dirents", """SELECT snap_id, node_id, name AS path, 1::BIGINT AS depth FROM dirents WHERE parent_node = 0
      UNION ALL SELECT d.snap_id, d.node_id, p.path || '/' || d.name, p.depth + 1 FROM paths p JOIN dirents d ON d.snap_id = p.snap_id AND d.parent_node = p.node_id"""),
    "tree": ("paths nodes", "SELECT p.path, p.depth, n.* FROM paths p JOIN nodes n ON n.snap_id = p.snap_id AND n.node_id = p.node_id"),
    "refs": ("nodes", """SELECT snap_id, node_id, f.field, f.hash FROM nodes, LATERAL (VALUES (1, content_hash), (2, xattr_hash), (3, acl_hash)) f(field, hash) WHERE f.hash IS NOT NULL"""),
    "packed": ("objects", f"""SELECT *, before // {PACK_BYTES} + 1 AS pack_num, row_number() OVER (PARTITION BY before // {PACK_BYTES} ORDER BY hash) - 1 AS entry_index,
      before - min(before) OVER (PARTITION BY before // {PACK_BYTES}) AS dat_offset FROM (SELECT *, CAST(coalesce(sum(compressed_size) OVER (ORDER BY hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
      FROM objects WHERE storage = 'pack')"""),
}


def cte(*names: str) -> str:
    """WITH RECURSIVE and the relations named, each after those it needs."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in SQL[name][0].split():
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({SQL[n][1]})" for n in order)
