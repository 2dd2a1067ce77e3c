"""What may be shown: edges released only if all that they rest on is granted now, and graphs kept for a while, by version.

An edge rests on references: items read under a connector, for a principal, with scopes and capabilities. It is released if every
one of these is in the grant that the principal holds now and every item can be reached now. The references are read once, each
beside what its principal holds and whether its item is reached, and an edge's are then judged together.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.adapters import cut

# Fixed value: minutes that a graph is kept after the answer that built it.
KEPT_MINUTES = 10
PARTS = 64


def _full(c) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def _held(grants: DataFrame) -> DataFrame:
    """connector, principal, _scopes, _capability: all that a principal holds, rows added up; null scopes are none."""
    all_of = lambda c: F.filter(F.array_distinct(F.flatten(F.collect_set(_full(c)))), lambda v: v.isNotNull())
    return grants.groupBy("connector", "principal").agg(all_of(F.col("scopes")).alias("_scopes"), all_of(F.col("capability")).alias("_capability"))


def requirements(references: DataFrame) -> DataFrame:
    """edge_id, connector, principal, scopes, capability, applies_to, digest: what an edge's references need together, by grant.

    references: edge_id, node_id, connector, principal, scopes, capability. Arrays are sorted sets, so equal references give equal rows;
    null arrays are empty ones. The digest is for cache keys and gives no right.
    """
    all_of = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_set(_full(c)))))
    out = references.groupBy("edge_id", "connector", "principal").agg(all_of(F.col("scopes")).alias("scopes"), all_of(F.col("capability")).alias("capability"), F.sort_array(F.collect_set("node_id")).alias("applies_to"))
    written = F.concat_ws("\x1f", "connector", "principal", F.array_join("scopes", "\x1e"), F.array_join("capability", "\x1e"))
    return out.withColumn("digest", F.substring(F.sha2(written, 256), 1, 12))


def release(edges: DataFrame, references: DataFrame, grants: DataFrame, reachable: DataFrame) -> DataFrame:
    """edges with granted, and refused_by ('none' for an edge without references, else the first connector and principal, or the first node, in the way).

    grants: connector, principal, scopes, capability held now (rows of one principal add up); reachable: node_id. A null connector
    or principal is in no grant, a null node is never reachable. refused_by is for accounts, not for the reader.
    """
    lacks = lambda c, held: F.size(F.array_except(_full(c), held)) > 0
    denied = F.when(F.col("_scopes").isNull() | lacks(F.col("scopes"), F.col("_scopes")) | lacks(F.col("capability"), F.col("_capability")), F.concat_ws("/", "connector", "principal"))
    each = references.join(_held(grants), ["connector", "principal"], "left").select("edge_id", "node_id", denied.alias("_denied"))  # no array goes further
    reached = reachable.select("node_id").distinct().withColumn("_reached", F.lit(True))
    lost = F.when(F.col("_reached").isNull(), F.coalesce(F.col("node_id").cast("string"), F.lit("")))
    each = each.join(reached, "node_id", "left").select("edge_id", "_denied", lost.alias("_lost"))
    judged = each.groupBy("edge_id").agg(F.min("_denied").alias("_denied"), F.min("_lost").alias("_lost")).withColumn("_based", F.lit(True))
    out = edges.join(judged, "edge_id", "left")
    by = F.when(F.col("_based").isNull(), "none").otherwise(F.coalesce("_denied", "_lost"))
    return out.select(*edges.columns, by.isNull().alias("granted"), by.alias("refused_by"))


def omissions(released: DataFrame, references: DataFrame) -> DataFrame:
    """connector, n: the edges withheld for want of leave, by the connectors they rest on; no requirement and no node is named."""
    withheld = released.filter(~F.col("granted")).select("edge_id")
    return references.join(withheld, "edge_id", "left_semi").select("edge_id", "connector").distinct().groupBy("connector").agg(F.count(F.lit(1)).alias("n"))


class GraphStore:
    """Rows of graphs by query_id, in a shared folder, gone KEPT_MINUTES after built_at. A put touches the partitions of its queries alone."""

    def __init__(self, path: str, parts: int = PARTS):
        self.path, self.parts = path, parts

    def _part(self):
        return F.pmod(F.xxhash64("query_id"), F.lit(self.parts)).cast("int")

    def _held(self, spark, schema) -> DataFrame:
        at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
        return spark.read.schema(schema).parquet(self.path) if there else spark.createDataFrame([], schema)

    def put(self, rows: DataFrame, now: datetime) -> None:
        """Replaces the graphs of the queries in rows (query_id, built_at and any other columns), one version on; expired rows of touched partitions go.

        The partitions' numbers come to the driver, PARTS at most. Writers are expected one at a time.
        """
        spark = rows.sparkSession
        new = cut(rows.withColumn("part", self._part()))
        parts = [r.part for r in new.select("part").distinct().collect()]
        schema = new.withColumn("version", F.lit(0).cast("long")).select(*rows.columns, "version", "part").schema
        held = cut(self._held(spark, schema).filter(F.col("part").isin(parts)))
        was = held.groupBy("query_id").agg(F.max("version").alias("_was"))
        fresh = new.join(was, "query_id", "left").withColumn("version", F.coalesce("_was", F.lit(0)) + 1)
        stay = held.join(new.select("query_id").distinct(), "query_id", "left_anti").filter(F.col("built_at") > F.lit(now - timedelta(minutes=KEPT_MINUTES)))
        names = [f.name for f in schema]
        fresh.select(names).unionByName(stay.select(names)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.path)

    def get(self, spark, schema, queries: DataFrame, now: datetime) -> DataFrame:
        """The rows held for queries (query_id); none for one that is gone, and none for one that never was: the two look alike."""
        from pyspark.sql.types import StructType

        full = StructType([*schema.fields]).add("version", "long").add("part", "integer")
        held = self._held(spark, full).filter(F.col("built_at") > F.lit(now - timedelta(minutes=KEPT_MINUTES)))
        return held.join(queries.select("query_id", self._part().alias("part")).distinct(), ["part", "query_id"], "left_semi").drop("part")
