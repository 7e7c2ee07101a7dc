"""The registry of feeds: a JSON document read by Spark into small dimensions. Unknown keys are ignored; what is required and missing is an error."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
_PORTS = "mktdata:int,refdata:int,snapshot:int"
SCHEMA = (
    "version int, sources array<struct<id:int,name:string>>, feeds array<struct<venue:string,category:string,code:string,kind:string,`group`:string,emit_trades:boolean,arbitration:string,publisher_offset:int,"
    f"publishers:struct<explicit:array<struct<{_PORTS}>>,derived:struct<ports:struct<{_PORTS}>,channels:array<struct<range:array<int>,id:int,label:string>>>>>>"
)
REQUIRED = ("venue", "category", "code", "kind", "group", "emit_trades", "arbitration")
# Names of kinds in the document.
KINDS = {"TopOfBook": "top_of_book", "MarketByPrice": "market_by_price", "MarketByOrder": "market_by_order", "Midpoint": "midpoint"}


def read(spark: SparkSession, path: str) -> DataFrame:
    """The document, one row. Another version, no feeds, or a feed without a required key is an error: a registry is small, so it is looked at here."""
    document = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    lacking = F.exists("feeds", lambda f: F.array_contains(F.array(*[f[k].isNull() for k in REQUIRED]), True))
    first = document.select("version", F.coalesce(F.size("feeds"), F.lit(0)).alias("n"), lacking.alias("lacking")).first()
    if first is None or first["version"] != VERSION:
        raise ValueError(f"only version {VERSION} of the registry is supported")
    if first["n"] < 1 or first["lacking"]:
        raise ValueError("the registry has no feeds, or one without a required key")
    return document


def sources(document: DataFrame) -> DataFrame:
    """source_id and name; none if the document has no such block."""
    return document.select(F.inline("sources")).select(F.col("id").cast("long").alias("source_id"), "name")


def feeds(document: DataFrame) -> DataFrame:
    """One row a feed: venue, category, code, kind, grp, emit_trades, arbitration (lower case), mirror_offset."""
    kind = F.lit(None).cast("string")
    for name, ours in KINDS.items():
        kind = F.when(F.col("kind") == name, ours).otherwise(kind)
    rows = document.select(F.inline("feeds"))
    return rows.select("venue", "category", "code", kind.alias("kind"), F.col("group").alias("grp"), "emit_trades", F.lower("arbitration").alias("arbitration"), F.col("publisher_offset").alias("mirror_offset"))


def publishers(document: DataFrame) -> DataFrame:
    """One row a publisher: venue, category, kind, channel (null where ports are listed), label, mktdata, refdata, snapshot ports.

    Derived ports are base + channel; an id that is listed twice counts once and keeps a label if one has it. Ports beyond 65,535 are null.
    """
    row = document.select(F.inline("feeds")).select("venue", "category", "kind", "publishers")
    listed = row.select("venue", "category", "kind", F.lit(None).cast("int").alias("channel"), F.lit(None).cast("string").alias("label"), F.inline("publishers.explicit"))
    each = row.where("publishers.derived is not null").select("venue", "category", "kind", F.col("publishers.derived.ports").alias("p"), F.explode("publishers.derived.channels").alias("c"))
    ids = F.when(F.col("c.range").isNotNull(), F.sequence(F.get("c.range", F.lit(0)), F.get("c.range", F.lit(1)))).otherwise(F.array("c.id"))
    channels = each.select("venue", "category", "kind", "p", "c.label", F.explode(ids).alias("channel")).groupBy("venue", "category", "kind", "p", "channel").agg(F.max("label").alias("label"))
    port = lambda role: F.when(F.col("p." + role) + F.col("channel") <= 65535, F.col("p." + role) + F.col("channel")).alias(role)
    derived = channels.select("venue", "category", "kind", "channel", "label", port("mktdata"), port("refdata"), port("snapshot"))
    return listed.unionByName(derived)
