"""Regions of a GeoJSON or TopoJSON file: ids and names. Geometry is left to who draws it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PART = "array<struct<id:string,properties:struct<id:string,NUTS_ID:string,na:string,name:string,NAME_LATN:string>>>"


def regions(spark: SparkSession, path: str | list[str], prefix: str = "ES") -> DataFrame:
    """(id, name) of the features whose id starts with prefix; the first name present counts, else it is empty."""
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.from_json("value", f"features {_PART}")["features"].alias("f"), F.map_values(F.from_json("value", f"objects map<string, struct<geometries:{_PART}>>")["objects"]).alias("o"))
    parts = F.coalesce("f", F.get("o", F.lit(0))["geometries"])
    rows = parsed.select(F.explode(parts).alias("x"))
    props = F.col("x.properties")
    named = rows.select(F.coalesce("x.id", props["id"], props["NUTS_ID"]).alias("id"), F.coalesce(props["na"], props["name"], props["NAME_LATN"], F.lit("")).alias("name"))
    return named.filter(F.startswith("id", F.lit(prefix)))
