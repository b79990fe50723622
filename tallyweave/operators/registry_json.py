"""Vehicle registry responses of any shape -> one canonical record per plate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyweave.functions.text import alnum_key, clean

CANONICAL = ("plate", "brand", "model", "year", "vin", "owner", "color", "status")

# Response field -> canonical field per country, in order of preference.
FIELD_MAPS: dict[str, dict[str, str]] = {
    "PE": {"plate": "plate", "brand": "brand", "model": "model", "year": "year", "chasisserial": "vin"},
    "MX": {"plate": "plate", "make": "brand", "model": "model", "year": "year", "vin": "vin", "owner": "owner", "status": "status"},
    "CO": {"plate": "plate", "marca": "brand", "linea": "model", "modelo": "year", "novin": "vin", "color": "color", "estadodelvehiculo": "status"},
    "CL": {"plate": "plate", "mark": "brand", "model": "model", "year": "year", "chasisnumber": "vin", "owner": "owner", "color": "color"},
    "AR": {"plate": "plate", "brand": "brand", "model": "model", "year": "year"},
    "BR": {"plate": "plate", "brand": "brand", "model": "model", "modelyear": "year", "color": "color"},
    "EC": {"plate": "plate", "model": "model", "year": "year", "status": "status"},
    "BO": {"plate": "plate", "brand": "brand", "model": "model", "year": "year", "color": "color"},
    "CR": {"plate": "plate", "brand": "brand", "model": "model", "year": "year", "color": "color"},
    "PY": {"plate": "plate", "brand": "brand", "model": "model", "year": "year"},
    "US": {"plate": "plate", "make": "brand", "model": "model", "year": "year", "vin": "vin", "color": "color"},
}

_NODE = "array<struct<name:string,val:string,open:boolean,depth:int,path:array<int>>>"


def _children(n: Column) -> Column:
    """Entries of an object (its containers lie one deeper), or items of a list (same depth).

    The text of a value comes from one reading, in the order of the keys, its type from another:
    a text that begins like a list or an object is still a text.
    """
    val, depth, path = n["val"], n["depth"], n["path"]
    is_open = lambda v: F.coalesce(F.schema_of_variant(v).rlike("^(ARRAY|OBJECT)"), F.lit(False))

    def entry(e: Column, i: Column) -> Column:
        return F.struct(
            alnum_key(e["t"]["key"]).alias("name"), e["t"]["value"].alias("val"), e["o"].alias("open"),
            F.when(e["o"], depth + 1).otherwise(depth).alias("depth"), F.concat(path, F.array(i)).alias("path"),
        )

    def item(e: Column, i: Column) -> Column:
        return F.struct(F.lit(None).cast("string").alias("name"), e["t"].alias("val"), e["o"].alias("open"), depth.alias("depth"), F.concat(path, F.array(i)).alias("path"))

    def typed(texts: Column, values: Column) -> Column:
        return F.zip_with(texts, F.transform(values, is_open), lambda t, o: F.struct(t.alias("t"), o.alias("o")))

    entries = typed(F.map_entries(F.from_json(val, "map<string,string>")), F.map_values(F.from_json(val, "map<string,variant>")))
    items = typed(F.from_json(val, "array<string>"), F.from_json(val, "array<variant>"))
    return F.when(val.rlike(r"^\s*\{"), F.transform(entries, entry).cast(_NODE)).otherwise(
        F.filter(F.transform(items, item), lambda x: x["open"]).cast(_NODE)
    )


def nesting(responses: DataFrame) -> int:
    """Greatest number of containers inside each other in any response: what it takes to open them all."""
    outside = F.regexp_replace("response", r'"(?:[^"\\]++|\\.)*+"', "")
    brackets = F.split(F.regexp_replace(outside, r"[^\[\]{}]", ""), "")

    def step(acc: Column, c: Column) -> Column:
        now = acc["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return responses.agg(F.max(F.aggregate(brackets, start, step, lambda acc: acc["most"]))).first()[0] or 0


def _nodes(responses: DataFrame, id_column: str) -> DataFrame:
    root = F.struct(
        F.lit(None).cast("string").alias("name"), F.col("response").alias("val"),
        F.coalesce(F.col("response").rlike(r"^\s*[\[{]"), F.lit(False)).alias("open"), F.lit(0).alias("depth"), F.array().cast("array<int>").alias("path"),
    )
    out = responses.select(id_column, root.alias("n"))
    # Leaves pass through unchanged; each step opens one level of containers, until none is left.
    for _ in range(nesting(responses)):
        out = out.select(id_column, F.explode(F.when(F.col("n.open"), _children(F.col("n"))).otherwise(F.array("n").cast(_NODE))).alias("n"))
    return out


def leaves(responses: DataFrame, id_column: str = "plate") -> DataFrame:
    """Leaf fields per response, of any depth: the shallowest occurrence of a name wins, then the first seen.

    Values are the JSON's own text, so a boolean is ``true`` or ``false``.
    """
    n = _nodes(responses, id_column).select(id_column, "n.*")
    kept = n.filter(F.col("name").isNotNull() & ~F.col("open") & (clean(F.col("val")) != ""))
    return kept.groupBy(id_column, "name").agg(
        F.min_by(clean(F.col("val")), F.struct("depth", "path")).alias("value")
    )


def field_map(spark: SparkSession) -> DataFrame:
    rows = [(c, leaf, field, k) for c, m in FIELD_MAPS.items() for k, (leaf, field) in enumerate(m.items())]
    return spark.createDataFrame(rows, "country string, name string, field string, priority int")


def canonical_records(responses: DataFrame, country_column: str = "country", id_column: str = "plate") -> DataFrame:
    """One row per response with the canonical fields; an unmapped field is ''."""
    # The map is a constant of a few dozen rows.
    fields = F.broadcast(field_map(responses.sparkSession))
    countries = responses.select(F.col(id_column).alias("lookup"), F.col(country_column).alias("country"))
    found = leaves(responses.withColumnRenamed(id_column, "lookup"), "lookup")
    mapped = found.join(countries, "lookup").join(fields, ["country", "name"])
    picked = mapped.groupBy("lookup", "country").agg(
        *[F.min_by("value", F.when(F.col("field") == f, F.col("priority"))).alias(f) for f in CANONICAL]
    )
    return countries.join(picked, ["lookup", "country"], "left").select(
        "lookup", "country", *[F.coalesce(F.col(f), F.lit("")).alias(f) for f in CANONICAL]
    )
