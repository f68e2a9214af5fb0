"""API descriptions (JSON) to operations, parameters, base paths and pointers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, strip_left
from ..session import cut_lineage
from .. import schemas

# The methods a path item may describe.
METHODS = "get put post delete options head patch trace".split()
SPEC_PROPERTY = r"(?i)^(swagger|openapi|x-openapi|apis?-?spec)$"


def is_spec(body: Column) -> Column:
    """An object that names its format and holds a paths object, of any size."""
    named = F.get_json_object(body, "$.openapi").isNotNull() | F.get_json_object(body, "$.swagger").isNotNull()
    paths = strip(F.coalesce(F.get_json_object(body, "$.paths"), F.lit("")))
    readable = (F.length(body) > 0) & strip_left(body).startswith("{")
    return F.coalesce(readable & named & paths.startswith("{"), F.lit(False))


def base_paths(document: Column) -> Column:
    """``''``, the Swagger base path, and the path part of every server URL."""

    def clean(raw):
        return F.regexp_replace(F.regexp_replace(raw, r"(?i)^[a-z][a-z0-9+.-]*://[^/]*", ""), r"/+$", "")

    servers = F.transform(F.coalesce(document["servers"], F.array().cast("array<struct<url:string>>")), lambda s: clean(s["url"]))
    found = F.filter(
        F.concat(F.array(clean(document["basePath"])), servers), lambda p: F.coalesce(p.startswith("/"), F.lit(False))
    )
    return F.array_union(F.array(F.lit("")), found)


def _parts(pointer: Column) -> Column:
    """The parts of a local reference, unescaped."""
    return F.transform(
        F.split(F.substring(pointer, 3, 1 << 20), "/"), lambda p: F.replace(F.replace(p, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
    )


def _json_path(parts: Column, index: bool = False) -> Column:
    def one(p):
        quoted = F.concat(F.lit("['"), p, F.lit("']"))
        return F.when(p.rlike("^[0-9]+$"), F.concat(F.lit("["), p, F.lit("]"))).otherwise(quoted) if index else quoted

    return F.concat(F.lit("$"), F.array_join(F.transform(parts, one), ""))


def _reference(text: Column) -> Column:
    return F.get_json_object(text, "$['$ref']")


def reference_table(documents: DataFrame, doc: list[str], body: str = "body") -> DataFrame:
    """doc, pointer, target: what every local ``$ref`` of a document ends at, chains followed.

    Each container of a document (``parameters``, ``components/schemas``, ...) is taken apart once, whatever number of
    references leads into it. Chains are followed by doubling, so the rounds are the logarithm of the longest; what is
    still a reference after that is a cycle and stays one. External references are not in the table.
    """
    pointers = F.array_distinct(F.regexp_extract_all(body, F.lit(r'"\$ref"\s*:\s*"(#/[^"]*)"'), F.lit(1)))
    asked = documents.select(*doc, F.explode(pointers).alias("pointer")).withColumn("parts", _parts(F.col("pointer")))
    depth = F.when(F.get("parts", 0) == "components", 2).otherwise(1)
    asked = asked.select(
        *doc, "pointer", F.slice("parts", F.lit(1), depth).alias("container"), F.get("parts", depth).alias("name"),
        F.slice("parts", depth + 2, F.greatest(F.size("parts") - depth - 1, F.lit(0))).alias("rest"),
    )
    containers = asked.select(*doc, "container").distinct().join(documents, doc)
    text = F.call_function("get_json_object", F.col(body), _json_path(F.col("container")))
    entries = containers.select(*doc, "container", F.explode(F.from_json(text, "map<string,string>")).alias("name", "text"))
    inside = F.coalesce(F.call_function("get_json_object", "text", _json_path(F.col("rest"))), F.call_function("get_json_object", "text", _json_path(F.col("rest"), index=True)))
    found = asked.join(entries, [*doc, "container", "name"]).select(*doc, "pointer", F.when(F.size("rest") == 0, F.col("text")).otherwise(inside).alias("target"))
    found = cut_lineage(found.filter("target is not null"), "references")
    chained = found.filter(_reference(F.col("target")).isNotNull())
    longest = chained.groupBy(*doc).count().agg(F.max("count")).first()[0] or 0
    for _ in range(int(longest).bit_length()):
        step = found.select(*doc, F.col("pointer").alias("next"), F.col("target").alias("further"))
        found = found.withColumn("next", _reference(F.col("target"))).join(step, [*doc, "next"], "left")
        found = cut_lineage(found.select(*doc, "pointer", F.coalesce("further", "target").alias("target")), "references")
    return found


def _followed(rows: DataFrame, column: str, targets: DataFrame, doc: list[str]) -> DataFrame:
    """``column`` replaced by what it refers to, where it is a reference that is known."""
    looked = rows.withColumn("pointer", _reference(F.col(column))).join(targets, [*doc, "pointer"], "left")
    return looked.withColumn(column, F.coalesce("target", column)).drop("pointer", "target")


def read_operations(specs: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """keys, method, route, deprecated, params. References are looked up where an operation, a parameter or its schema is one."""
    readable = specs.filter(is_spec(F.col(body))).withColumn("__doc", F.xxhash64(body))
    doc = [*keys, "__doc"]
    targets = reference_table(readable.select(*doc, body), doc, body)
    items = readable.select(*doc, F.explode(F.from_json(F.get_json_object(body, "$.paths"), "map<string,string>")).alias("route", "item"))
    items = _followed(items, "item", targets, doc)
    ops = items.select(*doc, "route", F.explode(F.from_json("item", "map<string,string>")).alias("verb", "op")).filter(F.lower("verb").isin(*METHODS))
    ops = _followed(ops, "op", targets, doc).filter(strip_left(F.col("op")).startswith("{"))
    operation = [*doc, "method", "route", "deprecated"]
    read = ops.select(
        *doc,
        F.upper("verb").alias("method"),
        "route",
        F.coalesce(F.get_json_object("op", "$.deprecated") == "true", F.lit(False)).alias("deprecated"),
        F.posexplode_outer(F.from_json(F.get_json_object("op", "$.parameters"), "array<string>")).alias("pos", "p"),
    )
    read = _followed(read, "p", targets, doc).withColumn("schema", F.get_json_object("p", "$.schema"))
    read = _followed(read, "schema", targets, doc)
    param = F.struct(
        "pos",
        F.get_json_object("p", "$.name").alias("name"),
        F.coalesce(F.get_json_object("p", "$.in"), F.lit("query")).alias("location"),
        F.coalesce(F.get_json_object("p", "$.required") == "true", F.lit(False)).alias("required"),
        F.coalesce(F.get_json_object("schema", "$.type"), F.lit("unknown")).alias("type"),
    )
    named = read.groupBy(*operation).agg(F.sort_array(F.collect_list(F.when(F.get_json_object("p", "$.name").isNotNull(), param))).alias("params"))
    return named.select(*keys, "method", "route", "deprecated", F.transform("params", lambda p: p.dropFields("pos")).alias("params"))


def operations(read: DataFrame, keys: list[str]) -> DataFrame:
    return read.select(*keys, "method", "route", "deprecated")


def operation_params(read: DataFrame, keys: list[str]) -> DataFrame:
    """One row per parameter name; of two with one name the last counts."""
    rows = read.select(*keys, "method", "route", F.posexplode("params").alias("pos", "p"))
    last = rows.groupBy(*keys, "method", "route", F.col("p.name").alias("name")).agg(F.max_by("p", "pos").alias("p"))
    return last.select(*keys, "method", "route", "name", "p.location", "p.required", "p.type")


def read_bases(specs: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    doc = F.from_json(F.col(body), schemas.SPEC)
    return specs.select(*keys, F.explode(base_paths(doc)).alias("base"))


def spec_urls(manifests: DataFrame, body: str = "body") -> DataFrame:
    """Description URLs an ``apis.json`` manifest lists, in listed order."""
    doc = F.from_json(F.col(body), schemas.MANIFEST_OF_SPECS)
    rest = [c for c in manifests.columns if c != body]
    apis = manifests.select(*rest, F.posexplode(doc["apis"]).alias("api_pos", "api"))
    props = apis.select(*rest, "api_pos", F.posexplode("api.properties").alias("prop_pos", "p"))
    return props.filter(F.col("p.type").rlike(SPEC_PROPERTY) & F.col("p.url").isNotNull()).select(*rest, "api_pos", "prop_pos", "p.url")
