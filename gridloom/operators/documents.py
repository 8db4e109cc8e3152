"""Contract documents (JSON) checked as relations: keys and fields become rows, rules are a small table, violations are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What a prediction contract may hold. (scope, key, required, kinds, longest text, least number, allowed values)
CONTENT_TYPES = ["CSV"]
FIELD_TYPES = ["INTEGER", "STRING", "DECIMAL"]
INSTANCE_TYPES = [
    "ml.m4.xlarge", "ml.m4.2xlarge", "ml.m4.4xlarge", "ml.m4.10xlarge", "ml.m4.16xlarge",
    "ml.m5.large", "ml.m5.xlarge", "ml.m5.2xlarge", "ml.m5.4xlarge", "ml.m5.12xlarge", "ml.m5.24xlarge",
    "ml.m6i.large", "ml.m6i.xlarge", "ml.m6i.2xlarge", "ml.m6i.4xlarge", "ml.m6i.8xlarge", "ml.m6i.12xlarge", "ml.m6i.16xlarge", "ml.m6i.24xlarge", "ml.m6i.32xlarge",
]
RULES = [
    ("document", "inputContentType", True, None, None, None, CONTENT_TYPES),
    ("document", "outputContentType", True, None, None, None, CONTENT_TYPES),
    ("document", "input", True, ["list"], None, None, None),
    ("document", "output", True, ["list"], None, None, None),
    ("document", "version", True, ["text"], None, None, None),
    ("document", "instanceTypes", False, ["list"], None, None, None),
    ("document", "defaultInstanceType", False, None, None, None, None),
    ("document", "instanceCount", False, ["whole number"], None, 1, None),
    ("document", "description", False, None, 1000, None, None),
    ("field", "name", True, None, 100, None, None),
    ("field", "type", True, None, None, None, FIELD_TYPES),
    ("field", "nullable", False, None, None, None, None),
    ("instance", "", False, None, None, None, INSTANCE_TYPES),
]
RULE = "scope STRING, key STRING, required BOOLEAN, kinds ARRAY<STRING>, longest INT, least INT, allowed ARRAY<STRING>"

_KIND = (
    "CASE WHEN schema_of_variant(value) LIKE 'ARRAY<%' THEN 'list' WHEN schema_of_variant(value) LIKE 'OBJECT<%' THEN 'object' "
    "WHEN schema_of_variant(value) = 'STRING' THEN 'text' WHEN schema_of_variant(value) = 'BIGINT' THEN 'whole number' WHEN schema_of_variant(value) = 'BOOLEAN' THEN 'flag' "
    "WHEN schema_of_variant(value) = 'VOID' THEN 'null' ELSE 'number' END"
)


def _explode(parents: DataFrame, *keep: str) -> DataFrame:
    """Entries of a variant column ``value``: ``keep``, then ``pos, key, value`` of each."""
    spark = parents.sparkSession
    view = "gl_contract_parents"
    parents.createOrReplaceTempView(view)
    columns = ", ".join(f"p.{c}" for c in keep)
    return spark.sql(f"SELECT {columns}, e.pos, e.key, e.value FROM {view} p, LATERAL variant_explode(p.value) e")


def contract_entries(documents: DataFrame) -> DataFrame:
    """``document, scope, place, key, value, kind``: keys of documents, keys of their input and output fields, and listed instance types."""
    parsed = documents.select("document", F.try_parse_json("body").alias("value")).where("schema_of_variant(value) LIKE 'OBJECT<%'")
    top = _explode(parsed, "document").select("document", F.lit("document").alias("scope"), F.col("key").alias("place"), "key", "value", F.expr(_KIND).alias("kind"))
    lists = top.where("kind = 'list' and place in ('input', 'output', 'instanceTypes')").select("document", "place", "value")
    items = _explode(lists, "document", "place").select(
        "document", F.when(F.col("place") == "instanceTypes", "instance").otherwise("item").alias("scope"),
        F.concat("place", F.lit("["), F.col("pos").cast("string"), F.lit("]")).alias("place"), F.lit("").alias("key"), "value", F.expr(_KIND).alias("kind"),
    )
    objects = items.where("scope = 'item' and kind = 'object'").select("document", "place", "value")
    fields = _explode(objects, "document", "place").select("document", F.lit("field").alias("scope"), "place", "key", "value", F.expr(_KIND).alias("kind"))
    return top.unionByName(items).unionByName(fields)


def contract_violations(documents: DataFrame, rules: list[tuple] | None = None) -> DataFrame:
    """``document, place, key, rule, found`` for every broken rule of ``documents`` (``document, body``).

    Rules: ``invalid_json``, ``missing_key``, ``wrong_kind``, ``unknown_value``, ``too_long``, ``too_small``, ``not_an_object``, ``extra_key`` (fields only), ``duplicate_name`` (fields of one list),
    ``not_listed`` (a default instance type that its list lacks). The rules are a fixed table of some ten rows and are broadcast; documents are spread over tasks and never gathered.
    """
    spark = documents.sparkSession
    known = spark.createDataFrame(rules or RULES, RULE)
    few = F.broadcast(known)
    entries = contract_entries(documents)
    text = F.expr("CASE WHEN kind = 'text' THEN variant_get(value, '$', 'string') ELSE to_json(value) END")
    met = entries.join(few, ["scope", "key"], "left").withColumn("found", text)
    number = F.expr("CASE WHEN kind = 'whole number' THEN variant_get(value, '$', 'bigint') END")
    checks = {
        "wrong_kind": F.col("kinds").isNotNull() & ~F.array_contains("kinds", F.col("kind")),
        "unknown_value": F.col("allowed").isNotNull() & ((F.col("kind") != "text") | ~F.array_contains("allowed", F.col("found"))),
        "too_long": F.col("longest").isNotNull() & (F.char_length("found") > F.col("longest")),
        "too_small": F.col("least").isNotNull() & (number < F.col("least")),
        "not_an_object": (F.col("scope") == "item") & (F.col("kind") != "object"),
        "extra_key": (F.col("scope") == "field") & F.col("required").isNull(),
    }
    broken = F.array_compact(F.array(*[F.when(check, F.lit(rule)) for rule, check in checks.items()]))
    by_entry = met.select("document", "place", "key", F.explode(broken).alias("rule"), "found")
    # what an object must hold: every document that is one, every field that is one
    holders = documents.where("schema_of_variant(try_parse_json(body)) LIKE 'OBJECT<%'").select("document", F.lit("document").alias("scope"), F.lit("").alias("place")).unionByName(
        entries.where("scope = 'item' and kind = 'object'").select("document", F.lit("field").alias("scope"), "place")
    )
    wanted = holders.join(few.where("required").select("scope", "key"), "scope")
    there = entries.select("document", "scope", F.when(F.col("scope") == "document", "").otherwise(F.col("place")).alias("place"), "key")
    missing = wanted.join(there, ["document", "scope", "place", "key"], "left_anti").select("document", "place", "key", F.lit("missing_key").alias("rule"), F.lit(None).cast("string").alias("found"))
    unreadable = documents.where("coalesce(schema_of_variant(try_parse_json(body)), '') NOT LIKE 'OBJECT<%'").select(
        "document", F.lit("").alias("place"), F.lit("").alias("key"), F.lit("invalid_json").alias("rule"), F.lit(None).cast("string").alias("found")
    )
    names = met.where("scope = 'field' and key = 'name'").groupBy("document", F.regexp_extract("place", r"^(\w+)\[", 1).alias("place"), "found").agg(F.count("*").alias("n")).where("n > 1")
    twice = names.select("document", "place", F.lit("name").alias("key"), F.lit("duplicate_name").alias("rule"), "found")
    default = met.where("place = 'defaultInstanceType'").select("document", "place", "key", "found")
    listing = entries.where("place = 'instanceTypes' and kind = 'list'").select("document").distinct()
    listed = met.where("scope = 'instance'").select("document", "found").distinct()
    unlisted = default.join(listing, "document", "left_semi").join(listed, ["document", "found"], "left_anti").select(
        "document", "place", "key", F.lit("not_listed").alias("rule"), "found"
    )
    out = by_entry
    for part in (missing, unreadable, twice, unlisted):
        out = out.unionByName(part)
    return out
