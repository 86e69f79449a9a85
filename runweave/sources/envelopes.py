"""External signal envelopes: JSON texts to typed rows and counted rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.functions.scalars import variant_kind

_UUID = r"(?i)^[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}$"


def parse_envelopes(raw: DataFrame, body: str = "body") -> DataFrame:
    """All columns and variant, idempotency_key, reject (null if good): seven kinds of reject."""
    v = F.try_parse_json(body)
    get = lambda p: F.try_variant_get(v, p, "variant")
    text = lambda p: F.try_variant_get(v, p, "string")
    kind = lambda p: variant_kind(get(p))
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    bad_fields = (
        F.when(text("$.variant") == "Trigger", get("$.workflow_id").isNull() | (kind("$.workflow_id") != "string") | ~F.rlike(text("$.workflow_id"), F.lit(_UUID)))
        .when(text("$.variant") == "Cancel", get("$.target").isNull())
        .when(text("$.variant") == "Wakeup", get("$.name").isNull() | (kind("$.name") != "string") | get("$.target").isNull()))
    reject = (
        F.when(~is_object, "MalformedJson").when(get("$.version").isNull(), "MissingVersion").when((kind("$.version") != "int") | (F.try_variant_get(v, "$.version", "long") < 0), "MalformedJson")
        .when(F.try_variant_get(v, "$.version", "long") != 1, "UnknownVersion").when(get("$.idempotency_key").isNull(), "MissingIdempotencyKey").when(kind("$.idempotency_key") != "string", "MalformedJson")
        .when(get("$.variant").isNull(), "MissingVariant").when(kind("$.variant") != "string", "MalformedJson")
        .when(~text("$.variant").isin("Trigger", "Cancel", "Wakeup"), "UnknownVariant").when(bad_fields, "VariantDeserialize"))
    return raw.select("*", F.when(reject.isNull(), text("$.variant")).alias("variant"), F.when(reject.isNull(), text("$.idempotency_key")).alias("idempotency_key"), reject.alias("reject"))


def reject_counts(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy(F.coalesce("reject", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"))
