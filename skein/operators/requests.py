"""What a request becomes when it is placed locally, and small request facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: local sampling is deterministic.
LOCAL_TEMPERATURE = 0


def usage_of(payload: Column) -> Column:
    """The payload's usage if it is an object, else an empty one."""
    usage = F.try_variant_get(payload, "$.usage", "variant")
    return F.when(F.schema_of_variant(usage).startswith("OBJECT"), usage).otherwise(F.parse_json(F.lit("{}")))


def request_bytes(request: Column) -> Column:
    """Bytes of the request's compact JSON."""
    return F.octet_length(F.to_json(request))


def needs_strict(tool: Column) -> Column:
    """A client tool (its input schema is an object) that is not strict yet."""
    schema = F.schema_of_variant(F.try_variant_get(tool, "$.input_schema", "variant"))
    return F.coalesce(schema.startswith("OBJECT"), F.lit(False)) & ~F.coalesce(F.try_variant_get(tool, "$.strict", "boolean"), F.lit(False))


def strict_tool(tool: Column) -> Column:
    """JSON of a tool, a client tool with strict set to true."""
    parts = F.map_filter(F.from_json(F.to_json(tool), "map<string,variant>"), lambda k, _: k != "strict")
    text = F.to_json(parts)
    with_flag = F.concat(F.left(text, F.length(text) - 1), F.lit(',"strict":true}'))
    return F.when(needs_strict(tool), with_flag).otherwise(F.to_json(tool))


def rewrite_local(df: DataFrame, policy, local_model: str, request: str = "request", features: str = "features", placement: str = "placement") -> DataFrame:
    """Calls with their local form: temperature, tools, model and output limit, and what they were before.

    Rows placed elsewhere keep nulls in the new columns.
    """
    r, local = F.col(request), F.col(placement) == "local"
    tools = F.coalesce(F.try_variant_get(r, "$.tools", "array<variant>"), F.array().cast("array<variant>"))
    asked = F.try_variant_get(r, "$.max_tokens", "bigint")
    want = policy.effective_max_tokens(F.col(features)) if hasattr(policy, "effective_max_tokens") else asked
    model = F.try_variant_get(r, "$.model", "string")
    return df.withColumns(
        {
            "local_temperature": F.when(local, F.lit(LOCAL_TEMPERATURE)),
            "original_temperature": F.when(local, F.try_variant_get(r, "$.temperature", "double")),
            "local_tools": F.when(local, F.transform(tools, strict_tool)),
            "strict_tools_added": F.when(local, F.size(F.filter(tools, needs_strict))),
            "local_model": F.when(local, F.lit(local_model)),
            "original_model": F.when(local & ~model.eqNullSafe(F.lit(local_model)), model),
            "local_max_tokens": F.when(local, want),
            "clamped_max_tokens": F.when(local & ~want.eqNullSafe(asked), want),
        }
    )


def resolve_link(preset: Column, presets: dict[str, tuple[float, float, float]], delay: Column, jitter: Column, mbps: Column) -> Column:
    """Link values: those given, else the preset's."""
    table = F.create_map(*[x for name, v in presets.items() for x in (F.lit(name), F.array(*[F.lit(p) for p in v]))])
    own = F.try_element_at(table, preset)
    return F.struct(F.coalesce(delay, own[0]).alias("delay_ms"), F.coalesce(jitter, own[1]).alias("jitter_ms"), F.coalesce(mbps, own[2]).alias("bandwidth_mbps"))


def first_token_ms(df: DataFrame, key: str, started: str, ts: str, line: str) -> DataFrame:
    """Milliseconds from a call's start to its first streamed choice with text or token ids."""
    data = F.when(F.col(line).startswith("data: "), F.substring(F.col(line), 7, 1 << 30))
    choices = F.try_variant_get(F.try_parse_json(data), "$.choices", "array<struct<text:string,token_ids:array<int>>>")
    some = F.exists(choices, lambda c: (F.coalesce(c["text"], F.lit("")) != "") | (F.coalesce(F.size(c["token_ids"]), F.lit(0)) > 0))
    return df.groupBy(key).agg((1000 * F.min(F.when(some, F.col(ts) - F.col(started)))).alias("ttft_ms"))


def token_streams(spark, pool: int, length: int, seed: int) -> DataFrame:
    """Four seeded token sequences by place: prefix, warm tail, target tail, unrelated.

    The target differs from the warm tail at every place, and the unrelated one
    from the target at the first. The draws are Spark's own.
    """
    draw = lambda i: F.floor(F.rand(seed + i) * pool).cast("int")
    one = spark.range(length).select(F.col("id").alias("place"), draw(0).alias("prefix"), draw(1).alias("warm"), draw(2).alias("_t"), draw(3).alias("_u"), F.floor(F.rand(seed + 10) * (pool - 1)).cast("int").alias("_r"))
    shift = lambda x, other: (F.col(other) + 1 + x) % pool  # noqa: E731  any token but the other
    two = one.withColumn("target", F.when(F.col("_t") == F.col("warm"), shift(F.col("_r"), "warm")).otherwise(F.col("_t")).cast("int"))
    clash = (F.col("place") == 0) & (F.col("_u") == F.col("target"))
    return two.select("place", "prefix", "warm", "target", F.when(clash, shift(F.col("_r"), "target")).otherwise(F.col("_u")).cast("int").alias("unrelated"))


def provenance(lines: DataFrame, line: str = "value", order: str = "line") -> DataFrame:
    """Facts of a run's provenance text: stamp, model, limits, cache tokens. Each is the first that a line gives, by place."""

    def pick(regex: str, kind: str = "string") -> Column:
        found = F.nullif(F.regexp_extract(F.col(line), regex, 1), F.lit(""))
        return F.min_by(found, F.when(found.isNotNull(), F.col(order))).try_cast(kind)

    tokens = F.nullif(F.replace(F.regexp_extract(F.col(line), r"(?i)kv cache size:?\s+([\d,]+)", 1), F.lit(","), F.lit("")), F.lit(""))
    return lines.agg(
        pick(r"timestamp\s+(\S+)").alias("stamp"), pick(r"^model\s+(\S+)").alias("model"), pick(r"max_model_len\s+(\d+)", "int").alias("max_model_len"),
        pick(r"gpu_mem_util\s+([\d.]+)", "double").alias("gpu_mem_util"), pick(r"kv_dtype\s+(\S+)").alias("kv_dtype"),
        F.min_by(tokens, F.when(tokens.isNotNull(), F.col(order))).try_cast("bigint").alias("kv_cache_tokens"),
    )
