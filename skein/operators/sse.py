"""Server-sent events: parse recorded bytes and fold them into messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_USAGE = "struct<input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint>"
#: What is read of an event; each line is parsed once.
EVENT = (
    "type string, index int, content_block struct<type:string,name:string,id:string,text:string,thinking:string,signature:string,input:variant>,"
    " delta struct<text:string,partial_json:string,thinking:string,signature:string,stop_reason:string>,"
    f" message struct<id:string,model:string,usage:{_USAGE}>, usage {_USAGE}"
)


#: Of events about a whole message everything is read.
_WHOLE = "message map<string,variant>, delta map<string,variant>, usage map<string,variant>"


def _texts(m: Column) -> Column:
    """A map's values as JSON; no map is an empty one."""
    return F.coalesce(F.transform_values(m, lambda _, v: F.coalesce(F.to_json(v), F.lit("null"))), F.create_map().cast("map<string,string>"))


def _over(a: Column, b: Column) -> Column:
    """Two maps as one; where both have a key the second counts."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def events(df: DataFrame, key: str, raw: str) -> DataFrame:
    """One row per event (key, pos, event, whole): data lines that hold an event's JSON, in order.

    whole has what an event says of its message: its fields and its usage, whatever their names.
    """
    lines = df.select(key, F.posexplode(F.split(F.col(raw).cast("string"), "\n")).alias("pos", "line"))
    data = F.trim(F.substring(F.col("line"), 6, 1 << 30))
    parsed = lines.where(F.col("line").startswith("data:")).select(key, "pos", F.from_json(data, EVENT).alias("event"), data.alias("_data")).where("event.type IS NOT NULL")
    kind = F.col("event.type")
    every = parsed.withColumn("_w", F.when(kind.isin("message_start", "message_delta"), F.from_json("_data", _WHOLE)))
    message = F.when(kind == "message_start", F.map_filter(F.col("_w.message"), lambda k, _: k != "content")).otherwise(F.col("_w.delta"))
    usage = F.when(kind == "message_start", F.try_variant_get(F.col("_w.message")["usage"], "$", "map<string,variant>")).otherwise(F.col("_w.usage"))
    whole = F.when(F.col("_w").isNotNull(), F.struct(_texts(message).alias("message"), _texts(usage).alias("usage")))
    return every.select(key, "pos", "event", whole.alias("whole"))


def reassemble(ev: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(blocks, messages): content blocks by index, and each message's id, model, stop reason and usage.

    A message also has all its fields and all its usage as maps of JSON texts, by
    whatever names they came; a later event's value replaces an earlier one's.

    A block begins with what its last start holds and goes on with the deltas
    after it; deltas without a start make a block of their own, without a type.
    Pieces of tool input replace the input that a start holds; if they are no
    JSON together, the empty string included, it becomes {"_unparsed": text}.
    A block event without an index belongs to block 0. Of values sent more than
    once the last one stays. Both frames come from one grouping.
    """
    kind, pos = F.col("event.type"), F.col("pos")

    def latest(*values: Column) -> Column:
        v = F.coalesce(*values)
        return F.max_by(v, F.when(v.isNotNull(), pos))

    started = kind == "content_block_start"
    begun = lambda name: F.max_by(F.col(f"event.content_block.{name}"), F.when(started, pos))
    use = lambda name: (F.col(f"event.usage.{name}"), F.col(f"event.message.usage.{name}"))
    # All text of a block in one list, put in order once: what it starts with, and its deltas.
    names = ("text", "thinking", "signature", "partial_json")
    first = [F.col(f"event.content_block.{n}") for n in names[:3]] + [F.lit(None).cast("string")]
    piece = F.struct(pos, started.alias("start"), *[F.when(started, b).when(kind == "content_block_delta", F.col(f"event.delta.{n}")).alias(n) for n, b in zip(names, first)])
    of_block = F.when(kind.isin("content_block_start", "content_block_delta"), F.coalesce(F.col("event.index"), F.lit(0))).alias("index")
    folded = ev.groupBy(key, of_block).agg(
        begun("type").alias("type"), begun("name").alias("name"), begun("id").alias("block_id"), begun("input").alias("_input"),
        F.array_sort(F.collect_list(F.when(of_block.isNotNull(), piece))).alias("_pieces"), F.max(F.when(started, pos)).alias("_from"),
        latest(F.col("event.message.id")).alias("message_id"), latest(F.col("event.message.model")).alias("model"),
        latest(F.when(kind == "message_delta", F.col("event.delta.stop_reason"))).alias("stop_reason"),
        latest(*use("input_tokens")).alias("input_tokens"), latest(*use("output_tokens")).alias("output_tokens"),
        latest(*use("cache_read_input_tokens")).alias("cache_read"), latest(*use("cache_creation_input_tokens")).alias("cache_creation"),
        F.array_sort(F.collect_list(F.when(F.col("whole").isNotNull(), F.struct(pos, "whole"))), lambda a, b: (a["pos"] - b["pos"]).cast("int")).alias("_wholes"),
    )
    since = folded.withColumn("_pieces", F.filter("_pieces", lambda p: F.col("_from").isNull() | (p["pos"] >= F.col("_from"))))
    joined = lambda name: F.array_join(F.transform("_pieces", lambda p: p[name]), "")
    text = joined("partial_json")
    tool = F.when(F.exists("_pieces", lambda p: p["partial_json"].isNotNull()), F.coalesce(F.to_json(F.try_parse_json(text)), F.to_json(F.struct(text.alias("_unparsed"))))).otherwise(F.to_json("_input"))
    blocks = since.where("index IS NOT NULL").select(key, "index", "type", "name", "block_id", *[joined(n).alias(n) for n in names[:3]], tool.alias("input"))
    merged = lambda name: F.aggregate("_wholes", F.create_map().cast("map<string,string>"), lambda m, w: _over(m, w["whole"][name])).alias(name if name == "usage" else "fields")
    messages = folded.where("index IS NULL").select(key, "message_id", "model", "stop_reason", "input_tokens", "output_tokens", "cache_read", "cache_creation", merged("message"), merged("usage"))
    return blocks, messages


def contents(blocks: DataFrame, key: str) -> DataFrame:
    """Each message's blocks in the order of their index."""
    fields = [c for c in blocks.columns if c not in (key, "index")]
    return blocks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("index", *fields))).alias("content"))


def first_chunk(df: DataFrame, key: str, ts: str, chunk: str, marker: str = "content_block_delta") -> DataFrame:
    """When the first chunk holding the marker came, per call."""
    return df.groupBy(key).agg(F.min(F.when(F.contains(chunk, F.lit(marker)), F.col(ts))).alias("first_ts"))
