"""Phase durations and link arithmetic. Null means that a phase did not happen, never zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def skip_null_sum(*xs: Column) -> Column:
    """Sum of those present; null only if none is."""
    some = F.coalesce(*xs)
    total = F.lit(0.0)
    for x in xs:
        total = total + F.coalesce(x, F.lit(0.0))
    return F.when(some.isNotNull(), total)


def effective_network(network: Column, shaped: Column) -> Column:
    """Link time including the simulated delay; an absent delay counts as none."""
    return network + F.coalesce(shaped, F.lit(0.0))


def corrected_server_ttft(ttft: Column, network: Column, shaped: Column) -> Column:
    return ttft - effective_network(network, shaped)


def first_stamp(event: Column, ts: Column, name: str) -> Column:
    """When an event first happened in a group."""
    return F.min(F.when(event == name, ts))


def phase(event: Column, ts: Column, start: str, end: str) -> Column:
    """Duration of a phase from first stamps; null without both."""
    return first_stamp(event, ts, end) - first_stamp(event, ts, start)


def transmission_ms(n_bytes: Column, mbps: Column) -> Column:
    """Time on the wire; 0 where the bandwidth is unlimited (null or 0)."""
    return F.when(mbps > 0, n_bytes * 8 / (mbps * 1e6) * 1000).otherwise(F.lit(0.0))


def shaped_wait_ms(n_bytes: Column, delay: Column, jitter: Column, mbps: Column, seed: int | None = None) -> Column:
    """Delay plus transmission, moved by a uniform jitter, never below 0; jitter alone does nothing."""
    active = (F.coalesce(delay, F.lit(0.0)) > 0) | (F.coalesce(mbps, F.lit(0.0)) > 0)
    move = F.lit(0.0) if seed is None else (F.rand(seed) * 2 - 1) * F.coalesce(jitter, F.lit(0.0))
    wait = F.greatest(F.coalesce(delay, F.lit(0.0)) + transmission_ms(n_bytes, mbps) + move, F.lit(0.0))
    return F.when(active, wait).otherwise(F.lit(0.0))


def tracks(delta: Column, expected: Column, tolerance: float) -> Column:
    """Within tolerance of what is expected; null if either is."""
    return F.abs(delta - expected) <= tolerance


def kv_bytes_per_token(layers: Column, heads: Column, head_dim: Column, dtype_bytes: Column) -> Column:
    return 2 * layers * heads * head_dim * dtype_bytes


def kv_estimates(usage: Column, tokens: Column, pool_bytes: Column, bytes_per_token: Column) -> Column:
    """Usage in percent, used tokens, pool and used GiB; the pool falls back to tokens x bytes a token."""
    pool = F.coalesce(pool_bytes.cast("double"), tokens * bytes_per_token)
    gib = F.lit(1024.0**3)
    return F.struct(
        (usage * 100).alias("used_pct"), F.floor(usage * tokens).alias("used_tokens"),
        (pool / gib).alias("pool_gib"), (pool / gib * usage).alias("used_gib"),
    )
