"""Schemas of trace records and experiment rows, declared so that nothing is inferred."""

from __future__ import annotations

FEATURES = (
    "model string, has_tools boolean, n_tools int, has_server_tools boolean, n_messages int, est_prompt_tokens long,"
    " est_system_tokens long, max_tokens long, stream boolean, is_tool_continuation boolean, seconds_since_last_call double,"
    " cloud_cache_ttl_s double, n_cache_breakpoints int"
)
LINK = (
    "shaping string, preset string, delay_ms double, jitter_ms double, bandwidth_mbps double, shaped_ms double,"
    " rtt_ewma_ms double, jitter_ewma_ms double, n_samples long, staleness_s double"
)
TIMING = (
    "ttft_ms double, total_ms double, network_ms double, server_ttft_ms double, connect_ms double, tls_ms double,"
    " send_ms double, response_headers_ms double"
)
LINK_SAMPLE = (
    "timestamp_utc timestamp, mode string, sequence int, repetition int, configured_delay_ms double, configured_jitter_ms double,"
    " configured_bandwidth_mbps double, request_bytes long, response_bytes long, placement string, status int, shaped_ms double,"
    " ttft_ms double, total_ms double, client_total_ms double, transport_network_ms double, effective_network_ms double,"
    " raw_server_ttft_ms double, corrected_server_ttft_ms double, connect_ms double, tls_ms double, send_ms double,"
    " response_headers_ms double, valid boolean"
)
PREFIX_SAMPLE = (
    "timestamp_utc timestamp, vllm_version string, model string, tokenizer string, kv_cache_dtype string, num_gpu_blocks int,"
    " kv_cache_size_tokens long, match_unit int, total_tokens int, prefix_fraction double, intended_cached_tokens int,"
    " actual_queried_tokens int, actual_cached_tokens int, repetition int, ttft_ms double, response_headers_ms double, valid_hit boolean"
)
