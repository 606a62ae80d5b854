"""Structured Streaming forms of question intake (T1), incremental ingest
(T2), the TTL cache as keyed state (T3) and live metrics (T4)."""
