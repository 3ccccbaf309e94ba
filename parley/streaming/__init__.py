"""Structured Streaming entry points for the stateless operators (features, redaction, risk bands)."""
