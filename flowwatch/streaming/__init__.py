"""Structured Streaming: sources/sinks, exactly-once table sink, the streaming
rule operator and incremental graph maintenance."""
