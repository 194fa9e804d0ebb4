"""Structured Streaming: statement files arriving as uploads, turned into bronze lines per micro-batch."""
