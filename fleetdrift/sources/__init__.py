"""Readers: from raw file text or nested JSON documents to typed rows."""
