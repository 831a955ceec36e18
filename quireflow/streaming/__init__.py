"""Streaming counterparts of session expiry, chat turns and event statistics."""
