"""Registered queries, their SQL counterparts and whole experiments."""
