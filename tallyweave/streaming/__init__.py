"""Structured Streaming: change watch, statement intake, live rules, review states."""
