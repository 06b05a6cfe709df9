"""Streaming and batch forms of the stateful operators."""
