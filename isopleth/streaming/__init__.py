"""Streaming forms of two batch operators; both give the batch result on the same rows."""
