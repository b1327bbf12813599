"""Structured Streaming forms of the bucket and session operators (an extension; the batch forms are in operators/)."""
