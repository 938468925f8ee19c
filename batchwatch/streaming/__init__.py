"""Structured Streaming jobs: file ingest, sweeps, live incident and step state, event metrics."""
