"""Sinks: states, manifests, reports, schemas."""
