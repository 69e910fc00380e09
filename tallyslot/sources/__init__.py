"""Readers, the dataset container, shared work folders and sinks."""
