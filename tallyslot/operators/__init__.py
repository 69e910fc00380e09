"""Reusable DataFrame operators; each keeps hot keys spread over many tasks."""
