"""Logical plans: views, reports, write-side jobs and quality jobs."""
