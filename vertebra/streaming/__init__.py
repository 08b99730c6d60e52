"""Structured Streaming jobs: live analysis, landing-zone loader, live status."""
