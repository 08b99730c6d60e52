"""Scans: warehouse tables, the derived frame fixture, JSON files, images, streams."""
