"""Reading and writing: canonical files, reports, API payloads, tables with snapshots."""
