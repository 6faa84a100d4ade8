"""sources: typed scans, landed payloads, sinks."""
