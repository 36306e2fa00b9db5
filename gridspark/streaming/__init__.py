"""Streams: workbooks as they arrive, and months of events with late data."""
