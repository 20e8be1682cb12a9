"""The same flow over streams: follow files, store bronze, de-duplicate, detect."""
