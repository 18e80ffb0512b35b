from driftline.sources.tables import load_table, normalise_timestamps  # noqa: F401
