from . import files, queries, scenes, sight, views  # noqa: F401  these add their queries to the registry
