from . import readers, sinks  # noqa: F401
