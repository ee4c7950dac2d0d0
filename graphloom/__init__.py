"""Source-structure analytics on Spark: graphs of source code, search, and operators for training data."""

__all__ = ["Engine", "Index", "index_repository", "reindex"]


def __getattr__(name: str):  # noqa: ANN202 - the workers import this package without needing any of these
    if name == "Engine":
        from graphloom.engine import Engine

        return Engine
    if name in __all__:
        from graphloom import index

        return getattr(index, name)
    raise AttributeError(name)
