"""Registered queries over the given tables."""


def load():
    """The registry with every query module imported."""
    from . import corpus, crawl, learning, registry, retrieval, studying  # noqa: F401

    return registry
