"""Queries over the given tables, with the SQL they are compared to."""


def catalog():
    """All registered queries by name."""
    from checks import file_queries, market_queries, signal_queries, text_queries  # noqa: F401
    from checks.registry import CATALOG

    return CATALOG
