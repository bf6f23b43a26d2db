"""Named queries over the driver tables."""

from importlib import import_module

MODULES = ("retrieval_queries", "telemetry_queries", "document_queries", "dialogue_queries", "crawl_queries", "pricing_queries", "streaming_queries", "eval_queries")


def load_catalog():
    """Import every query module and return (queries, SQL forms)."""
    from . import base

    for module in MODULES:
        import_module(f"{__name__}.{module}")
    return base.QUERIES, base.ORACLES
