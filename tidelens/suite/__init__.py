"""Queries over the test tables, each with its SQL twin where SQL can express it."""


def all_queries():
    from tidelens.suite import (catalogue, forecasts, grids, learning, reports, spatial, storage, surfing,  # noqa: F401
                                texts)
    from tidelens.suite.registry import REGISTRY

    return REGISTRY
