"""Registered queries over the driver's tables, one module per operator family."""


def load():
    from . import analytics, composed, filters, graphs, joins, retrieval, storage, texts  # noqa: F401
