"""Registered queries by family."""


def load_all():
    """Import every family once; returns (queries, SQL texts)."""
    import importlib
    import pkgutil

    from . import registry

    for module in pkgutil.iter_modules(__path__):
        if module.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{module.name}")
    return registry.QUERIES, registry.ORACLES
