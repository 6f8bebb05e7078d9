"""All registered queries and the SQL that checks them."""


def load():
    import importlib
    import pkgutil
    from marketframe import catalog
    for mod in pkgutil.iter_modules(catalog.__path__):
        if mod.name not in ("registry", "ctes", "sqltext"):
            importlib.import_module(f"marketframe.catalog.{mod.name}")
    from marketframe.catalog.registry import ORACLES, QUERIES
    return dict(QUERIES), dict(ORACLES)
