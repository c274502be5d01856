"""No query takes the place of another, and every SQL belongs to a query."""

import importlib
import pkgutil

from tamarisk import plans
from tamarisk.plans import registry


def test_names_are_distinct():
    modules = [importlib.import_module(f"tamarisk.plans.{m.name}") for m in pkgutil.iter_modules(plans.__path__) if m.name.endswith("_queries")]
    names = [q for m in modules for q in m.QUERIES]
    assert len(names) == len(set(names)) == len(registry.QUERIES) and set(registry.SQL) <= set(names)
