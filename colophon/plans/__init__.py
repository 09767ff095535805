"""Queries over the test tables, each with its SQL."""

from . import registry as registry
from . import stores as stores  # adds its queries to the registry's
