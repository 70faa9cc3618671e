"""Scalar column expressions (all built-in Spark functions; no Python UDFs)."""

from retentio.functions.expr import *  # noqa: F401,F403
from retentio.functions.expr import __all__  # noqa: F401
