"""Queries over the given tables, each with the equivalent SQL where there is one."""

from . import snapshots  # noqa: F401
from . import texts  # noqa: F401
from . import finder  # noqa: F401
from . import checks  # noqa: F401
