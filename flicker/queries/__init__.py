"""The registered queries of the engine; importing this package fills the registry."""

from . import benchmark, contacts, integrity, scenarios, series, sources  # noqa: F401
