"""Errors that the library raises for faults of its input."""


class TallyfoldError(Exception):
    """Any of them."""


class HeaderError(TallyfoldError):
    """A table's header can't be read."""


class CatalogError(TallyfoldError):
    """A folder or table isn't there."""


class StatementError(TallyfoldError):
    """A statement is empty or of an unknown kind."""
