"""Errors raised instead of status codes."""


class TessellaError(Exception):
    """Base class of every error this package raises itself."""


class NameCollision(TessellaError):
    """Two columns would end up with the same name."""


class KeyTypeMismatch(TessellaError):
    """Linked columns have types that cannot be compared without a text cast."""


class DisconnectedTables(TessellaError):
    """The links do not connect all tables."""


class NoRows(TessellaError):
    """A result that must have rows is empty."""


class UnsupportedColumn(TessellaError):
    """A column has a type the operator does not handle."""


class AlreadyStored(TessellaError):
    """The target of a store exists."""
