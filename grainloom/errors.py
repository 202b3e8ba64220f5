"""Refusals: a question that can't be answered safely is refused, never answered wrongly."""


class Refused(ValueError):
    """A request that is refused."""


class InvalidModel(ValueError):
    """A model that contradicts itself."""


class UnknownName(Refused):
    """A metric or dimension that the model doesn't have."""


class Unreachable(Refused):
    """A dimension that a metric can't be sliced by without counting rows twice."""


class Ambiguous(Refused):
    """More than one shortest join path."""


class NonAdditive(Refused):
    """A sum over periods of a measure that doesn't add up."""


class Forbidden(Refused):
    """A caller without the role, attribute or budget."""


class TooCostly(Refused):
    """A query that would read more than it may."""
