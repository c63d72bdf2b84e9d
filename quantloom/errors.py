"""Errors that name what is wrong with the input."""


class QuantError(ValueError):
    """Base of all input errors."""


class MissingColumn(QuantError):
    def __init__(self, name: str):
        super().__init__(f"Cannot find column '{name}'")


class MalformedRow(QuantError):
    """A line of a delimited file has a missing or an extra field."""

    def __init__(self, file: str, line: int, found: int, expected: int):
        super().__init__(f"line {line} of {file} has {found} fields instead of {expected}")
        self.file, self.line, self.found, self.expected = file, line, found, expected


class DuplicateCell(QuantError):
    """A matrix cell has more than one value."""


class EmptySample(QuantError):
    """A sample has no value left, so its median is undefined."""


class NullKey(QuantError):
    """An entity, sample, ion or value is null."""


class UnknownName(QuantError):
    """No such method, mode or id."""
