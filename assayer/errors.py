"""Errors of declarations, sources and configuration."""


class AssayError(Exception):
    """Any error of this package."""


class ColumnNotFound(AssayError):
    def __init__(self, name: str):
        super().__init__(f"column {name!r} isn't declared in this table")


class TableNotFound(AssayError):
    def __init__(self, name: str):
        super().__init__(f"table {name!r} isn't registered")


class RuleTypeError(AssayError):
    """A rule or relation that its column's type doesn't take."""


class IncorrectDate(AssayError, ValueError):
    def __init__(self, year: int, month: int, day: int):
        super().__init__(f"no such date: year {year}, month {month}, day {day}")


class IncorrectOperator(AssayError, ValueError):
    def __init__(self, operator: str):
        super().__init__(f"unknown operator {operator!r}")


class PatternError(AssayError, ValueError):
    """A regular expression or date format that can't be honoured exactly."""


class SourceError(AssayError, OSError):
    """A file that is missing, empty or malformed."""


class UnknownFormat(AssayError):
    def __init__(self, path: str):
        super().__init__(f"neither CSV nor Parquet by its name: {path}")


class ConfigError(AssayError):
    """A configuration document that can't be used."""
