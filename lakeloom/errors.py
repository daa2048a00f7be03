"""Errors that a statement can end with."""


class EngineError(Exception):
    """A statement was refused; its effects, if any, are undone."""


class ParseError(EngineError):
    """The text is not a statement of the dialect."""

    def __init__(self, message: str):
        super().__init__(f"[parse error] {message}")


class DuplicateKey(EngineError):
    """A primary or unique key would occur twice."""


class ForeignKeyError(EngineError):
    """A reference would dangle."""


class LockTimeout(EngineError):
    """Another transaction kept a needed lock too long."""

    def __init__(self):
        super().__init__("lock wait timeout")
