"""Errors of the directive language."""


class DirectiveError(ValueError):
    """Any fault of a directive."""


class DirectiveSyntaxError(DirectiveError):
    """The text does not follow the grammar."""


class DirectiveValueError(DirectiveError):
    """An unknown command, or an argument outside its domain."""
