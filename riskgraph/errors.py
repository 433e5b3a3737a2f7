"""The one exception raised when data fails a check."""


class IntegrityError(ValueError):
    """Input data breaks a rule that the following steps rely on."""
