"""The error every operator raises when it cannot do what it was asked."""


class OperatorError(ValueError):
    """Names the setting that is wrong and, where it helps, the columns the table has."""

    def __init__(self, message: str, results=None):
        super().__init__(message)
        self.results = results  # a check's results table, when the failure comes from a check
