"""What can be wrong with a predicate; all of it is found before any data is read."""


class PredicateError(ValueError):
    pass


class SyntaxProblem(PredicateError):
    def __init__(self, position: int, message: str) -> None:
        super().__init__(f"syntax error at byte {position}: {message}")
        self.position = position


class UnknownField(PredicateError):
    pass


class InactiveField(PredicateError):
    pass


class TypeMismatch(PredicateError):
    pass


class UnsupportedOperator(PredicateError):
    pass


class EmptyInList(PredicateError):
    """Only for trees built in code; ``IN ()`` in text is a syntax error."""
