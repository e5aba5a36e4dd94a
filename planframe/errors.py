"""Errors found before a plan runs."""


class PlanError(ValueError):
    """A plan that can't be run; ``path`` says where in the tree."""

    def __init__(self, message: str, path: str = "$"):
        super().__init__(f"{path}: {message}")
        self.path = path


class PlanTypeError(PlanError):
    """Types that don't fit an operator, predicate or aggregate."""


class UnknownOperatorError(PlanError):
    def __init__(self, op: object, path: str = "$"):
        super().__init__(f"unknown operator {op!r}", path)


class InvalidChildrenError(PlanError):
    def __init__(self, op: str, expected: str, got: int, path: str = "$"):
        super().__init__(f"{op} takes {expected} inputs, not {got}", path)


class OperatorFileError(PlanError):
    def __init__(self, op: str, needed: bool, path: str = "$"):
        super().__init__(f"{op} {'needs a' if needed else 'has no'} file", path)
