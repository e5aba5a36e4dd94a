"""Writing plans in Python: ``PlanBuilder().project(scan).cols([0, 1]).to_json()``.

A step is a finished piece of plan and never changes: setting an option gives a new step,
so one step can be an input of several others. Methods come from the tables of operators
and options in ``plans.ir``; there are no others, so a misspelt name is an error.
"""

from __future__ import annotations

import json
from copy import deepcopy
from dataclasses import dataclass, field, replace
from typing import Any

from .errors import PlanError, UnknownOperatorError
from .plans.compiler import CompiledPlan, compile_plan
from .plans.ir import OPERATORS, OPTIONS, check_file, check_inputs
from .types import LETTERS


def type_names(types: str | list[str]) -> list[str]:
    """A list of type names as it is; a string has one letter for each: i, r, t, b."""
    return [LETTERS[letter].value for letter in types] if isinstance(types, str) else list(types)


@dataclass(frozen=True)
class Step:
    """An operator with its inputs and the options set so far."""

    op: str
    inputs: tuple[Step, ...] = ()
    options: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self):
        check_inputs(self.op, len(self.inputs))

    def having(self, **options: Any) -> Step:
        """A step with these options as well."""
        for option in options:
            if option == "file":
                check_file(self.op, True)
            elif option not in OPTIONS[self.op]:
                raise PlanError(f"{self.op} has no option {option!r}")
        if "types" in options:
            options["types"] = type_names(options["types"])
        return replace(self, options=self.options | options)

    def to_json(self) -> dict[str, Any]:
        check_file(self.op, "file" in self.options)
        spec: dict[str, Any] = {"op": self.op, "options": deepcopy(self.options), "input": [i.to_json() for i in self.inputs]}
        return {key: value for key, value in spec.items() if value}

    def dumps(self, **how: Any) -> str:
        return json.dumps(self.to_json(), **how)

    def compile(self) -> CompiledPlan:
        return compile_plan(self.to_json())


def _option_method(option: str):
    def method(self: Step, value: Any) -> Step:
        return self.having(**{option: value})

    method.__name__, method.__doc__ = option, f"A step with the option ``{option}``."
    return method


for _option in sorted({o for options in OPTIONS.values() for o in options}):
    setattr(Step, _option, _option_method(_option))


class PlanBuilder:
    """Each operator is a method: its name with ``_`` for spaces, its inputs as arguments."""

    def step(self, op: str, *inputs: Step) -> Step:
        """The operator of that name."""
        if op not in OPERATORS:
            raise UnknownOperatorError(op)
        return Step(op, inputs)

    def __getattr__(self, missing: str):
        # operators are methods of the class, so only other names get here
        raise AttributeError(missing) if missing.startswith("_") else UnknownOperatorError(missing)


def _operator_method(op: str):
    def method(self: PlanBuilder, *inputs: Step) -> Step:
        return self.step(op, *inputs)

    method.__name__, method.__doc__ = op.replace(" ", "_"), f"The operator ``{op}``."
    return method


for _op in OPERATORS:
    setattr(PlanBuilder, _op.replace(" ", "_"), _operator_method(_op))
