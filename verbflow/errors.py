"""Errors and messages of the grammar."""

from __future__ import annotations

import warnings


class ExprError(Exception):
    """Raised while an expression is built or compiled; verbs add where it happened."""


class VerbError(Exception):
    """``verb``: what was called, ``argument``: which argument, ``message``: why it can't be done."""

    def __init__(self, verb: str, message: str, argument: str | None = None):
        self.verb, self.argument, self.message = verb, argument, message
        where = f"In `{verb}()`" + (f", argument `{argument}`" if argument else "")
        super().__init__(f"{where}: {message}")


class VerbMessage(UserWarning):
    """What a verb decided on its own, such as natural join keys."""


def inform(text: str) -> None:
    warnings.warn(text, VerbMessage, stacklevel=3)
