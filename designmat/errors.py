"""Errors of the formula engine, and suggestions for misspelt column names."""

from __future__ import annotations


class FormulaSyntaxError(ValueError):
    """A formula text that can't be read; the message marks the place."""

    def __init__(self, message: str, text: str = "", at: int | None = None):
        if at is not None:
            message += f"\n  {text}\n  {' ' * at}^"
        super().__init__(message)


class UnboundTermError(ValueError):
    """A term that has to be bound to a schema first."""


class LevelError(ValueError):
    """Levels that no contrast coding can be made of."""


class LevelMismatchError(LevelError):
    """Levels of a coding and of the data that differ."""


class ColumnNotFoundError(ValueError):
    """A formula variable that the table lacks."""


class EmptyColumnError(ValueError):
    """A column without rows."""


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def near_names(name: str, names: list[str], most: int = 8) -> list[str]:
    """Names within the largest distance of 0 to 2, case ignored, that gives no more than ``most`` of them."""
    ranked = sorted((edit_distance(n.upper(), name.upper()), n) for n in names)
    within = [[n for d, n in ranked if d <= limit] for limit in (0, 1, 2)]
    return next((x for x in reversed(within) if len(x) <= most), within[0])


def check_columns(wanted: list[str], have: list[str]) -> None:
    for name in wanted:
        if name not in have:
            near = near_names(name, have)
            hint = f"; the nearest names appear to be: {', '.join(near)}" if near else ""
            raise ColumnNotFoundError(f"There isn't a variable called '{name}' in your data{hint}")
