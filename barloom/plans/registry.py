"""The commands: their arguments, series, lookbacks and builders. One source for checks, names and plans."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from .errors import DirectiveValueError

REQUIRED = object()


@dataclass(frozen=True)
class Argument:
    """A number with its default and bounds; kind: int, float or frame (a time frame)."""

    default: object = REQUIRED
    least: float | None = 1
    most: float | None = None
    kind: str = "int"

    def bind(self, text: str | None, command: str):
        if text is None:
            if self.default is REQUIRED:
                raise DirectiveValueError(f"{command} needs an argument")
            return self.default
        if self.kind == "frame":
            return text
        try:
            value = int(text) if self.kind == "int" else float(text)
        except ValueError:
            raise DirectiveValueError(f"{command}: {text!r} is not {'a whole number' if self.kind == 'int' else 'a number'}") from None
        if (self.least is not None and value < self.least) or (self.most is not None and value > self.most):
            raise DirectiveValueError(f"{command}: {text} is out of range")
        return value


@dataclass(frozen=True)
class Spec:
    name: str
    line: str
    args: tuple[Argument, ...]
    series: tuple[str, ...]
    lookback: Callable[..., int]
    build: Callable
    kind: str = "window"  # or recursive: complete rows only

    @property
    def title(self) -> str:
        return f"{self.name}.{self.line}" if self.line else self.name


COMMANDS: dict[tuple[str, str], Spec] = {}
ALIASES: dict[tuple[str, str], str] = {}
SAME_NAME = {"style": "cdl"}


def register(name: str, args=(), series=("close",), lookback: Callable[..., int] = lambda *a: 0, kind: str = "window", aliases: str = ""):
    """Decorator: command, or command.line, with its further line names."""
    base, _, line = name.partition(".")

    def add(build):
        COMMANDS[base, line] = Spec(base, line, tuple(args), tuple(series), lookback, build, kind)
        for alias in aliases.split():
            ALIASES[base, alias] = line
        return build

    return add


def find(name: str, line: str = "") -> Spec:
    name = SAME_NAME.get(name, name)
    line = ALIASES.get((name, line), line)
    if (name, line) not in COMMANDS:
        raise DirectiveValueError(f"unknown command {name}{'.' * bool(line)}{line}")
    return COMMANDS[name, line]


def period(default: object = REQUIRED, least: int = 1) -> Argument:
    return Argument(default, least)


def real(default: object, least: float | None = None, most: float | None = None) -> Argument:
    return Argument(default, least, most, "float")


def m1(p: int) -> int:
    return max(p - 1, 0)


#: The kinds of moving average and how many rows each needs before its first value, per period.
AVERAGES = {0: "sma", 1: "ema", 2: "wma", 3: "dema", 4: "tema", 5: "trima", 6: "kama", 7: "mama", 8: "t3"}


def average_lookback(p: int, kind: int) -> int:
    if p == 1:
        return 0
    return {3: 2 * m1(p), 4: 3 * m1(p), 6: p, 7: 32, 8: 6 * m1(p)}.get(kind, m1(p))
