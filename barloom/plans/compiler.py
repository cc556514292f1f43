"""Compiles directives to staged columns over one window order, and recursive commands to one ordered pass.

Every native stage is a projection over the same partitioning and order, so Spark shuffles and sorts once for all of
them. Recursive commands are collected: all that depend on no other recursive command run in a single streaming
pass over the sorted partitions, whose memory is the state of one key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from . import language as L
from .errors import DirectiveValueError
from .registry import ALIASES, COMMANDS, SAME_NAME, Spec, find

COMPARE = {"<", "<=", "==", "!=", ">", ">="}
CROSS = {"//", "\\", "><"}
LOGIC = {"&", "|", "^"}


def clean(c: Column) -> Column:
    """Missing is NULL: NaN and the infinities are read as missing."""
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def divide(a: Column, b: Column) -> Column:
    """IEEE division without ANSI errors, where a result that is not finite is missing."""
    return F.when(b != 0, a / b)


def number_text(value) -> str:
    return str(int(value)) if isinstance(value, float) and value.is_integer() and abs(value) < 1 << 53 else str(value)


def correlation(x: Column, y: Column, frame: WindowSpec | None = None) -> Column:
    """Pearson's, over a frame or a group; missing where a side is constant, for which the built-in one divides by zero."""
    cov, a, b = (c if frame is None else c.over(frame) for c in (F.covar_pop(x, y), F.var_pop(x), F.var_pop(y)))
    return F.when((a > 0) & (b > 0), F.least(F.greatest(clean(F.try_divide(cov, F.sqrt(a) * F.sqrt(b))), F.lit(-1.0)), F.lit(1.0)))


class Compiler:
    """Grows a frame by temporary columns. key: partition columns; order: columns that order the rows of a key."""

    def __init__(self, df: DataFrame, key: Sequence[str], order: Sequence[str]):
        self.df, self.key, self.order = df, list(key), list(order)
        self.columns = set(df.columns)
        self.w0 = Window.partitionBy(*key).orderBy(*order)
        self.staged: dict[str, Column] = {}
        self.shared: dict[str, object] = {}  # what commands keep for each other
        self.compiled: dict[object, Column] = {}
        self.machines: list[tuple[str, str, tuple, list[str]]] = []  # column, machine, arguments, inputs
        self.n = 0

    # Stages

    def stage(self, c: Column, key: str | None = None) -> Column:
        """c as a column of its own, so that windows may stand over it."""
        text = str(c._jc.toString())
        if text in self.columns or text.startswith("_b") and text[2:].isdigit():
            return c
        whole = len(text) < 300 and "..." not in text and "more field" not in text and "lambda" not in text
        key = key or (text if whole else None)
        if key not in self.staged or key is None:
            if self.machines and (not whole or any(column in text for column, *_ in self.machines)):
                self.run_machines()
            self.n += 1
            name = f"_b{self.n}"
            self.df = self.df.withColumn(name, c)
            if key is None:
                return F.col(name)
            self.staged[key] = F.col(name)
        return self.staged[key]

    def rows(self, n: int):
        return self.w0.rowsBetween(-(n - 1), 0)

    def past(self, n: int):
        """The n rows before the current one."""
        return self.w0.rowsBetween(-n, -1)

    @property
    def all(self):
        return self.w0.rowsBetween(Window.unboundedPreceding, 0)

    def full(self, x: Column, n: int, value: Column) -> Column:
        """value where the last n rows are there and x is present in all of them."""
        return F.when(F.count(x).over(self.rows(n)) == n, value)

    def over(self, f, x: Column, n: int) -> Column:
        """An aggregate of the last n values of x, if all are present."""
        x = self.stage(x)
        return self.full(x, n, f(x).over(self.rows(n)))

    def lag(self, x: Column, n: int = 1) -> Column:
        return F.lag(self.stage(x), n).over(self.w0) if n else x

    def sma(self, x: Column, n: int) -> Column:
        return self.over(F.avg, x, n)

    def total(self, x: Column, n: int) -> Column:
        return self.over(F.sum, x, n)

    def highest(self, x: Column, n: int) -> Column:
        return self.over(F.max, x, n) + F.lit(0.0)

    def lowest(self, x: Column, n: int) -> Column:
        return self.over(F.min, x, n) + F.lit(0.0)

    def values(self, x: Column, n: int) -> Column:
        """The last n values as an array, oldest first; missing if one is."""
        x = self.stage(x)
        return self.stage(self.full(x, n, F.collect_list(x).over(self.rows(n))))

    def weighted(self, x: Column, weights: Sequence[float]) -> Column:
        """The sum of the last values times weights, oldest first."""
        a = self.values(x, len(weights))
        pairs = F.zip_with(a, F.array(*(F.lit(float(w)) for w in weights)), lambda v, w: v * w)
        return F.when(a.isNotNull(), F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v))

    def wma(self, x: Column, n: int) -> Column:
        return self.weighted(x, range(1, n + 1)) / (n * (n + 1) / 2)

    def position(self) -> Column:
        return self.stage(F.row_number().over(self.w0) - 1, "position")

    def machine(self, name: str, args: Sequence, *inputs: Column, out: int = 0) -> Column:
        """An output of a recursive machine over its complete rows."""
        columns = [self.stage(c.cast("double")) for c in inputs]
        names = [str(c._jc.toString()) for c in columns]
        key = f"{name}{tuple(args)}{names}"
        if key not in self.staged:
            self.n += 1
            column = f"_b{self.n}"
            self.machines.append((column, name, tuple(args), names))
            self.staged[key] = F.col(column)
        return self.staged[key][out]

    def run_machines(self) -> None:
        if self.machines:
            from ..functions.machines import run

            self.df = run(self.df, self.key, self.order, self.machines)
            self.machines = []

    def average(self, x: Column, n: int, kind: int) -> Column:
        from ..functions.native import moving_average

        return moving_average(self, x, n, kind)

    # Trees

    def bind(self, tree) -> Spec | None:
        if isinstance(tree, L.Name):
            return None if tree.text in self.columns else find(tree.text.lower())
        return find(tree.name, tree.line)

    def compile(self, tree) -> Column:
        if tree not in self.compiled:
            self.compiled[tree] = self._compile(tree)
        return self.compiled[tree]

    def _compile(self, tree) -> Column:
        if isinstance(tree, L.Number):
            return F.lit(tree.value)
        if isinstance(tree, L.Name) and tree.text in self.columns:
            kind = self.df.schema[tree.text].dataType.typeName()
            c = F.col(f"`{tree.text}`")
            return self.stage(clean(c.cast("double")), f"series {tree.text}") if kind not in ("boolean", "string", "timestamp", "timestamp_ntz", "date") else c
        if isinstance(tree, L.Name):
            tree = L.Command(tree.text.lower(), "", ())
        if isinstance(tree, L.Command):
            return self.command(tree)
        if isinstance(tree, L.Unary):
            inner = self.compile(tree.of)
            return ~inner if tree.op == "~" else -inner
        return self.binary(tree)

    def binary(self, tree) -> Column:
        a, b, op = self.compile(tree.left), self.compile(tree.right), tree.op
        if op in LOGIC:
            return a & b if op == "&" else a | b if op == "|" else a != b
        if op in COMPARE:
            return {"<": a < b, "<=": a <= b, "==": a == b, "!=": a != b, ">": a > b, ">=": a >= b}[op]
        if op in CROSS:
            a, b = self.stage(a), self.stage(b)
            up = (self.lag(a) <= self.lag(b)) & (a > b)
            down = (self.lag(a) >= self.lag(b)) & (a < b)
            return up if op == "//" else down if op == "\\" else up | down
        a, b = a.cast("double"), b.cast("double")
        return clean(a + b if op == "+" else a - b if op == "-" else a * b if op == "*" else divide(a, b))

    def command(self, tree: L.Command) -> Column:
        spec = find(tree.name, tree.line)
        args = bind_args(spec, tree.args)
        if len(tree.operands) > len(spec.series):
            raise DirectiveValueError(f"{spec.title} takes {len(spec.series)} series")
        given = [self.compile(x) for x in tree.operands]
        for name in spec.series[len(given) :]:
            if name not in self.columns:
                raise DirectiveValueError(f"{spec.title} needs a series for {name}" if name.startswith("<") else f"{spec.title} needs the column {name}")
            given.append(self.compile(L.Name(name)))
        return spec.build(self, *args, *given)

    def finish(self, columns: dict[str, Column]) -> DataFrame:
        self.run_machines()
        kept = [c for c in self.df.columns if not c.startswith("_b")]
        return self.df.select(*(f"`{c}`" for c in kept if c not in columns), *(c.alias(name) for name, c in columns.items()))


def bind_args(spec: Spec, texts: Sequence[str | None]) -> list:
    if len(texts) > len(spec.args):
        raise DirectiveValueError(f"{spec.title} takes at most {len(spec.args)} arguments")
    texts = [*texts, *[None] * (len(spec.args) - len(texts))]
    return [a.bind(t, spec.title) for a, t in zip(spec.args, texts, strict=True)]


def stringify(text_or_tree, columns: Sequence[str] = ()) -> str:
    """The one name of a directive: lower case, aliases resolved, defaults dropped, few parentheses."""
    tree = L.parse(text_or_tree) if isinstance(text_or_tree, str) else text_or_tree
    if isinstance(tree, L.Number):
        return number_text(tree.value)
    if isinstance(tree, L.Name):
        low = tree.text.lower()
        return tree.text if tree.text in columns or (SAME_NAME.get(low, low), "") not in COMMANDS else stringify(L.Command(low, "", ()), columns)
    if isinstance(tree, L.Unary):
        inner = stringify(tree.of, columns)
        return tree.op + (f"({inner})" if L.level_of(tree.of) < len(L.LEVELS) else inner)
    if isinstance(tree, L.Binary):
        mine = L.level_of(tree)
        left, right = (stringify(x, columns) for x in (tree.left, tree.right))
        left = f"({left})" if L.level_of(tree.left) < mine else left
        right = f"({right})" if L.level_of(tree.right) <= mine else right
        return f"{left} {tree.op} {right}"
    spec = find(tree.name, tree.line)
    values = bind_args(spec, tree.args)
    parts = ["" if a.default == v else number_text(v) for a, v in zip(spec.args, values, strict=True)]
    while parts and not parts[-1]:
        parts.pop()
    operands = [stringify(x, columns) if isinstance(x, L.Name) and x.text in (*columns, *spec.series) else f"({stringify(x, columns)})" for x in tree.operands]
    while operands and len(operands) <= len(spec.series) and operands[-1] == spec.series[len(operands) - 1]:
        operands.pop()
    return spec.title + (":" + ",".join(parts) if parts else "") + ("@" + ",".join(operands) if operands else "")


def lookback(text_or_tree, columns: Sequence[str] = ("open", "high", "low", "close", "volume")) -> int:
    """Rows before the first value of a directive on complete data."""
    tree = L.parse(text_or_tree) if isinstance(text_or_tree, str) else text_or_tree
    if isinstance(tree, L.Number) or (isinstance(tree, L.Name) and tree.text in columns):
        return 0
    if isinstance(tree, L.Name):
        tree = L.Command(tree.text.lower(), "", ())
    if isinstance(tree, L.Unary):
        return lookback(tree.of, columns)
    if isinstance(tree, L.Binary):
        return max(lookback(tree.left, columns), lookback(tree.right, columns)) + (tree.op in CROSS)
    spec = find(tree.name, tree.line)
    own = spec.lookback(*bind_args(spec, tree.args))
    return own + max([0, *(lookback(x, columns) for x in tree.operands)])


def commands() -> list[str]:
    """All lines that a directive can name, with their other names."""
    return sorted({s.title for s in COMMANDS.values()} | {f"{n}.{a}" for n, a in ALIASES})


def evaluate(df: DataFrame, directives: dict[str, str] | Sequence[str], key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df with a column for each directive: a mapping of names to texts, or texts that get their canonical names."""
    from ..functions import candles, machines, native  # noqa: F401  they register the commands

    named = dict(directives) if isinstance(directives, dict) else {stringify(d, df.columns): d for d in directives}
    compiler = Compiler(df, key, order)
    return compiler.finish({name: compiler.compile(L.parse(text)) for name, text in named.items()})
