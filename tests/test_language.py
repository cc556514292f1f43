import pytest

import barloom.functions.candles
import barloom.functions.machines
import barloom.functions.native  # noqa: F401
from barloom.plans import language as L
from barloom.plans.compiler import commands, lookback, stringify
from barloom.plans.errors import DirectiveError, DirectiveSyntaxError, DirectiveValueError
from barloom.plans.registry import COMMANDS


def test_every_line_is_there():
    assert len(COMMANDS) == 254
    assert sum(k[0] == "cdl" for k in COMMANDS) == 63
    assert {"macd.dea", "boll.u", "stoch.slowk"} <= set(commands())


@pytest.mark.parametrize(("text", "name"), [
    ("MACD.dea:12,26,9", "macd.signal"), ("boll.u:20,2", "boll.upper"), ("boll.upper:,3", "boll.upper:,3"), ("style.doji", "cdl.doji"), ("ma:5,0@close", "ma:5"), ("ma:5@open", "ma:5@open"),
    ("ema:5@(macd)", "ema:5@(macd)"), ("close>ma:5", "close > ma:5"), ("(close + open) * 2", "(close + open) * 2"), ("close + open * 2", "close + open * 2"), ("close - (open - high)", "close - (open - high)"),
    ("close // ma:5", "close // ma:5"), ("close \\\\ ma:5", "close \\ ma:5"), ("~(close > open & close < 3)", "~(close > open & close < 3)"),
])
def test_one_name_for_an_identity(text, name):
    assert stringify(text, ("open", "high", "low", "close")) == name
    assert stringify(name, ("open", "high", "low", "close")) == name


def test_precedence():
    tree = L.parse("1 + 2 * 3 > 4 & 5 < 6")
    assert tree.op == "&" and tree.left.op == ">" and tree.left.left.op == "+" and tree.left.left.right.op == "*"
    assert L.parse("1 - 2 - 3").left.op == "-"


@pytest.mark.parametrize("text", ["", "ma:", "1 +", "(close", "close)", "ma:5@", "close ? 1", "@close"])
def test_syntax_errors(text):
    with pytest.raises(DirectiveError):
        stringify(text, ("close",))


@pytest.mark.parametrize("text", ["ma:0", "ma:x", "nothing:3", "ma:5,9", "cci:1", "boll.side", "ma:1,2,3", "quantile:5,2"])
def test_value_errors(text):
    with pytest.raises(DirectiveValueError):
        stringify(text, ("close",))


def test_deep_nesting_is_refused():
    with pytest.raises(DirectiveSyntaxError):
        L.parse("-" * 200 + "1")


@pytest.mark.parametrize(("text", "rows"), [("ma:5", 4), ("macd.signal", 33), ("close // ma:5", 5), ("ma:3@(ma:5)", 6), ("adx:14", 27), ("t3:5", 24), ("close", 0), ("ichimoku.senkou_b", 77), ("cdl.morningstar", 12)])
def test_lookback(text, rows):
    assert lookback(text) == rows
