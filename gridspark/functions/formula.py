"""Formulas read once into one struct: relative form, functions, references and numbers.

A formula is scanned by one pattern of lexical alternatives; what it does not know makes the formula opaque (null).  References
become relative to the cell that holds the formula, so that copies along a row or column have equal forms.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_CELL = r"\$?[A-Za-z]{1,3}\$?[0-9]{1,7}"
_COLUMN = r"\$?[A-Za-z]{1,3}"
_LINE = r"\$?[0-9]{1,7}"
_END = r"(?![A-Za-z0-9_.(!\[])"
# A sheet, quoted or not, or the first and the last of a span of sheets.
_SHEET = r"(?:'(?:[^']|'')+'|(?:\[[^\]]*\])?[^\W\d][\w.]*(?::[^\W\d][\w.]*)?|\[[^\]]*\][\w.]*)!"
_LEXICON = re.compile(
    rf"""(?P<space>\s+)
    |(?P<text>"(?:[^"]|"")*")
    |(?P<error>\#(?:NULL!|DIV/0!|VALUE!|REF!|NAME\?|NUM!|N/A|SPILL!|CALC!))
    |(?P<ref>(?:{_SHEET})?(?:{_CELL}:{_CELL}|{_COLUMN}:{_COLUMN}|{_LINE}:{_LINE}|{_CELL}){_END})
    |(?P<function>[^\W\d][\w.]*\()
    |(?P<table>[^\W\d][\w.]*\[(?:[^\[\]]|\[[^\[\]]*\])*\])
    |(?P<bool>(?:TRUE|FALSE)(?![\w.!]))
    |(?P<name>(?:{_SHEET})?[^\W\d][\w.\\]*)
    |(?P<number>(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)
    |(?P<mark><>|<=|>=|[-+*/^&=<>%(){{}},;:@!])""",
    re.VERBOSE | re.IGNORECASE,
)
_SPLIT = re.compile(r"^(?:'((?:[^']|'')+)'|([^!]+))!(.*)$", re.DOTALL)
_POINT = re.compile(r"^(\$?)([A-Za-z]*)(\$?)([0-9]*)$")

REFERENCE = "struct<text: string, sheet: string, external: string, row1: int, col1: int, row2: int, col2: int, is_range: boolean>"
PARSED = f"struct<norm: string, functions: array<string>, refs: array<{REFERENCE}>, names: array<string>, numbers: array<double>>"


def column_number(letters: str) -> int:
    out = 0
    for c in letters.upper():
        out = out * 26 + ord(c) - 64
    return out


def column_letters(number: int) -> str:
    out = ""
    while number > 0:
        number, rest = divmod(number - 1, 26)
        out = chr(65 + rest) + out
    return out


def _point(text: str) -> tuple[int | None, int | None, bool, bool]:
    """(row, column, is the row absolute, is the column absolute) of one end of a reference."""
    first, letters, second, digits = _POINT.match(text).groups()
    if not letters:
        return int(digits), None, first == "$", False
    return (int(digits) if digits else None), column_number(letters), second == "$", first == "$"


def _relative(point, row: int, col: int) -> str:
    def part(letter, value, absolute, here):
        if value is None:
            return ""
        if absolute:
            return f"{letter}{value}"
        return letter if value == here else f"{letter}[{value - here}]"

    r, c, r_abs, c_abs = point
    return part("R", r, r_abs, row) + part("C", c, c_abs, col)


def split_sheet(token: str) -> tuple[str | None, str | None, str]:
    """(external workbook, sheet, rest) of a reference or name."""
    found = _SPLIT.match(token)
    if not found:
        return None, None, token
    sheet = found[1].replace("''", "'") if found[1] else found[2]
    external = None
    if (a := sheet.find("[")) >= 0 and (b := sheet.find("]", a)) >= 0:
        external, sheet = sheet[a + 1 : b], sheet[b + 1 :]
    return external, sheet or None, found[3]


def parse(formula: str | None, row: int, col: int) -> dict | None:
    """What :data:`PARSED` holds of the formula in the cell at ``row`` and ``col``; None if it is opaque."""
    if not formula or formula[0] != "=":
        return None
    norm, functions, refs, names, numbers = [], set(), [], [], []
    at = 1
    while at < len(formula):
        found = _LEXICON.match(formula, at)
        if not found:
            return None
        kind, text, at = found.lastgroup, found[0], found.end()
        if kind == "ref":
            external, sheet, rest = split_sheet(text)
            ends = [_point(p) for p in rest.split(":")]
            prefix = (f"[EXT:{external.upper()}]" if external is not None else "") + (f"{sheet.upper()}!" if sheet else "")
            norm.append(prefix + ":".join(_relative(p, row, col) for p in ends))
            refs.append({"text": text, "sheet": sheet, "external": external, "row1": ends[0][0], "col1": ends[0][1], "row2": ends[-1][0], "col2": ends[-1][1], "is_range": len(ends) > 1})
        elif kind == "function":
            functions.add(text[:-1].upper())
            norm.append(text.upper())
        elif kind in ("name", "table"):
            names.append(text)
            norm.append(text.upper())
        elif kind != "space":
            if kind == "number":
                numbers.append(float(text))
            norm.append(text.upper() if kind in ("bool", "error") else text)
    return {"norm": "".join(norm), "functions": sorted(functions), "refs": refs, "names": names, "numbers": numbers}


def _parsed(formula: pd.Series, row: pd.Series, col: pd.Series) -> pd.DataFrame:
    """Column by column; cells without a formula, most of them, share one empty list."""
    n, nothing = len(formula), []
    out = {"norm": [None] * n, **{c: [nothing] * n for c in ("functions", "refs", "names", "numbers")}}
    rows, cols = row.to_numpy(), col.to_numpy()
    for i in formula.notna().to_numpy().nonzero()[0].tolist():
        found = parse(formula.iat[i], int(rows[i]), int(cols[i]))
        if found:
            for name, values in out.items():
                values[i] = found[name]
    return pd.DataFrame(out)


def parsed(formula: Column, row: Column, col: Column) -> Column:
    """:data:`PARSED` of a formula column, in Arrow batches; its ``norm`` is null for constants and opaque formulas."""
    return F.pandas_udf(_parsed, PARSED)(formula, row, col)


def _shift(formula: pd.Series, row: pd.Series, col: pd.Series, expected: pd.Series, along_rows: pd.Series) -> pd.Series:
    def one(f, r, c, want, vertical):
        for d in (-3, -2, -1, 1, 2, 3):
            got = parse(f, int(r) + d * bool(vertical), int(c) + d * (not vertical))
            if got and got["norm"] == want:
                return d
        return None

    return pd.Series([one(*x) for x in zip(formula, row, col, expected, along_rows, strict=True)], dtype="Int32")


def matching_shift(formula: Column, row: Column, col: Column, expected: Column, along_rows: Column) -> Column:
    """By how many cells, up to three, the formula is off from where its relative form would be ``expected``; null if by none."""
    return F.pandas_udf(_shift, "int")(formula, row, col, expected, along_rows)


def coordinate(row: Column, col: Column) -> Column:
    """A1 text of a cell, for columns up to ZZZ."""
    n = col - 1
    letter = lambda x: F.char(F.lit(65) + x)
    one, two = letter(n), F.concat(letter(F.floor((n - 26) / 26)), letter((n - 26) % 26))
    three = F.concat(letter(F.floor((n - 702) / 676)), letter(F.floor((n - 702) / 26) % 26), letter((n - 702) % 26))
    return F.concat(F.when(n < 26, one).when(n < 702, two).otherwise(three), row.cast("string"))


def translated(formula: str, rows: int, cols: int) -> str | None:
    """The formula as it reads when it is copied so many rows down and columns right; None if it is opaque."""
    out, at = ["="], 1
    while at < len(formula):
        found = _LEXICON.match(formula, at)
        if not found:
            return None
        piece, at = found[0], found.end()
        if found.lastgroup == "ref":
            cut = piece.rfind("!") + 1
            ends = []
            for end in piece[cut:].split(":"):
                row, col, row_fixed, col_fixed = _point(end)
                letters = "" if col is None else ("$" if col_fixed else "") + column_letters(col if col_fixed else col + cols)
                digits = "" if row is None else ("$" if row_fixed else "") + str(row if row_fixed else row + rows)
                ends.append(letters + digits)
            piece = piece[:cut] + ":".join(ends)
        out.append(piece)
    return "".join(out)


_BARE_SHEET = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*")


def sheets_renamed(formula: str, names: dict[str, str]) -> str:
    """The formula with its references to sheets by their new names, all at once, so that swaps and chains come out right; an opaque one as it is.

    What stood in quotes stays in quotes.
    """
    out, at = ["="], 1
    while at < len(formula):
        found = _LEXICON.match(formula, at)
        if not found:
            return formula
        piece, at = found[0], found.end()
        if found.lastgroup in ("ref", "name") and "!" in piece:
            external, sheet, rest = split_sheet(piece)
            ends = sheet.split(":") if sheet else []  # two for a span
            if external is None and any(end in names for end in ends):
                new = ":".join(names.get(end, end) for end in ends)
                quoted = new if all(map(_BARE_SHEET.fullmatch, new.split(":"))) and piece[0] != "'" else "'" + new.replace("'", "''") + "'"
                piece = f"{quoted}!{rest}"
        out.append(piece)
    return "".join(out)


def _renamed(formula: pd.Series, moves: pd.Series) -> pd.Series:
    return pd.Series([sheets_renamed(f, {m["old_sheet"]: m["new_sheet"] for m in own}) for f, own in zip(formula, moves, strict=True)])


def renamed(formula: Column, moves: Column) -> Column:
    """:func:`sheets_renamed` with the new names in an array of {old_sheet, new_sheet}."""
    return F.pandas_udf(_renamed, "string")(formula, moves)
