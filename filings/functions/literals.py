"""Lines that hold a Python literal, as JSON text.

Records were stored as the printed form of dicts and tuples. `literal_json`
rewrites such a line as a column expression: the line is cut into tokens, strings
as a whole, so that nothing inside quotes is taken for structure; then every
token becomes its JSON form. Strings of either quote with the prefixes u and b,
all escapes, numbers with a long mark or without a digit on one side of the
point, None, True and False, tuples, nested values, commas before a closing
bracket and keys that are no strings are rewritten. JSON lines stay what they
are. What is no literal gives null: text between tokens, strings that are not
closed, names, sums, sets and strings side by side.

Escapes of all strings stand for code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filings.functions.text import let

# Escaped backslashes and quotes are masked, so that a quote ends a string. These
# code points are never used for text; a line that holds one is no literal.
_BACKSLASH, _SINGLE, _DOUBLE = "\ufdd0", "\ufdd1", "\ufdd2"

_STRING = r"""[uUbB]?'[^']*+'|[uUbB]?"[^"]*+\""""
_NUMBER = r"[-+]?(?:[0-9]++(?:\.[0-9]*+)?|\.[0-9]++)(?:[eE][-+]?[0-9]++)?[lL]?(?![A-Za-z0-9_.])"
_NAME = r"(?:None|True|False|null|true|false)(?![A-Za-z0-9_])"
_TOKEN = rf"(?s){_STRING}|{_NUMBER}|{_NAME}|[\[\](){{}}:,]|[\t\r\n ]++"
# Pieces of the text of a string.
_PIECE = (
    r"(?s)\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8}|\\[0-7]{1,3}|\\."
    r'|[\x00-\x1f]|"|[^\\\x00-\x1f"]++|\\'
)
# Escapes of one letter.
_ESCAPES = {
    r"\n": r"\n", r"\t": r"\t", r"\r": r"\r", r"\b": r"\b", r"\f": r"\f",
    r"\a": r"\u0007", r"\v": r"\u000b", "\\\n": "",
}
_NAMES = {"None": "null", "True": "true", "False": "false"}
_OPENING, _CLOSING = {"(": "["}, (")", "]", "}")


def _masked(line: Column) -> Column:
    # Pairs of backslashes first: what then stands before a quote escapes it.
    line = F.replace(line, F.lit("\\\\"), F.lit(_BACKSLASH))
    line = F.replace(line, F.lit("\\'"), F.lit(_SINGLE))
    return F.replace(line, F.lit('\\"'), F.lit(_DOUBLE))


def _code_point(digits: Column) -> Column:
    """Up to eight hexadecimal digits as an escape, or as a character beyond 16 bits."""
    eight = F.lpad(digits, 8, "0")
    character = F.decode(F.unhex(eight), "UTF-32")
    return F.when(eight.startswith("0000"), F.concat(F.lit("\\u"), F.substring(eight, 5, 4))).otherwise(character)


def _json_piece(piece: Column) -> Column:
    out = F.when(piece == '"', F.lit('\\"'))
    for escape, value in _ESCAPES.items():
        out = out.when(piece == escape, F.lit(value))
    rest = F.substring(piece, F.lit(3), F.length(piece))
    out = out.when(piece.rlike(r"^\\[xuU][0-9a-fA-F]{2}"), _code_point(rest))
    octal = F.conv(F.substring(piece, F.lit(2), F.length(piece)), 8, 16)
    out = out.when(piece.rlike(r"^\\[0-7]"), _code_point(octal))
    # Other escapes stand for themselves, the backslash included.
    out = out.when(piece.startswith("\\"), F.concat(F.lit("\\"), piece))
    out = out.when(piece < " ", _code_point(F.hex(F.ascii(piece))))
    return out.otherwise(piece)


def _json_string(token: Column) -> Column:
    quoted = F.regexp_replace(token, "^[uUbB]", "")
    text = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    pieces = F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))
    text = F.array_join(F.transform(pieces, _json_piece), "")
    text = F.replace(text, F.lit(_BACKSLASH), F.lit("\\\\"))
    text = F.replace(text, F.lit(_SINGLE), F.lit("'"))
    text = F.replace(text, F.lit(_DOUBLE), F.lit('\\"'))
    return F.concat(F.lit('"'), text, F.lit('"'))


def _json_number(token: Column) -> Column:
    number = F.regexp_replace(token, "[+lL](?![0-9])|^[+]", "")
    number = F.regexp_replace(number, r"^(-?)\.", "$10.")
    number = F.regexp_replace(number, r"\.(?![0-9])", ".0")
    return F.regexp_replace(number, r"^(-?)0+(?=[0-9])", "$1")


def _json_token(token: Column, next_one: Column) -> Column:
    value = F.when(token == "(", F.lit("[")).when(token == ")", F.lit("]"))
    value = value.when((token == ",") & next_one.isin(*_CLOSING), F.lit(""))
    for name, json in _NAMES.items():
        value = value.when(token == name, F.lit(json))
    value = value.when(token.rlike("['\"]$"), _json_string(token))
    value = value.when(token.rlike("^[-+.0-9]"), _json_number(token))
    value = value.otherwise(token)
    is_key = (next_one == ":") & ~token.rlike("['\"]$")
    return F.when(is_key, F.concat(F.lit('"'), value, F.lit('"'))).otherwise(value)


def literal_json(line: Column) -> Column:
    """The literal of a line as JSON text; null where there is none.

    Brackets are not matched here: the JSON parser does that.
    """

    def joined(tokens: Column) -> Column:
        return F.array_join(
            F.transform(tokens, lambda t, i: _json_token(t, F.coalesce(F.get(tokens, i + 1), F.lit("")))), ""
        )

    def rewritten(masked: Column) -> Column:
        tokens = F.regexp_extract_all(masked, F.lit(_TOKEN), F.lit(0))
        solid = lambda every: F.filter(every, lambda t: ~t.rlike(r"^[\t\r\n ]"))
        return let(
            tokens,
            lambda every: F.when(F.array_join(every, "") == masked, let(solid(every), joined)),
        )

    clean = ~line.rlike(f"[{_BACKSLASH}{_SINGLE}{_DOUBLE}]") & (F.trim(line) != "")
    return F.when(clean, let(_masked(line), rewritten))
