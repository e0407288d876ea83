"""Translate ECMAScript regular expressions to the dialect of the engine that runs them.

The rule catalogue is written in ECMAScript form.  Java (Spark) differs from it in what
``\\s``, ``.`` and ``\\b`` mean on non-ASCII text, so those tokens are spelled out.
"""

from __future__ import annotations

# ECMAScript white space and line terminators, as the inside of a character class.
# Fixed values.
SPACE_CLASS = (
    r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
LINE_END_CLASS = r"\n\r\x{2028}\x{2029}"
# The same with a range: Java takes ten times as long over a class that unites single characters above U+00FF.
LINE_ENDS = r"\n\r\x{2028}-\x{2029}"
# White space that ends no line.
INLINE_SPACE_CLASS = r"\t\x0B\f \x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{FEFF}"

WORD = "[A-Za-z0-9_]"
SPACE = f"[{SPACE_CLASS}]"
NOT_SPACE = f"[^{SPACE_CLASS}]"
DOT = f"[^{LINE_END_CLASS}]"
IN_LINE = f"[^{LINE_ENDS}]"

# Start of a line as ECMAScript multi-line mode sees it.
LINE_START = f"(?:^|(?<=[{LINE_ENDS}]))"

_OUTSIDE = {
    r"\s": SPACE,
    r"\S": NOT_SPACE,
    r"\b": f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))",
    ".": IN_LINE,
}
ANY = r"[\x{0}-\x{10FFFF}]"


def _tokens(pattern: str):
    """Yield (token, inside_class) pairs."""
    i, inside = 0, False
    while i < len(pattern):
        width = 2 if pattern[i] == "\\" else 1
        token = pattern[i : i + width]
        if token == "[" and not inside:
            if pattern.startswith(r"[\s\S]", i):
                yield r"[\s\S]", False
                i += 6
                continue
            inside = True
        elif token == "]" and inside:
            inside = False
        yield token, inside
        i += width


def to_java(pattern: str, ignore_case: bool = False, starts: str = "") -> str:
    """Java form of an ECMAScript pattern.

    ``starts`` names the characters a match can start with; they are looked for before
    the alternatives are tried one by one, which settles most places in a text.
    """
    out = []
    for token, inside in _tokens(pattern):
        if token == r"[\s\S]":
            out.append(ANY)
        elif inside:
            out.append(SPACE_CLASS if token == r"\s" else token)
        else:
            out.append(_OUTSIDE.get(token, token))
    ahead = f"(?=[{starts}])" if starts else ""
    return ("(?i)" if ignore_case else "") + ahead + "".join(out)


def words(alternatives: list[str]) -> str:
    """Java pattern for any of ``alternatives`` (ECMAScript pieces) as whole words."""
    body = "|".join(to_java(a) for a in alternatives)
    starts = "".join(sorted({a[0] for a in alternatives}))
    return f"(?=[{starts}])(?<!{WORD})(?:{body})(?!{WORD})"
