"""Path patterns as regular expressions.

A pattern without a slash names a file at any depth; one that ends in a slash, all below that
directory; any other is read from the root. ``**`` spans directories, ``*`` and ``?`` do not,
``{a,b}`` is either and ``[...]`` a class of characters.
"""

from __future__ import annotations

import re

_PART = re.compile(r"\*\*/|\*\*|\*|\?|\[[^\]]+\]|[{},]|.", re.S)
_MEANS = {"**/": "(?:[^/]+/)*", "**": ".*", "*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")"}


def glob_regex(glob: str) -> str:
    """A regular expression for whole paths; negations, comments and escapes are refused."""
    if not glob or glob[0] in "!#" or "\\" in glob:
        raise ValueError(f"pattern {glob!r}: negations ('!'), comments ('#') and escapes are not read")
    whole = glob + "**" if glob.endswith("/") else glob
    out, depth = [], 0
    for part in _PART.findall(whole):
        depth += (part == "{") - (part == "}")
        if part[0] == "[" and len(part) > 1:
            out.append("[" + part[1:-1].replace("!", "^", 1) + "]" if part[1] == "!" else part)
        elif part == ",":
            out.append("|" if depth else ",")
        else:
            out.append(_MEANS.get(part) or re.escape(part))
    if depth:
        raise ValueError(f"pattern {glob!r}: braces do not close")
    return ("^" if "/" in glob else "^(?:.*/)?") + "".join(out) + "$"
