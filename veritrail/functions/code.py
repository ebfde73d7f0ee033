"""What of a source text is code: comments and the insides of strings blanked, places unchanged.

A text is cut into comments, strings, templates and other pieces that follow each
other without gaps, so whatever begins first decides how the rest is read: quotes
in comments open nothing, nor do comment marks in strings. Blanked text has the
length and lines of the original, so a match in it can be read there.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_QUOTED = r'''"(?:[^"\\\n]|\\.)*+"?|'(?:[^'\\\n]|\\.)*+'?'''
_C_COMMENTS = r"/\*.*?(?:\*/|$)|//[^\n]*+"
_TEXT_BLOCK = r'"""(?:[^"\\]|\\.|"(?!""))*+(?:"""|$)'
# A slash begins a pattern, not a division, behind an opening or an operator.
_PATTERN = r"(?<=[(,=:\[!&|?{};][ ]{0,4})/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*+"
_SCRIPT = rf"(?s){_C_COMMENTS}|{_QUOTED}|`(?:[^`\\]|\\.)*+`?|{_PATTERN}|[^\"'`/]++|/"
_JVM = rf"(?s){_C_COMMENTS}|{_TEXT_BLOCK}|{_QUOTED}|[^\"'/]++|/"
_PYTHON = rf"(?s){_TEXT_BLOCK}|'''(?:[^'\\]|\\.|'(?!''))*+(?:'''|$)|#[^\n]*+|{_QUOTED}|[^\"'#]++"
PIECES = {"typescript": _SCRIPT, "javascript": _SCRIPT, "java": _JVM, "kotlin": _JVM, "python": _PYTHON}


def code_only(content: Column, language: str) -> Column:
    """``content`` with spaces for comments and underscores within quotes and patterns; line ends and the quotes stay."""
    spaces = lambda p: F.regexp_replace(p, r"[^\n]", " ")
    comment = (lambda p: p.startswith("#")) if language == "python" else (lambda p: p.startswith("//") | p.startswith("/*"))
    string = lambda p: p.rlike("^[\"'`]") | (p.startswith("/") & (F.length(p) > 1))
    inner = lambda p: F.concat(F.substring(p, 1, 1), F.regexp_replace(F.substr(p, F.lit(2), F.length(p) - 2), r"[^\n]", "_"), F.when(F.length(p) > 1, F.substr(p, F.length(p), F.lit(1))).otherwise(""))
    pieces = F.regexp_extract_all(content, F.lit(PIECES[language]), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(comment(p), spaces(p)).when(string(p), inner(p)).otherwise(p)), "")
