"""Regex building blocks with Python-``re`` semantics, written so the same
pattern text runs in Spark (Java regex) and in the DuckDB oracle (RE2).

Python's ``\\w``, ``\\s`` and ``\\d`` are Unicode-aware; Java's are ASCII
unless flagged and RE2's are always ASCII, so the classes are spelled out
with Unicode properties instead of the short escapes.
"""

# The character classes behind Python's Unicode \w, \s, \d.
WORD_CHARS = r"\p{L}\p{N}_"                              # inside [...]
SPACE_CHARS = r"\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}"          # str.isspace()
WORD = f"[{WORD_CHARS}]"
SPACE = f"[{SPACE_CHARS}]"
DIGIT = r"\p{Nd}"

# Java flags: d = only "\n" ends a line (Python's "."), u = Unicode case
# folding for (?i).  RE2 already behaves like this, so the oracle SQL
# drops the prefix.
JAVA_FLAGS = "(?d)"
JAVA_FLAGS_CI = "(?diu)"


def java(pattern: str, ignore_case: bool = False) -> str:
    """Pattern text for ``rlike`` / ``regexp_extract`` in Spark."""
    return (JAVA_FLAGS_CI if ignore_case else JAVA_FLAGS) + pattern


def re2(pattern: str, ignore_case: bool = False) -> str:
    """The same pattern for RE2 (DuckDB)."""
    return ("(?i)" if ignore_case else "") + pattern
