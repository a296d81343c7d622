"""String predicates and cleaners matching Python's ``str.strip`` semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values shared with the scrubbing prompt format.
EOS_TEXT = "<|endoftext|>"
RAW_TAG = "[RAW] "
REDACTED_TAG = " [REDACTED] "
MARKER = "[REDACTED]"
BLANK_MESSAGE = "Please enter text to redact."

# Python's str.isspace() set, as a Java regex class: Unicode white space plus
# the four information separators U+001C..U+001F that Java's (?U)\s omits.
WS_CLASS = "[\\s\\x1c-\\x1f]"
NONBLANK_RE = "(?U)[^\\s\\x1c-\\x1f]"
STRIP_RE = "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$"

# Word runs used by the vocabulary tokenizer and by segmenting: runs of
# characters other than space, tab, LF, CR, FF and VT (\x0B, never \v).
WORD_RE = "[^ \\t\\n\\r\\f\\x0B]+"
WORD_OR_GAP_RE = "[^ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+"


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nonblank(c) -> Column:
    """True when ``str.strip()`` would leave something (NULL stays NULL)."""
    return col_of(c).rlike(NONBLANK_RE)


def py_strip(c) -> Column:
    """``str.strip()`` with Python's white-space set."""
    return F.regexp_replace(col_of(c), STRIP_RE, "")


def words(c) -> Column:
    """Array of word runs (see WORD_RE)."""
    return F.regexp_extract_all(col_of(c), F.lit(WORD_RE), 0)
