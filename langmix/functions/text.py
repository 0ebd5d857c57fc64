"""Text column functions (F10-F18, F23). All JVM-side, no Python UDFs.

Regexes are written so that the same pattern text runs in Java regex and in
RE2, which lets the SQL oracles reuse them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the reference's behaviour) -------------------
# Characters whose presence marks a "special character" sentence:
#   ! @ # $ % ^ & * ( ) [ ] { } ; : , . / < > ? \ | ` ~ - = _ + " ' and the digits 0-9
SPECIAL_CHAR_CLASS = r"""[!@#$%^&*()\[\]{};:,./<>?\\|`~=_+"'0-9-]"""
# Python's string.punctuation: the four ASCII punctuation ranges ! to /, : to @, [ to `, { to ~
ASCII_PUNCT_CLASS = r"[!-/:-@\[-`{-~]"
# Token count threshold of a "short" sentence.
SHORT_MAX_TOKENS = 5
# Marker removed by the evaluation text cleaner.
URL_MARKER = "<URL>"
# ---------------------------------------------------------------------------

# Python str.split(): runs of Unicode whitespace separate tokens.
TOKEN_PATTERN = r"(?U)\S+"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def num_tokens(c) -> Column:
    """number of whitespace tokens (Python ``len(s.split())``)."""
    return F.regexp_count(col_(c), F.lit(TOKEN_PATTERN)).cast("long")


def tokens_ws(c) -> Column:
    """the whitespace tokens themselves."""
    return F.regexp_extract_all(col_(c), F.lit(TOKEN_PATTERN), 0)


def has_special_char(c) -> Column:
    """F15."""
    return col_(c).rlike(SPECIAL_CHAR_CLASS)


def is_short(c) -> Column:
    """F16: at most five whitespace tokens."""
    return num_tokens(c) <= SHORT_MAX_TOKENS


def char_length(c) -> Column:
    """Unicode code points."""
    return F.length(col_(c))


def strip_ws(c) -> Column:
    """Python ``str.strip()`` on whitespace."""
    return F.regexp_replace(col_(c), r"(?U)^\s+|\s+$", "")


def clean_text(c) -> Column:
    """null -> ''; drop <URL>; lower; delete ASCII punctuation; collapse whitespace; strip."""
    s = F.coalesce(col_(c), F.lit(""))
    s = F.replace(s, F.lit(URL_MARKER), F.lit(""))
    s = F.lower(s)
    s = F.regexp_replace(s, ASCII_PUNCT_CLASS, "")
    s = F.regexp_replace(s, r"(?U)\s+", " ")
    return strip_ws(s)


def clean_tweet(c) -> Column:
    """drop @handles, strip, collapse whitespace."""
    s = F.regexp_replace(col_(c), r"(?U)@\S+", "")
    s = strip_ws(s)
    return F.regexp_replace(s, r"(?U)\s+", " ")


def delete_newlines(c) -> Column:
    """F13 (first form): delete newlines."""
    return F.regexp_replace(col_(c), "\n", "")


def newlines_to_space(c) -> Column:
    """F13 (second form): newline -> space, then strip."""
    return strip_ws(F.regexp_replace(col_(c), "\n", " "))


def join_segments(c) -> Column:
    """join document segments with a space."""
    return F.array_join(col_(c), " ")


# social-media tokenisation of lower-cased text. Alternatives in priority
# order: URLs, @handles, #hashtags, emoticons, words (with inner ' or -),
# numbers, any other single non-space symbol.
TWEET_TOKEN_PATTERN = (
    r"https?://[^\s]+"
    r"|@[\p{L}\p{N}_]+"
    r"|#[\p{L}\p{N}_]+"
    r"|[:;=8][-o^']?[()\[\]dDpP/\\|*]"
    r"|[\p{L}\p{N}_]+(?:['-][\p{L}\p{N}_]+)*"
    r"|[^\s]"
)


def tweet_tokens(c) -> Column:
    """lower-cased tweet-style tokens (documented approximation)."""
    return F.regexp_extract_all(F.lower(col_(c)), F.lit(TWEET_TOKEN_PATTERN), 0)


def ngram_text(c) -> Column:
    """Detector view of a text: lower-cased, whitespace runs collapsed, space-padded."""
    return F.concat(F.lit(" "), F.lower(F.regexp_replace(col_(c), r"\s+", " ")), F.lit(" "))


def char_ngrams(padded, n: int) -> Column:
    """Character n-grams of an already padded text column (see :func:`ngram_text`).

    One linear regex pass: each match consumes one code point and captures the
    n code points starting there (a lookahead), so grams overlap and never
    start inside a surrogate pair."""
    return F.regexp_extract_all(col_(padded), F.lit(f"(?s)(?=(.{{{n}}}))."), 1)


def char_ngram_count(padded, n: int) -> Column:
    """Number of grams :func:`char_ngrams` yields, without building them."""
    return F.greatest(F.length(col_(padded)) - n + 1, F.lit(0))


def label_line(language, sentence) -> Column:
    """``__label__<lang> <sentence>`` on one line (newlines become spaces)."""
    return F.concat(F.lit("__label__"), col_(language), F.lit(" "), newlines_to_space(strip_ws(col_(sentence))))


def parse_label_line(c) -> tuple[Column, Column]:
    """Split a label line on its first space -> (language, sentence)."""
    line = col_(c)
    lang = F.regexp_extract(line, r"^__label__([^ ]*) ", 1)
    sent = F.regexp_extract(line, r"^__label__[^ ]* ([\s\S]*)$", 1)
    return lang, sent


def is_label_line(c) -> Column:
    line = col_(c)
    return line.startswith("__label__") & line.contains(" ")
