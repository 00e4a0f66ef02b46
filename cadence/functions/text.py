"""Text column functions (H11-H16) and the character n-gram expression (K1).

Everything is a JVM-side string / higher-order-function expression; whole
texts are processed (no prefix cut unless a caller asks for one).
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sanitising patterns for the character tokenizer (tags, digits,
# punctuation, cross-lingual symbols, runs of two or more spaces).
RE_TAG = r"<.*?>"
RE_DIGIT = r"[0-9]"
RE_PUNCT = r"[.,:|/\"_\[\]()]"
RE_XLING = r"[♫♪%–]"
RE_SPACES = r" {2,}"
WS_TOKEN = "<ws>"
UNK_TOKEN = "<unk>"
PAD_TOKEN = "<pad>"

# URL and e-mail patterns removed before language detection.
RE_URL = r"https?://[-_.?&~;+=/#0-9A-Za-z]{1,2076}"
RE_MAIL = r"[-_.0-9A-Za-z]{1,64}@[-_0-9A-Za-z]{1,255}[-_.0-9A-Za-z]{1,255}"
RE_MAIL_FAST = RE_MAIL.replace("{1,64}@", "{1,64}+@")

# N-gram character normalisation.
LATIN1_EXCLUDED = "\u00a0\u00ab\u00b0\u00bb"       # become spaces
ROMANIAN_FROM, ROMANIAN_TO = "șț", "şţ"   # comma-below -> cedilla
# Vietnamese letters that take a tone mark, and the marks (grave,
# acute, tilde, hook above, dot below); what a pair composes to is Unicode's NFC.
VI_LETTERS = "AEIOUYaeiouyÂÊÔâêôĂăƠơƯư"
VI_MARKS = "\u0300\u0301\u0303\u0309\u0323"
VI_COMPOSED = "".join(unicodedata.normalize("NFC", a + m) for m in VI_MARKS for a in VI_LETTERS)
FARSI_YEH, ARABIC_YEH = "ی", "ي"
LATIN_EXT_ADDITIONAL_REP = "ể"                # U+1EA0 and later in that block
HIRAGANA_REP, KATAKANA_REP, BOPOMOFO_REP, HANGUL_REP = "あ", "ア", "ㄅ", "가"

# Basic-Latin non-letters, the excluded Latin-1 signs and general punctuation become spaces.
RE_TO_SPACE = r"[\x{0000}-\x{0040}\x{005B}-\x{0060}\x{007B}-\x{007F}\x{2000}-\x{206F}" + LATIN1_EXCLUDED + "]"
# All other characters that H15 changes lie in these blocks.
RE_MAY_CHANGE = r"[\x{0218}-\x{1FFF}\x{3040}-\x{D7AF}]"

ALPHA = 0.5          # fixed value: smoothing weight alpha
BASE_FREQ = 10000    # fixed value: smoothing base frequency
PROB_THRESHOLD = 0.1  # fixed value: minimum probability of a reported language
N_GRAM = 3


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sanitize_text(s) -> Column:
    """Strip tags, digits, punctuation, symbols; delete runs of >=2
    spaces; trim surrounding whitespace; lower-case."""
    t = F.regexp_replace(_c(s), RE_TAG, "")
    t = F.regexp_replace(t, RE_DIGIT, "")
    t = F.regexp_replace(t, RE_PUNCT, "")
    t = F.regexp_replace(t, RE_XLING, "")
    t = F.regexp_replace(t, RE_SPACES, "")
    t = F.regexp_replace(t, r"^\s+|\s+$", "")
    return F.lower(t)


def char_tokens(s) -> Column:
    """Characters of the sanitised text, space -> ``<ws>``."""
    t = sanitize_text(s)
    chars = F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(F.split(t, ""))
    return F.transform(chars, lambda ch: F.when(ch == " ", F.lit(WS_TOKEN)).otherwise(ch))


def strip_url_mail(s, max_chars: int | None = None) -> Column:
    """URLs and e-mail addresses -> space, runs of spaces -> one space.
    ``max_chars`` optionally keeps only the first characters (off by default:
    whole texts are processed)."""
    # the guards skip the scans for texts that cannot contain a match; the
    # possessive local part cannot change the (leftmost) match because '@'
    # is outside its character class, it only removes backtracking
    t = _c(s)
    t = F.when(F.contains(t, F.lit("http")), F.regexp_replace(t, RE_URL, " ")).otherwise(t)
    t = F.when(F.contains(t, F.lit("@")), F.regexp_replace(t, RE_MAIL_FAST, " ")).otherwise(t)
    if max_chars:
        t = F.substring(t, 1, max_chars)
    return F.when(F.contains(t, F.lit("  ")), F.regexp_replace(t, " {2,}", " ")).otherwise(t)


def _beyond_ascii(t: Column) -> Column:
    return F.octet_length(t) > F.length(t)


def drop_minor_latin(s) -> Column:
    """When Latin letters are fewer than half the non-Latin characters,
    drop every character from 'A' to 'z'."""
    t = _c(s)
    # count Latin letters by runs (one regex match per run, not per letter)
    latin = F.length(t) - F.length(F.regexp_replace(t, r"[A-z]+", ""))
    non_latin = F.regexp_count(t, F.lit(r"[\x{0300}-\x{1DFF}\x{1F00}-\x{10FFFF}]"))
    # texts of ASCII alone, and those without the other letters, are not counted
    return F.when(_beyond_ascii(t) & (non_latin > 0) & (latin * 2 < non_latin), F.regexp_replace(t, r"[A-z]", "")).otherwise(t)


def compose_vietnamese(s) -> Column:
    """A Vietnamese letter and the tone mark behind it -> one letter; a mark
    behind anything else stays. Texts without marks are only scanned once."""
    t = _c(s)

    def joined(piece: Column) -> Column:
        at = F.instr(F.lit(VI_LETTERS), F.substring(piece, -2, 1))
        row = F.instr(F.lit(VI_MARKS), F.substring(piece, -1, 1))
        one = F.substring(F.lit(VI_COMPOSED), (row - 1) * len(VI_LETTERS) + at, F.lit(1))
        pair = (F.length(piece) >= 2) & (at > 0) & (row > 0)
        return F.when(pair, F.concat(F.substring(piece, F.lit(1), F.length(piece) - 2), one)).otherwise(piece)

    pieces = F.split(t, f"(?<=[{VI_MARKS}])")
    return F.when(t.rlike(f"[{VI_MARKS}]"), F.array_join(F.transform(pieces, joined), "")).otherwise(t)


def normalize_ngram_chars(s, collapse: bool = False, cjk_classes: dict[str, str] | None = None) -> Column:
    """Per-character normalisation applied before n-gram extraction.

    ``collapse=True`` turns each RUN of space-mapped characters into one
    space: identical n-grams (the window restarts at a space and a space run
    emits nothing) for far fewer regex matches; the standalone function keeps
    one space per character. ``cjk_classes`` gives the character that stands for
    each ideograph of a class; others, and all without it, stay as they are.
    """
    t = F.regexp_replace(_c(s), RE_TO_SPACE + ("+" if collapse else ""), " ")
    t = F.translate(t, ROMANIAN_FROM + FARSI_YEH, ROMANIAN_TO + ARABIC_YEH)
    if cjk_classes:
        t = F.translate(t, "".join(cjk_classes), "".join(cjk_classes.values()))
    rare = (F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(
        t, r"[\x{1EA0}-\x{1EFF}]", LATIN_EXT_ADDITIONAL_REP),
        r"[\x{3040}-\x{309F}]", HIRAGANA_REP),
        r"[\x{30A0}-\x{30FF}]", KATAKANA_REP),
        r"[\x{3100}-\x{312F}\x{31A0}-\x{31BF}]", BOPOMOFO_REP),
        r"[\x{AC00}-\x{D7AF}]", HANGUL_REP))
    # one guard scan instead of five replacement scans for texts without these scripts
    any_rare = t.rlike(r"[\x{1EA0}-\x{1EFF}\x{3040}-\x{312F}\x{31A0}-\x{31BF}\x{AC00}-\x{D7AF}]")
    return F.when(any_rare, rare).otherwise(t)


def detection_text(s, max_chars: int | None = None) -> Column:
    """H13 -> H14: the text the detector sees (before per-char normalisation)."""
    return drop_minor_latin(strip_url_mail(s, max_chars))


def script_of(ch) -> Column:
    """Unicode script of a character via ``Character.UnicodeScript``
    (a rule of the Java platform rather than a copied table); Common /
    Inherited / Unknown -> ``Others``; names title-cased."""
    cp = F.ascii(_c(ch))
    name = F.call_function("reflect", F.lit("java.lang.Character$UnicodeScript"), F.lit("of"), cp)
    pretty = F.initcap(F.regexp_replace(F.lower(name), "_", " "))
    return F.when(name.isin("COMMON", "INHERITED", "UNKNOWN") | name.isNull(), F.lit("Others")) \
        .otherwise(pretty)


def ngram_words(s) -> Column:
    """Words of the text after H15, as ``split(text, ' ')`` gives them. A text
    that H15 changes in nothing but spaces is split in one scan."""
    t = _c(s)
    changed = F.split(normalize_ngram_chars(compose_vietnamese(t), collapse=True), " ")
    return F.when(~_beyond_ascii(t), F.split(t, "[^A-Za-z]+")).when(t.rlike(RE_MAY_CHANGE), changed) \
        .otherwise(F.split(t, RE_TO_SPACE + "+"))


def word_paddings(words) -> Column:
    """Words (an ARRAY column from ``split(text, ' ')``) as padded strings
    ``' ' + word [+ ' ']``.

    The n-gram window restarts after each space, so a word's grams are those
    of its padded form; the trailing space is present when a space follows.
    Pass a materialised column: inside the lambda the array size is read
    per element, and an inline text expression would be re-evaluated for
    every word.
    """
    words = _c(words)
    n = F.size(words)
    padded = F.transform(words, lambda w, i: F.when(
        F.length(w) > 0,
        F.concat(F.lit(" "), w, F.when(i < n - 1, F.lit(" ")).otherwise(F.lit("")))))
    return F.filter(padded, lambda p: p.isNotNull())


def _is_upper(ch: Column) -> Column:
    return (F.upper(ch) == ch) & (F.lower(ch) != ch)


def padded_grams(p) -> Column:
    """K1: 1..3-grams of one padded word; grams ending inside a run of
    capitals (this and the previous character upper case) are skipped, and
    a lone space is never a gram."""
    p = _c(p)
    L = F.length(p)

    def ending_at(e):
        return F.transform(F.sequence(F.lit(1), F.least(F.lit(N_GRAM), e)), lambda n: F.substring(p, e - n + 1, n))

    def outside_capitals(e):
        cap = _is_upper(F.substring(p, e, 1)) & _is_upper(F.substring(p, e - 1, 1))
        return F.when(cap, F.array().cast("array<string>")).otherwise(ending_at(e))

    ends = F.sequence(F.lit(2), L)
    # no two capitals meet in a word without one behind its first character
    rest = F.substring(p, F.lit(3), L)
    allg = F.when(F.lower(rest) == rest, F.flatten(F.transform(ends, ending_at))) \
        .otherwise(F.flatten(F.transform(ends, outside_capitals)))
    return F.filter(allg, lambda g: g != F.lit(" "))
