"""String rules used when cleaning raw records. All native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the source system's rules.
# Suffixes kept in upper case, and suffixes written in title case.
UPPER_SUFFIXES = ["II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "PHD", "MD"]
TITLE_SUFFIXES = ["JR", "SR", "ESQ"]

# Python's str.strip()/split() treat Unicode white space and the \x1c-\x1f
# separators as blanks; Java's \s needs the (?U) flag to see the former.
_WS = r"[\s\x1c-\x1f]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Remove leading/trailing white space (Spark's trim only removes spaces)."""
    return F.regexp_replace(_col(c), rf"(?U)^{_WS}+|{_WS}+$", "")


def split_ws(c) -> Column:
    """Split on runs of white space, dropping empty pieces (Python ``str.split()``)."""
    return F.filter(F.split(_col(c), rf"(?U){_WS}+"), lambda x: x != "")


# A private-use character that cannot occur in names; marks inserted word breaks.
_MARK = "\ue000"


def collapse_ws(c) -> Column:
    """Runs of white space become one space, outer blanks removed (``' '.join(s.split())``)."""
    return strip_ws(F.regexp_replace(_col(c), rf"(?U){_WS}+", " "))


def title_case(c) -> Column:
    """Each run of letters: first letter upper, the rest lower (``O'Malley``, ``3Rd``).

    ``initcap`` starts a word only after a space, so a marker and a space are put
    after every other non-letter first, and removed again afterwards. Plain string
    functions, no lambdas: the whole expression stays in generated code.
    """
    spaced = F.regexp_replace(_col(c), r"([^\p{L} ])", "$1" + _MARK + " ")
    return F.regexp_replace(F.initcap(spaced), _MARK + " ", "")


_SUFFIX_ALT = "|".join(UPPER_SUFFIXES + TITLE_SUFFIXES)
# a whole space-separated token that is a suffix, any case, with optional trailing dots
_SUFFIX_TOKEN = rf"(?i)(?<=^| )(?:{_SUFFIX_ALT})\.*(?= |$)"


def person_name(c) -> Column:
    """"LAST, FIRST MIDDLE SUFFIX" -> "First Middle Last Suffix".

    * no comma: words title-cased and joined by one space;
    * comma: the text before the first comma is the last name (inner spaces kept);
      words after it whose upper-case form without trailing dots is a known suffix
      move to the end, in order (upper-case set kept upper, the other set title-cased);
    * the result is stripped; blank input gives an empty string (a rule rejects it).
    """
    v = strip_ws(c)
    no_comma = title_case(collapse_ws(v))

    last = strip_ws(F.substring_index(v, ",", 1))
    rest = collapse_ws(F.regexp_replace(F.regexp_replace(v, r"^[^,]*,", ""), ",", " "))
    given = collapse_ws(F.regexp_replace(rest, _SUFFIX_TOKEN, ""))
    sfx = F.regexp_replace(F.upper(F.array_join(
        F.regexp_extract_all(rest, F.lit(rf"(?i)(?<=^| )((?:{_SUFFIX_ALT})\.*)(?= |$)"), 1), " ")),
        r"\.+(?= |$)", "")
    for t in TITLE_SUFFIXES:
        sfx = F.regexp_replace(sfx, rf"(?<=^| ){t}(?= |$)", t.title())
    core = title_case(F.when(given == "", last).otherwise(F.concat_ws(" ", given, last)))
    with_comma = F.when(sfx != "", F.concat_ws(" ", core, sfx)).otherwise(core)

    out = F.when(v.contains(","), with_comma).otherwise(no_comma)
    return F.when(_col(c).isNull(), F.lit(None).cast("string")).otherwise(strip_ws(out))


def pad_district(c) -> Column:
    """All-digit district codes are left-padded with 0 to width 2; never truncated."""
    x = _col(c)
    return F.when(x.rlike(r"^[0-9]+$") & (F.length(x) < 2), F.lpad(x, 2, "0")).otherwise(x)


def none_sentinel(c) -> Column:
    """A value that reads ``NONE`` (any case, any outer blanks) means no value."""
    x = _col(c)
    return F.when(F.upper(strip_ws(x)) == "NONE", F.lit(None).cast("string")).otherwise(strip_ws(x))
