"""Reading published text: whitespace, numbers and ISO-8601 dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import FIRST_PERIOD, LAST_PERIOD

# Every character that counts as whitespace at the edge of a cell.
_SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_NUMBER = r"\A[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"
_PLAIN_DATE = r"\A\d{4}(?:-\d{2}(?:-\d{2})?)?\z"
# Year, month and day with one separator or none; hour, minute and second with colons or none; then a sign, hours and minutes.
_DAY = r"(\d{4})(?:([-/. ])(\d{1,2})\2(\d{1,2})|(\d{2})(\d{2}))"
_TIME = r"[T ](?:(\d{2})(\d{2})(?:(\d{2})(?:\.\d+)?)?|(\d{1,2})(?::(\d{1,2})(?::(\d{1,2})(?:\.\d+)?)?)?)"
_LOCAL = rf"\A{_DAY}(?:{_TIME} ?Z?)?\z"
_SHIFTED = rf"\A{_DAY}{_TIME} ?([+-])(?:(\d{{2}})(?::?(\d{{2}}))?|(\d)(?::(\d{{2}}))?)\z"
_CLOCK = "$1-$3$5-$4$6 0$7$10:0$8$11:0$9$12"  # a part that is missing reads 0, others have a 0 too many
_OTHER_SHAPE = r"(?s)\A(?!\d{4}(-\d{1,2}(-\d{1,2}([T ]\d.*)?)?)?\z).*\z"


def strip(c: Column) -> Column:
    """Drop leading and trailing whitespace of any kind (tabs and no-break spaces too).

    Cells that begin and end with a printable ASCII character pass as they are, which
    spares most of them the slower search through the whitespace set.  The two characters
    are looked at without a pattern, which would make a Java text of every cell first.
    """
    printable = lambda edge: F.ascii(edge).between(ord("!"), ord("~"))
    clean = printable(c) & printable(F.substring(c, -1, 1))
    return F.when(clean, c).otherwise(F.btrim(c, F.lit(_SPACES)))


def finite_number(c: Column) -> Column:
    """Text to double; anything unreadable or not finite becomes null.

    The shape is tested first because a plain cast also reads ``1d`` and hex floats.
    """
    number = F.when(c.rlike(_NUMBER), c).try_cast("double")
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def iso_date(c: Column) -> Column:
    """Text to the UTC calendar date of an ISO-8601 instant; unreadable text becomes null.

    A timestamp with an offset moves to UTC first, so a late evening west of
    Greenwich lands on the next day.  Needs a UTC session.  Dates, months and years take
    a cast, the common shapes of dates and times one anchored pattern; only what has
    another shape goes through the rewrites.
    """
    day = (
        F.when(c.rlike(_PLAIN_DATE), c.try_cast("date"))
        .when(c.rlike(_LOCAL), _clock_date(c, _LOCAL, _CLOCK))
        .when(c.rlike(_SHIFTED), _clock_date(c, _SHIFTED, _CLOCK + "$13$14$16:0$15$17"))
        .otherwise(_instant_date(c))
    )
    earliest, latest = (F.lit(bound).cast("date") for bound in (FIRST_PERIOD, LAST_PERIOD))
    return F.when(day.between(earliest, latest), day)


def _clock_date(c: Column, pattern: str, replacement: str) -> Column:
    """The UTC date of a text of this pattern, spelled the way a cast reads it."""
    spelled = F.regexp_replace(F.regexp_replace(c, pattern, replacement), r"([ :])0(?=\d\d)", "$1")
    return F.to_date(spelled.try_cast("timestamp"))


def _instant_date(c: Column) -> Column:
    clock = r"[T ][\d:.]{1,20}"
    rewrites = [
        # Dates: other separators, none at all, and year with month.
        (r"\A(\d{4})([/. ])(\d{1,2})\2(\d{1,2})(?=\z|[T ])", "$1-$3-$4"),
        (r"\A(\d{4})[/. ](\d{1,2})\z", "$1-$2"),
        (r"\A(\d{4})(\d{2})(\d{2})(?=\z|[T ])", "$1-$2-$3"),
        # Times without colons.
        (r"(?<=\d)([T ]\d{2})(\d{2})(\d{2})(?=\z|[Z. +-])", "$1:$2:$3"),
        (r"(?<=\d)([T ]\d{2})(\d{2})(?=\z|[Z +-])", "$1:$2"),
        # Offsets: a space before them, one digit, no colon, hours only.
        (rf"(?<={clock}) (?=[+-]\d|Z)", ""),
        (rf"(?<={clock}[+-])(\d)\z", "0$1"),
        (rf"(?<={clock}[+-]\d\d)(\d\d)\z", ":$1"),
        (rf"(?<={clock}[+-]\d\d)\z", ":00"),
        # Minutes and seconds that are left out.
        (r"(?<=\d)([T ]\d{1,2})(?=\z|[Z+-])", "$1:00"),
        (r"(?<=\d)([T ]\d{1,2}:\d{1,2})(?=\z|[Z+-])", "$1:00"),
    ]
    text = c
    for pattern, replacement in rewrites:
        text = F.regexp_replace(text, pattern, replacement)
    # Anything of another shape is replaced by a text no cast accepts.
    return F.to_date(F.regexp_replace(text, _OTHER_SHAPE, "-").try_cast("timestamp"))
