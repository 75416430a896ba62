"""References, labels, dates and validators as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .profile import LATIN, Profile
from .text import _col, js_round

# Accepted shapes and limits of submitted data.
CLIENT_ID = r"^[A-Za-z0-9_-]{8,64}$"
FEEDBACK_ID = r"^[A-Za-z0-9_-]{8,40}$"
DAY = r"^\d{4}-\d{2}-\d{2}$"
VOTES = ("up", "down")
REASONS = ("wrong-place", "wrong-move", "slow", "confusing", "other", "uncertain")
REQUEST_KINDS = ("aliyah", "verse", "today", "holidays")
MAX_PAYLOAD, MAX_LINES, MAX_LINE_CHARS, MAX_VISIBLE = 20_000, 80, 300, 200
MAX_TARGET, MAX_TEXT, MAX_COMMENT, MAX_NAME, MAX_MESSAGE = 200, 4000, 1000, 120, 300


def parse_ref(cv: Column | str, name: Column | str, books: dict[str, int]) -> Column:
    """struct(book, chapter, verse) from "c:v" and a book name; a missing number counts as 1, an unknown book is null."""
    parts = F.split(_col(cv), ":")
    number = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)).try_cast("int"), F.lit(1))
    pairs = [F.lit(x) for kv in books.items() for x in kv]
    return F.struct(
        F.try_element_at(F.create_map(*pairs), _col(name)).alias("book"), number(1).alias("chapter"), number(2).alias("verse")
    )


def verse_range_label(book: Column, c1: Column, v1: Column, c2: Column, v2: Column) -> Column:
    same_chapter = c1 == c2
    tail = (
        F.when(same_chapter & (v1 == v2), F.lit(""))
        .when(same_chapter, F.concat(F.lit("-"), v2))
        .otherwise(F.concat(F.lit("-"), c2, F.lit(":"), v2))
    )
    return F.concat(book, F.lit(" "), c1, F.lit(":"), v1, tail)


def list_label(items: Column, joiner: str = " and ") -> Column:
    """"a", "a and b", "a, b and c"."""
    n = F.size(items)
    head = F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(0))), ", ")
    return (
        F.when(n == 0, "").when(n == 1, F.element_at(items, 1)).otherwise(F.concat(head, F.lit(joiner), F.try_element_at(items, F.lit(-1))))
    )


def grouped_label(parts: Column, none: str = "none") -> Column:
    """Label of array<struct<parent, labels array<string>>>; the parent is named only if there are several."""
    one = lambda x: F.when(
        F.size(parts) > 1, F.concat(list_label(x["labels"]), F.lit(" of "), x["parent"])
    ).otherwise(list_label(x["labels"]))
    return F.when(F.size(parts) == 0, none).otherwise(F.array_join(F.transform(parts, one), "; "))


def range_link(base: Column, c1: Column, v1: Column, c2: Column, v2: Column) -> Column:
    """`base.c.v`, with `-v` for a range in one chapter and `-c.v` across chapters."""
    tail = (
        F.when((c1 == c2) & (v1 == v2), F.lit(""))
        .when(c1 == c2, F.concat(F.lit("-"), v2))
        .otherwise(F.concat(F.lit("-"), c2, F.lit("."), v2))
    )
    return F.concat(base, F.lit("."), c1, F.lit("."), v1, tail)


DAY_MICROS = 86_400_000_000


def local_day(ts: Column | str, tz: str = "UTC") -> Column:
    """Calendar day of an instant in `tz`, whatever the time zone of the session."""
    return F.date_from_unix_date(F.floor(F.unix_micros(F.from_utc_timestamp(_col(ts), tz)) / DAY_MICROS).cast("int"))


def day_start(day: Column | str, tz: str = "UTC") -> Column:
    """Instant at which a local day begins."""
    return F.to_utc_timestamp(F.timestamp_micros(F.unix_date(_col(day)).cast("bigint") * DAY_MICROS), tz)


def valid_day(c: Column | str) -> Column:
    """The date of a well-formed, existing YYYY-MM-DD, else null."""
    c = _col(c)
    return F.when(c.rlike(DAY), F.try_to_date(c, "yyyy-MM-dd"))


def valid_id(c: Column | str, pattern: str = CLIENT_ID) -> Column:
    c = _col(c)
    return F.when(c.rlike(pattern), c)


def one_of(c: Column | str, options: tuple[str, ...]) -> Column:
    c = _col(c)
    return F.when(c.isin(*options), c)


def in_range(c: Column | str, low, high) -> Column:
    c = _col(c)
    return F.coalesce((c >= low) & (c <= high), F.lit(False))


def _failing(rules: dict[str, Column]) -> Column:
    return F.filter(F.array(*[F.when(bad, name) for name, bad in rules.items()]), lambda x: x.isNotNull())


def reading_errors(lines: Column | str, p: Profile = LATIN) -> Column:
    """Names of the limits that an array of submitted line texts breaks."""
    lines = _col(lines)
    return _failing(
        {
            "too-many-lines": F.size(lines) > MAX_LINES,
            "long-line": F.exists(lines, lambda x: F.length(x) > MAX_LINE_CHARS),
            "bad-character": F.exists(lines, lambda x: ~x.rlike(f"^[{p.letters} ?]*$")),
        }
    )


def visible_lines(claimed: Column | str, lines: Column | str) -> Column:
    claimed = _col(claimed)
    ok = (claimed >= 0) & (claimed < MAX_VISIBLE)
    return F.when(ok, js_round(claimed)).otherwise(F.size(_col(lines))).cast("int")


def placement_errors(
    start: Column, end: Column, column: Column, first_line: Column, words: Column | int, columns: Column | int
) -> Column:
    """Names of the range rules that a submitted placement breaks."""
    words = words if isinstance(words, Column) else F.lit(words)
    return _failing(
        {
            "start": ~in_range(start, 0, words - 1),
            "end": ~in_range(end, start, words - 1),
            "column": column.isNotNull() & ~in_range(column, 1, columns),
            "first-line": first_line.isNotNull() & ~in_range(first_line, 1, 100),
        }
    )


def target_errors(word: Column, label: Column, book: Column, chapter: Column, verse: Column, words) -> Column:
    words = words if isinstance(words, Column) else F.lit(words)
    return _failing(
        {
            "word": ~in_range(word, 0, words - 1),
            "label": F.coalesce(F.length(label) > MAX_TARGET, F.lit(True)),
            "ref": ~(in_range(book, 1, 5) & in_range(chapter, 1, 200) & in_range(verse, 1, 200)),
        }
    )


def request_errors(kind: Column, year: Column, book: Column, chapter: Column, verse: Column, date: Column) -> Column:
    """Names of the rules that a target request breaks."""
    return _failing(
        {
            "kind": ~F.coalesce(kind.isin(*REQUEST_KINDS), F.lit(False)),
            "year": (kind == "holidays") & year.isNotNull() & ~in_range(year, 5000, 6500),
            "verse": (kind == "verse")
            & ~F.coalesce(in_range(book, 1, 5) & (chapter >= 1) & (verse >= 1), F.lit(False)),
            "date": (kind == "today") & date.isNotNull() & ~date.rlike(DAY),
        }
    )
