"""Dates and times of day inside free text, as Column expressions.

A scanner takes the first date-like piece and the first clock-like piece of a text, then reads their numbers, month
names, half of the day and zone. Nothing is tried pattern by pattern on the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .rows import let

# Month names and their short forms in English, German, French and Spanish.
MONTHS = {
    1: "january jan januar jän janvier janv enero ene",
    2: "february feb februar février févr fevrier febrero",
    3: "march mar märz mär mars marzo",
    4: "april apr avril avr abril abr",
    5: "may mai mayo",
    6: "june jun juni juin junio",
    7: "july jul juli juillet juil julio",
    8: "august aug août aout agosto ago",
    9: "september sep sept septembre septiembre",
    10: "october oct oktober okt octobre octubre",
    11: "november nov novembre noviembre",
    12: "december dec dezember dez décembre déc decembre diciembre dic",
}
# Number words and units of relative dates.
NUMBER_WORDS = {
    "a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11,
    "twelve": 12,
}
UNITS = "second minute hour day week month year"

NAME = "(?:" + "|".join(sorted((w for names in MONTHS.values() for w in names.split()), key=lambda w: (-len(w), w))) + r")(?!\p{L})"
BREAK = r"[\s,./-]"
OF = r"(?:\s*(?:of|de|del)\s+)?"
HOUR = r"\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?"
COMPACT_END = r"(?=t?\d{4}(?:\d{2})?(?!\d)|(?!\d))"
# each shape with the place of year, month and day among its groups
SHAPES = [
    (r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", 1, 2, 3),
    (r"((?:19|20)\d{2})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])" + COMPACT_END, 1, 2, 3),
    (rf"(\d{{4}}){BREAK}*({NAME})\.?{BREAK}*(\d{{1,2}})", 1, 2, 3),
    (rf"(\d{{1,2}})(?:st|nd|rd|th|er|º)?{OF}{BREAK}*({NAME})\.?{OF}{BREAK}*(\d{{4}}|\d{{2}}(?![\d:]))", 3, 2, 1),
    (rf"(?<!\p{{L}})({NAME})\.?{BREAK}*(\d{{1,2}})(?:st|nd|rd|th)?{BREAK}+(\d{{4}})", 3, 1, 2),
    (rf"(?<!\p{{L}})({NAME})\.?\s+(\d{{1,2}})\s+{HOUR}(?:\s+\p{{L}}{{3,4}})?\s+(\d{{4}})", 3, 1, 2),
    (rf"(?<!\p{{L}})({NAME})\.?{OF}{BREAK}*(\d{{4}})", 2, 1, None),
]
# numbers alone: the order of day and month is a matter of custom
NUMERIC = r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})"
EDGE = (r"(?<![\d])", r"(?!\d)")
CLOCK = r"(?<![\d:])(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,6})\d*)?)?(?![\d:])\s*(?:([ap])\.?m\b\.?)?\s*(z|utc|gmt|[+-]\d{2}:?\d{2})?(?![\d\p{L}])"
COMPACT_CLOCK = r"(?<=\dt|\d{8})(\d{2})(\d{2})(\d{2})?(?!\d)"
SHORT_CLOCK = r"(?<![\d:])(\d{1,2})\s*([ap])\.?m\b\.?"
# words that may stand beside a date when nothing else may
FILLER = r"(?:mon|tue|tues|wed|thu|thur|thurs|fri|sat|sun)(?:day|nesday|rsday|urday)?(?!\p{L})|\b(?:at|on|the|of|and|t|uhr|um)\b|[\s,.;()]+"


def _any_shape() -> str:
    return "|".join(f"{EDGE[0]}{s}{EDGE[1]}" for s in [x[0] for x in SHAPES] + [NUMERIC])


def _month_number(name: Column) -> Column:
    numbers = F.create_map(*[F.lit(x) for number, names in MONTHS.items() for w in names.split() for x in (w, number)])
    return F.coalesce(F.try_element_at(numbers, name), _int(name))


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _year(c: Column) -> Column:
    """Years of two digits belong to 1969 to 2068."""
    n = _int(c)
    return F.when(F.length(c) > 2, n).otherwise(F.when(n < 69, n + 2000).otherwise(n + 1900))


def scanned(c: Column, day_first: bool = False, whole: bool = False, now: Column | None = None) -> Column:
    """Timestamp of the first date inside a text with the first time of day there, null without a date.

    Dates of numbers only are read month first unless ``day_first`` or the first number exceeds 12. A month
    without a day is its first day. A time without a zone is one of the session's zone. With ``whole`` the
    text must hold nothing else but weekdays and small words. With ``now``, "two weeks ago", "in 3 days", "yesterday",
    "today" and "tomorrow" count from it.
    """

    def found(text: Column) -> Column:
        date = let(F.regexp_extract(text, _any_shape(), 0), lambda d: F.when(d != "", _date_parts(d, day_first)))
        out = F.when(text.rlike(r"\d"), let(F.struct(date.alias("date"), _clock_parts(text).alias("clock")), _moment))
        if whole:
            rest = F.regexp_replace(F.regexp_replace(text, f"{_any_shape()}|{CLOCK}|{SHORT_CLOCK}|{COMPACT_CLOCK}", " "), FILLER, "")
            out = F.when(rest == "", out)
        return out if now is None else F.coalesce(out, relative(text, now))

    return let(F.lower(c), found)


def _date_parts(date: Column, day_first: bool) -> Column:
    """``year, month, day`` of a date-like piece."""

    def parts(year: Column, month: Column, day: Column) -> Column:
        return F.struct(year.alias("year"), month.alias("month"), day.alias("day"))

    def numbers() -> Column:
        one, two, year = (F.regexp_extract(date, f"^{NUMERIC}$", i) for i in (1, 2, 3))
        swapped = (_int(two) <= 12) if day_first else (_int(one) > 12)
        return parts(_year(year), F.when(swapped, _int(two)).otherwise(_int(one)), F.when(swapped, _int(one)).otherwise(_int(two)))

    out = F.when(date.rlike(f"^{NUMERIC}$"), numbers())
    for shape, y, m, d in SHAPES:
        full = f"^{shape}$".replace(COMPACT_END, "")
        part = lambda i, full=full: F.regexp_extract(date, full, i)
        out = out.when(date.rlike(full), parts(_year(part(y)), _month_number(part(m)), F.lit(1) if d is None else _int(part(d))))
    return out


def _clock_parts(text: Column) -> Column:
    """``hour, minute, second, zone`` of the first time of day in a text; null fields without one."""

    def parts(hour: Column, minute: Column, second: Column, zone: Column) -> Column:
        return F.struct(hour.alias("hour"), minute.alias("minute"), second.cast("decimal(16,6)").alias("second"), zone.alias("zone"))

    def halved(hour: Column, half: Column) -> Column:
        return F.when((half == "p") & (hour < 12), hour + 12).when((half == "a") & (hour == 12), F.lit(0)).otherwise(hour)

    def long(clock: Column) -> Column:
        piece = lambda i: F.regexp_extract(clock, CLOCK, i)
        second = F.concat(piece(3), F.lit("."), piece(4), F.lit("0")).try_cast("decimal(16,6)")
        zone = F.when(piece(6).rlike("^[+-]"), F.regexp_replace(piece(6), r"^([+-]\d{2}):?(\d{2})$", "$1:$2")).when(piece(6) != "", "UTC")
        return parts(halved(_int(piece(1)), piece(5)), _int(piece(2)), second, zone)

    none, zero = F.lit(None), F.lit(0)
    short, packed = F.regexp_extract(text, SHORT_CLOCK, 0), lambda i: _int(F.regexp_extract(text, COMPACT_CLOCK, i))
    brief = lambda s: parts(halved(_int(F.regexp_extract(s, SHORT_CLOCK, 1)), F.regexp_extract(s, SHORT_CLOCK, 2)), zero, zero, none.cast("string"))
    last = F.when(text.rlike(COMPACT_CLOCK), parts(packed(1), packed(2), F.coalesce(packed(3), zero), none.cast("string")))
    return let(
        F.regexp_extract(text, CLOCK, 0), lambda clock: F.when(clock != "", long(clock)).otherwise(let(short, lambda s: F.when(s != "", brief(s)).otherwise(last)))
    )


def _moment(p: Column) -> Column:
    date, clock = p["date"], p["clock"]
    zero = F.lit(0)
    return F.try_make_timestamp(
        date["year"], date["month"], date["day"], F.coalesce(clock["hour"], zero), F.coalesce(clock["minute"], zero),
        F.coalesce(clock["second"], zero.cast("decimal(16,6)")), F.coalesce(clock["zone"], F.current_timezone()),
    )


def relative(text: Column, now: Column) -> Column:
    """``now`` moved by the first relative phrase of a lower-case text; null without one."""
    number = rf"(\d{{1,6}}|{'|'.join(sorted(NUMBER_WORDS, key=lambda w: (-len(w), w)))})\s+({'|'.join(UNITS.split())})s?"
    ago, ahead = rf"\b{number}\s+ago\b", rf"\bin\s+{number}\b"
    words = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    back, on = text.rlike(ago), text.rlike(ahead)
    count = F.when(back, F.regexp_extract(text, ago, 1)).when(on, F.regexp_extract(text, ahead, 1))
    unit = F.when(back, F.regexp_extract(text, ago, 2)).when(on, F.regexp_extract(text, ahead, 2))
    n = F.coalesce(F.try_element_at(words, count), _int(count)) * F.when(back, -1).otherwise(1)
    day = F.when(text.rlike(r"\byesterday\b"), -1).when(text.rlike(r"\btomorrow\b"), 1).when(text.rlike(r"\b(?:today|now)\b"), 0)
    n = F.coalesce(n, day)
    unit = F.when(back | on, unit).otherwise("day")
    of = lambda name: F.when(unit == name, n).otherwise(0)
    moved = F.try_add(
        now, F.make_interval(of("year"), of("month"), of("week"), of("day"), of("hour"), of("minute"), of("second").cast("decimal(18,6)"))
    )
    return F.when(n.isNotNull(), moved)
