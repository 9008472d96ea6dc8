"""Column expressions: formats, brands, channels, calendar parts, change types, clamps."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Can formats, and the two-digit codes that stand for them inside a sku code.
FORMATS = ("1/3", "1/2", "2/5")
FORMAT_CODES = {"13": "1/3", "12": "1/2", "25": "2/5"}

# Month names used as chart labels, January first.
MONTH_LABELS = ("Ene", "Feb", "Mar", "Abr", "May", "Jun", "Jul", "Ago", "Sep", "Oct", "Nov", "Dic")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def format_state(container: Column | str) -> Column:
    """Can format named anywhere in the container text; NULL when none is."""
    text = F.upper(_col(container))
    return F.coalesce(*[F.when(text.contains(f), F.lit(f)) for f in FORMATS])


def format_extract(container: Column | str) -> Column:
    """First `digits/digits` in the text, 'OTRO' when there is none, NULL for NULL or empty."""
    c = _col(container)
    hit = F.regexp_extract(c, r"(\d+/\d+)", 1)
    return F.when(c.isNull() | (c == ""), None).when(hit == "", "OTRO").otherwise(hit)


def format_from_code(sku: Column | str) -> Column:
    """Format digits within the first six characters of a sku code, not touching other digits."""
    head = F.substring(F.upper(_col(sku)), 1, 6)
    code = F.regexp_extract(head, "(?<![0-9])(13|12|25)(?![0-9])", 1)
    return lookup(code, FORMAT_CODES)


def brand_from_code(sku: Column | str) -> Column:
    """Two leading letters of a sku code, upper case; NULL when it starts otherwise."""
    return F.nullif(F.upper(F.regexp_extract(_col(sku), "(?i)^([A-Z]{2})", 1)), F.lit(""))


def clean_channel(channel: Column | str) -> Column:
    """Channel without its 'Canal distrib.' prefix; NULL when nothing is left."""
    body = F.regexp_replace(_col(channel), r"(?i)^Canal\s*distrib\.?\s*", "")
    return F.nullif(F.trim(body), F.lit(""))


def lookup(key: Column | str, mapping: Mapping[str, object], default: object = None) -> Column:
    """Value of a small literal mapping."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    found = F.element_at(F.create_map(*pairs), _col(key))
    return found if default is None else F.coalesce(found, F.lit(default))


def yes_flag(c: Column | str, yes: str = "SI") -> Column:
    return F.upper(_col(c)) == F.lit(yes)


def over_threshold(c: Column | str, threshold: float) -> Column:
    return _col(c) > F.lit(threshold)


def count_flag(c: Column | str) -> Column:
    """True when the value reads as a number above zero."""
    return F.coalesce(_col(c).try_cast("double"), F.lit(0.0)) > 0


def round_to_int(c: Column | str) -> Column:
    """Half-even rounding cast; Spark's own cast truncates."""
    return F.rint(_col(c)).cast("int")


def changeover_hours(stop: Column | str, *excluded: Column | str) -> Column:
    """Stop hours left after the excluded parts, never negative, NULL read as zero."""
    left = F.coalesce(_col(stop), F.lit(0.0))
    for e in excluded:
        left = left - F.coalesce(_col(e), F.lit(0.0))
    return F.greatest(left, F.lit(0.0))


def calendar_parts(ts: Column | str) -> dict[str, Column]:
    """Year, month, ISO week, ISO weekday (1 = Monday) as longs."""
    c = _col(ts)
    return {
        "anyo": F.year(c).cast("long"),
        "mes": F.month(c).cast("long"),
        "semana": F.weekofyear(c).cast("long"),
        "dia_semana": (F.weekday(c) + 1).cast("long"),
    }


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch, for frames with bounds in mixed units."""
    return F.unix_micros(_col(ts).cast("timestamp"))


HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US


def hours_between(later: Column | str, earlier: Column | str) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(float(HOUR_US))


def first_match(cases: Iterable[tuple[Column, object]], default: object = None) -> Column:
    """Ordered CASE: the first true condition wins; NULL conditions do not match."""
    out = None
    for cond, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out if default is None else out.otherwise(F.lit(default))


def calls_bucket(c: Column | str) -> Column:
    """Maintenance calls as '0', '1-2', '3-5', '6+'; anything between the ranges falls to '6+'."""
    n = _col(c)
    return first_match(
        [(n.isNull() | (n == 0), "0"), (n.between(1, 2), "1-2"), (n.between(3, 5), "3-5")], "6+"
    )


def cip_bucket(c: Column | str) -> Column:
    h = _col(c)
    return first_match(
        [(h.isNull() | (h == 0), "cip_0"), (h < 0.5, "cip_lt_30min"), (h < 1.5, "cip_30_90min")],
        "cip_gt_90min",
    )


def run_length_bucket(c: Column | str) -> Column:
    """Run length with shared borders: the first range that fits wins, NULL goes to '24h+'."""
    h = _col(c)
    return first_match(
        [
            (h < 2, "< 2h"),
            (h.between(2, 5), "2-5h"),
            (h.between(5, 10), "5-10h"),
            (h.between(10, 24), "10-24h"),
        ],
        "24h+",
    )


def clamp(c: Column | str, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _col(c)))


def same_as(a: Column | str, b: Column | str) -> Column:
    """Equality that is false, never NULL, when a side is missing."""
    return F.coalesce(_col(a) == _col(b), F.lit(False))


# Order in which a changed attribute names the change type.
CHANGE_PRIORITY = (
    ("estado_volumen", "VOLUMEN"),
    ("marca", "MARCA"),
    ("familia", "FAMILIA"),
    ("packaging_primario", "PRIMARIO"),
    ("packaging_secundario", "SECUNDARIO"),
    ("palet", "PALET"),
)


def change_type(flags: Sequence[tuple[Column, str]]) -> Column:
    """Name of the first true flag; NULL when none is."""
    return first_match(flags)


def confidence_level(n: Column | str) -> Column:
    """Amount of history behind an estimate: 10 or more, 3 or more, fewer."""
    c = F.coalesce(_col(n), F.lit(0))
    return first_match([(c >= 10, "high"), (c >= 3, "medium")], "low")


def time_grain(ts: Column | str, grain: str) -> Column:
    """Text key of the day, ISO week start or month holding the timestamp."""
    c = _col(ts)
    if grain == "day":
        return F.date_format(c, "yyyy-MM-dd")
    if grain == "week":
        return F.date_format(F.date_trunc("week", c), "yyyy-MM-dd")
    if grain == "month":
        return F.date_format(c, "yyyy-MM")
    raise ValueError(f"unknown grain {grain!r}")
