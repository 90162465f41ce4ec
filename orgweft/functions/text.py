"""String, date and JSON column functions. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date formats accepted in ticket and workspace exports, tried in order.
TICKET_DATE_FORMATS = (
    "d/MMM/yy h:mm a",
    "d/MMM/yy H:mm",
    "d/MMM/yyyy h:mm a",
    "d/MMM/yyyy H:mm",
    "yyyy-M-d H:mm",
    "yyyy-M-d",
)
WORKSPACE_DATE_FORMATS = ("yyyy-M-d'T'H:m:s", "yyyy-M-d H:m:s", "yyyy-M-d")
_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?([+-]\d{2}:?\d{2})?)?$"


def blank_to_null(value: Column) -> Column:
    """Trimmed text, or null when nothing is left."""
    return F.nullif(F.trim(_spaces(value)), F.lit(""))


def _spaces(value: Column) -> Column:
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def key_suffix(key: Column) -> Column:
    """The part of a canonical key after its first colon."""
    return F.regexp_replace(key, r"^[^:]*:", "")


def bare_module(key: Column) -> Column:
    return F.regexp_replace(key, r"^module:", "")


def edge_key(rel_type: Column | str, source: Column, target: Column, tail: Column) -> Column:
    rel = F.lit(rel_type) if isinstance(rel_type, str) else rel_type
    return F.concat_ws(":", F.lower(rel), key_suffix(source), key_suffix(target), tail)


def clean_list(values: Column) -> Column:
    """Trimmed, distinct, sorted strings; an absent list is an empty one."""
    trimmed = F.transform(F.coalesce(values, F.array().cast("array<string>")), _spaces)
    return F.array_sort(F.array_distinct(F.filter(trimmed, lambda x: F.length(x) > 0)))


def normalize_source_id(value: Column) -> Column:
    """Case-folded id without ``mailto:``, angle brackets or an ``.invalid`` tail."""
    plain = F.regexp_replace(_spaces(value), r"^mailto:", "")
    plain = F.lower(_spaces(F.regexp_replace(plain, r"^[<>]+|[<>]+$", "")))
    return F.regexp_replace(plain, r"\.invalid$", "")


def slug(value: Column) -> Column:
    """Lower-case name with every run of other characters turned into one dash."""
    dashed = F.regexp_replace(F.lower(value), r"[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, r"^-+|-+$", "")


def handle_stem(source_id: Column) -> Column:
    """Readable start of an unresolved handle: the local part, at most 24 characters."""
    local = F.when(F.contains(source_id, F.lit("@")), F.substring_index(source_id, "@", 1))
    dashed = F.regexp_replace(F.lower(F.coalesce(local, source_id)), r"[^a-z0-9._-]+", "-")
    stem = F.substring(F.regexp_replace(dashed, r"^-+|-+$", ""), 1, 24)
    return F.coalesce(F.nullif(stem, F.lit("")), F.lit("id"))


def lookup_text(value: Column) -> Column:
    """Text as compared by the question matcher."""
    return F.trim(F.regexp_replace(F.lower(value), r"[^a-z0-9]+", " "))


def mentions(text: Column) -> Column:
    """Distinct sorted ids written as ``<@id>`` or ``<@id|label>``."""
    parts = F.filter(F.split(text, "<@"), lambda _part, position: position > 0)
    ids = F.transform(
        parts, lambda part: F.substring_index(F.substring_index(part, ">", 1), "|", 1)
    )
    return F.array_sort(F.array_distinct(F.filter(ids, lambda x: F.length(x) > 0)))


def trailer_dependencies(body: Column) -> Column:
    """Module keys listed in ``Depends-On:`` lines, distinct and sorted."""
    lines = F.transform(F.split(body, r"\r\n|[\n\r]"), _spaces)
    listed = F.filter(lines, lambda line: F.startswith(line, F.lit("Depends-On:")))
    items = F.flatten(
        F.transform(listed, lambda line: F.split(F.substr(line, F.lit(len("Depends-On:") + 1)), ","))
    )
    return clean_list(F.transform(items, lambda item: bare_module(_spaces(item))))


def iso_epoch(text: Column) -> Column:
    """Epoch seconds of an ISO date or date-time; without a zone it is UTC."""
    plain = F.regexp_replace(_spaces(text), "Z", "+00:00")
    zoned = F.regexp_replace(plain, r"([+-]\d{2})(\d{2})$", "$1:$2")
    zoned = F.when(plain.rlike(r":\d{2}.*[+-]\d{4}$"), zoned).otherwise(plain)
    return F.when(plain.rlike(_ISO), _seconds(F.try_to_timestamp(zoned)))


def ticket_epoch(text: Column) -> Column:
    plain = _spaces(text)
    parsed = []
    for fmt in TICKET_DATE_FORMATS:
        stamp = F.try_to_timestamp(plain, F.lit(fmt))
        if "/yy " in fmt:
            # Two-digit years from 69 on belong to the last century.
            last_century = stamp - F.make_interval(years=F.lit(100))
            stamp = F.when(F.year(stamp) >= 2069, last_century).otherwise(stamp)
        parsed.append(_seconds(stamp))
    return F.coalesce(iso_epoch(plain), *parsed)


def workspace_epoch(text: Column) -> Column:
    plain = _spaces(text)
    return F.coalesce(
        *[_seconds(F.try_to_timestamp(plain, F.lit(fmt))) for fmt in WORKSPACE_DATE_FORMATS]
    )


def _seconds(stamp: Column) -> Column:
    return F.floor(F.unix_micros(stamp) / F.lit(1_000_000)).cast("bigint")


def percent_quote(value: Column) -> Column:
    """Percent-encoding with no safe characters besides letters, digits and ``_.-~``."""
    encoded = F.replace(F.url_encode(value), F.lit("+"), F.lit("%20"))
    encoded = F.replace(encoded, F.lit("*"), F.lit("%2A"))
    return F.replace(encoded, F.lit("%7E"), F.lit("~"))


# Control characters whose JSON escape has a letter in it, written lower case.
_LETTER_ESCAPES = (0x0B, 0x0E, 0x0F, 0x1A, 0x1B, 0x1C, 0x1D, 0x1E, 0x1F)


def json_text(value: Column) -> Column:
    """A JSON string literal with raw UTF-8 and lower-case control escapes, or ``null``.

    Spark writes these escapes in upper case, so the characters travel through the
    encoder as Unicode noncharacters and are written out afterwards.
    """
    stand_ins = "".join(chr(0xFDD0 + place) for place in range(len(_LETTER_ESCAPES)))
    marked = F.translate(value, "".join(map(chr, _LETTER_ESCAPES)), stand_ins)
    rare = _quoted(marked)
    for stand_in, code in zip(stand_ins, _LETTER_ESCAPES, strict=True):
        rare = F.replace(rare, F.lit(stand_in), F.lit(f"\\u{code:04x}"))
    literal = F.when(value.rlike(r"[\x0b\x0e\x0f\x1a-\x1f]"), rare).otherwise(_quoted(value))
    return F.when(value.isNull(), F.lit("null")).otherwise(literal)


def _quoted(value: Column) -> Column:
    array_text = F.to_json(F.array(value))
    return F.substr(array_text, F.lit(2), F.length(array_text) - 2)


def json_array(values: Column) -> Column:
    items = F.transform(values, json_text)
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def json_object(**members: Column) -> Column:
    """JSON object text with sorted keys and no spaces; each value is already JSON text."""
    parts: list[Column] = []
    for position, name in enumerate(sorted(members)):
        lead = ("{" if position == 0 else ",") + f'"{name}":'
        parts += [F.lit(lead), members[name]]
    return F.concat(*parts, F.lit("}"))


def half_even(value: Column) -> Column:
    """Nearest integer, ties to even."""
    return F.rint(value).cast("bigint")


def title_case(value: Column) -> Column:
    """Upper-case the first letter of every word, leaving the rest as it is."""
    words = F.split(value, " ")
    return F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))),
        " ",
    )


def capitalize(value: Column) -> Column:
    return F.concat(F.upper(F.substring(value, 1, 1)), F.lower(F.substr(value, F.lit(2))))
