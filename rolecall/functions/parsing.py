"""Parsing helpers of the readers: text out of HTML, dates, and regions out of place names."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of a title that mean an internship, and patterns and words that place a location in a region, in order.
INTERN_TITLE = r"(?i)\b(intern|internship|trainee|apprentice|summer\s+analyst|co-?op)\b"
INTERN_TITLE_PLURAL = r"(?i)\b(intern|interns|internship|co-?op|apprentice|trainee|summer\s+analyst)\b"
US_STATES = "al|ak|az|ar|ca|co|ct|de|fl|ga|hi|id|il|in|ia|ks|ky|la|me|md|ma|mi|mn|ms|mo|mt|ne|nv|nh|nj|nm|ny|nc|nd|oh|ok|or|pa|ri|sc|sd|tn|tx|ut|vt|va|wa|wv|wi|wy|dc"
REGION_PATTERNS = (
    ("india", r"(?i)\b(india|ind|bengaluru|bangalore|hyderabad|pune|chennai|mumbai|new\s+delhi|delhi|gurgaon|gurugram|noida|kolkata|ahmedabad|coimbatore|kochi|jaipur)\b"),
    ("worldwide", r"(?i)\b(worldwide|anywhere|global)\b"),
    ("us", rf"(?i)\b(united\s+states|usa|u\.s\.|[a-z .'-]+,\s*(?:{US_STATES}))\b|\b(new\s+york|nyc|sf|san\s+francisco|seattle|austin|boston|chicago|new\s+mexico|california|texas)\b"),
    ("europe", r"(?i)\b(united\s+kingdom|uk|london|ireland|dublin|germany|berlin|munich|france|paris|netherlands|amsterdam|spain|madrid|barcelona|poland|warsaw|portugal|lisbon|sweden|stockholm|switzerland|zurich|italy|milan|romania|bucharest|czech|prague|europe)\b"),
    ("apac", r"(?i)\b(singapore|japan|tokyo|australia|sydney|melbourne|korea|seoul|china|shanghai|taiwan|vietnam|philippines|malaysia|indonesia)\b"),
    ("canada", r"(?i)\b(canada|toronto|vancouver|montreal|ottawa|waterloo)\b"),
    ("latam", r"(?i)\b(brazil|(?<!new\s)mexico|argentina|colombia|chile|latam)\b"),
)
#: References of nearly all markup, replaced before the others are looked up in the whole table of HTML 5, which Python brings. None gives an ampersand.
_COMMON = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": "\u00a0"}
#: Names that count without a semicolon too, longest first, as the longest wins.
_BARE = "^(" + "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))) + ")"
#: Numbers that mean a sign of Windows-1252, where it has one.
_WINDOWS = {str(c): bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(0x80, 0xA0)}

#: Of a day; and the seconds before and after 1970 that a time can hold.
_DAY_MICROS, _MOST_SECONDS = 86_400_000_000, 9_223_372_036_854

REGIONS = "array<string>"


def text(c: Column) -> Column:
    """Empty counts as absent."""
    return F.nullif(c, F.lit(""))


def _table(entries: dict[str, str]) -> Column:
    """A map of fixed text, as one literal."""
    return F.from_json(F.lit(json.dumps(entries)), "map<string,string>")


def _numbered(reference: Column) -> Column:
    """The character of ``#8217;`` or ``#x2019;``; U+FFFD for one that can't be, nothing for a control character."""
    digits = F.regexp_extract(reference, "^#[xX]?0*([0-9A-Fa-f]*)", 1)
    code = F.when(digits == "", 0).when(F.length(digits) > 8, 1 << 21).when(reference.rlike("^#[xX]"), F.conv(digits, 16, 10).cast("bigint")).otherwise(digits.try_cast("bigint"))
    small = F.least(code, F.lit(1 << 21)).cast("int")
    none = small.between(1, 8) | (small == 11) | small.between(14, 31) | (small == 127) | small.between(0xFDD0, 0xFDEF) | (small.bitwiseAND(0xFFFE) == 0xFFFE)
    return (
        F.when((small == 0) | small.between(0xD800, 0xDFFF) | (small > 0x10FFFF), "\ufffd").when(small.between(0x80, 0x9F), F.element_at(_table(_WINDOWS), small.cast("string")))
        .when(none, "").otherwise(F.decode(F.unhex(F.lpad(F.hex(small), 8, "0")), "UTF-32"))
    )


def _resolved(piece: Column) -> Column:
    """What follows an ampersand, with the reference at its start resolved if there is one."""
    number, name, bare = (F.regexp_extract(piece, pattern, 0) for pattern in (r"^#([xX][0-9A-Fa-f]+|[0-9]+);?", "^[A-Za-z][A-Za-z0-9]{0,30};", _BARE))
    rest = lambda start: F.substr(piece, F.length(start) + 1)
    sign = F.try_element_at(_table(html5), name)
    return (
        F.when(number != "", F.concat(_numbered(number), rest(number))).when(name == "amp;", F.concat(F.lit("&"), rest(name))).when((name != "") & sign.isNotNull(), F.concat(sign, rest(name)))
        .when(bare != "", F.concat(F.element_at(_table(html5), bare), rest(bare))).otherwise(F.concat(F.lit("&"), piece))
    )


def unescape(html: Column) -> Column:
    """Resolves the character references of HTML 5, one level at a time: by number, by name, and the old names without a semicolon."""
    def common(h: Column) -> Column:
        for reference, sign in _COMMON.items():
            h = F.replace(h, F.lit(reference), F.lit(sign))
        return h

    def rest(h: Column) -> Column:
        pieces = F.split(h, "&")
        return (
            F.when(~h.contains("&"), h).when(~h.rlike("&(?!amp;)"), F.replace(h, F.lit("&amp;"), F.lit("&")))
            .otherwise(F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), _resolved), "")))
        )

    return _once(html, lambda h: F.when(~h.contains("&"), h).otherwise(_once(common(h), rest)))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: a lambda's argument is a variable."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def html_to_text(html: Column, escaped: bool = True, by: str = "\n") -> Column:
    """The text between tags, trimmed and joined ``by`` something; null if there is none. Scripts and styles are left out; a ``<`` that begins no tag is text. ``escaped``: the markup itself may be escaped."""
    plain = F.regexp_replace(unescape(html) if escaped else html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "<!>")
    parts = F.transform(F.split(plain, r"(?s)<[A-Za-z/!?][^>]*>"), lambda x: F.regexp_replace(unescape(x), r"^[\s\u00a0]+|[\s\u00a0]+$", ""))
    return text(F.regexp_replace(F.array_join(F.filter(parts, lambda x: x != ""), by), r"\n{3,}", "\n\n"))


def utc(instant: Column) -> Column:
    """An instant as the time in UTC, whatever zone the session has."""
    micros = F.unix_micros(instant)
    rest = (F.pmod(micros, F.lit(_DAY_MICROS)).cast("decimal(11,0)") * F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(18,6)")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=F.floor(micros / F.lit(_DAY_MICROS)).cast("int"), secs=rest)


def parse_iso(value: Column) -> Column:
    """An ISO 8601 date or time, as UTC without a zone; one that names no zone is in UTC. Null if it isn't one."""
    zoned = value.rlike(r"(?i)[T ]\d{1,2}:.*(Z|UTC|GMT|[+-]\d{1,2}(:?\d{2})?)\s*$")
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}"), F.when(zoned, utc(value.try_cast("timestamp"))).otherwise(value.try_cast("timestamp_ntz")))


def moment(value: Column, a_second: int = 1) -> Column:
    """A count of seconds since 1970, or of so many parts of one, as a time; null beyond the times that there are."""
    most = _MOST_SECONDS * a_second
    whole = value.cast("bigint")
    return F.when(whole.between(-most, most), utc(F.timestamp_micros(whole * F.lit(1_000_000 // a_second))))


def seconds(value: Column) -> Column:
    """Seconds since 1970 as a time; 0 counts as absent."""
    return F.when(value != 0, moment(value))


def regions_of(*found: tuple[str, Column]) -> Column:
    """The regions whose condition holds, each once, in order; ``unknown`` if none does."""
    none = F.array().cast(REGIONS)
    parts = [F.when(F.coalesce(holds, F.lit(False)), F.array(F.lit(region))).otherwise(none) for region, holds in found]
    return or_unknown(F.array_distinct(F.concat(*parts)))


def or_unknown(regions: Column) -> Column:
    return F.when(F.size(regions) == 0, F.array(F.lit("unknown"))).otherwise(regions)


def regions_from_text(place: Column) -> Column:
    """Regions by whole words of a place name; ``unknown`` if there are none."""
    return regions_of(*((region, place.rlike(pattern)) for region, pattern in REGION_PATTERNS))


def regions_by_words(place: Column, words: tuple[tuple[str, str], ...]) -> Column:
    """Regions by parts of a place name, as ordered pairs of part and region."""
    low = F.lower(place)
    return regions_of(*((region, low.contains(part)) for part, region in words))


def with_india(regions: Column, known: Column, alone: bool) -> Column:
    """Puts ``india`` in front where the source says so in a field; ``alone`` in place of the others."""
    india = F.array(F.lit("india"))
    return F.when(F.coalesce(known, F.lit(False)) & ~F.array_contains(regions, "india"), india if alone else F.concat(india, F.filter(regions, lambda r: r != "unknown"))).otherwise(regions)
