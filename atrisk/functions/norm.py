"""Text keys, numbers and coordinates of landed registries as columns, without Python workers."""

from __future__ import annotations

import functools
import math
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal forms and words that tell nothing about a name, and texts for no number.
LEGAL = ["sa", "sl", "slu", "sau", "scp", "sccl", "cb", "sc", "fundacio", "fundacion", "foundation", "assoc", "associacio", "asociacion"]
NOISE = ["de", "del", "la", "el", "les", "los", "las", "i", "y", "d", "l", "en"]
NO_NUMBER = ["na", "n/a", "-", "null", "none"]
# The ellipsoid of the European datum, the scale and false easting of its zones.
SEMI_MAJOR, FLATTENING, SCALE, FALSE_EASTING = 6378137.0, 1 / 298.257222101, 0.9996, 500_000.0


@functools.cache
def _plain_letters() -> tuple[str, str, dict[str, str]]:
    """From Unicode's own decompositions: letters with one plain form and these forms, the
    marks to be deleted being at the end; and what decomposes into several characters,
    without Hangul, whose syllables stay whole on either side of a comparison."""
    one, several, marks = {}, {}, []
    for code in (*range(0x80, 0xAC00), *range(0xF900, 0xFFFE)):
        c = chr(code)
        if unicodedata.combining(c):
            marks.append(c)
            continue
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != c:
            one[c] = plain
        elif len(plain) > 1 and code < 0x2200 or 0xFB00 <= code < 0xFB07:
            several[c] = plain
    return "".join(one) + "".join(marks), "".join(one.values()), several


def unaccented(text: Column) -> Column:
    """Compatibility forms without combining marks; ASCII texts pass as they are."""
    letters, plain, several = _plain_letters()
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in several.items()))
    spelt = F.aggregate(pairs, text, lambda t, p: F.replace(t, p["a"], p["b"]))
    wide = F.when(text.rlike("[" + "".join(several) + "]"), spelt).otherwise(text)
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(wide, letters, plain)).otherwise(text)


def folded(text: Column) -> Column:
    """Lower case without accents; letters of every script, digits and underscores stay, a middle
    dot joins what it parts, and whatever else becomes one space."""
    joined = F.regexp_replace(unaccented(text), "·", "")
    return F.trim(F.regexp_replace(F.lower(joined), r"[^\p{L}\p{N}_]+", " "))


def name_key(name: Column) -> Column:
    """A name's telling words, folded and sorted; empty where there is none."""
    words = F.filter(F.split(folded(F.coalesce(name, F.lit(""))), " "), lambda w: (F.length(w) > 1) & ~w.isin(LEGAL + NOISE))
    return F.array_join(F.array_sort(words), " ")


def clean_text(text: Column) -> Column:
    """One blank for white space, none at the ends; null for what is then empty."""
    return F.nullif(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit(""))


def title_case(text: Column) -> Column:
    """Cased as a name where a registry writes all in capitals, with words of up to three
    letters, often acronyms, as they are; names in mixed case don't change."""
    clean = clean_text(text)
    one = lambda w: F.when(F.length(w) <= 3, w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w)))))
    loud = (clean == F.upper(clean)) & (clean != F.lower(clean)) & (F.length(clean) > 4)
    return F.when(loud, F.array_join(F.transform(F.split(clean, " "), one), " ")).otherwise(clean)


def decimal(text: Column) -> Column:
    """A number from text: of point and comma the last one is the decimal sign, a comma alone
    is one too; units and blanks are left out. Null for what is no number."""
    raw = F.trim(text)
    bare = F.regexp_replace(raw, r"[^0-9,.\-+eE]", "")
    comma, point = F.instr(F.reverse(bare), ","), F.instr(F.reverse(bare), ".")
    both = F.when(comma < point, F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(bare, F.lit(","), F.lit("")))
    plain = F.when((comma > 0) & (point > 0), both).otherwise(F.replace(bare, F.lit(","), F.lit(".")))
    return F.when(~F.lower(raw).isin(NO_NUMBER) & plain.rlike("[0-9]"), plain.try_cast("double"))


def dms(text: Column) -> Column:
    """Degrees from text such as 41° 23' 15.5" N, of which minutes, seconds and the hemisphere
    may be left out, or from a plain number; south and west are negative."""
    figure = r"([0-9]+(?:[.,][0-9]+)?)\s*"
    form = rf"(?i)^\s*(-?){figure}[º°d]\s*(?:{figure}['′m]\s*)?(?:{figure}(?:''|[\"″s])\s*)?([NSEWO])?\s*$"
    found = F.split(F.regexp_replace(text, form, "$1\x01$2\x01$3\x01$4\x01$5"), "\x01")  # one match for all groups

    def degrees(groups: Column) -> Column:
        part = lambda i: F.coalesce(F.replace(F.get(groups, F.lit(i - 1)), F.lit(","), F.lit(".")).try_cast("double"), F.lit(0.0))
        below = (F.get(groups, F.lit(0)) == "-") | F.upper(F.get(groups, F.lit(4))).isin("S", "W", "O")
        total = part(2) + part(3) / 60.0 + part(4) / 3600.0
        return F.when(below, -total).otherwise(total)

    return F.when(text.rlike(form), let(found, degrees)).otherwise(F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("double"))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def utm(easting: Column, northing: Column, zone: int = 31, *, north: bool = True) -> Column:
    """``lon, lat`` of transverse Mercator coordinates, by the inverse series in the
    third flattening up to its fourth power (below a millimetre within a zone)."""
    n = FLATTENING / (2 - FLATTENING)
    radius = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64) * SCALE
    plane = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    sphere = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]
    start = F.struct(((northing if north else northing - 10_000_000.0) / radius).alias("up"), ((easting - FALSE_EASTING) / radius).alias("across"))

    def turned(s: Column) -> Column:
        up, across = s["up"], s["across"]
        xi = up - sum(F.sin(up * (2 * j)) * F.cosh(across * (2 * j)) * c for j, c in enumerate(plane, 1))
        eta = across - sum(F.cos(up * (2 * j)) * F.sinh(across * (2 * j)) * c for j, c in enumerate(plane, 1))
        return let(F.struct(xi.alias("xi"), eta.alias("eta")), placed)

    def placed(t: Column) -> Column:
        lon = F.atan2(F.sinh(t["eta"]), F.cos(t["xi"])) + math.radians((zone - 1) * 6 - 177)
        lat = let(F.asin(F.sin(t["xi"]) / F.cosh(t["eta"])), lambda chi: chi + sum(F.sin(chi * (2 * j)) * c for j, c in enumerate(sphere, 1)))
        return F.struct(F.degrees(lon).alias("lon"), F.degrees(lat).alias("lat"))

    return let(start, turned)


def coordinates(lon: Column, lat: Column, easting: Column, northing: Column, zone: int = 31) -> Column:
    """``lon, lat`` from texts: degrees where both read and are a place on Earth other than
    0, 0, else from the plane coordinates, else null."""
    read = F.struct(dms(lon).alias("x"), dms(lat).alias("y"), decimal(easting).alias("e"), decimal(northing).alias("n"))

    def pick(r: Column) -> Column:
        given = F.struct(r["x"].alias("lon"), r["y"].alias("lat"))
        on_plane = r["e"].between(100_000, 900_000) & r["n"].between(0, 10_000_000)
        return F.when(valid(r["x"], r["y"]), given).when(on_plane, utm(r["e"], r["n"], zone))

    return let(read, pick)


def valid(lon: Column, lat: Column) -> Column:
    """Whether a pair is a place on Earth: numbers within range and not the point 0, 0."""
    inside = lon.between(-180, 180) & lat.between(-90, 90) & ~F.isnan(lon) & ~F.isnan(lat)
    return F.coalesce(inside & ~((F.abs(lon) < 1e-9) & (F.abs(lat) < 1e-9)), F.lit(False))
