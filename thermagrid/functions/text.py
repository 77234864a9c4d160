"""Text normalisation, slot extraction, tagging and rule classification."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import col, let


def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Compatibility folding to ASCII, derived from the whole Unicode database:
    one-to-one letters, and those that fold to several characters."""
    source, target, several = [], [], {}
    for code in (*range(0x80, 0xD800), *range(0xE000, sys.maxunicode + 1)):
        if not unicodedata.decomposition(chr(code)):
            continue
        folded = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(folded) == 1:
            source.append(chr(code))
            target.append(folded)
        elif len(folded) > 1:
            several[chr(code)] = folded
    return "".join(source), "".join(target), several


FOLD_FROM, FOLD_TO, FOLD_SEVERAL = _fold_tables()


def ascii_fold(text: str | Column) -> Column:
    """Accents and compatibility forms to ASCII; what has no ASCII form goes.

    ASCII text stays as it is; one-to-one letters are one ``translate``; only a
    text that holds a character with a longer form is taken apart.
    """
    c = col(text)
    longer = F.create_map(*[F.lit(x) for pair in FOLD_SEVERAL.items() for x in pair])
    expanded = F.array_join(F.transform(
        F.split(c, ""), lambda ch: F.coalesce(F.try_element_at(longer, ch), ch)), "")
    rare = F.length(F.translate(c, "".join(FOLD_SEVERAL), "")) < F.length(c)
    folded = F.regexp_replace(F.translate(F.when(rare, expanded).otherwise(c), FOLD_FROM, FOLD_TO),
                              r"[^\x00-\x7F]", "")
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(folded)


def normalize_text(text: str | Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(
        ascii_fold(text), r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))), r"[\s\x1c-\x1f]+", " ")


def slug(name: str | Column) -> Column:
    base = F.regexp_replace(F.lower(ascii_fold(name)), "[^a-z0-9]+", "_")
    base = F.regexp_replace(base, "^_+|_+$", "")
    return F.when(base == "", F.lit("area")).otherwise(base)


def word_grams(plain: Column, longest: int) -> Column:
    """All distinct runs of 1..longest words, with what stands between them.

    The text is cut at word edges, so pieces alternate between words and
    separators; a run of n words is 2n-1 consecutive pieces. Runs that start
    on a separator are harmless: no term starts with one.
    """
    word = "[a-z0-9_]"
    cuts = f"(?<!{word})(?={word})|(?<={word})(?!{word})"

    def runs(pieces: Column) -> Column:
        def of(n: int) -> Column:
            width = 2 * n - 1
            starts = F.when(F.size(pieces) >= width, F.sequence(
                F.lit(1), F.size(pieces) - width + 1)).otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda i: F.array_join(F.slice(pieces, i, width), ""))
        return reduce(F.concat, [pieces] + [of(n) for n in range(2, longest + 1)])

    return F.array_distinct(let(F.split(plain, cuts), runs))


def tag_terms(text: str | Column, aliases: dict[str, str]) -> Column:
    """Canonical names whose alias stands in the text on word edges, ordered by
    the alias's first position. One narrow projection: no join, no explode.

    Aliases that begin and end with a word character are looked up among the
    text's runs of words; the few others are searched one by one.
    """
    usual = {a: n for a, n in aliases.items() if re.fullmatch(r"[a-z0-9_](.*[a-z0-9_])?", a)}
    other = {a: n for a, n in aliases.items() if a and a not in usual}
    names = F.create_map(*[F.lit(x) for kv in {**usual, **other}.items() for x in kv]) if usual or other else None
    if names is None:
        return F.array().cast("array<string>")
    longest = max((len(re.findall("[a-z0-9_]+", a)) for a in usual), default=0)

    def tags(plain: Column) -> Column:
        parts = [F.array_intersect(word_grams(plain, longest), F.array(*[F.lit(a) for a in usual]))] if usual else []
        parts += [F.when(plain.rlike(rf"(?<![a-z0-9_]){re.escape(a)}(?![a-z0-9_])"), F.array(F.lit(a)))
                  .otherwise(F.array().cast("array<string>")) for a in other]
        placed = F.transform(reduce(F.concat, parts), lambda a: F.struct(
            F.instr(plain, a).alias("pos"), F.element_at(names, a).alias("name")))
        return F.array_distinct(F.transform(F.array_sort(placed), lambda p: p["name"]))

    return let(normalize_text(text), tags)


# Request-text patterns (accent-free lower-case text).
ISO_DATE = r"\b(20\d{2}-\d{2}-\d{2})\b"
YEAR = r"\b(20\d{2})\b"
RESOLUTION = r"(?:a|resolucion(?: de)?)\s*(\d+(?:[.,]\d+)?)\s*(?:m|metros?)\b"
AREA_KM2 = r"(\d+(?:[.,]\d+)?)\s*(?:km\s*(?:\^?2|²)|kilometros?\s+cuadrados?)"
DISTANCE = r"(\d+(?:[.,]\d+)?)\s*(km|m|metros?|kilometros?)"
SEASON_WORDS = ("mayo", "octubre")
SEASON_DAYS = ("-05-01", "-10-31")
ADD_WORDS = ("anade", "agrega", "incluye", "tambien")
REMOVE_WORDS = ("quita", "elimina", "borra")
DIRECTIONS = {"izquierda": "west", "oeste": "west", "derecha": "east", "este": "east",
              "arriba": "north", "norte": "north", "abajo": "south", "sur": "south"}
MOVE_WORDS = ("mueve", "desplaza", "corre", "lleva")
SCALES = {"doble": 2.0, "mitad": 0.5}
SIZE_WORDS = ("grande", "pequeno", "reduce", "amplia", "tamano")
PLACE = r"(?:barrio de|alrededor de|rode(?:e|a)\s+(?:el\s+)?|centrad[oa]\s+en)\s+(.+)"
HOME_CITY = "sevilla"
# End of fixed values.


def decimal_text(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def _group(plain: Column, pattern: str, index: int = 1) -> Column:
    found = F.regexp_extract(plain, pattern, index)
    return F.when(found != "", found)


def _has_any(plain: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [plain.contains(w) for w in words])


def _first_of(plain: Column, values: dict) -> Column:
    """The value of the first word, in the order of the table, that the text holds."""
    return F.coalesce(*[F.when(plain.contains(word), F.lit(value)) for word, value in values.items()])


def _place(text: Column, plain: Column) -> Column:
    """The place phrase in its own spelling: the pattern runs to the end of its line
    and folding keeps the length, so it is cut from the text by position."""
    found = _group(plain, PLACE)
    begin = F.instr(plain, found)
    own = F.when(F.length(text) == F.length(plain), F.substr(text, begin, F.length(found))).otherwise(found)
    name = F.regexp_replace(own, r"^[ .]+|[ .]+$", "")
    elsewhere = ~F.lower(ascii_fold(name)).contains(HOME_CITY) & plain.contains(HOME_CITY)
    return F.when(elsewhere, F.concat(name, F.lit(f", {HOME_CITY}"))).otherwise(name)


def request_slots(text: str | Column) -> dict[str, Column]:
    """First and last ISO date (or the named season of the first year),
    resolution in metres, area in km2, distance in metres, add / remove verbs,
    direction of a move, scale of a change of size, place phrase."""
    plain = F.lower(ascii_fold(text))
    dates = F.regexp_extract_all(plain, F.lit(ISO_DATE), F.lit(1))
    year = _group(plain, YEAR)
    season = plain.contains(SEASON_WORDS[0]) & plain.contains(SEASON_WORDS[1])

    def edge(position: int, month_day: str) -> Column:
        explicit = F.try_element_at(dates, F.lit(position))
        return F.coalesce(explicit, F.when(season, F.concat(year, F.lit(month_day))))

    amount, unit = decimal_text(_group(plain, DISTANCE)), _group(plain, DISTANCE, 2)
    return {
        "start_date": edge(1, SEASON_DAYS[0]),
        "end_date": edge(-1, SEASON_DAYS[1]),
        "resolution_m": decimal_text(_group(plain, RESOLUTION)),
        "area_km2": decimal_text(_group(plain, AREA_KM2)),
        "distance_m": F.when(unit.startswith("k"), amount * F.lit(1000.0)).otherwise(amount),
        "adds": _has_any(plain, ADD_WORDS),
        "removes": _has_any(plain, REMOVE_WORDS),
        "direction": F.when(_has_any(plain, MOVE_WORDS), _first_of(plain, DIRECTIONS)),
        "scale_factor": F.when(_has_any(plain, SIZE_WORDS), _first_of(plain, SCALES)),
        "place": _place(col(text), plain),
    }


def place_query(text: str | Column) -> Column:
    """Conversational place wording to a stable look-up text."""
    c = F.regexp_replace(col(text), r"^[ .,\t\r\n]+|[ .,\t\r\n]+$", "")
    # Patterns and replacements, in order.
    steps = [
        (r"(?i)^(?:el\s+)?barrio\s+de\s+", ""),
        (r"(?i),\s*en\s+", ", "),
        (r"(?i)\s+en\s+([^,]+)$", ", $1"),
        (r"\s*,\s*", ", "),
        (r"(?:,\s*){2,}", ", "),
        (r"^[ ,]+|[ ,]+$", ""),
    ]
    # End of fixed values.
    return reduce(lambda acc, step: F.regexp_replace(acc, *step), steps, c)


# Failure classes and their marker texts; the first class wins.
FAILURE_RULES = [
    ("MISSING_SENTINEL_HUB_CREDENTIALS",
     ["completa sh_client_id", "sh_client_id", "sh_client_secret", "oauth de sentinel hub"]),
    ("MISSING_CDS_CREDENTIAL", ["completa cds_api_key", "cds_api_key"]),
    ("AUTHENTICATION_REJECTED", ["401", "unauthorized", "invalid credential", "invalid_grant"]),
    ("PERMISSION_DENIED", ["403", "forbidden", "permission denied", "not authorized"]),
    ("RATE_LIMIT", ["429", "too many requests", "rate limit", "quota exceeded"]),
    ("NETWORK_ERROR", ["timeout", "timed out", "connectionerror", "name resolution", "dns"]),
    ("NO_PRODUCTS", ["no scenes", "no products", "no acquisitions", "no se encontraron",
                     "sin adquisiciones"]),
    ("GEOCODING_ERROR", ["no se encontró ningún lugar", "nominatim", "geocod"]),
    ("MISSING_DEPENDENCY", ["modulenotfounderror", "no module named", "importerror"]),
    ("KERNEL_DIED", ["kernel died", "deadkernelerror", "kernel is dead"]),
    ("OUT_OF_MEMORY", ["memoryerror", "out of memory", "cannot allocate memory"]),
    ("DISK_FULL", ["no space left", "disk full"]),
    ("FILE_NOT_FOUND", ["filenotfounderror", "no such file or directory"]),
    ("INVALID_OUTPUT", ["parsererror", "emptydataerror", "ninguna columna solicitada"]),
]
UNKNOWN_FAILURE = "UNCLASSIFIED_ERROR"
# End of fixed values.


def classify(text: str | Column, rules: list[tuple[str, list[str]]],
             default: str) -> Column:
    """First rule with any marker inside the lower-cased text."""
    lowered = F.lower(col(text))
    chain = None
    for code, markers in rules:
        hit = reduce(lambda a, b: a | b, [lowered.contains(m) for m in markers])
        chain = F.when(hit, F.lit(code)) if chain is None else chain.when(hit, F.lit(code))
    return F.lit(default) if chain is None else chain.otherwise(F.lit(default))


def failure_class(message: str | Column) -> Column:
    return classify(message, FAILURE_RULES, UNKNOWN_FAILURE)
