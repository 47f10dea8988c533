"""Service codes of the old systems in a target model, by a versioned rule table with confidences in thousandths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION = "rules-v1"
#: Token, line of business, whether it is the usual token, whether sizes end in YD, sizes on offer, and whether a frequency is required.
FAMILIES = (
    ("RO", "rolloff", True, True, (10, 20, 30, 40), False), ("ROLLOFF", "rolloff", False, True, (10, 20, 30, 40), False),
    ("COMM", "frontload", True, True, (2, 4, 6, 8), False), ("FL", "frontload", False, True, (2, 4, 6, 8), False), ("FRONTLOAD", "frontload", False, True, (2, 4, 6, 8), False),
    ("RES", "residential", True, False, (1, 2), True), ("RESIDENTIAL", "residential", False, False, (1, 2), True),
)
FREQUENCIES = {"W": "weekly", "WEEKLY": "weekly", "BW": "biweekly", "BIW": "biweekly", "M": "monthly", "MONTHLY": "monthly", "OC": "oncall", "ONCALL": "oncall"}
#: The shapes of codes.
_RETIRED = r"^SW-OPEN-([0-9]{1,2})(?:YD)?$"
_SHAPE = r"^SW-([A-Z]+)(?:-([0-9]{1,2}))?(?:YD)?(?:-([A-Z]+))?$"
_ANYWHERE = r"(ROLLOFF|FRONTLOAD|RESIDENTIAL|COMM|RO|FL|RES)"

#: The notes of the mapping.
RETIRED_NOTE = "Open-top service is retired in the target model; migrate to the rolloff equivalent."
NO_SIZE = "Missing container size."
ODD_SIZE = "Size %d yards is outside the %s yard sizes offered for %s."
NO_FREQUENCY = "Residential codes require an explicit frequency token."
ODD_FREQUENCY = 'Unknown frequency token "%s".'
NO_SUFFIX = "Missing YD suffix."
ODD_TOKEN = 'Unknown line-of-business token "%s".'
SIZE_ONLY = "Parsed size %d yards, but the line of business is unknown."
GUESSED = 'Code structure unrecognized; inferred line of business from token "%s".'
SIZE_GUESSED = "Parsed size %d yards, unverified."
NO_TOKEN = "No recognizable line-of-business token; manual mapping required."


def _by_token(token: Column, values: list) -> Column:
    return F.try_element_at(F.create_map(*[x for f, v in zip(FAMILIES, values, strict=True) for x in (F.lit(f[0]), v)]), token)


def map_service_code(code: Column) -> Column:
    """Struct ``(lob, size_yards, frequency, confidence, retired, retired_as, notes, version)``; null for null and blank codes.

    ``notes`` tells in words, in the order of the parts of a code, why a confidence isn't 1.
    """
    v = F.upper(F.trim(F.regexp_replace(code, r"(?U)\s+", " ")))
    old = F.regexp_extract(v, _RETIRED, 1)
    token, size, word = (F.regexp_extract(v, _SHAPE, k) for k in (1, 2, 3))
    n = F.when(size != "", size.cast("int"))
    lob = _by_token(token, [F.lit(f[1]) for f in FAMILIES])
    canonical = _by_token(token, [F.lit(f[2]) for f in FAMILIES])
    suffixed = _by_token(token, [F.lit(f[3]) for f in FAMILIES])
    sizes = _by_token(token, [F.array(*[F.lit(s) for s in f[4]]) for f in FAMILIES])
    required = _by_token(token, [F.lit(f[5]) for f in FAMILIES])
    given = F.try_element_at(F.create_map(*[F.lit(x) for kv in FREQUENCIES.items() for x in kv]), word)
    frequency = F.when(given.isNotNull(), given).when(~required & (size != ""), "weekly")
    no_size, odd_size = size == "", (size != "") & ~F.coalesce(F.array_contains(sizes, n), F.lit(False))
    odd_word, no_word = (word != "") & given.isNull(), required & (word == "")
    no_suffix = canonical & suffixed & (word == "") & ~v.rlike("-[0-9]{1,2}YD$")
    points = (
        F.when(canonical, 1000).otherwise(920) - F.when(no_size | odd_size, 400).otherwise(0)
        - F.when(odd_word | no_word, 400).otherwise(0) - F.when(no_suffix, 100).otherwise(0)
    )
    guess = F.regexp_extract(v, _ANYWHERE, 1)
    guessed = _by_token(guess, [F.lit(f[1]) for f in FAMILIES])
    guessed_size = F.nullif(F.regexp_extract(v, "([0-9]{1,2})", 1), F.lit("")).cast("int")
    notes = {
        "retired": [(F.lit(True), F.lit(RETIRED_NOTE))],
        "known": [
            (no_size, F.lit(NO_SIZE)), (odd_size, F.format_string(ODD_SIZE, n, F.array_join(F.transform(sizes, lambda x: x.cast("string")), "/"), lob)),
            (no_word, F.lit(NO_FREQUENCY)), (odd_word, F.format_string(ODD_FREQUENCY, word)), (no_suffix, F.lit(NO_SUFFIX)),
        ],
        "shaped": [(F.lit(True), F.format_string(ODD_TOKEN, token)), (size != "", F.format_string(SIZE_ONLY, n))],
        "other": [
            (guessed.isNotNull(), F.format_string(GUESSED, guess)), (guessed_size.isNotNull(), F.format_string(SIZE_GUESSED, guessed_size)),
            (guessed.isNull(), F.lit(NO_TOKEN)), (guessed_size.isNull(), F.lit(NO_SIZE)),
        ],
    }
    texts = {k: F.filter(F.array(*[F.when(bad, text) for bad, text in rows]), lambda x: x.isNotNull()) for k, rows in notes.items()}
    retired, shaped, known = old != "", v.rlike(_SHAPE), lob.isNotNull()
    result = F.struct(
        F.when(retired, "rolloff").when(shaped, lob).otherwise(guessed).alias("lob"),
        F.when(retired, F.nullif(old, F.lit("")).cast("int")).when(shaped, n).otherwise(guessed_size).alias("size_yards"),
        F.when(retired, "weekly").when(shaped & known, frequency).alias("frequency"),
        (F.when(retired, 600).when(shaped & known, F.greatest(points, F.lit(0))).when(shaped, 300).when(guessed.isNotNull(), 450).otherwise(300) / 1000).alias("confidence"),
        retired.alias("retired"),
        F.when(retired, F.concat(F.lit("SW-RO-"), F.nullif(old, F.lit("")).cast("int").cast("string"), F.lit("YD"))).alias("retired_as"),
        F.when(retired, texts["retired"]).when(shaped & known, texts["known"]).when(shaped, texts["shaped"]).otherwise(texts["other"]).alias("notes"),
        F.lit(VERSION).alias("version"),
    )
    return F.when(v != "", result)
