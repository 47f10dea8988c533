"""The same postal address written differently: a gazetteer built from the addresses themselves.

Addresses are taken apart into number, unit, street words, kind, direction and town; where nothing shows where the street
ends and the town begins, every split is a reading. Town spellings are clustered, streets are clustered within their town, and
every street of the gazetteer gets an identifier. Each address is resolved by a beam search over gazetteer entries: readings
meet the towns, the best few go on; their street names meet the town's spellings, the best few go on; these meet the
town's entries and are scored by edits, kind, direction and known house numbers. Addresses are joined on street
identifier, number and unit.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drayline.llm.trie_join import trie_join
from drayline.plans.materialize import materialize, release
from drayline.plans.skew import parallelism_of, salted_join

#: Street kinds and directions with their abbreviations, units, and parts of town names.
KINDS = {
    "st": ("street", "str"), "ave": ("avenue", "av", "aven"), "rd": ("road",), "blvd": ("boulevard", "boul", "bvd"), "dr": ("drive", "drv"), "ln": ("lane", "la"), "ct": ("court", "crt"), "pl": ("place", "plc"), "ter": ("terrace", "terr"),
    "sq": ("square", "sqr"), "pkwy": ("parkway", "pky", "parkwy"), "hwy": ("highway", "hiway", "hway"), "cir": ("circle", "circ"), "way": ("wy",), "trl": ("trail",), "aly": ("alley",), "cres": ("crescent",), "row": (), "loop": (), "walk": (),
}
DIRECTIONS = {"n": ("north", "no", "nor"), "s": ("south", "so", "sou"), "e": ("east",), "w": ("west",), "ne": ("northeast",), "nw": ("northwest",), "se": ("southeast",), "sw": ("southwest",)}
TOWN_PARTS = {"fort": ("ft",), "port": ("pt",), "heights": ("hts", "hgts", "hghts"), "junction": ("jct", "jctn", "junc"), "saint": ("st",), "mount": ("mt",), "springs": ("spgs",), "north": ("n",), "south": ("s",), "east": ("e",), "west": ("w",)}
_KIND = {w: k for k, others in KINDS.items() for w in (k, *others)}
_FULL_KIND = {w: k for w, k in _KIND.items() if len(w) >= 5}
_DIRECTION = {w: k for k, others in DIRECTIONS.items() for w in (k, *others)}
_TOWN_PART = {w: k for k, others in TOWN_PARTS.items() for w in others}
_BOX = re.compile(r"\b(?:p\.?\s*o\.?\s*box|pob|post office box|box)\s*(?:no\.?|#)?\s*([0-9]+)\b")
_UNIT = re.compile(r"\b(?:suite|ste|unit|apartment|apt|room|rm)\b\.?\s*#?\s*([0-9]+\s?[a-z]?|[a-z])\b|#([0-9]+[a-z]?)(?=\s*(?:$|[,/;]))")
_ZIP = re.compile(r"\b([0-9]{5})(?:-[0-9]{4})?\b")
#: House numbers: with a half, as a range, of a grid, or plain.
_NUMBER = re.compile(r"(?:\b(?:no|nr)\b\.?\s*|#\s*)?\b([0-9]{1,6} 1/2|[0-9]{1,6}-[0-9]{1,6}|[nsew][0-9]{1,6}[nsew][0-9]{1,6}|[0-9]{1,6}[a-z]?)\b")
_HALF = re.compile(r"\b([0-9]{1,6})[ -]1/2\b")
_LONG_NUMBER = re.compile(r"^[0-9]{5}(?=\s+[a-z])")
#: Readings of a street name that stay in the beam.
BEAM = 4
#: A street name, and a town name, is a slip for a neighbour that is this many times as frequent.
SLIP_TIMES, TOWN_TIMES = 4, 4
#: A spelling that a town has at most so often is judged by all towns.
FEW = 2
ZIP_SHARE = 0.6
#: What a reading costs whose street the gazetteer doesn't have; about as much as the most edits.
UNKNOWN_STREET = 2.5


def _fold(text: str) -> str:
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", text.lower()).strip()


def town_key(text: str) -> str:
    """Town name with its usual parts spelled out and without spaces."""
    words = re.findall(r"[a-z]+", _fold(text))
    return "".join(_TOWN_PART.get(w, w) if len(words) > 1 else w for w in words)


def _kind_of(word: str) -> str | None:
    if word in _KIND:
        return _KIND[word]
    if len(word) >= 5:
        for full, kind in _FULL_KIND.items():
            if abs(len(full) - len(word)) <= 1 and _one_slip(word, full):
                return kind
    return None


def _one_slip(a: str, b: str) -> bool:
    if len(a) == len(b):
        bad = [k for k in range(len(a)) if a[k] != b[k]]
        return len(bad) <= 1 or len(bad) == 2 and bad[1] == bad[0] + 1 and a[bad[0]] == b[bad[1]] and a[bad[1]] == b[bad[0]]
    if len(a) > len(b):
        a, b = b, a
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


Reading = tuple[str, str, str, str, str, str, str]


def _street(words: list[str]) -> tuple[str, str, str]:
    """(core, kind, direction) of the words of a street."""
    words = list(words)
    direction = kind = ""
    if len(words) > 1 and words[-1] in _DIRECTION:
        direction = _DIRECTION[words.pop()]
    if len(words) > 1 and words[0] in _DIRECTION and not (len(words) == 2 and _kind_of(words[1]) and len(words[0]) > 2):
        direction = direction or _DIRECTION[words[0]]
        words = words[1:]
    if len(words) > 1 and _kind_of(words[-1]):
        kind = _kind_of(words.pop()) or ""
        if len(words) > 1 and words[-1] in _DIRECTION:
            direction = direction or _DIRECTION[words.pop()]
    return "".join(words), kind, direction


def read_address(address: str, city: str | None = None) -> list[Reading]:
    """Readings (number, unit, core, kind, direction, town, zip) of an address, the plainest first; none without a number.

    A box has the core ``box``. A city that is given is the town. Without one, an address that goes on after its street
    without a mark has several readings.
    """
    text = _fold(address)
    known = town_key(city) if city else ""
    box = _BOX.search(text)
    zip_code = ""
    if box:
        rest = text[: box.start()] + "," + text[box.end() :]
        found = _ZIP.search(rest)
        return [(box.group(1).lstrip("0") or "0", "", "box", "box", "", known or town_key(_ZIP.sub(" ", rest)), found.group(1) if found else "")]
    unit = ""

    def take(m: re.Match) -> str:
        nonlocal unit
        unit = unit or re.sub(r"\s", "", m.group(1) or m.group(2))
        return ","

    text = _UNIT.sub(take, text)
    # halves are kept from being cut at their stroke
    text = _HALF.sub("\\1 1\0", text)
    number, street, town = "", None, []
    awaiting = False
    segments = [x for segment in re.split(r"[,/:;]|\s-\s", text) if (x := segment.strip(" ."))]
    for at, segment in enumerate(segments):
        segment = segment.replace("1\0", "1/2")
        # five digits ahead of words are a house number if there is no other
        others = " ".join(segments[:at] + [_LONG_NUMBER.sub(" ", segment)] + segments[at + 1 :])
        house = not number and _LONG_NUMBER.match(segment) and not _NUMBER.search(_ZIP.sub(" ", others))
        codes = [m for m in _ZIP.finditer(segment) if not (house and m.start() == 0)]
        if codes:
            found = codes[-1]
            zip_code = zip_code or found.group(1)
            segment = (segment[: found.start()] + " " + segment[found.end() :]).strip()
            if number or not _NUMBER.search(segment):
                if segment:
                    town.append(segment)
                continue
        m = _NUMBER.search(segment) if not number else None
        if m:
            number = m.group(1)
            left = (segment[: m.start()] + " " + segment[m.end() :]).strip(" .#")
            if re.search("[a-z]", left):
                street = left
            else:
                awaiting = True
        elif awaiting and street is None:
            street = segment
        else:
            town.append(segment)
    if not number:
        return []
    if street is None and town:
        street = town.pop(0)
    words = re.findall(r"[a-z0-9]+", (street or "").replace("'", ""))
    place = town_key(" ".join(town))
    number = number.replace(" 1/2", "h").lstrip("0") or "0"
    readings = [(words, known or place)]
    if not place:
        # the town may follow without a mark, and a state of two letters may follow the town
        end = len(words) - (len(words) > 2 and len(words[-1]) == 2 and words[-1] not in _DIRECTION and words[-1] not in _KIND)
        splits = [(words[:k], town_key(" ".join(words[k:end]))) for k in range(1, end)]
        readings = [x for x in splits if x[1] == known] or readings if known else readings + splits
    parts = [(number, unit.lstrip("0"), *_street(w), t, zip_code) for w, t in readings]
    return [p for p in parts if p[2]]


_READ = "address string, city string, reading int, number string, unit string, core string, kind string, direction string, town string, zip string"


def read_addresses(addresses: DataFrame) -> DataFrame:
    """Every different address text with its city taken apart; ``addresses`` has the columns ``address`` and ``city``."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(a, c, k, *parts) for a, c in zip(batch["address"], batch["city"], strict=True) for k, parts in enumerate(read_address(a, c))]
            yield pd.DataFrame(rows, columns=["address", "city", "reading", "number", "unit", "core", "kind", "direction", "town", "zip"])

    written = addresses.where(r"address rlike '[0-9]'").select("address", "city").distinct()
    return written.repartition(parallelism_of(written)).mapInPandas(read, _READ)


def _roots(counts: DataFrame, edges: DataFrame, times: float, scope: list[str], spelling: str) -> DataFrame:
    """``scope, spelling, root``: the spelling that each one is a slip for, or itself. ``counts`` has ``n``."""
    near = counts.withColumnRenamed(spelling, "a").withColumnRenamed("n", "own").join(edges, "a").join(counts.select(*scope, F.col(spelling).alias("b"), "n"), [*scope, "b"])
    up = near.where(F.col("n") >= times * F.col("own")).groupBy(*scope, F.col("a").alias(spelling)).agg(F.max_by("b", F.struct(-F.col("d"), F.col("n"), "b")).alias("up"))
    first = counts.join(up, [*scope, spelling], "left").select(*scope, spelling, F.coalesce("up", spelling).alias("root"))
    first = materialize(first)
    step = first.select(*scope, F.col(spelling).alias("root"), F.col("root").alias("next"))
    return first.join(step, [*scope, "root"], "left").select(*scope, spelling, F.coalesce("next", "root").alias("root"))


def resolve_addresses(records: DataFrame) -> DataFrame:
    """``(record_id, house, unit, many_units)``: each record's house (street identifier and number), with its unit.

    ``records`` has ``record_id, address, city, zip``; city and zip may be null and are then looked for in the address.
    Records whose address has no number or no town, or is null, are left out. ``many_units`` tells that the house is known
    with several units. A record with several addresses has several rows; repeated rows count once; an empty
    table gives no rows; other columns are not read.
    """
    held = records.select(F.col("record_id").cast("string").alias("record_id"), "address", "city", F.substring(F.regexp_replace("zip", "[^0-9]", ""), 1, 5).alias("own_zip")).where("record_id is not null and address is not null").distinct()
    held = held.withColumn("city", F.coalesce("city", F.lit("")))
    read = read_addresses(held)
    count = F.max("reading").over(Window.partitionBy("address", "city"))
    read = read.withColumn("open", count > 0)
    parts = held.join(read, ["address", "city"]).select(
        F.xxhash64("address", "city").alias("text"), "record_id", "reading", "open", "number", "unit", "core", "kind", "direction",
        F.nullif("town", F.lit("")).alias("town"), F.coalesce(F.nullif("own_zip", F.lit("")), F.nullif("zip", F.lit(""))).alias("zip"),
    )
    parts = materialize(parts)

    # towns: slips go to the spelling that is far more frequent; a zip's town is the one that most of its addresses name
    # readings of one address compete, so only sure ones make the gazetteer
    sure = parts.where("not open")
    towns = materialize(sure.where("town is not null").groupBy("town").agg(F.count("*").alias("n")))
    town_edges = trie_join(towns.select(F.lit("").alias("scope"), F.col("town").alias("word")))
    town_roots = materialize(_roots(towns, town_edges.drop("scope"), TOWN_TIMES, [], "town"))
    placed = salted_join(parts, town_roots, "town")
    by_zip = placed.where("not open and root is not null and zip is not null").groupBy("zip", "root").agg(F.count("*").alias("n"))
    zips = by_zip.groupBy("zip").agg(F.max_by("root", F.struct("n", "root")).alias("zip_town"), F.max("n").alias("most"), F.sum("n").alias("all")).where(F.col("most") >= ZIP_SHARE * F.col("all")).select("zip", "zip_town")
    frequent = towns.join(town_roots, "town").groupBy("root").agg(F.sum("n").alias("town_n"))
    placed = placed.join(zips, "zip", "left").join(frequent, "root", "left")
    # a name that is hardly ever written may be a worse slip; then the zip decides, if it says something alike
    alike = (F.levenshtein("root", "zip_town") <= 3) | (F.col("town_n") == 1)
    town = F.when(F.col("root").isNull(), F.col("zip_town")).when(F.col("zip_town").isNotNull() & (F.col("town_n") <= 3) & alike, F.col("zip_town")).otherwise(F.col("root"))
    # the first step of the beam: the plain reading, and those whose town the gazetteer has; a kind at the street's end, then the longest name of a town go ahead
    placed = placed.withColumn("place", town).where("place is not null and (reading = 0 or root is not null)")
    first = Window.partitionBy("record_id", "text").orderBy(F.desc(F.col("kind") != ""), F.desc(F.length("town")), "reading")
    stepped = placed.where("open").withColumn("k", F.row_number().over(first)).where(F.col("k") <= BEAM).drop("k")
    # with one reading left, an address is as plain as any
    stepped = stepped.withColumn("open", F.count("*").over(Window.partitionBy("record_id", "text")) > 1)
    fields = ("text", "record_id", "open", "number", "unit", "core", "kind", "direction", F.col("place").alias("town"))
    placed = materialize(placed.where("not open").select(*fields).unionByName(stepped.select(*fields)))
    release(parts, towns, town_edges, town_roots)

    # the second step of the beam: a street name as written, and its nearest spellings where it may be a slip for one of the same town
    streets_of = placed.where("kind <> 'box'")
    # the town's own counts decide; where it has a spelling hardly ever, the counts of all towns stand in
    local = streets_of.groupBy("town", "core").agg(F.count_if(~F.col("open")).alias("n"))
    every = local.groupBy("core").agg(F.sum("n").alias("every"))
    local = materialize(local.join(every, "core"))
    edges = trie_join(local.select(F.col("town").alias("scope"), F.col("core").alias("word")))
    far = local.select("town", F.col("core").alias("b"), F.col("n").alias("n_b"), F.col("every").alias("every_b"))
    near = edges.withColumnRenamed("scope", "town").join(local.withColumnRenamed("core", "a"), ["town", "a"]).join(far, ["town", "b"])
    few = (F.col("n") <= FEW) & (F.col("n_b") > 0)
    near = near.withColumn("clear", (F.col("n_b") >= SLIP_TIMES * F.greatest("n", F.lit(1))) | (few & (F.col("every_b") >= SLIP_TIMES * F.col("every"))))
    ahead = near.where(F.col("clear") | (few & (F.col("every_b") >= F.col("every")) & ((F.col("every_b") > F.col("every")) | (F.col("every") <= FEW))))
    best = Window.partitionBy("town", "a").orderBy("d", F.desc("n_b"), F.desc("every_b"), "b")
    beam = ahead.withColumn("k", F.row_number().over(best)).where(F.col("k") < BEAM).select("town", F.col("a").alias("core"), F.col("b").alias("as"), "d", "clear")
    beam = materialize(beam.unionByName(local.select("town", "core", F.col("core").alias("as"), F.lit(0).alias("d"), F.lit(True).alias("clear"))))

    release(edges, local)

    # the gazetteer: streets of each town with their known house numbers
    gazetteer = materialize(placed.where("kind <> '' and not open").groupBy("town", F.col("core").alias("as"), F.col("kind").alias("e_kind"), F.col("direction").alias("e_direction"), F.col("number").alias("e_number")).agg(F.count("*").alias("n")))
    streets = gazetteer.groupBy("town", "as", "e_kind", "e_direction").agg(F.sum("n").alias("n"))

    places = placed.where("kind <> 'box'").select("town", "core", "kind", "direction", "number").distinct()
    tried = places.join(beam, ["town", "core"])
    same_kind = (F.col("kind") == F.col("e_kind")) | (F.col("kind") == "")
    met = tried.join(streets, ["town", "as"]).where(same_kind & (F.col("direction") == F.col("e_direction")))
    met = met.join(gazetteer.withColumnRenamed("n", "houses").withColumnRenamed("e_number", "number"), ["town", "as", "e_kind", "e_direction", "number"], "left")
    others = F.coalesce("houses", F.lit(0)) > F.when((F.col("d") == 0) & (F.col("kind") != ""), 1).otherwise(0)
    # an unclear slip needs a known house; a name that is spelled right stays
    usable = met.where((F.col("d") == 0) | F.col("clear") | others)
    slip = F.max(F.when(F.col("clear") & (F.col("d") > 0), 1).otherwise(0)).over(Window.partitionBy("town", "core", "kind", "direction", "number"))
    cost = (
        F.col("d").cast("double")
        - F.when(others, 3.0).otherwise(0.0)
        + F.when((F.col("d") == 0) & (slip == 1), 2.5).otherwise(0.0)
        - F.log1p(F.col("n").cast("double")) * 0.01
    )
    scored = usable.withColumn("cost", cost)
    rivals = F.count("*").over(Window.partitionBy("town", "core", "kind", "direction", "number", "as"))
    # without a kind, a street must be the only one of its name, or the only one with that house
    known = F.sum(F.when(others, 1).otherwise(0)).over(Window.partitionBy("town", "core", "kind", "direction", "number", "as"))
    scored = scored.withColumn("sure", (F.col("kind") != "") | (rivals == 1) | ((known == 1) & others)).where("sure")
    place = ["town", "core", "kind", "direction", "number"]
    chosen = scored.groupBy(*place).agg(F.min_by(F.struct("as", "e_kind", "cost"), F.struct("cost", "as", "e_kind")).alias("s"))
    box = F.col("kind") == "box"
    found = placed.join(chosen, place, "left")
    # the last step: of an address's readings the cheapest; one that no entry knows costs most
    total = F.coalesce("s.cost", F.lit(UNKNOWN_STREET))
    won = F.row_number().over(Window.partitionBy("record_id", "text").orderBy(total, F.length("core"), "core", "kind"))
    found = found.where("not open").unionByName(found.where("open").withColumn("k", won).where("k = 1").drop("k"))
    street = F.concat_ws("|", "town", F.when(box, F.lit("box")).otherwise(F.coalesce("s.as", "core")), F.coalesce("s.e_kind", "kind"), "direction")
    houses = materialize(found.select("record_id", F.concat_ws("|", street, "number").alias("house"), "unit").distinct())
    release(placed, beam, gazetteer)
    units = houses.where("unit <> ''").groupBy("house").agg((F.count_distinct("unit") > 1).alias("many"))
    return houses.join(units, "house", "left").select("record_id", "house", "unit", F.coalesce("many", F.lit(False)).alias("many_units"))


def location_key(house: Column, unit: Column, many_units: Column) -> Column:
    """A location: the house, and where it has several units the unit."""
    return F.when(many_units, F.concat_ws("#", house, unit)).otherwise(house)


def located_pairs(resolved: DataFrame) -> DataFrame:
    """``(left_id, right_id)``: every two different records of one location, smaller identifier first."""
    r = resolved.select("record_id", location_key(F.col("house"), F.col("unit"), F.col("many_units")).alias("place")).distinct()
    left, right = r.withColumnRenamed("record_id", "left_id"), r.withColumnRenamed("record_id", "right_id")
    return salted_join(left, right, "place", "inner").where("left_id < right_id").select("left_id", "right_id").distinct()
