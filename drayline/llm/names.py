"""Variant spellings of names that people typed.

A name is taken apart without regard to token order: fillers, titles and legal forms go, first names become their formal form,
words of trade are recognised by spelling or abbreviation, and what is left is the core (a surname or a firm's own
word). Cores are joined by a sharded trie with Levenshtein automata; of neighbouring cores in the same context (same first
name, or same trade) the rarer is a variant of the commoner. Initials and missing trades are filled in where only one
entity fits.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drayline.llm.components import connected_components
from drayline.llm.trie_join import trie_join
from drayline.plans.materialize import materialize, release
from drayline.plans.skew import parallelism_of, salted_join

#: What stands for no name.
PLACEHOLDERS = (
    "unknown", "n/a", "na", "none", "null", "nil", "tbd", "tba", "test", "test test", "testing", "see notes", "see note", "see file", "cash customer", "cash", "customer",
    "new customer", "walk in", "walk-in", "no name", "noname", "misc", "do not use", "xxx", "same", "pending", "various", "anonymous",
)
#: Legal forms, partner words, titles, generations, and remarks that people add to names.
LEGAL = ("llc", "inc", "incorporated", "co", "company", "ltd", "limited", "corp", "corporation", "lp", "llp", "plc", "pc")
PARTNERS = ("sons", "son", "daughters", "daughter", "partners", "partner", "bros", "brothers", "sisters", "associates")
REMARK_WORDS = ("file", "main", "office", "billing", "mail", "call", "note", "notes", "old", "see", "not", "duplicate")
TITLES = ("mr", "mrs", "ms", "miss", "dr", "prof", "rev", "sir", "attn", "attention", "acct", "account", "the", "and")
GENERATIONS = {"jr": "jr", "junior": "jr", "sr": "sr", "senior": "sr", "ii": "ii", "iii": "iii", "iv": "iv"}
REMARKS = r"\([^)]*\)|\[[^\]]*\]|\bc/o\b|\bdo not mail\b|\bdo not call\b|/\s*billing\b|\bsee file\b|\bsee notes?\b|\bold acct\b|\bmain office\b|\bacct:|\battn:?"
#: Everyday and foreign forms of first names, by formal name.
NICKNAMES = {
    "abigail": ("abby", "abbie", "gail"), "alexander": ("alex", "sandy", "sasha", "xander", "alec"), "andrew": ("andy", "drew"), "anthony": ("tony",), "barbara": ("barb", "babs"), "benjamin": ("ben", "benny"),
    "charles": ("charlie", "chuck", "chas"), "christopher": ("chris", "kit"), "christine": ("chris", "tina", "christy"), "daniel": ("dan", "danny"), "david": ("dave", "davy"), "deborah": ("deb", "debbie", "debra"),
    "dorothy": ("dot", "dottie", "dolly"), "edward": ("ed", "eddie", "ned", "ted", "teddy"), "elizabeth": ("liz", "beth", "betty", "lizzie", "eliza", "betsy"), "francisco": ("paco", "pancho", "frank", "cisco"), "gregory": ("greg",),
    "guadalupe": ("lupe", "lupita"), "james": ("jim", "jimmy", "jamie"), "jennifer": ("jen", "jenny", "jenn"), "john": ("jack", "johnny"), "jose": ("pepe",), "joseph": ("joe", "joey"), "jurgen": ("juergen",),
    "katherine": ("kate", "katie", "kathy", "kat", "catherine"), "kenneth": ("ken", "kenny"), "lawrence": ("larry", "laurie", "laurence"), "margaret": ("maggie", "meg", "peggy", "marge"), "matthew": ("matt",),
    "michael": ("mike", "mick", "mickey"), "mohammed": ("mo", "muhammad", "mohamed", "mohammad"), "nicholas": ("nick", "nico", "nicky"), "patricia": ("pat", "patty", "trish", "tricia"), "patrick": ("pat", "paddy"),
    "rebecca": ("becky", "becca"), "rene": (), "richard": ("rick", "dick", "rich", "ricky"), "robert": ("bob", "rob", "bobby", "robbie"), "samuel": ("sam",), "stephen": ("steve", "steven"), "susannah": ("sue", "susie", "suzie", "susanna"),
    "theodore": ("theo", "ted", "teddy"), "thomas": ("tom", "tommy"), "victoria": ("vicky", "tori", "vicki"), "william": ("bill", "will", "liam", "billy", "willy"), "zachary": ("zach", "zack", "zac"),
}
#: A token is part of the lexicon if it stands in this part of the names; so there are few of them.
LEXICON_SHARE, LEXICON_LEAST = 0.0015, 4
#: A word of trade stands for another too if so many of its names have that one.
ALWAYS_BESIDE = 0.6
#: A lexicon word is a word of trade if so many of its names have a legal form.
TRADE_LEGAL = 0.1
#: Two edits that aren't swaps only link cores of which one has three letters that not more than this part of all cores share.
ODD_SHARE = 0.0001
_TOKEN = re.compile(r"[^\W_]+(?:['’.-][^\W_]+)*")
_REMARK, _SPACE, _LLC, _TWO_LETTERS = re.compile(REMARKS), re.compile(r"\s+"), re.compile(r"\bl\.\s?l\.\s?c\b\.?"), re.compile(r"[^\W\d_]{2}")
#: Of these, every remark has one.
_REMARK_SIGNS = ("(", "[", "/", "do not", "see ", "old acct", "main office", "acct:", "attn")
_PLACEHOLDERS, _TITLES, _LEGAL = frozenset(PLACEHOLDERS), frozenset(TITLES), frozenset(LEGAL)


def fold(text: str) -> str:
    """Lower case without accents."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def tokens_of(name: str) -> list[str]:
    return _tokens(fold(name))


def _tokens(text: str) -> list[str]:
    if any(sign in text for sign in _REMARK_SIGNS):
        text = _REMARK.sub(" ", text)
    if "l." in text:
        text = _LLC.sub("llc", text)
    # words in another script keep their letters
    found = _TOKEN.findall(text.replace("+", " ").replace("&", " "))
    return [t if t.isascii() and t.isalnum() and t == t.lower() else re.sub(r"[^a-z0-9]", "", t) or re.sub(r"[\W_]", "", t) for t in found]


def within(a: str, b: str, most: int) -> bool:
    """Whether two words are within so many edits; swapped neighbours count once."""
    if abs(len(a) - len(b)) > most:
        return False
    before, row = None, list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        fresh = [i]
        for j in range(1, len(b) + 1):
            cost = min(row[j] + 1, fresh[-1] + 1, row[j - 1] + (a[i - 1] != b[j - 1]))
            if before is not None and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                cost = min(cost, before[j - 2] + 1)
            fresh.append(cost)
        if min(fresh) > most and min(row) > most:
            return False
        before, row = row, fresh
    return row[-1] <= most


class Nearby:
    """The words of a list that are :func:`within` so many edits of a given one, by the length of the listed word."""

    def __init__(self, words: Iterable[str], most: Callable[[str], int]):
        self.by_length: dict[int, list[tuple[str, frozenset[str], int]]] = defaultdict(list)
        for w in words:
            for n in range(len(w) - most(w), len(w) + most(w) + 1):
                self.by_length[n].append((w, frozenset(w), most(w)))

    def of(self, token: str) -> list[str]:
        letters = set(token)
        # an edit brings in and takes away one letter at most
        return [w for w, own, most in self.by_length.get(len(token), ()) if len(letters - own) <= most and len(own - letters) <= most and within(token, w, most)]


def _abbreviates(short: str, word: str) -> bool:
    if not 2 <= len(short) < len(word) or short[0] != word[0]:
        return False
    letters = iter(word)
    return word.startswith(short) and len(short) >= 3 or len(short) >= 3 and all(c in letters for c in short)


def turned(a: list[str], b: list[str]) -> bool:
    """Whether two names have the same words in another order, with at most one edit in one of them."""
    if len(a) != len(b) or a == b:
        return False
    over, short = Counter(a) - Counter(b), Counter(b) - Counter(a)
    if not over:
        return True
    if over.total() > 1 or sum(map(len, a)) < 4 or sum(map(len, b)) < 4:
        return False
    (x,), (y,) = over, short
    # in one order, the join of the cores decides
    return within(x, y, 1) and [x if w == y else w for w in b] != a


def turned_pairs(names: DataFrame) -> DataFrame:
    """``(left_id, right_id)``: entities with names of which one is the other in another order.

    ``names`` has ``turn``, ``words`` and ``entity``. Sorted letters, whole and less one, are the same in any order of the
    words, so every order with at most one edit or swap is found.
    """
    each = names.where("turn is not null").groupBy("turn", "words").agg(F.collect_set("entity").alias("entities"))
    letters = F.array_sort(F.split(F.array_join("words", ""), ""))
    less = F.transform(F.sequence(F.lit(1), F.size("letters")), lambda k: F.array_join(F.concat(F.slice("letters", F.lit(1), k - 1), F.slice("letters", k + 1, F.size("letters"))), ""))
    keys = F.array_distinct(F.concat(F.array(F.array_join("letters", "")), less))
    shards = each.withColumn("letters", letters).select("turn", "words", "entities", F.explode(F.transform(keys, lambda k: F.xxhash64("turn", k))).alias("shard"))
    groups = shards.groupBy("shard").agg(F.collect_list(F.struct("turn", "words", "entities")).alias("g")).where("size(g) > 1").select("g")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: set[tuple[str, str]] = set()
            for g in batch["g"]:
                for x, y in combinations([(n["turn"], list(n["words"]), sorted(n["entities"])) for n in g], 2):
                    if x[0] == y[0] and (x[2] != y[2] or len(x[2]) > 1) and turned(x[1], y[1]):
                        out.update((e, f) for e in x[2] for f in y[2] if e != f)
            yield pd.DataFrame(sorted(out), columns=["left_id", "right_id"], dtype=object)

    return groups.mapInPandas(search, "left_id string, right_id string").distinct()


class NameReader:
    """Takes names apart with a lexicon of the corpus."""

    def __init__(self, trades: list[str], partners: dict[str, list[str]] | None = None):
        """``trades``: words of trade, commonest first. ``partners``: words that nearly always stand beside a word."""
        formal: dict[str, set[str]] = defaultdict(set)
        for name, others in NICKNAMES.items():
            for n in (name, *others):
                formal[n].add(name)
        self.formal = {k: tuple(sorted(v)) for k, v in formal.items()}
        # abbreviations, slips and joined words that are frequent themselves are no words of their own
        words = [t for t in trades if t not in self.formal]
        rank = {w: k for k, w in enumerate(words)}
        listed = set(words)
        compound = {w for w in words if any(w[:k] in listed and w[k:] in listed for k in range(2, len(w) - 1))}
        words = [w for w in words if w not in compound]
        whole = [w for w in words if not any(x != w and (_abbreviates(w, x) or rank[x] < rank[w] and within(w, x, 1)) for x in words)]
        self.joined = {a + b: (a, b) for a in whole for b in whole if a != b}
        self.trades = whole
        self.common = {w for w in trades if w not in self.formal}
        self.beside = partners or {}
        self.listed = frozenset(whole)
        self.by_initial: dict[str, list[str]] = defaultdict(list)
        for w in whole:
            self.by_initial[w[:1]].append(w)
        self.near_trades = Nearby(whole, lambda w: 2 if len(w) >= 8 else 1)
        self.near_first = Nearby(NICKNAMES, lambda w: 2 if len(w) >= 9 else 1)
        self.near_partners = Nearby([p for p in PARTNERS if len(p) >= 4], lambda w: 1)
        self.partner_cache: dict[str, bool] = {}
        self.cache: dict[str, tuple[str, ...]] = {}
        self.first_cache: dict[str, tuple[str, ...]] = {}

    def trade(self, token: str) -> tuple[str, ...]:
        """Words of trade that a token stands for; none if it is no such word."""
        got = self.cache.get(token)
        if got is None:
            if token in self.listed:
                got = (token,)
            elif token in self.joined:
                got = self.joined[token]
            else:
                fits = [w for w in self.by_initial.get(token[:1], ()) if _abbreviates(token, w)]
                if fits:
                    starts = [w for w in fits if w.startswith(token)]
                    got = (min(starts or fits, key=lambda w: (len(w), w)),)
                else:
                    near = self.near_trades.of(token) if len(token) >= 4 else []
                    got = (min(near),) if near else ()
            if len(self.cache) > 500_000:
                self.cache.clear()
            self.cache[token] = got
        return got

    def first(self, token: str) -> tuple[str, ...]:
        """Formal first names that a token can stand for."""
        got = self.formal.get(token)
        if got is None:
            got = self.first_cache.get(token)
        if got is None:
            got = tuple(sorted(self.near_first.of(token))) if len(token) >= 4 else ()
            if len(self.first_cache) > 500_000:
                self.first_cache.clear()
            self.first_cache[token] = got
        return got

    def partner(self, token: str) -> bool:
        """Whether a token is a partner word or within one edit of a long one."""
        got = self.partner_cache.get(token)
        if got is None:
            got = token in PARTNERS or len(token) >= 4 and bool(self.near_partners.of(token))
            if len(self.partner_cache) > 500_000:
                self.partner_cache.clear()
            self.partner_cache[token] = got
        return got

    def read(self, name: str) -> tuple[str, str, list[str], str, str]:
        """(kind, core, contexts, generation, initial); kind is ``firm``, ``person`` or ``none``.

        Contexts are the possible trades of a firm, or formal first names of a person; none where the name has no such part.
        """
        return self.read_words(name)[:5]

    def read_words(self, name: str) -> tuple[str, str, list[str], str, str, list[str]]:
        """As :meth:`read`, with the words whose order says nothing: those of a core, or all of a person of unlisted first name."""
        folded = fold(name)
        plain = _SPACE.sub(" ", folded).strip(" .*-–_?!")
        if plain in _PLACEHOLDERS:
            return "none", "", [], "", "", []
        if not _TWO_LETTERS.search(plain):
            # no word stands in it: all its letters and digits are the core, unless they say nothing
            core = re.sub(r"[\W_]", "", plain)
            blank = len(set(core)) < 2 and (not core or core.isascii()) or core in {re.sub(r"[\W_]", "", p) for p in PLACEHOLDERS}
            return ("none" if blank else "firm"), "" if blank else core, [], "", "", []
        tokens = [t for t in _tokens(folded) if t and t not in _TITLES]
        generation = next((GENERATIONS[t] for t in tokens if t in GENERATIONS), "")
        tokens = [t for t in tokens if t not in GENERATIONS]
        if not tokens or " ".join(tokens) in _PLACEHOLDERS:
            return "none", "", [], "", "", []
        legal = [t for t in tokens if t in _LEGAL]
        partners = [t for t in tokens if self.partner(t)]
        rest = [t for t in tokens if t not in _LEGAL and t not in partners]
        found = [self.trade(t) if len(rest) > 1 and t not in self.formal else () for t in rest]
        # where a common word of trade stands, a mere likeness to another, unrelated one is a piece of the core
        sure = {w for t, f in zip(rest, found, strict=True) if t in self.common for w in f}
        related = sure | {b for w in sure for b in self.beside.get(w, ())}
        found = [f if not sure or t in self.common or related & set(f) else () for t, f in zip(rest, found, strict=True)]
        left = [t for t, f in zip(rest, found, strict=True) if not f]
        trades = [w for f in found for w in f]
        trades += [b for w in trades for b in self.beside.get(w, ()) if b in self.trades]
        if legal or partners or trades:
            # a single letter between words of a firm is a cut-off piece of its core
            if left:
                return "firm", "".join(left), [" ".join(sorted(set(trades)))] if trades else [], "", "", left
            return "firm", " ".join(sorted(set(trades))) or " ".join(tokens), ["*"], "", "", []
        letters = [t for t in left if len(t) == 1]
        long = [t for t in left if len(t) > 1]
        if not long:
            return "none", "", [], "", "", []
        given = [t for t in long if t in self.formal] or [t for t in long[:1] + long[-1:] if len(long) > 1 and self.first(t)]
        if given and len(long) > 1:
            g = given[0]
            surname = [t for k, t in enumerate(long) if k != long.index(g)]
            return "person", "".join(surname), list(self.first(g)), generation, "", surname
        if letters:
            return "person", "".join(long), [], generation, letters[0], long
        if len(long) == 1:
            return "firm", long[0], [], "", "", []
        return "person", "".join(long[1:]), [long[0]], generation, "", long


_READ = "name string, kind string, core string, context string, options array<string>, generation string, initial string, turn string, words array<string>"


def read_names(names: DataFrame) -> DataFrame:
    """Every different name taken apart; ``names`` has the column ``name``."""
    spark = names.sparkSession
    once = materialize(names.where("name is not null").select("name").distinct())
    total = once.count()
    folded = F.translate(F.lower("name"), "áàâäãéèêëíìîïóòôöõúùûüçñ", "aaaaaeeeeiiiiooooouuuucn")
    legal = F.arrays_overlap("t", F.array(*[F.lit(x) for x in LEGAL]))
    least = max(LEXICON_LEAST, int(LEXICON_SHARE * total))
    # at most 1/LEXICON_SHARE times the mean number of tokens
    lexicon = (
        once.select(F.array_distinct(F.split(folded, "[^a-z0-9]+")).alias("t"))
        .select(F.explode("t").alias("w"), legal.alias("legal"))
        .where("length(w) >= 4")
        .groupBy("w").agg(F.count("*").alias("n"), F.count_if("legal").alias("l"))
        .where((F.col("n") >= least) & (F.col("l") >= TRADE_LEGAL * F.col("n"))).select("w", "n")
    )
    skip = {*LEGAL, *PARTNERS, *TITLES, *GENERATIONS, *REMARK_WORDS}
    frequency = {r["w"]: r["n"] for r in lexicon.collect() if r["w"] not in skip}
    words = sorted(frequency, key=lambda w: (-frequency[w], w))
    # how often two words of trade stand in one name; at most as many pairs as the lexicon has
    listed = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
    both = (
        once.select(F.array_intersect(F.split(folded, "[^a-z0-9]+"), listed).alias("t")).where("size(t) > 1")
        .select("t", F.explode("t").alias("a")).select("a", F.explode("t").alias("b")).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))
    )
    beside: dict[str, list[str]] = defaultdict(list)
    for r in both.collect():
        if r["n"] >= ALWAYS_BESIDE * frequency[r["a"]]:
            beside[r["a"]].append(r["b"])
    shared = spark.sparkContext.broadcast((words, dict(beside)))

    columns = ["name", "kind", "core", "context", "options", "generation", "initial", "turn", "words"]
    schema = pa.schema([(c, pa.list_(pa.string()) if c in ("options", "words") else pa.string()) for c in columns])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = NameReader(*shared.value)
        for batch in batches:
            rows = []
            for name in batch["name"].to_pylist():
                kind, core, options, generation, initial, words = reader.read_words(name)
                # what must be equal where words are turned round; the first of all words of a name is in its core elsewhere
                everything = len(options) == 1 and len("".join(words)) > len(core)
                turn = "|".join((kind, "?" if everything else "/".join(options), generation, initial)) if len(words) > 1 else None
                rows.append((name, kind, core, options[0] if len(options) == 1 else None, options, generation, initial, turn, words))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [()] * len(columns), schema, strict=True)], schema=schema)

    return once.repartition(parallelism_of(once)).mapInArrow(read, _READ)


def odd_cores(cores: DataFrame) -> DataFrame:
    """``core`` of those with three letters in a row that hardly any other core has."""
    total = max(1, cores.count())
    marked = F.concat(F.lit("^"), F.col("core"), F.lit("$"))
    threes = cores.select("core", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("core")), lambda k: F.substring(marked, k, F.lit(3))))).alias("three"))
    # of cores of a-z and 0-9 there are at most 38 ** 3 different ones
    rare = threes.groupBy("three").agg(F.count("*").alias("n")).where(F.col("n") - 1 <= ODD_SHARE * total).select("three")
    return threes.join(rare, "three").select("core").distinct()


def _plausible(edges: DataFrame, odd: DataFrame) -> DataFrame:
    """Without neighbours at two edits, none of them a swap, that both look like names of their own.

    ``odd`` has ``core`` and ``alone``, as what looks odd among names without a context is another matter. Where letters
    were swapped, the distance without swaps is greater.
    """
    edges = edges.withColumn("alone", F.startswith("scope", F.lit("?")))
    for side in ("a", "b"):
        edges = edges.join(odd.select(F.col("core").alias(side), "alone", F.lit(True).alias(f"odd_{side}")), [side, "alone"], "left")
    return edges.where("d <= 1 or levenshtein(a, b) > d or odd_a or odd_b").select("scope", "a", "b", "d")


def _roots(nodes: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """``(key, core, root)``: of each core the best neighbour in its scope, twice, so that a variant of a variant comes to the same core.

    ``nodes`` has ``key``, ``scope``, ``core`` and how often it is written, ``n``.
    """
    near = nodes.withColumnRenamed("core", "a").withColumnRenamed("n", "own").join(edges, ["scope", "a"]).join(nodes.select("scope", F.col("core").alias("b"), "n"), ["scope", "b"])
    better = near.where((F.col("n") > F.col("own")) | ((F.col("n") == F.col("own")) & (F.col("b") < F.col("a"))))
    up = better.groupBy(*key, F.col("a").alias("core")).agg(F.max_by("b", F.struct(-F.col("d"), F.col("n"), F.col("b"))).alias("up"))
    first = materialize(nodes.join(up, [*key, "core"], "left").select(*key, "core", F.coalesce("up", "core").alias("root")))
    for _ in range(2):
        step = first.select(*key, F.col("core").alias("root"), F.col("root").alias("next"))
        first = first.join(step, [*key, "root"], "left").select(*key, "core", F.coalesce("next", "root").alias("root"))
    return materialize(first)


def resolve_names(records: DataFrame, record_id: str = "id", name: str = "name") -> DataFrame:
    """``(record_id, name, entity)``: records with a name that means somebody, with the key of whom it means.

    Null, blank and placeholder names, those without letters and digits or with only one repeated, and records without an identifier, are left out; a record with several names has a
    row for each; repeated rows count once; an empty table gives no rows; other columns are not read.
    """
    held = materialize(records.select(F.col(record_id).cast("string").alias("record_id"), F.col(name).alias("name")).where("record_id is not null and name is not null").distinct())
    read = materialize(read_names(held).where("kind <> 'none' and core <> ''"))
    counts = held.groupBy("name").agg(F.count("*").alias("n"))
    nodes = (
        read.where("context is not null").join(counts, "name")
        .groupBy("kind", "context", "generation", "core").agg(F.sum("n").alias("n"))
    )
    nodes = materialize(nodes)
    key = ["kind", "context", "generation"]
    scope = F.concat_ws("|", *key)
    # names without a context that are alike in all but the core are a scope of their own
    own = F.concat_ws("|", F.lit("?"), "kind", F.array_join("options", "/"), "initial", "generation")
    loose = read.where("context is null").withColumn("own", own)
    bare = materialize(loose.join(counts, "name").groupBy("own", "kind", "core", "options", "generation", "initial").agg(F.sum("n").alias("n")))
    odd = odd_cores(nodes.select("core").distinct())
    odd_bare = odd_cores(nodes.select("core").union(bare.select("core")).distinct()).join(bare, "core", "left_semi")
    odd = materialize(odd.withColumn("alone", F.lit(False)).unionByName(odd_bare.withColumn("alone", F.lit(True))))
    # one pass finds the neighbours within contexts, and those of names without a context among all cores of their kind and
    # among themselves; only odd-looking cores may be two edits off
    part = F.concat_ws("|", F.lit("*"), "kind", "generation")
    within_context = nodes.select(scope.alias("scope"), F.col("core").alias("word"))
    # numbers one digit apart are different names
    within_bare = bare.where("core rlike '[^0-9]'").select(F.col("own").alias("scope"), F.col("core").alias("word"))
    within_all = within_context.unionByName(within_bare)
    wanted = materialize(bare.select(part.alias("scope"), F.col("core").alias("word")).distinct())
    any_context = nodes.select(part.alias("scope"), F.col("core").alias("word")).distinct()
    near = trie_join(within_all, more=[(any_context, wanted)])
    found = materialize(_plausible(near, odd))
    release(near)
    loose_edges, bare_edges = found.where("startswith(scope, '*')"), found.where("startswith(scope, '?')")
    canon = _roots(nodes.withColumn("scope", scope), found.where("not scope rlike '^[*?]'"), key)
    bare_roots = _roots(bare.select(F.col("own").alias("scope"), "core", "n"), bare_edges, ["scope"]).withColumnRenamed("scope", "own")

    def entity(kind: str = "kind") -> F.Column:
        return F.concat_ws("|", F.col(kind), "root", "context", "generation")

    exact = read.where("context is not null").join(canon, [*key, "core"]).select("name", entity().alias("entity"))
    # names with an initial, several formal names or no trade belong to the only entity that fits
    around = wanted.select("scope", F.col("word").alias("a"), F.col("word").alias("b"), F.lit(0).alias("d")).unionByName(loose_edges.select("scope", "a", "b", "d"))
    targets = canon.select("kind", F.col("context"), "generation", F.col("core").alias("b"), "root")
    fits = (F.size("options") > 0) & F.array_contains("options", F.col("context")) | (F.size("options") == 0) & ((F.col("initial") == "") | F.col("context").startswith(F.col("initial")))
    met = materialize(
        bare.withColumn("scope", part).withColumnRenamed("core", "a").join(around, ["scope", "a"])
        .join(targets, ["kind", "generation", "b"]).where(fits)
        .groupBy("own", F.col("a").alias("core"), "d").agg(F.min(entity()).alias("one"), F.max(entity()).alias("other"))
        # the nearest decide: if they are one entity, the name belongs to it
        .groupBy("own", "core").agg(F.min_by(F.struct("one", "other"), "d").alias("near"))
        .select("own", "core", F.when(F.col("near.one") == F.col("near.other"), F.col("near.one")).alias("entity"), F.lit(True).alias("several"))
    )
    # what meets no entity goes with its root; what meets several stays apart from each, but together with its like
    of_root = met.select("own", F.col("core").alias("root"), F.col("entity").alias("root_entity"))
    alone = F.concat_ws("|", "own", "root")
    placed = bare_roots.join(met, ["own", "core"], "left").join(of_root, ["own", "root"], "left")
    placed = placed.select("own", "core", F.coalesce("entity", F.when(F.col("several").isNull(), F.col("root_entity")), alone).alias("entity"))
    rest = loose.join(placed, ["own", "core"]).select("name", "entity")
    means = materialize(exact.unionByName(rest))
    # entities whose names only differ in the order of their words are one
    release(nodes, bare, odd, wanted, found, met)
    turns = materialize(turned_pairs(read.where("turn is not null").select("name", "turn", "words").join(means, "name")))
    if not turns.isEmpty():
        groups = connected_components(turns).select(F.col("record_id").alias("entity"), F.col("group_id"))
        release(turns)
        means = means.join(groups, "entity", "left").select("name", F.coalesce("group_id", "entity").alias("entity"))
    return held.join(means, "name").select("record_id", "name", "entity")


def linked_pairs(resolved: DataFrame) -> DataFrame:
    """``(left_id, right_id)``: every two different records of one entity, smaller identifier first."""
    r = resolved.select("record_id", "entity").distinct()
    left, right = r.withColumnRenamed("record_id", "left_id"), r.withColumnRenamed("record_id", "right_id")
    return salted_join(left, right, "entity", "inner").where("left_id < right_id").select("left_id", "right_id").distinct()
