"""Training-data operators against brute force, exact round trips, and odd cases."""

import datetime as dt
import random
import string

import numpy as np
import pytest

from drayline.llm.addresses import located_pairs, read_address, resolve_addresses, town_key
from drayline.llm.components import connected_components
from drayline.llm.leaks import Patterns, find_leaks, words_of
from drayline.llm.names import NICKNAMES, NameReader, linked_pairs, resolve_names, within
from drayline.llm.packing import count_tokens, enumerate_patterns, fit_counts, pack, packing_quality, plan_packing
from drayline.llm.survivorship import canonical_fields, fit_sources, judge_facts, retained_values, surviving_values
from drayline.llm.trie_join import CUTS, FEW_CUTS, _keys, neighbours, neighbours_of_all, trie_join
from drayline.llm.truncation import judge_endings, symbol, truncation_rates


def edit_distance(a: str, b: str) -> int:
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def slip(rng: random.Random, word: str) -> str:
    k = rng.randrange(len(word) - 1)
    kind = rng.randrange(4)
    letter = rng.choice(string.ascii_lowercase)
    return [word[:k] + word[k + 1 :], word[:k] + letter + word[k:], word[:k] + letter + word[k + 1 :], word[:k] + word[k + 1] + word[k] + word[k + 2 :]][kind]


# --- trie join


def test_trie_join_finds_all_that_brute_force_finds(spark, monkeypatch):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(4, 13))) for _ in range(130)]
    words = sorted({*base, *(slip(rng, w) for w in base), *(slip(rng, slip(rng, w)) for w in base), *(slip(rng, slip(rng, w)) for w in base), "ab", ""})
    df = spark.createDataFrame([("s", w) for w in words] + [("t", words[0]), (None, "abcdef"), ("s", None)], "scope string, word string")
    most = {w: 2 if len(w) >= 8 else 1 if len(w) >= 4 else 0 for w in words}
    near = {(a, b): d for a in words for b in words if a != b and abs(len(a) - len(b)) <= 2 and (d := edit_distance(a, b)) <= min(most[a], most[b])}
    assert sum(d == 2 for d in near.values()) > 150
    # as one shard, in pieces, and in blocks
    for scope_words, block_rows, batch_from in ((2000, 4000, 400), (10, 4000, 400), (10, 7, 1), (2000, 30, 1)):
        monkeypatch.setattr("drayline.llm.trie_join.SCOPE_WORDS", scope_words)
        monkeypatch.setattr("drayline.llm.trie_join.BLOCK_ROWS", block_rows)
        monkeypatch.setattr("drayline.llm.trie_join.BATCH_FROM", batch_from)
        assert {(r.a, r.b): r.d for r in trie_join(df).collect()} == near
        some = spark.createDataFrame([("u", w) for w in words[::3]], "scope string, word string")
        others = spark.createDataFrame([("u", w) for w in words], "scope string, word string")
        got = {(r.scope, r.a, r.b) for r in trie_join(df, more=[(others, some)]).collect()}
        assert got == {("s", *p) for p in near} | {("u", *p) for p in near if p[0] in words[::3]}
    assert trie_join(df.limit(0)).count() == 0


def test_swaps_at_the_ends_of_pieces_are_found(spark, monkeypatch):
    monkeypatch.setattr("drayline.llm.trie_join.SCOPE_WORDS", 0)
    for n in (8, 9, 10, 11, 14):
        word = string.ascii_lowercase[:n]
        swaps = [word[:k] + word[k + 1] + word[k] + word[k + 2 :] for k in range(n - 1)]
        twice = {w[:k] + w[k + 1] + w[k] + w[k + 2 :] for w in swaps for k in range(n - 1)} - {word}
        df = spark.createDataFrame([("s", w) for w in {word, *twice}], "scope string, word string")
        assert {r.b for r in trie_join(df).where(f"a = '{word}'").collect()} == {w for w in twice if edit_distance(word, w) <= 2}


def test_all_automata_at_once_find_what_each_finds():
    rng = random.Random(8)
    for letters in ("ab", "abc", "abcd") * 8:
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(0, 7))) for _ in range(70)})
        asked = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(0, 7))) for _ in range(40)})
        rng.shuffle(words)
        trie = {}
        for w in words:
            node = trie
            for letter in w:
                node = node.setdefault(letter, {})
            node[""] = w
        most = np.array([rng.randint(0, 2) for _ in asked])
        want = {(q, w, d) for q, m in zip(asked, most) for w, d in neighbours(trie, q, m)}
        assert want == {(q, w, edit_distance(q, w)) for q, m in zip(asked, most) for w in words if edit_distance(q, w) <= m}
        assert {(asked[i], words[j], int(d)) for i, j, d in zip(*neighbours_of_all(words, asked, most))} == want


@pytest.mark.parametrize("cuts", [CUTS, FEW_CUTS])
def test_neighbours_share_a_shard_and_few_others_do(cuts):
    rng = random.Random(3)
    base = ["".join(rng.choice(string.ascii_lowercase) for _ in range(n)) for n in range(4, 30) for _ in range(8)]
    words = sorted({*base, *(slip(rng, w) for w in base), *(slip(rng, slip(rng, w)) for w in base)} - {""})
    numbers, keys = _keys(np.array(words), np.zeros(len(words), np.uint64), cuts)
    shards = {}
    for i, k in set(zip(numbers.tolist(), keys.tolist())):
        shards.setdefault(k, []).append(i)
    together = {(min(i, j), max(i, j)) for s in shards.values() for i in s for j in s if i != j}
    for i, a in enumerate(words):
        for j in range(i + 1, len(words)):
            most = 2 if min(len(a), len(words[j])) >= 8 else 1
            if min(len(a), len(words[j])) >= 4 and abs(len(a) - len(words[j])) <= most and (i, j) not in together:
                assert not within(a, words[j], most), (a, words[j])
    # pieces of two letters, as before, brought together about fifty times as many
    assert len(together) < 12 * len(words)


def test_large_shards_that_nobody_asks_are_left(spark, monkeypatch):
    for name, most in (("SCOPE_WORDS", 0), ("BLOCK_ROWS", 5)):
        monkeypatch.setattr(f"drayline.llm.trie_join.{name}", most)
    words = [f"abcdefgh{x}{y}" for x in "ijklm" for y in "nopqr"]
    index = spark.createDataFrame([("s", w) for w in [*words, "zyxwvuts"]] + [("t", w) for w in words], "scope string, word string")
    asked = spark.createDataFrame([("s", "zyxwvutt"), ("s", "abcdefghin"), ("u", "abcdefghin")], "scope string, word string")
    got = {(r.scope, r.a, r.b, r.d) for r in trie_join(index, asked).collect()}
    assert got == {("s", "zyxwvutt", "zyxwvuts", 1)} | {("s", "abcdefghin", w, edit_distance("abcdefghin", w)) for w in words if w != "abcdefghin"}


# --- names


def test_unlisted_words_are_compared_with_few_listed_ones(monkeypatch):
    rng, calls = random.Random(4), []
    reader = NameReader(TRADES)
    monkeypatch.setattr("drayline.llm.names.within", lambda a, b, most: calls.append(a) or within(a, b, most))
    words = ["".join(rng.choice(string.ascii_lowercase) for _ in range(9)) for _ in range(200)]
    for w in words:
        reader.read(f"{w} & Sons Hauling LLC")
        reader.read(f"Maria {w}")
    # comparing each word with all listed ones takes over 50 calls a word
    assert len(calls) < 2 * len(words)
    slips = [slip(rng, slip(rng, w)) for w in [*TRADES, *NICKNAMES] for _ in range(20) if len(w) > 2]
    for w in slips:
        assert reader.near_trades.of(w) == [x for x in reader.trades if within(w, x, 2 if len(x) >= 8 else 1)]
        assert reader.near_first.of(w) == [x for x in NICKNAMES if within(w, x, 2 if len(x) >= 9 else 1)]


TRADES = "hauling masonry roofing dental group auto parts storage self landscaping masnry".split()


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Acmerdolm & Sons Hauling LLC", "HAULING, ACMERDOLM", True), ("Acmerdolm Hauling", "Acmerdolm Roofing", False), ("Bill Vontisolm", "VONTISOLM, WILLIAM R.", True), ("William Vontisolm Jr", "William Vontisolm Sr.", False),
        ("Groc Autoparts", "Groc Auto Pts Inc.", True), ("Dr. José Pidrugand (see file)", "Jose P. Pidrugand", True), ("Fond ratane Haulg", "Fondratane Hauling", True), ("William Vontisolm", "Robert Vontisolm", False),
    ],
)
def test_parts_of_names(a, b, same):
    reader = NameReader([*TRADES, "haulg"], {"auto": ["parts"], "parts": ["auto"]})
    assert (reader.read(a)[:4] == reader.read(b)[:4]) == same


def test_placeholders_are_nobody_and_slips_are_counted():
    reader = NameReader(TRADES)
    assert {reader.read(x)[0] for x in ("n/a", " UNKNOWN ", "-", "", "see notes", "Test test", "Cash Customer")} == {"none"}
    assert within("dringerpova", "drnigerpoav", 2) and not within("abcd", "abef", 1)


def test_names_are_linked(spark):
    firms = [(f"f{k}", f"{''.join(c)}dorp Hauling LLC", 0) for k, c in enumerate(zip("bcdfghjklm", "aeiouaeiou", "mnprtvwxyz", "ouaeiouaei", "bdfhjlnprt"))]
    rows = firms + [("1", "Quenlogane Hauling LLC", 1), ("2", "Quenlgoane & Sons Hauling", 1), ("3", "E. Fabechen", 1), ("4", "Elizabeth Fabechen", 1), ("5", "Fabechen, Liz", 1), ("6", None, 1), ("7", "unknown", 1), ("8", "unknown", 1), ("9", "x" * 20_000, 1), ("4", "Elizabeth Fabechen", 1), (None, "Elizabeth Fabechen", 1), ("10", "Edward Vontorp", 1), ("11", "Elizabeth Vontorp", 1), ("12", "E. Vontorp", 1)]
    df = spark.createDataFrame(rows, "id string, name string, kind int")
    got = {tuple(r) for r in linked_pairs(resolve_names(df)).collect()}
    assert got == {("1", "2"), ("3", "4"), ("3", "5"), ("4", "5")}
    assert linked_pairs(resolve_names(df.limit(0))).count() == 0


def test_names_without_context_meet_each_other(spark):
    rows = [("1", "Cinblukorp"), ("2", "the cunblukorp"), ("3", "J. Dringersmith"), ("4", "Dringersmth, J."), ("5", "K. Dringersmith"), ("6", "Jitiven, Inc."), ("7", "Jitivn LLC"), ("8", "Chris Pidrugand"), ("9", "Chris Pidrugnad"), ("10", "5551234"), ("11", "5551235"), ("12", "Elizabeth Fabechen"), ("13", "Edward Fabechen"), ("14", "E. Fabechen"), ("15", "E. Fabechn")]
    got = {tuple(r) for r in linked_pairs(resolve_names(spark.createDataFrame(rows, "id string, name string"))).collect()}
    assert got == {("1", "2"), ("3", "4"), ("6", "7"), ("8", "9"), ("14", "15")}


def test_words_in_another_order_are_linked(spark):
    firms = [(f"f{k}", f"{''.join(c)}dorp Hauling LLC") for k, c in enumerate(zip("bcdfghjklm", "aeiouaeiou", "mnprtvwxyz", "ouaeiouaei", "bdfhjlnprt"))]
    rows = firms + [("1", "Zelda Fitzmor"), ("2", "Fitzmor, Zelda"), ("3", "Fitzmr Zelda"), ("4", "Vontis Kerdol Hauling"), ("5", "Kerdol Vontis Hauling LLC"), ("6", "Hauling Kredol Vontis"), ("7", "Zelda Fitzmor Jr"), ("8", "Zelda Fabechen"), ("9", "Maria Nuvok"), ("10", "Mario Nuvok"), ("11", "Q. Bexter Dolm"), ("12", "Dolm Bexter, Q."), ("13", "Yorick van Trebolm"), ("14", "van Trebolm, Yorick")]
    got = {tuple(r) for r in linked_pairs(resolve_names(spark.createDataFrame(rows, "id string, name string"))).collect()}
    assert got == {("1", "2"), ("1", "3"), ("2", "3"), ("4", "5"), ("4", "6"), ("5", "6"), ("11", "12"), ("13", "14")}


def test_names_without_latin_words_are_linked(spark):
    names = ["3M", "3m", "3M Company", "7-11", "7-11", "A & B", "a+b", "Иванов Пётр", "иванов петр", "Кафе LLC", "Сталь LLC", "王伟", "王伟", "N/A", "N.A.", "N.A.", "0", "000", "x", "X.", "??", "??"]
    rows = [(f"{k:02}", n) for k, n in enumerate(names)]
    got = {tuple(r) for r in linked_pairs(resolve_names(spark.createDataFrame(rows, "id string, name string"))).collect()}
    assert got == {("00", "01"), ("00", "02"), ("01", "02"), ("03", "04"), ("05", "06"), ("07", "08"), ("11", "12")}


# --- addresses


def test_parts_of_addresses():
    assert read_address("8656, Wicketlock La, Apt 26B")[0] == ("8656", "26b", "wicketlock", "ln", "", "", "")
    assert read_address("Fallowholm Ct East 1080")[0] == ("1080", "", "fallowholm", "ct", "e", "", "")
    assert read_address("44650-1234 Brindle Jct, 2654 N Lar chgrove Ter, #35") == [("2654", "35", "larchgrove", "ter", "n", "brindlejunction", "44650")]
    assert read_address("P.O. Box #11")[0][:3] == ("11", "", "box") and read_address("see notes") == [] and read_address("12") == []


@pytest.mark.parametrize(
    ("text", "city", "number", "core", "town", "zip_code"),
    [
        ("12345 Main St, Springfield", None, "12345", "main", "springfield", ""), ("123456 Oak Rd, Dayton", None, "123456", "oak", "dayton", ""), ("N6W23001 Bluemound Rd, Dayton", None, "n6w23001", "bluemound", "dayton", ""),
        ("10-12 Oak St, Dayton", None, "10-12", "oak", "dayton", ""), ("123 1/2 Oak St, Dayton", None, "123h", "oak", "dayton", ""), ("45402 Dayton, 12 Oak St", None, "12", "oak", "dayton", "45402"),
        ("12 Oak St Dayton OH 45402", None, "12", "oak", "dayton", "45402"), ("12 Oak St Fort Wayne", "Ft. Wayne", "12", "oak", "fortwayne", ""), ("12 Oak St", "Dayton", "12", "oak", "dayton", ""), ("12345 Oak St, Dayton 45402", None, "12345", "oak", "dayton", "45402"),
    ],
)
def test_numbers_zips_and_towns(text, city, number, core, town, zip_code):
    assert (number, core, town, zip_code) in [(r[0], r[2], r[5], r[6]) for r in read_address(text, city)]


def test_towns_without_a_mark_are_found_by_the_beam(spark):
    rows = [(f"k{k}", f"{k} Willow St, Dayton", None, "45402") for k in range(1, 9)] + [(f"m{k}", f"{k} Elm Rd, Fort Wayne", None, None) for k in range(1, 9)]
    rows += [("a", "3 Willow St Dayton OH 45402", None, None), ("b", "3 Willow St Dayton", None, None), ("c", "3 Willwo St Dayton", None, None), ("d", "4 Elm Rd Ft Wayne", None, None), ("e", "4 Elm Rd", "Fort Wayne", None), ("f", "7 Ash Ct Dayton", None, None), ("g", "7 Ash Ct, Dayton", None, None), ("h", "7 Nowhere", None, None)]
    got = {(r.left_id, r.right_id) for r in located_pairs(resolve_addresses(spark.createDataFrame(rows, "record_id string, address string, city string, zip string"))).collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "c"), ("a", "k3"), ("b", "k3"), ("c", "k3"), ("d", "e"), ("d", "m4"), ("e", "m4"), ("f", "g")}
    assert town_key("Ft. Norwith") == town_key("FORT  NORWITH") != town_key("Port Norwith")


def test_addresses_are_linked(spark):
    filler = [(f"x{k}", f"{k} {n} St", "Varney", "41744") for n in ("Otterford", "Kestrelrun") for k in range(1, 9)]
    rows = filler + [
        ("1", "100 Otterford Street", "Varney", "41744"), ("2", "Oterford St 100", "Varnye", "41744-1111"), ("3", "100 Otterford Ave", "Varney", "41744"), ("4", "100 N Otterford St", "Varney", None), ("5", "100 Otterford St, Varney 41744", None, ""),
        ("6", "200 Kestrelrun St Ste 1", "Varney", None), ("7", "Suite 1, 200 Kestrelrun Str.", None, "41744"), ("8", "200 Kestrelrun St #2", "Varney", ""), ("9", "PO Box 7", "Varney", None), ("10", "box 7", None, "41744"),
        ("11", None, "Varney", None), ("12", "unknown", "Varney", None), ("13", "", "Varney", None), ("14", "1 " + "z" * 20_000, "Varney", None), ("1", "100 Otterford Street", "Varney", "41744"), ("15", "5 Nowhere St", None, None), ("16", "100 Otterford", "Varney", None),
    ]
    df = spark.createDataFrame(rows, "record_id string, address string, city string, zip string").selectExpr("*", "'u' as unit", "1 as number")
    got = {tuple(r) for r in located_pairs(resolve_addresses(df)).collect()}
    assert {("1", "2"), ("1", "5"), ("2", "5"), ("6", "7"), ("10", "9")} <= got
    assert not {p for p in got if {"3", "4", "8", "11", "12", "13", "14", "15"} & set(p)}
    assert located_pairs(resolve_addresses(df.limit(0))).count() == 0


# --- groups


def groups_of(pairs):
    least = {}
    for a, b in pairs:
        if a and b and a.strip() and b.strip():
            least.setdefault(a, a), least.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if a in least and b in least and least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    return least


def test_each_town_has_its_own_neighbours_of_a_spelling(spark):
    towns = ["Brackton", "Dunmoor", "Felwick", "Gorsham", "Hexdale"]
    rows, want = [], set()
    for k, (town, letter) in enumerate(zip(towns, "abcde", strict=True)):
        rows += [(f"r{k}-{n:02}", f"{n + 1} Maplewor{letter} St", town, "") for n in range(40 - 4 * k)]
        rows.append((f"s{k}", "7 Maplewort St", town, ""))
        want.add((f"r{k}-06", f"s{k}"))
    df = spark.createDataFrame(rows, "record_id string, address string, city string, zip string")
    assert {tuple(r) for r in located_pairs(resolve_addresses(df)).collect()} == want


def test_components_match_brute_force(spark):
    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(400):03d}", f"n{rng.randrange(400):03d}") for _ in range(260)] + [(f"c{k:03d}", f"c{k + 1:03d}") for k in range(60)] + [("hub", f"s{k}") for k in range(300)]
    pairs += [("n001", None), (None, "n002"), ("", "n003"), ("self", "self"), ("n004", "n004"), *pairs[:20], *[(b, a) for a, b in pairs[:20]]]
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in pairs], "left_id string, right_id string, group_id string, record_id int")
    got = {r.record_id: r.group_id for r in connected_components(df).collect()}
    assert got == groups_of(pairs)
    assert connected_components(df.limit(0)).count() == 0


def test_hubs_are_met_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr("drayline.llm.components.MIN_HUB_EDGES", 50)
    monkeypatch.setattr("drayline.llm.components.HUB_SHARE", 0.01)
    pairs = [("m", f"s{k:03d}") for k in range(300)] + [(f"s{k:03d}", f"t{k:03d}") for k in range(0, 300, 7)] + [("a", "s005")]
    df = spark.createDataFrame(pairs, "left_id string, right_id string")
    assert {r.record_id: r.group_id for r in connected_components(df).collect()} == groups_of(pairs)


# --- survivors


def member(cluster, record, day, source="A", name=None, phone=None, email=None, address=None):
    return (cluster, record, source, None if day is None else dt.datetime(2020, 1, day), name, phone, email, address, "x")


MEMBERS = "cluster_id string, record_id string, source string, updated_at timestamp, name string, phone string, email string, address string, fact string"


def test_survivors(spark):
    rows = [
        member("k", "3", 9, name="Acme Pl", phone="1234567890", email="ap@acme", address="12"), member("k", "2", 8, "B", "Acme Plumbing", "(327) 555-0100", "ap@acme.example", "12 Oak St"),
        member("k", "1", 2, "A", "Acme Plumbing", "327.555.0101", "p@@acme.example", "12�Oak St"), member("k", "4", 1, None, "Old Name", None, "old@acme.example", None), member("k", "4", 1, None, "Old Name", None, "old@acme.example", None),
        member("t", "1", 5, name="Beta"), member("t", "2", 5, name="Alpha"), member("n", "1", None, name="Only"), member("e", "1", 3, name="n/a", phone="", email=None, address="see notes"), member(None, "9", 3, name="No"), member("k", None, 9, name="Newer"), member("l", "1", 1, name="y" * 50_000),
    ]
    df = spark.createDataFrame(rows, MEMBERS)
    got = {(r.cluster_id, r.field_name): r.record_id for r in surviving_values(df).collect()}
    assert got == {("k", "name"): "1", ("k", "phone"): "2", ("k", "email"): "2", ("k", "address"): "2", ("t", "name"): "1", ("n", "name"): "1", ("l", "name"): "1"}
    kept = {(r.cluster_id, r.field_name, r.fact) for r in retained_values(df).collect()}
    assert ("k", "email", "ap@acme.example") in kept and ("k", "email", "old@acme.example") not in kept
    both = [member("v", f"{s}{k}", k, s, name=f"Name {k}") for s in "AB" for k in (1, 2)]
    assert {r.fact for r in retained_values(spark.createDataFrame(both, MEMBERS)).collect()} == {"name 1", "name 2"}
    assert surviving_values(df.limit(0)).count() == 0


def test_pieces_of_crowded_groups_are_found_alike(spark, monkeypatch):
    rows = [member("k", str(k), 1 + k % 20, name=n) for k, n in enumerate(["Acme Plumbing Supply", "Acme Plu", "Plumbing", "umbing Supply", "Other Firm", "Acme Plumbing Supply Co"] + [f"Firm {c}xyz" for c in "abcdefgh"])]
    df = spark.createDataFrame(rows, MEMBERS)

    def usable():
        return {r.fact for r in judge_facts(df)[1].where("usable").collect()}

    first = usable()
    monkeypatch.setattr("drayline.llm.survivorship.MAX_VALUES_IN_ROW", 3)
    assert usable() == first and "other firm" in first and not {"acme plu", "plumbing", "umbing supply", "acme plumbing supply"} & first


def test_pieces_cut_on_both_sides_are_found_in_crowded_groups(spark):
    names = ["Acme Plumbing Supply", "umbing Sup", "cm", "Plumbing Sup " + "y" * 5_000, "Bad\ufffd Other Firm", "ther Fir", "naïve œuvre GmbH", "ïve œuv"] + [f"Firm {c}{d}xyz" for c in "abcdefgh" for d in "qrstu"]
    df = spark.createDataFrame([member("k", str(k), 1 + k % 20, name=n) for k, n in enumerate(names)], MEMBERS)
    usable = {r.fact for r in judge_facts(df)[1].where("usable").collect()}
    lower = [n.lower() for n in names]
    whole = {n for n in lower if "\ufffd" not in n and not any(n != o and n in o for o in lower if "\ufffd" not in o)}
    assert usable == whole and not {"umbing sup", "cm", "ïve œuv"} & usable and "ther fir" in usable


def test_sources_get_their_quality():
    patterns = [(("good",), ("bad",), (), 500), (("bad",), (), ("good",), 300), (("bad",), ("good",), (), 20), (("bad", "good"), (), (), 50)]
    rates, truth = fit_sources(patterns)
    assert rates["good"][0, 0] > rates["bad"][0, 0] and rates["bad"][1, 0] > rates["good"][1, 0] and truth[0] > 0.9 > 0.1 > truth[1] and truth[3] > 0.9


def liars(honest_day):
    """A source that is nearly always corrected, and clusters in which nobody corrected it."""
    rows = []
    for k in range(200):
        rows += [member(f"c{k:03d}", "1", 5, "liar", name=f"Wrong Firm {k}x"), member(f"c{k:03d}", "2", 9, "one", name=f"Right Firm {k}x"), member(f"c{k:03d}", "3", 8, "two", name=f"Right Firm {k}x")]
    for k in range(5):
        rows += [member(f"z{k}", "1", 9, "liar", name=f"Wrong House {k}x"), member(f"z{k}", "2", honest_day, "one", name=f"Right House {k}x"), member(f"z{k}", "3", honest_day, "two", name=f"Right House {k}x")]
    return rows


def test_a_late_value_of_a_source_that_is_mostly_wrong_loses(spark, monkeypatch):
    df = spark.createDataFrame(liars(7), MEMBERS)
    got = {r.cluster_id: (r.value, r.record_id) for r in surviving_values(df).collect()}
    assert all(got[f"z{k}"] == (f"Right House {k}x", "2") for k in range(5)) and got["c007"] == ("Right Firm 7x", "2")
    # an honest source's late value wins
    fair = spark.createDataFrame([(*r[:2], "three" if r[0][0] == "z" and r[2] == "liar" else r[2], *r[3:]) for r in liars(7)], MEMBERS)
    assert {r.value for r in surviving_values(fair).where("cluster_id like 'z%'").collect()} == {f"Wrong House {k}x" for k in range(5)}
    # the rounds on all executors come to the same
    near = {(r.cluster_id, r.fact): round(r.p_true, 6) for r in judge_facts(df)[1].collect()}
    monkeypatch.setattr("drayline.llm.survivorship.LOCAL_PATTERNS", 1)
    assert {(r.cluster_id, r.fact): round(r.p_true, 6) for r in judge_facts(df)[1].collect()} == near


def test_values_of_many_clusters_are_fillers_only_if_contradicted(spark):
    rows = [member(f"c{k}", "1", 9, name="John Smith", phone="3275550100") for k in range(15)] + [member(f"c{k}", "2", 5, name=None if k else "Jo", phone=f"41255501{k:02d}") for k in range(15)]
    got = {(r.cluster_id, r.field_name): r.value for r in surviving_values(spark.createDataFrame(rows, MEMBERS)).collect()}
    assert got["c3", "name"] == "John Smith" and got["c3", "phone"] == "4125550103"


def test_canonical_fields(spark):
    rows = [member("k", "1", 9, name="Acme", email="bad"), member("k", "2", 5, name="Old", email="a@acme.example"), member("e", "1", 1, name="n/a")]
    assert {r.cluster_id: r.canonical_fields for r in canonical_fields(spark.createDataFrame(rows, MEMBERS)).collect()} == {"k": {"name": "Acme", "email": "a@acme.example"}}


# --- packing


def test_plans_take_exactly_all_items():
    rng = np.random.default_rng(1)
    for capacity in (1, 7, 64, 512):
        histogram = np.bincount(np.minimum(rng.geometric(4 / capacity if capacity > 4 else 0.7, 3000), capacity), minlength=capacity + 1)
        histogram[0] = 0
        used = np.zeros(capacity + 1, np.int64)
        plan = plan_packing(histogram, capacity)
        for repeats, content in plan:
            assert repeats > 0 and sum(k * n for k, n in content.items()) <= capacity
            for k, n in content.items():
                used[k] += repeats * n
        assert (used == histogram).all()
        containers, total = sum(r for r, _ in plan), int((histogram * np.arange(capacity + 1)).sum())
        assert containers <= 1.02 * total / capacity + 2
    assert plan_packing(np.zeros(9, np.int64), 8) == [] and enumerate_patterns(np.zeros(9, np.int64), 8) == []
    x = fit_counts([(5, 3), (4, 4)], np.array([0, 0, 0, 10, 8, 10, 0, 0, 0]))
    assert abs(x[0] - 10) < 0.5 and abs(x[1] - 4) < 0.5


def test_packing_in_odd_cases(spark, monkeypatch):
    monkeypatch.setattr("drayline.llm.packing.RANK_ROWS", 40)
    rows = [(k, 30) for k in range(300)] + [(1000, 250), (1001, 100), (1002, 0), (1003, None), (5, 30)] + [(2000 + k, k % 99 + 1) for k in range(400)]
    df = spark.createDataFrame([(a, b, 7) for a, b in rows], "doc_id long, n_tokens long, container_id int")
    out = pack(df, 100).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in out if r.doc_id not in (1000,)) == sorted((a, b or 0) for a, b in rows if a != 1000)
    assert sorted((r.piece, r.first_token, r.n_tokens) for r in out if r.doc_id == 1000) == [(0, 0, 100), (1, 100, 100), (2, 200, 50)]
    room = {}
    for r in out:
        if r.container_id is not None:
            room[r.container_id] = room.get(r.container_id, 0) + r.n_tokens
    assert max(room.values()) <= 100 and set(room) == set(range(len(room))) and {r.doc_id for r in out if r.container_id is None} == {1002, 1003}
    assert packing_quality(pack(df, 100), 100).first().overfull == 0
    assert pack(df.limit(0), 100).count() == 0


def test_tokens_are_counted(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (1, "hello world"), (4, "a " * 30_000)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in count_tokens(df).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] >= 30_000


# --- leaks


def brute_leak(item, doc):
    """Whether some part of the item of 15 words or more stands in the document with an edit in seven words."""
    for length in range(15, len(item) + 1):
        for a in range(len(item) - length + 1):
            part = item[a : a + length]
            row = [0] * (len(doc) + 1)
            for i, w in enumerate(part, 1):
                fresh = [i]
                for j, v in enumerate(doc, 1):
                    fresh.append(min(row[j] + 1, fresh[-1] + 1, row[j - 1] + (w != v)))
                row = fresh
            if min(row) <= length // 7:
                return True
    return False


def test_leaks_match_brute_force(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice(string.ascii_lowercase) for _ in range(4)) for _ in range(300)]

    def text(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    items = [(k, " ".join(text(rng.randint(12, 40)))) for k in range(12)]
    docs = []
    for d in range(150):
        words = text(rng.randint(0, 30))
        item = rng.choice(items)[1].split()
        n = rng.randint(5, len(item))
        a = rng.randint(0, len(item) - n)
        part = item[a : a + n]
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(part))
            part = part[:k] + rng.choice([[], ["changed"], ["more", part[k]]]) + part[k + 1 :]
            if not part:
                break
        docs.append((d, " ".join(words + [w.upper() + rng.choice(["", ",", " - "]) for w in part] + text(rng.randint(0, 30)))))
    want = {(d, i) for d, t in docs for i, s in items if brute_leak(words_of(s), words_of(t))}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {tuple(r) for r in find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and len(want) > 10


def test_leaks_in_odd_cases(spark, monkeypatch):
    long = " ".join(f"w{k}" for k in range(20))
    items = [(k, f"Read this and answer. {' '.join(f'{c}{n}' for n in range(18))}") for k, c in enumerate("abc")] + [(7, None), (8, "too short"), (9, long), (9, long), (None, long)]
    docs = [(1, None), (2, ""), (3, "read this and answer"), (4, "zz " * 30_000 + long.replace("w3 ", "W3; ")), (5, long), (5, long), (None, long), (6, " ".join(f"a{n}" for n in range(10)))]
    d, i = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, item_id int"), spark.createDataFrame([(a, b, 2) for a, b in items], "item_id long, text string, doc_id int")
    assert {tuple(r) for r in find_leaks(d, i).collect()} == {(4, 9), (5, 9)}
    monkeypatch.setattr("drayline.llm.leaks.LETTERS_PER_PASS", 150)
    assert {tuple(r) for r in find_leaks(d, i).collect()} == {(4, 9), (5, 9)}
    assert find_leaks(d, i.limit(0)).count() == find_leaks(d.limit(0), i).count() == 0


def test_only_the_instruction_is_cut_off_items(spark, monkeypatch):
    line = " ".join(f"read{n}" for n in range(16)) + "."
    rest = [" ".join(f"{c}{n}" for n in range(14)) for c in "abcdefghijklmnopqrstuvwxyzäöüéèáàóòñ"]
    items = [(k, f"At 3.{k} {r}") for k, r in enumerate(rest[:3])] + [(k, f"Answer briefly: {rest[k]}") for k in range(3, 6)] + [(k, f"{line} {rest[k]} end") for k in range(6, 16)] + [(k, f"{rest[k]} end") for k in range(16, 36)]
    docs = [(k, " ".join(t.split()[:15])) for k, t in items if k < 6] + [(90, line), (91, f"{rest[8]} end")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(k, k) for k in range(6)} | {(91, 8)}
    assert {tuple(r) for r in find_leaks(d, i).collect()} == want
    monkeypatch.setattr("drayline.llm.leaks.LETTERS_PER_PASS", 150)
    assert {tuple(r) for r in find_leaks(d, i).collect()} == want


def test_shifts_skip_no_pattern():
    rng = np.random.default_rng(2)
    words = [f"v{k}" for k in range(40)]
    patterns = Patterns([(1, " ".join(rng.choice(words, 60))), (2, " ".join(rng.choice(words, 60)))])
    text = np.concatenate([rng.integers(0, 41, 4000), patterns.coded[0][3:30], rng.integers(0, 41, 700), patterns.coded[1][:20]])
    place, number = patterns.search(text)
    grams = {}
    for k, g in enumerate(patterns.grams.tolist()):
        grams.setdefault(tuple(g), []).append(k)
    want = sorted((p, k) for p in range(len(text) - 4) for k in grams.get(tuple(text[p : p + 5].tolist()), []))
    assert sorted(zip(place.tolist(), number.tolist())) == want


# --- truncation


def test_cut_texts_are_found(spark):
    rng = random.Random(4)
    nouns, verbs = ["container", "invoice", "schedule", "dispatcher"], ["approved", "cancelled", "delivered", "inspected"]

    def sentence():
        return f"The {rng.choice(nouns)} was {rng.choice(verbs)} by the {rng.choice(nouns)} on {rng.choice(['Monday', 'Friday'])} before the {rng.choice(nouns)}."

    docs, cut = [], set()
    for k in range(400):
        text = " ".join(sentence() for _ in range(rng.randint(2, 5)))
        if k % 10 == 0:
            end = rng.randint(len(text) // 2, len(text) - 3)
            while text[end - 1] in ". " or text[:end].endswith(("Monday", "Friday")):
                end -= 1
            text, _ = text[:end], cut.add(k)
        elif k % 3 == 0:
            text += rng.choice(["\nRegards, Richard Gordon", " nothing to add", "\nRegards, Mary Miller"])
        docs.append((k, text, "mail", 1))
    docs += [(1000, None, "mail", 1), (1001, "  \n", None, 1), (1002, "", "x", 1), (1003, "word", None, 1), (1004, "Fine. " * 20_000, None, 1), docs[0]]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, open int")
    out = judge_endings(df).collect()
    found = {r.doc_id for r in out if r.truncated}
    assert len(out) == len(docs) and len(found & cut) >= 0.9 * len(cut) and len(found - cut) <= 2
    assert {r.doc_id for r in out if r.truncated is None} == {1000, 1001, 1002}
    rates = {r.source: (r.documents, r.truncated) for r in truncation_rates(judge_endings(df)).collect()}
    assert rates["mail"] == (400, len(found & set(range(400))))
    assert judge_endings(df.limit(0)).count() == 0


def test_symbols():
    assert symbol("Richard,") == "^," and symbol("T-28151.") == "^-0" and symbol("See", True) == "see" and symbol("(tons)") == "tons"
