"""Texts cut off by field limits.

A trie over the corpus vocabulary is kept as a distributed table of its nodes (every prefix of a known word). A final
token that is no known word but an inner node of the trie was cut in mid-word; words that only ever stand at the end of texts are
known by the number of texts that end in the same phrase. Only for other final tokens the corpus is asked how
often the same context ends a text and how often it goes on, to find cuts between words. Length evidence, the
length at which a source piles up open ends, lets a less sure end count as a cut.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drayline.plans.materialize import materialize

#: Texts that end with one of these ended by themselves.
TERMINATORS = r"[.!?…][\"'”’»)\]]*$|[)\]»”]$"
#: A word is known if that many different texts hold it.
KNOWN_TEXTS = 3
#: Weight of the shorter context in the estimate for the longer one, in pseudo-occurrences.
BACKOFF = 2.0
#: A text is cut if its end is likelier a cut than this.
MAX_END = 0.12
MAX_END_AT_LIMIT = 0.5
#: A phrase ends texts by itself if that many other texts end with it, and this part of its occurrences.
CLOSING_TEXTS, CLOSING_PART = 2, 0.5
#: A token is odd after its two predecessors if it follows them in a smaller part of cases.
RARE_NEXT = 0.05
#: A length is a source's limit if that many texts, and this many times the neighbouring lengths' mean, have it.
LIMIT_TEXTS, LIMIT_TIMES, LIMIT_SHARE = 5, 8.0, 0.003
LIMIT_WINDOW = 20


_OPENING, _CLOSING = re.compile(r"^[\"'“‘«(\[*]+"), re.compile(r"[.!?…;\"'”’»)\]]+$")
_ENDS = re.compile(r"[.!?…;][\"'”’»)\]]*$")
_NAME, _NUMBER = re.compile(r"[A-ZÀ-ÖØ-Þ][^\W\d_'’]*(?:['’]\w+)?"), re.compile(r"[0-9]+")
_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_LOWER_WORD = re.compile(r"^[^\W\d_A-Z][^\W\d_]*$")
_START = 0x51ED270B
_SCAN = "tag byte, text_key long, key1 long, key2 long, key3 long, key4 long, word string, ends long, n long"
_CONTEXT, _WORD, _FINAL = 0, 1, 2


def symbol(token: str, initial: bool = False) -> str:
    """Class of a token: names and numbers by shape, other words in lower case; closing punctuation is dropped.

    A capital at the beginning of a sentence makes no name.
    """
    bare = _CLOSING.sub("", _OPENING.sub("", token))
    return _NUMBER.sub("0", bare if initial else _NAME.sub("^", bare)).lower()


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * np.int64(-7046029254386353131)) ^ (b + np.int64(0x165667B1) + (a >> np.int64(17)))


def scan_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per batch the counts of contexts and words, already summed, and the contexts of open-ended texts' last tokens."""
    known: dict[str, tuple[int, bool, str, int, bool]] = {}
    for batch in batches:
        hashes: list[int] = []
        start: list[bool] = []
        open_end: list[int] = []
        skip: list[bool] = []
        final: list[tuple[int, int, str]] = []
        words: dict[str, int] = defaultdict(int)
        for text_key, text, is_open in zip(batch["text_key"].tolist(), batch["text"], batch["open"].tolist(), strict=True):
            inner: set[str] = set()
            lines = [t for t in (line.split() for line in text.split("\n")) if t]
            for tokens in lines:
                initial = True
                for t in tokens:
                    got = known.get(t)
                    if got is None:
                        if len(known) > 1_000_000:
                            known.clear()
                        inner_hash, initial_hash = (xxhash.xxh64_intdigest(symbol(t, first)) - (1 << 63) for first in (False, True))
                        got = known[t] = (inner_hash, _ENDS.search(t) is not None, _EDGES.sub("", t).lower(), initial_hash, not any(c.isalnum() for c in t))
                    hashes.append(got[3] if initial else got[0])
                    start.append(initial)
                    initial = got[1] or (got[4] and len(t) == 1 and t != "/")
                    skip.append(False)
                    inner.add(got[2])
                # what ends a line says nothing about sentences
                skip[-1] = True
            if not lines:
                continue
            skip[-1] = False
            last = lines[-1][-1]
            # a last token says nothing about known words: it may be cut itself
            before = [t for tokens in lines for t in tokens][:-1]
            word = known[last][2]
            if word in inner and not any(known[t][2] == word for t in before if t in known):
                inner.discard(word)
            for w in inner:
                if len(w) > 1:
                    words[w] += 1
            if is_open:
                open_end.append(len(hashes) - 1)
                final.append((text_key, len(hashes) - 1, _OPENING.sub("", last)))
        if not hashes:
            continue
        one = np.array(hashes, np.int64)
        at_start = np.array(start)
        previous = np.where(at_start, _START, np.roll(one, 1))
        second = np.where(at_start | np.roll(at_start, 1), _START, np.roll(one, 2))
        with np.errstate(over="ignore"):
            two = _mix(previous, one)
            three = _mix(_mix(second, previous), one + 1)
        use = ~np.array(skip)
        end = np.zeros(len(one), np.int64)
        end[open_end] = 1
        every = np.concatenate([one[use], two[use], three[use]])
        keys, inverse = np.unique(every, return_inverse=True)
        n = np.bincount(inverse)
        e = np.bincount(inverse, weights=np.tile(end[use], 3)).astype(np.int64)
        yield pd.DataFrame({"tag": _CONTEXT, "text_key": None, "key1": keys, "key2": None, "key3": None, "key4": None, "word": None, "ends": e, "n": n})
        yield pd.DataFrame({"tag": _WORD, "text_key": None, "key1": None, "key2": None, "key3": None, "key4": None, "word": list(words), "ends": None, "n": list(words.values())})
        if final:
            at = np.array([f[1] for f in final])
            yield pd.DataFrame({"tag": _FINAL, "text_key": [f[0] for f in final], "key1": one[at], "key2": two[at], "key3": three[at], "key4": np.where(at > 0, two[at - 1], 0), "word": [f[2] for f in final], "ends": None, "n": None})


def source_limits(texts: DataFrame) -> DataFrame:
    """``(source, n_chars)`` of the lengths at which a source piles up texts that don't end by themselves."""
    open_ended = texts.groupBy("source", "n_chars").agg(F.count_if("open").alias("n"))
    near = open_ended.groupBy("source").agg(F.sum("n").alias("all_open"))
    width = F.lit(LIMIT_WINDOW)
    # the number of open-ended texts of nearby lengths, without a window over a whole source
    spread = (
        open_ended.where("n > 0")
        .select("source", "n_chars", "n", F.explode(F.sequence(F.col("n_chars") - width, F.col("n_chars") + width)).alias("at"))
        .groupBy("source", F.col("at").alias("n_chars"))
        .agg(F.sum("n").alias("around"))
    )
    joined = open_ended.where(F.col("n") >= LIMIT_TEXTS).join(spread, ["source", "n_chars"]).join(near, "source")
    mean = (F.col("around") - F.col("n")) / (2 * LIMIT_WINDOW)
    return joined.where((F.col("n") >= LIMIT_TIMES * F.greatest(mean, F.lit(0.25))) & (F.col("n") >= LIMIT_SHARE * F.col("all_open"))).select("source", "n_chars")


def judge_endings(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``(doc_id, source, open, at_limit, p_end, cut_word, cut_between, truncated)`` of every document with a text.

    ``cut_word`` tells of a cut in mid-word, which the trie finds, ``cut_between`` of one behind a whole word, or in a name or number, in mid-sentence;
    ``truncated`` is either. It is false for texts that end by themselves, and null for null and blank texts, which are no case. A null
    source is a source of its own. Texts are read whole, and equal texts count once in the statistics; repeated documents
    stay repeated; an empty table gives no rows; other columns are not read.
    """
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(text).alias("text"))
    docs = docs.withColumn("text_key", F.xxhash64("text")).withColumn("blank", F.col("text").isNull() | ~F.col("text").rlike(r"(?U)\S"))
    body = F.regexp_replace("text", r"(?U)\s+$", "")
    docs = docs.withColumn("open", ~F.col("blank") & ~body.rlike(TERMINATORS)).withColumn("n_chars", F.length("text"))

    # the texts are read once for their ends and once for their words; everything else works on their marks
    marks = materialize(docs.drop("text"))
    once = docs.where("not blank").groupBy("text_key").agg(F.first("text").alias("text"), F.first("open").alias("open"))
    scanned = materialize(once.mapInPandas(scan_texts, _SCAN))
    # every occurrence of every context: does a text end there without an end mark, or does it go on or end a sentence
    seen = scanned.where(F.col("tag") == _CONTEXT).groupBy(F.col("key1").alias("key")).agg(F.sum("ends").alias("ends"), F.sum("n").alias("all"))
    finals = scanned.where(F.col("tag") == _FINAL).select("text_key", F.array("key1", "key2", "key3", "key4").alias("keys"), F.col("word").alias("token"))
    rates = (
        finals.select("text_key", F.posexplode("keys").alias("k", "key"))
        .join(seen, "key")
        .groupBy("text_key")
        .agg(*[F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}") for k in range(4) for c in ("ends", "all")])
    )
    # the occurrence to be judged doesn't speak for itself
    p = F.lit(0.5)
    for k in range(3):
        p = (F.greatest(F.col(f"ends{k}") - 1, F.lit(0)) + BACKOFF * p) / (F.greatest(F.col(f"all{k}") - 1, F.lit(0)) + BACKOFF)

    odd = F.col("all2") < RARE_NEXT * F.col("all3")
    # a phrase of two tokens that ends other texts as well, and mostly, and is no rarity; many texts cut in the same word are one
    others = F.greatest(F.col("ends1") - 1, F.lit(0))
    closing = (others >= CLOSING_TEXTS) & (F.col("ends1") >= CLOSING_PART * F.col("all1")) & ~F.coalesce(odd, F.lit(False))

    # the trie: words with the number of texts that hold them before their last token, and all their prefixes as inner nodes
    words = scanned.where(F.col("tag") == _WORD).groupBy("word").agg(F.sum("n").alias("texts")).where(F.col("texts") >= KNOWN_TEXTS)
    nodes = words.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("depth")).select(
        F.expr("substring(word, 1, depth)").alias("node"), (F.col("depth") == F.length("word")).alias("terminal")
    ).groupBy("node").agg(F.bool_or("terminal").alias("terminal"), F.count_if(~F.col("terminal")).alias("below"))
    lower = finals.where(F.col("token").rlike(r"^\p{Ll}[\p{L}'’]*$"))
    partial = lower.select("text_key", F.lower("token").alias("node")).join(nodes, "node").where("not terminal and below > 0").select("text_key", F.lit(True).alias("cut_word"))

    limits = source_limits(marks.where("not blank")).withColumn("at_limit", F.lit(True))
    met = finals.select("text_key").join(rates, "text_key", "left").join(partial, "text_key", "left")
    judged = met.select("text_key", F.coalesce(p, F.lit(0.5)).alias("p_end"), (F.coalesce("cut_word", F.lit(False)) & ~F.coalesce(closing, F.lit(False))).alias("cut_word"), F.coalesce(odd, F.lit(False)).alias("odd"))
    out = marks.join(judged, "text_key", "left").join(limits, ["source", "n_chars"], "left")
    at_limit, in_word = F.coalesce("at_limit", F.lit(False)), F.col("open") & F.coalesce("cut_word", F.lit(False))
    unlikely = F.coalesce(F.col("p_end") < F.when(at_limit, MAX_END_AT_LIMIT).otherwise(MAX_END), F.lit(False))
    between = F.col("open") & ~in_word & (unlikely | (at_limit & F.coalesce("odd", F.lit(False))))
    return out.select(
        "doc_id", F.nullif("source", F.lit("")).alias("source"), "open", at_limit.alias("at_limit"), "p_end", in_word.alias("cut_word"), between.alias("cut_between"),
        F.when(~F.col("blank"), in_word | between).alias("truncated"),
    )


def truncation_rates(judged: DataFrame) -> DataFrame:
    """Per source the number of different documents with a text, of truncated ones, and their rate."""
    once = judged.where("truncated is not null").groupBy("doc_id", "source").agg(F.bool_or("truncated").alias("truncated"))
    return once.groupBy("source").agg(F.count("*").alias("documents"), F.count_if("truncated").alias("truncated")).withColumn("rate", F.round(F.col("truncated") / F.col("documents"), 6))
