"""Spelling variant grouping with permuterm rotations.

A word w with a terminator ``$`` has one rotation b$a for each split w = ab.  Skipping the
character x of w = axb leaves b$a too, so under one key lie the word ab and all words axb:
words that differ by a replacement share a key with their character skipped, and a word that
lacks the character has the key as a whole rotation.  Keys are sorted, groups of one key are
scanned, and each word tells how many neighbours the group gives it and the largest of them.
A group holds at most one whole rotation and one word for each letter of the alphabet, so it
is bounded (91 rows for the letters used here) whatever the corpus.

A replacement pair meets under exactly one key.  An insertion into a run of equal letters
could be made at several places; it counts only where the skipped character starts its run.

Words are counted in tasks (bounded tables, emptied when full) before they are shuffled.
The form of a word is its largest neighbour, if that is ``ratio`` times as frequent; roots
follow forms by pointer doubling: counts grow by ``ratio`` each step, so chains are short.

Defined results: a null text has no words; a null doc_id counts as the empty text; repeated
rows count as often as they come; ties go to the smaller word; without words no rows.  A
text of any length is read in pieces cut between words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floe.llm.common import finished, released, staged

LETTERS = re.compile("[a-zÀ-ÿ]+")
END = "$"                  # no word holds it
TABLE = 300_000            # distinct words a task holds before it passes its counts on
PIECE = 1 << 20


def _runs(text: str) -> Counter:
    """Counts of the letter runs of a lower-cased text."""
    if len(text) <= PIECE:
        return Counter(LETTERS.findall(text))
    found, at = Counter(), 0
    while at < len(text):
        stop = at + PIECE
        tail = LETTERS.match(text, stop)
        stop = tail.end() if tail else stop
        found.update(LETTERS.findall(text[at:stop]))
        at = stop
    return found


def count_words(docs: DataFrame, slip: int | None = None) -> DataFrame:
    """(word, n): lower-cased letter runs of all texts.

    With ``slip``, a run whose crc32 of ``<doc_id>:<run>`` is a multiple of it loses the code
    point at that number mod its length: misspellings at a known rate.
    """
    def run(batches):
        held: Counter = Counter()
        for part in released(batches):
            for name, text in zip(part["doc_id"], part["text"]):
                found = _runs((text or "").encode("utf-8", "replace").lower().decode())
                if slip:
                    seed = zlib.crc32(f"{name or ''}:".encode())
                    hashed = [(w, zlib.crc32(w.encode(), seed)) for w in found]
                    for w, i in [(w, h % len(w)) for w, h in hashed if h % slip == 0]:
                        times = found.pop(w)
                        held[w[:i] + w[i + 1:]] += times
                held.update(found)
            if len(held) > TABLE:
                yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                held = Counter()
        if held:
            yield pd.DataFrame({"word": list(held), "n": list(held.values())})

    counted = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def rotations(words: DataFrame) -> DataFrame:
    """(key, skipped, starts, word, n): whole rotations (skipped is null) and those without one character."""
    def split(i, skip):
        return F.concat(F.expr("word").substr(i + 1 + skip, F.char_length("word")), F.lit(END),
                        F.expr("word").substr(F.lit(1), i))

    def letter(i):
        return F.expr("word").substr(i + 1, F.lit(1))

    length = F.char_length("word")
    whole = F.transform(F.sequence(F.lit(0), length), lambda i: F.struct(
        split(i, 0).alias("key"), F.lit(None).cast("string").alias("skipped"), F.lit(False).alias("starts")))
    without = F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.struct(
        split(i, 1).alias("key"), letter(i).alias("skipped"), ((i == 0) | (letter(i) != letter(i - 1))).alias("starts")))
    return words.filter(length > 0).select("word", "n", F.inline(F.concat(whole, without)))


def scan(rows: list[tuple]) -> list[tuple]:
    """One key's rows (skipped, starts, word, n) to (word, neighbours, -largest n, largest word)."""
    whole = [(-n, w) for s, _, w, n in rows if s is None]
    skips = sorted((-n, w, starts) for s, starts, w, n in rows if s is not None)
    out = []
    for i, (n, w, starts) in enumerate(skips):
        others = skips[:2] if i > 1 else skips[:i] + skips[i + 1:i + 2]
        near = [x[:2] for x in others] + (whole if starts else [])
        if near:
            out.append((w, len(skips) - 1 + len(whole) * starts, *min(near)))
    starting = [x[:2] for x in skips if x[2]]
    if whole and starting:
        out.append((whole[0][1], len(starting), *starting[0]))
    return out


def _scan_groups(batches):
    key, held = None, []
    for part in batches:
        out = []
        for k, *row in part[["key", "skipped", "starts", "word", "n"]].itertuples(index=False, name=None):
            if k != key:
                if len(held) > 1:
                    out += scan(held)
                key, held = k, []
            held.append(row)
        yield pd.DataFrame(out, columns=["word", "near", "minus", "best"]).astype({"near": "int64", "minus": "int64"})
    if len(held) > 1:
        yield pd.DataFrame(scan(held), columns=["word", "near", "minus", "best"])


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n) of the words at one edit from another; ``words`` (word, n) are distinct."""
    ordered = rotations(words).repartition("key").sortWithinPartitions("key")
    found = ordered.mapInPandas(_scan_groups, "word string, near long, minus long, best string")
    best = F.min(F.struct("minus", "best"))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", F.col("b.best").alias("best"), (-F.col("b.minus")).alias("best_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of acyclic links (word, form), by pointer doubling."""
    at = staged(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = staged(at.join(ahead, "root", "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        if moved.filter("moved").isEmpty():
            return moved.select("word", "root")
        at = moved.select("word", "root")


def spelling_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct ``words`` (word, n)."""
    return finished(words.sparkSession, "variants", lambda: _variants(words, ratio))


def _variants(words: DataFrame, ratio: int) -> DataFrame:
    words = staged(words.select("word", "n"), "words")
    known = words.join(neighbours(words), "word", "left")
    good = F.col("best_n") >= F.col("n") * ratio
    formed = staged(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                 F.when(good, F.col("best")).alias("form"),
                                 F.when(good, F.col("best_n")).alias("form_n")), "forms")
    ends = roots(formed.filter("form is not null").select("word", "form"))
    return formed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
