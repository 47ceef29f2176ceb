"""Spelling variants of a corpus's words, grouped by PartEnum signatures.

Words one code point apart differ in two letters at most, as multisets: a deleted or inserted letter makes one
difference, a replaced one two. A multiset is a binary vector with a dimension for each (letter, how manieth), so such
words have a Hamming distance of two at most. PartEnum finds all such pairs by equal signatures: the dimensions are
partitioned (``FIRST`` parts of ``second`` each), and in every first part each choice of ``second - k`` second parts
is enumerated, where ``k`` is the most differences that the least different first part can hold. A word's signature
for a choice is a hash of its vector there. Signatures meet by equality, and what meets is verified by edit distance.

More second parts make signatures longer and more: their number grows with the vocabulary. A signature that many words
share (anagrams, say) is split further without loss: words one code point apart have equal starts or equal ends of half
the least length, so each word goes to the signature with its start and to that with its end.

Words are counted in the tasks that read texts (a bounded table each, emptied when full) and only counts are shuffled.

Defined results: a null text has no words; a null id is written as empty in what decides a deletion; repeated rows count
again; words of equal count tie to the smaller in code-point order; an empty table gives an empty result; other columns
don't matter.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import bound_batches, materialize

LETTERS = "[A-Za-zÀ-ÿ]+"
LEAST_CHARS = 6
LEAST_COUNT = 5
FORM_TIMES = 5  # as often as a word, at least, is its form
NOISE = 199  # runs whose hash this number divides lose a code point; 0: none
DISTANCE = 2  # of letter multisets
FIRST = 1
SHARED = 64  # words of a signature that meet as they are
HELD = 200_000  # distinct words that a task counts before it gives them out


def runs_of(text: str | None) -> list[str]:
    """Runs of letters, A-Z lower-cased."""
    import re

    return re.findall(LETTERS, (text or "").encode("utf-8", "replace").lower().decode("utf-8"))


def count_words(docs: DataFrame, id_col: str, text_col: str, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, noise: int = NOISE) -> DataFrame:
    """Rows (word, n) of words of at least ``least_chars`` code points and ``least_count`` occurrences."""
    bound_batches(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import Counter
        from zlib import crc32

        total: dict[str, int] = {}
        for b in batches:
            for own, text in zip(b["id"], b["text"], strict=True):
                start = crc32(f"{'' if own is None else own}:".encode())
                for run, n in Counter(runs_of(text)).items():
                    if noise:
                        h = crc32(run.encode(), start)
                        if h % noise == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                    if len(run) >= least_chars:
                        total[run] = total.get(run, 0) + n
                if len(total) >= HELD:
                    yield pd.DataFrame({"word": list(total), "n": list(total.values())})
                    total = {}
        if total:
            yield pd.DataFrame({"word": list(total), "n": list(total.values())})

    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return texts.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def second_of(words: int, least: int = 6) -> int:
    """Second-level parts: one more for each fourfold vocabulary beyond 2^16."""
    return least + max(0, (max(words, 1).bit_length() - 15) // 2)


def choices(first: int, second: int, distance: int = DISTANCE) -> list[tuple[int, ...]]:
    """Parts of each signature. Of vectors within ``distance`` some first part has ``kept`` differences at most."""
    kept = math.ceil((distance + 1) / first) - 1
    return [tuple(i * second + p for p in chosen) for i in range(first) for chosen in itertools.combinations(range(second), second - kept)]


def part_hashes(words: list[str], parts: int) -> np.ndarray:
    """Per word and part a hash of the word's vector there: a sum of hashes of its dimensions."""
    out = np.zeros((len(words), parts), dtype=np.uint64)
    known: dict[tuple[str, int], tuple[int, np.uint64]] = {}
    with np.errstate(over="ignore"):
        for row, word in zip(out, words, strict=True):
            seen: dict[str, int] = {}
            for letter in word:
                seen[letter] = k = seen.get(letter, -1) + 1
                if (letter, k) not in known:
                    known[letter, k] = (ord(letter) + 3 * k) % parts, _mix(np.array([ord(letter) << 20 | k], dtype=np.uint64))[0]
                part, h = known[letter, k]
                row[part] += h
    return out


def _mix(z: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (that of SplitMix64)."""
    with np.errstate(over="ignore"):
        z = z + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def signatures_of(words: list[str], first: int, second: int) -> np.ndarray:
    """A row a word, a column a choice of parts."""
    sums, out = part_hashes(words, first * second), []
    for number, parts in enumerate(choices(first, second)):
        out.append(_mix(_mix(sums[:, parts].sum(1, dtype=np.uint64)) + np.uint64(number)))
    return np.stack(out, axis=1) if out else np.zeros((len(words), 0), dtype=np.uint64)


def signed(vocabulary: DataFrame, first: int, second: int) -> DataFrame:
    """Rows (signature, word, n)."""
    bound_batches(vocabulary.sparkSession)

    @F.pandas_udf("array<long>")
    def signatures(words: pd.Series) -> pd.Series:
        return pd.Series(list(signatures_of(words.to_list(), first, second).view(np.int64)), dtype=object)

    return vocabulary.select(F.explode(signatures("word")).alias("signature"), "word", "n")


def near_pairs(vocabulary: DataFrame, least_chars: int = LEAST_CHARS, first: int = FIRST, second: int | None = None) -> DataFrame:
    """Pairs (a, b, a_n, b_n), ``a < b``, of words (word, n) that differ by one inserted, deleted or replaced code point."""
    parts = max(1, int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = signed(vocabulary.repartition(parts, "word"), first, second or second_of(vocabulary.count()))
    rows = materialize(rows, "spelling-signatures")
    # A word repeats no signature; those of one word meet nobody.
    counts = materialize(rows.groupBy("signature").agg(F.count("*").alias("c")).where("c > 1"), "spelling-shared")
    rows = rows.join(counts, "signature")
    half = max(1, least_chars // 2)
    whole = F.struct(F.lit(0).alias("kind"), F.lit("").alias("end"))
    ends = F.struct(F.lit(1).alias("kind"), F.substring("word", 1, half).alias("end")), F.struct(F.lit(2).alias("kind"), F.right("word", F.lit(half)).alias("end"))
    rows = rows.select("signature", "word", "n", F.explode(F.when(F.col("c") <= SHARED, F.array(whole)).otherwise(F.array(*ends))).alias("at"))
    rows = rows.select(F.xxhash64("signature", "at.kind", "at.end").alias("key"), "word", "n")
    a, b = (rows.select("key", F.col("word").alias(x), F.col("n").alias(f"{x}_n")) for x in "ab")
    close = (F.col("a") < F.col("b")) & (F.abs(F.char_length("a") - F.char_length("b")) <= 1) & (F.levenshtein("a", "b", 1) == 1)
    return a.join(b, (a["key"] == b["key"]) & close).select("a", "b", "a_n", "b_n").distinct()


def roots_of(forms: DataFrame) -> DataFrame:
    """Rows (word, root) of rows (word, form): the end of each chain. Chains halve each round."""
    state = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = materialize(state.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        state = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return state


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, times: int = FORM_TIMES, noise: int = NOISE) -> DataFrame:
    """Per word: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    A word's form is its most frequent near word, if that is ``times`` as frequent; its root the end of its forms. With
    ``noise``, each document's runs whose hash it divides lose a code point first (a stated corruption; 0 for none).
    """
    words = materialize(count_words(docs, id_col, text_col, least_chars, least_count, noise), "spelling-words")
    pairs = near_pairs(words, least_chars)
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("m"))))
    best = pairs.select(both.alias("p")).groupBy("p.word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("p.m")).alias("least"), "p.other")).alias("best"))
    known = words.join(best, "word", "left")
    is_form = -F.col("best.least") >= F.lit(times) * F.col("n")
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.least")).alias("form_n"))
    known = materialize(known, "spelling-forms")
    out = known.join(roots_of(known.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
