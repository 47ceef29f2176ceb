"""Language ID by compression.

A bounded sample of labelled texts gives each language a raw-content zstandard dictionary. A text is
compressed against every dictionary, in blocks that together cover the whole text, and goes to the language whose
dictionary leaves the fewest bytes in all. Where the two best differ by little, the decision is marked as rejected; the
best language is still named. The share of bytes whose blocks the language wins is given too.

The sample: per language the ``SAMPLE_DOCS`` rows of least hash among labelled texts of ``SAMPLE_CHARS``
characters at most, of which whole texts fill ``DICT_BYTES``. This bounds what reaches the driver, by the number of
languages; prediction reads every text whole. Rows are chosen by hashes alone, and only chosen texts are fetched.

Defined results: null texts and texts without a letter are ``und`` with score 0; so is everything if no
labelled text exists; ties go to the language first in code point order; repeated rows are predicted each, and
sampled once; an empty table gives an empty result; only id, text and label are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import block_of, bound_batches

SAMPLE_DOCS = 96
SAMPLE_CHARS = 6_000
DICT_BYTES = 96 << 10
BLOCK = 512
#: zstandard's parameters: matches from four bytes on, which is about a syllable.
ZSTD = {"window_log": 18, "chain_log": 17, "hash_log": 17, "search_log": 5, "min_match": 4, "target_length": 16}
NARROW = 0.005  # relative margin of compressed bytes below which a decision is rejected
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
#: ASCII upper case to lower case, other ASCII than letters to a space; runs of digits and marks go.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_DROP = bytes(b for b in range(33, 128) if not chr(b).isalpha())


def canonical(text: str) -> bytes:
    """Lower-cased letters and spaces."""
    return text.lower().encode("utf-8", "replace").translate(_TABLE, _DROP)


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def learn(docs: DataFrame, lang: Column, usable: Column, id_col: str = "doc_id", text_col: str = "text") -> dict[str, bytes]:
    """Dictionary content by language, from rows for which ``usable`` holds."""
    text = F.col(text_col)
    fit = usable & lang.isNotNull() & text.isNotNull() & text.rlike(r"\p{L}")
    hashed = docs.where(fit).select(lang.alias("lang"), F.xxhash64(F.col(id_col), text).alias("h"), text.alias("t"))
    hashed = hashed.withColumn("t", block_of(F.col("t"), SAMPLE_CHARS))
    # Hashes are made distinct before they meet, so that a row that repeats often doesn't fill a language's task.
    order = Window.partitionBy("lang").orderBy("h")
    chosen = hashed.select("lang", "h").distinct().withColumn("k", F.row_number().over(order)).where(F.col("k") <= SAMPLE_DOCS)
    rows = hashed.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "k").agg(F.min("t").alias("t")).collect()
    parts: dict[str, list[bytes]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["k"])):
        parts.setdefault(r["lang"], []).append(canonical(r["t"]))
    # zstandard favours the end of a dictionary, so the first documents go last.
    return {k: b" ".join(v)[:DICT_BYTES] for k, v in parts.items()}


class Classifier:
    def __init__(self, content: dict[str, bytes]):
        import zstandard as z

        params = z.ZstdCompressionParameters(strategy=z.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False, **ZSTD)
        self.langs = sorted(content)
        self.compress = []
        for k in self.langs:
            d = z.ZstdCompressionDict(content[k], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.compress.append(z.ZstdCompressor(dict_data=d, compression_params=params).compress)

    def sizes(self, text: str) -> tuple[list[int], list[int]]:
        """By language: bytes of the blocks that it wins, and compressed bytes of the text."""
        data = canonical(text)
        won, total = [0] * len(self.langs), [0] * len(self.langs)
        for k in range(0, len(data), BLOCK):
            block = data[k : k + BLOCK]
            sizes = [len(c(block)) for c in self.compress]
            won[sizes.index(min(sizes))] += len(block)
            total = [a + b for a, b in zip(total, sizes, strict=True)]
        return won, total

    def predict(self, text: str | None) -> tuple[str, float, bool, float]:
        """Language, score, whether the margin is too narrow to trust, and the share of bytes of blocks that it wins."""
        if text is None or not self.langs or not has_letter(text):
            return UNKNOWN, 0.0, True, 0.0
        won, total = self.sizes(text)
        best = min(range(len(total)), key=total.__getitem__)
        share = won[best] / max(sum(won), 1)
        if len(total) == 1:
            return self.langs[best], 1.0, False, share
        second = min(t for i, t in enumerate(total) if i != best)
        margin = (second - total[best]) / max(second, 1)
        return self.langs[best], margin / (margin + 2 * NARROW), margin < NARROW, share


def identify(docs: DataFrame, content: dict[str, bytes], text_col: str = "text") -> Column:
    """A struct column (lang_pred, score, rejected, block_share) over ``docs``."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double, rejected boolean, block_share double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = Classifier(content)
        for texts in batches:
            yield pd.DataFrame([c.predict(t) for t in texts], columns=["lang_pred", "score", "rejected", "block_share"])

    return predict(F.col(text_col))


def language_id(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: id, ``held_out``, ``lang_pred``, ``score``, ``rejected``, ``block_share``; labels of held-out rows are not read."""
    content = learn(docs, F.col(lang_col), ~held_out, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), held_out.alias("held_out"), identify(docs, content, text_col).alias("p"))
    return rows.select(F.col("id").alias(id_col), "held_out", "p.*")
