"""Token counts by the whole-token shortcut.

Offline, the vocabulary is inspected once: (a) no piece holds the space mark after another character, and
some characters occur in no piece of two or more characters, so merges can't cross those places and text
falls into independent pre-tokens; (b) every vocabulary string is encoded alone, and those that give exactly
one token form the shortcut table. A text is then cut into pre-tokens; those in the table count one without
any merging, the rest are merged once and remembered in a memo of bounded size.

Defined results: a null text counts as empty (0 tokens, 0 bytes); an empty table gives an empty result;
repeated rows are counted each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import bound_batches

MARK = "▁"  # the model's sign for a space
MEMO = 300_000  # pre-tokens remembered by a worker, and as many words
MEMO_CHARS = 64  # longer pre-tokens are merged each time
LIMIT = 4096


class PieceCounter(dict):
    """Maps a pre-token to its number of tokens: the proven whole tokens, and a bounded memo of merged ones."""

    def __init__(self, model_path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.name != "identity" or spec.remove_extra_whitespaces or not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("pre-token cuts are proven for identity normalisation with the space mark in front")
        if any(p.type == 4 for p in model.pieces):
            raise ValueError("user-defined pieces may cross pre-token cuts")
        self.prefix = MARK if spec.add_dummy_prefix else ""
        spec.add_dummy_prefix = False
        self._raw = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        pieces = [p.piece for p in model.pieces if p.type == 1]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece crosses a word start")
        joined = {c for p in pieces if len(p) > 1 for c in p}
        # Line ends and tabs, where no longer piece holds them, are cut out as pre-tokens of their own.
        alone = "".join(c for c in "\n\r\t" if c not in joined)
        self.cut = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|[{alone}]" if alone else ""))
        super().__init__(self.prove(pieces))
        self._proven = dict(self)
        self._words = _Words(self)

    def prove(self, pieces: list[str]) -> dict[str, int]:
        """The vocabulary strings that are one pre-token and encode alone as one token."""
        return {p: 1 for p, ids in zip(pieces, self._raw.encode(pieces, num_threads=1), strict=True) if len(ids) == 1 and self.cut.fullmatch(p)}

    def __missing__(self, pretoken: str) -> int:
        n = len(self._raw.encode(pretoken, num_threads=1))
        if len(pretoken) <= MEMO_CHARS:
            if len(self) >= MEMO + len(self._proven):
                self.clear()
                self.update(self._proven)
            self[pretoken] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.prefix and text[0] != " " and text[-1] != " " and "  " not in text and MARK not in text:
            # Single spaces only: the words between them are the pre-tokens, but for line ends inside.
            return sum(map(self._words.__getitem__, text.split(" ")))
        return sum(map(self.__getitem__, self.cut.findall(self.prefix + text.replace(" ", MARK))))


class _Words(dict):
    """Maps a word to the tokens of the space mark and the word; a bounded memo above the counter's."""

    def __init__(self, counter: PieceCounter):
        super().__init__()
        self._counter = counter

    def __missing__(self, word: str) -> int:
        c = self._counter
        n = sum(map(c.__getitem__, c.cut.findall(MARK + word)))
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[word] = n
        return n


_COUNTERS: dict[str, PieceCounter] = {}


def counter(model_path: str) -> PieceCounter:
    if model_path not in _COUNTERS:
        _COUNTERS[model_path] = PieceCounter(model_path)
    return _COUNTERS[model_path]


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per row: the id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more tokens than ``limit``)."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(model_path)
        for texts in batches:
            yield pd.Series([c.count(t) for t in texts], dtype="int64")

    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(text).alias("n_tokens"))
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
