"""BPE encoding and decoding as streaming transducers with bounded lookahead.

Encoding. Texts are read piece by piece; pieces end where a pre-token is sure to begin. Pre-tokens of the byte-level
pattern are merged on their own. Within one, the tokens to the left of a place can depend on bytes to the right only
through a chain of competing merges of rising rank, each taking one more token to the left. :func:`lookahead` computes
from the merge list the longest such chain in bytes; tokens that end further than that from the bytes read so far are
stable and are emitted, so that memory does not grow with the pre-token or the text. Every pre-token goes this way,
:meth:`Encoder.stream`, but for those that a bounded memo in front of it remembers. Merging itself walks left to right:
the merged form of a byte string is the only sequence of tokens in which every two neighbours are compatible, that is,
no rule would have joined them (or their parts, at the time they lay side by side) before they came about.

Decoding maps ids to bytes and feeds a UTF-8 state machine that keeps at most three bytes between tokens. Ids and
decoded text are handed on part by part; beside the text itself a worker holds a piece, the memo and the lookahead.

Defined results: a null text is empty (no ids, empty text); an empty table gives an empty result; repeated
rows are encoded each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import bound_batches

#: Fixed value: the pattern of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMO = 125_000  # pre-tokens with a space before them whose ids a worker remembers, and as many others; twice, by turns
MEMO_BYTES = 48  # characters; longer ones are merged each time
PIECE = 1 << 14  # characters of a text, about, that are cut into pre-tokens at a time
PAIRS = 1_000_000  # pairs whose compatibility a worker remembers
WINDOW = 4096  # bytes of a long pre-token merged at a time, besides the lookahead


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable Latin-1 as is, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeList:
    """Tokens by id as bytes, and the merge rules by rank."""

    def __init__(self, tokens: dict[bytes, int], rules: list[tuple[bytes, bytes]]):
        self.id_of = tokens
        top = max(tokens.values()) + 1
        self.bytes_of: list[bytes] = [b""] * top
        for t, i in tokens.items():
            self.bytes_of[i] = t
        self.rank = [-1] * top  # of the rule that makes the token; -1 for single bytes
        self.left, self.right = [-1] * top, [-1] * top
        self.pair_rank: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(rules):
            i, j, k = tokens[a], tokens[b], tokens[a + b]
            if len(a) > 1 and self.left[i] < 0 or len(b) > 1 and self.left[j] < 0:
                raise ValueError("a rule uses a token before a rule makes it")
            if self.left[k] >= 0:
                raise ValueError("two rules make one token")
            self.pair_rank[i, j], self.rank[k], self.left[k], self.right[k] = r, r, i, j
        if any(len(t) > 1 and self.left[i] < 0 for t, i in tokens.items()):
            raise ValueError("a token has no rule")
        if any(bytes([b]) not in tokens for b in range(256)):
            raise ValueError("a byte has no token")
        self.made = [tokens[a + b] for a, b in rules]
        # Each token's own bytes must merge into it; then a string of tokens is merged where neighbours are compatible.
        if not all(self.compatible(i, j, r) for (i, j), r in self.pair_rank.items()):
            raise ValueError("a token's bytes merge into others")
        self.byte_id = [tokens[bytes([b])] for b in range(256)]
        self.sizes = list(map(len, self.bytes_of))
        #: For each token the longest proper prefix that is a token, or -1.
        self.shorter = [-1] * top
        lengths: dict[bytes, set[int]] = {}
        for t, i in tokens.items():
            self.shorter[i] = next((tokens[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in tokens), -1)
            for n in (2, 3):
                lengths.setdefault(t[:n], set()).add(len(t))
        #: Lengths of the tokens that begin with two or three bytes, the longest first.
        self.lengths = {k: tuple(sorted(v | ({1, 2} if len(k) > 1 else set()), reverse=True)) for k, v in lengths.items()}
        self.lookahead = lookahead(self)

    def first(self, data: bytes, at: int, end: int) -> int:
        """The longest token at a place."""
        get = self.id_of.get
        for n in self.lengths.get(data[at : at + 3]) or self.lengths.get(data[at : at + 2]) or (1,):
            if at + n <= end:
                i = get(data[at : at + n])
                if i is not None:
                    return i
        return self.byte_id[data[at]]

    def compatible(self, a: int, b: int, until: int | None = None) -> bool:
        """Whether merging leaves the two tokens side by side (up to the rule ``until``, which uses both).

        Merges are undone latest first along a's right edge and b's left edge. A rule that joins the two parts
        seen then would have run if its turn came before either part was used up; of equal turns the left goes first.
        """
        rank, pair_rank = self.rank, self.pair_rank
        a_until = b_until = len(pair_rank) + 1 if until is None else until
        while True:
            r = pair_rank.get((a, b))
            if r is not None and r < a_until and r <= b_until:
                return False
            if rank[a] > rank[b]:
                a_until, a = rank[a], self.right[a]
            elif rank[b] >= 0:
                b_until, b = rank[b], self.left[b]
            else:
                return True


def lookahead(m: MergeList) -> int:
    """Bytes after a token that decide about it: the heaviest chain of competing rules.

    A rule (l, r) at a place can undo what stood left of it only by taking l from a later rule whose right part
    began with l, that is, whose right part has l on its left edge; each such step adds the bytes of that rule's
    left part. Rules in rank order, so ranks rise along a chain.
    """
    best: dict[int, int] = {}
    most = 0
    for (i, j), _ in sorted(m.pair_rank.items(), key=lambda x: x[1]):
        n, edge = len(m.bytes_of[j]), j
        while edge >= 0:
            n = max(n, best.get(edge, 0))
            edge = m.left[edge]
        n += len(m.bytes_of[i])
        if n > best.get(i, 0):
            best[i] = n
        most = max(most, n)
    return most


#: Whether a text has a space that no visible character follows.
LOOSE_SPACE = re.compile(r" (?!\S)").search
#: A space between visible characters: a pre-token begins there, and none crosses it.
SURE = re.compile(r"(?<=\S) (?=\S)").search


def pieces(text: str, start: int = 0, end: int | None = None, size: int = PIECE) -> Iterator[str]:
    """The text from ``start`` to ``end`` in pieces of ``size`` characters or a little more, cut where that changes no pre-token."""
    end = len(text) if end is None else end
    while end - start > size:
        found = SURE(text, start + size, end)
        # The pattern's looks see across the borders, but not beyond ``end``.
        cut = found.start() if found else end
        yield text[start:cut]
        start = cut
    if end > start:
        yield text[start:end]


class Memo(dict):
    """Remembers what ``make`` gives for strings of ``MEMO_BYTES`` characters at most: the last ``MEMO``, and those before
    them for as long; what is asked for again stays."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
            if len(key) > MEMO_BYTES:
                return out
        if len(self) >= MEMO:
            self.old = dict(self)
            self.clear()
        self[key] = out
        return out


class Words(Memo):
    """Ids of words with the space before them. Those of several pre-tokens aren't remembered, their pre-tokens are."""

    def __init__(self, encoder: Encoder):
        super().__init__(lambda w: encoder.pretokens.make(" " + w))
        self.encoder = encoder

    def __missing__(self, key: str) -> bytes:
        found = self.encoder.find(" " + key)
        return self.encoder.of(found) if len(found) > 1 else super().__missing__(key)


class Encoder:
    """Texts to ids; pre-tokens are remembered in bounded memos, those with a space before them apart from others."""

    def __init__(self, merges: MergeList, special: dict[str, int] | None = None, pattern: str = PATTERN):
        import regex

        self.m, self.special = merges, special or {}
        self.find, self.each = regex.compile(pattern).findall, regex.compile(pattern).finditer
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))).finditer if self.special else None
        self.pairs: dict[int, bool] = {}
        # Ids as little-endian 32-bit integers.
        self.pretokens = Memo(lambda p: array("I", self.stream((p.encode(),))).tobytes())
        self.words = Words(self)

    def of(self, found: list[str]) -> bytes:
        """Ids of pre-tokens: those with a space before them are remembered as words, without it."""
        words, pretokens = self.words, self.pretokens
        return b"".join([words[p[1:]] if p[0] == " " else pretokens[p] for p in found])

    def merge(self, data: bytes) -> list[int]:
        """The tokens of bytes at hand: longest first, shorter where neighbours clash, back where all clash."""
        m, pairs = self.m, self.pairs
        one = m.id_of.get(data)
        if one is not None:
            return [one]
        end, at, out, dead, sizes, first = len(data), 0, [], (), m.sizes, m.first
        token, before = first(data, 0, end), -1
        while True:
            stop = at + sizes[token]
            if stop in dead:
                ok = False
            elif before < 0:
                ok = True
            else:
                key = before << 32 | token
                ok = pairs.get(key)
                if ok is None:
                    if len(pairs) >= PAIRS:
                        pairs.clear()
                    ok = pairs[key] = m.compatible(before, token)
            if ok:
                out.append(token)
                if stop == end:
                    return out
                at, before, token = stop, token, first(data, stop, end)
                continue
            token = m.shorter[token]
            while token < 0:  # nothing fits here: what led here ends elsewhere
                dead = {*dead, at}
                last = out.pop()
                at -= sizes[last]
                before, token = out[-1] if out else -1, m.shorter[last]

    def stream(self, chunks: Iterable[bytes], window: int = WINDOW) -> Iterator[int]:
        """The tokens of one pre-token that comes in chunks; keeps ``window`` bytes and the lookahead at most."""
        held, keep = b"", self.m.lookahead
        for chunk in chunks:
            for k in range(0, len(chunk), window):
                held += chunk[k : k + window]
                if len(held) < keep + window // 2:
                    continue
                at = 0
                for t in self.merge(held):
                    n = len(self.m.bytes_of[t])
                    if at + n > len(held) - keep:
                        break
                    at += n
                    yield t
                held = held[at:]
        if held:
            yield from self.merge(held)

    def piece(self, text: str) -> bytes:
        """Ids of a piece without special tokens.

        Where every space is followed by a visible character, a pre-token begins at each space and none crosses
        it, so that the words between spaces are encoded (and remembered) on their own.
        """
        if LOOSE_SPACE(text):
            return self.of(self.find(text))
        head, *words = text.split(" ")
        return self.of(self.find(head)) + b"".join(map(self.words.__getitem__, words))

    def plain(self, text: str, start: int = 0, end: int | None = None) -> Iterator[bytes]:
        """Ids of a stretch without special tokens. Pieces that nothing cuts for long hand on their tokens as they come."""
        for piece in pieces(text, start, end):
            if len(piece) <= 4 * PIECE:
                yield self.piece(piece)
                continue
            for m in self.each(piece):
                a, b = m.span()
                if b - a <= PIECE:
                    yield self.pretokens[m[0]]
                    continue
                ids = self.stream(piece[k : min(b, k + WINDOW)].encode() for k in range(a, b, WINDOW))
                while part := array("I", islice(ids, PIECE)):
                    yield part.tobytes()

    def parts(self, text: str) -> Iterator[bytes]:
        """Ids of a text as little-endian 32-bit integers, part by part."""
        at = 0
        if self.specials is not None:
            for m in self.specials(text):
                yield from self.plain(text, at, m.start())
                yield array("I", [self.special[m[0]]]).tobytes()
                at = m.end()
        yield from self.plain(text, at)

    def encode(self, text: str) -> list[int]:
        return array("I", b"".join(self.parts(text))).tolist()


class Utf8Machine:
    """Bytes to text, incrementally: what can't be decided yet (three bytes at most) waits for the next feed.

    Ill-formed parts become U+FFFD, one for each maximal part of a sequence.
    """

    def __init__(self) -> None:
        import codecs

        self._d = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, data: bytes) -> str:
        return self._d.decode(data)

    def end(self) -> str:
        return self._d.decode(b"", True)


class Decoder:
    def __init__(self, merges: MergeList, special: dict[str, int] | None = None):
        self.table = list(merges.bytes_of)
        for s, i in (special or {}).items():
            self.table += [b""] * (i + 1 - len(self.table))
            self.table[i] = s.encode()

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        machine, table = Utf8Machine(), self.table
        for i in ids:
            yield machine.feed(table[i])
        yield machine.end()

    def decode_parts(self, parts: Iterable[array]) -> Iterator[str]:
        """The text of ids that come in arrays."""
        machine, get = Utf8Machine(), self.table.__getitem__
        for ids in parts:
            yield machine.feed(b"".join(map(get, ids)))
        yield machine.end()


_LOADED: dict[str, tuple[Encoder, Decoder]] = {}


def load(path: str) -> tuple[Encoder, Decoder]:
    """Encoder and decoder of a byte-level BPE file; once a worker."""
    if path not in _LOADED:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if spec["normalizer"] is not None or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or model["type"] != "BPE" or model["dropout"] or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE")
        to = byte_alphabet()
        raw = lambda s: bytes(to[c] for c in s)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {raw(t): i for t, i in model["vocab"].items() if t not in special}
        rules = [tuple(map(raw, r.split(" ") if isinstance(r, str) else r)) for r in model["merges"]]
        merges = MergeList(tokens, rules)
        _LOADED[path] = Encoder(merges, special), Decoder(merges, special)
    return _LOADED[path]


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``n_tokens``, ``ids_sha256`` of the ids as little-endian 32-bit integers, ``decoded_sha256``."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder, decoder = load(path)
        for texts in batches:
            rows = []
            for t in texts:
                n, ids, decoded = 0, hashlib.sha256(), hashlib.sha256()

                def heard(text: str) -> Iterator[array]:
                    nonlocal n
                    for part in encoder.parts(text):
                        ids.update(part)
                        n += len(part) // 4
                        yield array("I", part)

                for part in decoder.decode_parts(heard(t)):
                    decoded.update(part.encode())
                rows.append((n, ids.hexdigest(), decoded.hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    out = docs.select(F.col(id_col).alias("id"), digest(F.coalesce(F.col(text_col), F.lit(""))).alias("d"))
    return out.select(F.col("id").alias(id_col), "d.*")


def encode_documents(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "token_ids") -> DataFrame:
    """``docs`` with the ids of every text as an array column."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder, _ = load(path)
        for texts in batches:
            yield pd.Series([encoder.encode(t) for t in texts])

    return docs.withColumn(out_col, ids(F.coalesce(F.col(text_col), F.lit(""))))
