"""Secret scans with multipart credential linking, in DataFrame operations only.

Base scan. Three kinds of spans by pattern (assignments, access identifiers, hex runs), leftmost and without
overlap within a kind. No pattern crosses a line end, so texts are scanned line by line, and only lines that can hold a
part are looked at. Positions come from splitting a line at the matches: running sums of the lengths of matches and of
what lies between are code point offsets.

Linking. A multipart credential is an access identifier, a secret and an endpoint that belong together. Weak
candidates of each part (short or unlabelled strings that alone would be noise) are found too. Every part
reaches through its scope, the interval between blank lines. Weak candidates are joined with the parts of other roles
on that interval; the join runs inside the row, scope by scope in order of place, so that nothing is shuffled and
no pairs are made. A weak candidate is reported if its scope has a part with which it forms a credential: a secret
beside an identifier or an endpoint, and either of these beside a secret. Base spans are always reported.

Running sums go in blocks, and scopes are runs of lines, so that the work grows with the text's length but for a small share
that takes the power of one and a half.

Defined results: null texts are empty; texts without matches give counts of 0, empty span lists and the hash
of the empty string; repeated rows get a row each; an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns, and what is checked after a match.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # a run is taken whole, so that asking for its length at once is the same as checking after
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

#: Weak candidates of the three roles.
WEAK_ACCESS = r"(?i:access_?key(?:_?id)?|client_?id|account|user(?:name)?|login)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@._-]{4,64}"
WEAK_SECRET = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[^A-Z]{0,63}[A-Z]|[a-z0-9+/_-]{64,}+[A-Z])[A-Za-z0-9+/_-]{32,}+(?![A-Za-z0-9+/_-])"
WEAK_ENDPOINT = r"(?:https?|ftp|s3|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D\"'<>]{3,}|(?i:host|endpoint|region|server)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.-]{4,}"
BLANK = r"[\x20\x09\r]*"  # a line of these alone parts scopes
#: What a line with a part has to hold.
SOME = r"[:=]|AKIA|[0-9a-f]{24}|[A-Za-z0-9+/_-]{32}"
KINDS = ("assign", "access", "hex", "weak_access", "weak_secret", "weak_endpoint")
STEP = 32  # places of a block of running sums
SPANS = "array<struct<s:int,k:int,e:int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often it occurs there."""
    return F.transform(F.array(value), body)[0]


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda s, x: s + x)


def blocked(v: Column, width: Column, heads: Callable[[Column], Column]) -> Column:
    """Sums before each place of an array that isn't empty, from blocks and what ``heads`` makes of the blocks' sums."""
    blocks = F.transform(F.sequence(F.lit(0), F.size(v) - 1, width), lambda k: F.slice(v, k + 1, width))
    joined = lambda b, before: F.flatten(F.transform(b, lambda x, i: let(F.get(before, i), lambda head: F.transform(x, lambda _, k: head + total(F.slice(x, 1, k))))))
    return let(blocks, lambda b: let(heads(F.transform(b, total)), lambda before: joined(b, before)))


def running(values: Column) -> Column:
    """Sums of the values before each place of an array: in blocks of ``STEP``, whose sums go in blocks of their root."""
    each = lambda sums: F.transform(sums, lambda _, i: total(F.slice(sums, 1, i)))
    roots = lambda sums: blocked(sums, F.ceil(F.sqrt(F.size(sums))).cast("int"), each)
    return let(values, lambda v: F.when(F.size(v) > 0, blocked(v, F.lit(STEP), roots)).otherwise(F.array().cast("array<int>")))


def spans(text: Column, pattern: str, kind: int, keep: Callable[[Column], Column] | None = None) -> Column:
    """Array of (s, k, e): start, kind and end (exclusive) of the pattern's matches, by position.

    ``keep`` tests a match's text; matches that fail it are left out, but what they took stays taken.
    """
    pieces = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))

    def placed(p: Column) -> Column:
        # The last piece is followed by no match.
        starts = running(F.transform(p, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))))
        found = F.zip_with(p, starts, lambda x, at: F.struct((at + F.length(x["gap"])).alias("s"), x["hit"].alias("hit")))
        good = F.filter(found, lambda x: x["hit"].isNotNull() if keep is None else x["hit"].isNotNull() & keep(x["hit"]))
        return F.transform(good, lambda x: F.struct(x["s"], F.lit(kind).alias("k"), (x["s"] + F.length(x["hit"])).alias("e")))

    return let(pieces, placed)


def only_if(test: Column, value: Column) -> Column:
    return F.when(test, value).otherwise(F.array().cast(SPANS))


def text_of(found: Column) -> Column:
    """kind:start:end, comma-joined, by start, then kind."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(found), lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")


def parts_of(line: Column) -> Column:
    """A line's base spans, and the weak candidates that no base span overlaps, by role."""
    base = F.struct(
        only_if(line.rlike("[:=]"), spans(line, ASSIGN, 0, lambda h: F.length(F.regexp_extract(h, ASSIGN, 1)) >= ASSIGN_LEAST)).alias("assign"),
        only_if(F.contains(line, F.lit("AKIA")), spans(line, ACCESS, 1, lambda h: F.length(h) >= ACCESS_LEAST)).alias("access"),
        only_if(line.rlike(HEX), spans(line, HEX, 2)).alias("hex"),
    )

    def weak(b: Column) -> Column:
        taken = F.concat(b["assign"], b["access"], b["hex"])
        # A weak candidate that lies in a base span says nothing new.
        apart = lambda w: F.filter(w, lambda x: ~F.exists(taken, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])))
        marked = line.rlike("[:=]")
        return F.struct(
            b["assign"], b["access"], b["hex"], apart(only_if(marked, spans(line, WEAK_ACCESS, 3))).alias("wa"),
            apart(only_if(line.rlike("[A-Za-z0-9+/_-]{32}"), spans(line, WEAK_SECRET, 4))).alias("ws"), apart(only_if(marked, spans(line, WEAK_ENDPOINT, 5))).alias("we"),
        )

    return let(base, weak)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``assign``, ``access``, ``hex`` and ``linked`` as arrays of (s, k, e): code points, end exclusive."""
    rows = docs.select(F.col(id_col).alias("id"), F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1).alias("lines"))
    # Where no line can hold a part, places aren't asked for.
    some = F.exists("lines", lambda x: x.rlike(SOME))
    numbered = lambda starts, scopes: F.arrays_zip(F.col("lines").alias("line"), starts.alias("at"), scopes.alias("scope"))
    blank = F.transform("lines", lambda x, i: ((i > 0) & (i < F.size("lines") - 1) & x.rlike(f"^{BLANK}$")).cast("int"))
    zipped = numbered(running(F.transform("lines", lambda x: F.length(x) + 1)), running(blank))
    rows = rows.select("id", F.when(some, F.filter(zipped, lambda x: x["line"].rlike(SOME))).alias("held"))
    rows = rows.select("id", F.transform("held", lambda x: F.struct(x["at"].alias("at"), x["scope"].alias("scope"), parts_of(x["line"]).alias("p"))).alias("held"))

    def moved(lines: Column, kind: str) -> Column:
        """Spans of a kind with places in the text."""
        each = F.transform(lines, lambda x: F.transform(x["p"][kind], lambda y: F.struct((y["s"] + x["at"]).alias("s"), y["k"].alias("k"), (y["e"] + x["at"]).alias("e"))))
        return F.coalesce(F.flatten(each), F.array().cast(SPANS))

    def linked(scope: Column) -> Column:
        """The weak parts of a scope's lines that form a credential there."""
        holds = lambda *kinds: F.exists(scope, lambda x: sum((F.size(x["p"][k]) for k in kinds[1:]), F.size(x["p"][kinds[0]])) > 0)
        roles = F.struct(holds("assign", "hex", "ws").alias("secret"), holds("access", "wa", "we").alias("other"))
        return let(roles, lambda r: F.concat(only_if(r["secret"], moved(scope, "wa")), only_if(r["other"], moved(scope, "ws")), only_if(r["secret"], moved(scope, "we"))))

    # Lines come in order, so that a scope's lines are a run: from where the scope's number changes to the next change.
    first = lambda h: F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: (i == 0) | (F.get(h, i)["scope"] != F.get(h, F.greatest(i - 1, F.lit(0)))["scope"]))
    runs = lambda h, at: F.transform(at, lambda s, j: F.slice(h, s + 1, F.coalesce(F.get(at, j + 1), F.size(h)) - s))
    scopes = F.when(F.size("held") > 0, let(first(F.col("held")), lambda at: runs(F.col("held"), at)))
    rows = rows.select("id", "held", F.coalesce(F.flatten(F.transform(scopes, linked)), F.array().cast(SPANS)).alias("linked"))
    return rows.select(F.col("id").alias(id_col), *[moved(F.col("held"), k).alias(k) for k in KINDS[:3]], "linked")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts of base spans by kind, ``base_sha256`` and ``spans``."""
    found = scan(docs, id_col, text_col)
    size = lambda c: F.size(c).cast("long")
    found = found.select(
        id_col, size("assign").alias("n_assign"), size("access").alias("n_access"), size("hex").alias("n_hex"),
        F.concat("assign", "access", "hex").alias("base"), "linked",
    )
    return found.select(id_col, "n_assign", "n_access", "n_hex", F.sha2(text_of(F.col("base")), 256).alias("base_sha256"), text_of(F.concat("base", "linked")).alias("spans"))
