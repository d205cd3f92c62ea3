"""Secret scans in DataFrame functions only: three fixed patterns, and entropy over sliding windows.

Base kinds (`assign`, `access`, `hex`) are leftmost matches that don't overlap within a kind; matches that are too
short are dropped after matching. The kind `entropy` adds spans of candidate strings in which some window of 20
characters has a high Shannon entropy for its character class; counts follow the window one character at a time.
Long candidates, and texts of many matches, are worked on in blocks, so that time and memory grow in proportion.
Allow-listed candidates, and spans that touch a base span, are not added. Places are code points, ends exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import let, renamed

_either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
ASSIGN = "(" + "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The same matches as `AKIA[A-Z0-9]+` of 16 characters or more and `[0-9a-f]+` of 32 or more: runs are maximal.
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "entropy")

CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
#: Bits a character from which a window of that class is taken for a secret. Random text has about 3.1 and 4.1.
BITS = {"hex": 2.9, "other": 3.8}
#: Candidates that are no secrets: digits, UUIDs, words with separators, placeholders, runs of the alphabet. No pattern
#: here repeats a group that Java would match by recursion, so that candidates may be as long as a text.
ALLOWED = "^[0-9]+$|^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|^[-A-Za-z_/=+]*$|[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Xx]{6}|[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd][Ee][Rr]|abcdefgh|ABCDEFGH|01234567"
#: Segments of a candidate, and what holds for one of them where all are judged: placeholders, and words.
SEGMENTS = "(?<=[-_/=+])|(?=[-_/=+])"
PLACEHOLDER = "[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Xx]{6}|[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd][Ee][Rr]|abcdefgh|ABCDEFGH|01234567"
WORDS = "^(?:[-_/=+]|[a-z]+|[A-Z]+|[A-Z][a-z]+|(?:[A-Z]?[a-z]{3,}+|[A-Z]{3,}+)++|)$"
NUMBERS = "^[0-9]+$|^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
#: c log2 c in millionths, so that sums are exact in any order; a window's entropy is log2(w) - sum / w.
CLOGC = [round(c * math.log2(c) * 1e6) if c else 0 for c in range(WINDOW + 2)]
MOST = {k: CLOGC[WINDOW] - round(b * WINDOW * 1e6) for k, b in BITS.items()}

#: Matches, and starts of windows, in a block.
BLOCK, STARTS, CHUNK = 64, 512, 4096
#: Counts are packed by fives of bits, twelve in a number; for each code point of ASCII its symbol.
PACKED = 12
SYMBOL = [ALPHABET.find(chr(c)) for c in range(128)]


def _symbol(k: int) -> str:
    """A symbol's number, the place of its count, one of that count, and whether it is a letter or digit of hex; -1 is none."""
    c, word, shift = ALPHABET[k] if k >= 0 else "", k // PACKED, 5 * (k % PACKED) if k >= 0 else 0
    return f"struct({k} AS k, {word} AS word, {shift} AS shift, {1 << shift if k >= 0 else 0}L AS unit, {int(c != '' and c in 'ABCDEFabcdef')} AS letter, {int(c != '' and c in '0123456789')} AS digit)"


_NO_SPANS = "array<struct<start:int,stop:int,kind:int>>"


def _before(xs: Column, zero: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array, `op` over all elements before it, in blocks, so that many cost little over linear."""
    total = lambda a: F.aggregate(a, zero, op)

    def placed(blocks: Column, totals: Column) -> Column:
        offsets = F.transform(totals, lambda _, i: total(F.slice(totals, F.lit(1), i)))
        return F.flatten(F.zip_with(blocks, offsets, lambda block, offset: F.transform(block, lambda _, j: op(offset, total(F.slice(block, F.lit(1), j))))))

    def divided(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda b: F.slice(xs, b * BLOCK + 1, F.lit(BLOCK)))
        return F.when(F.size(xs) > 0, let(blocks, lambda bs: let(F.transform(bs, total), lambda ts: placed(bs, ts)))).otherwise(F.array().cast("array<int>"))

    return let(xs, divided)


def _matches(text: Column, pattern: str) -> Column:
    """Start and string of each leftmost match that overlaps no other. A match starts after all matches and gaps before it."""

    def placed(found: Column) -> Column:
        gaps = F.slice(F.transform(F.split(text, pattern, -1), F.length), F.lit(1), F.size(found))
        widths = F.slice(F.concat(F.array(F.lit(0)), F.transform(found, F.length)), F.lit(1), F.size(found))
        starts = let(F.zip_with(gaps, widths, lambda x, y: x + y), lambda steps: F.zip_with(_before(steps, F.lit(0), lambda x, y: x + y), steps, lambda x, y: x + y))
        return F.zip_with(starts, found, lambda a, m: F.struct(a.alias("start"), m.alias("s")))

    none = F.array().cast("array<struct<start:int,s:string>>")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(none))


def _runs(symbols: Column, most: Column, whole: bool) -> Column:
    """Stretches (a, b) of up to a block of windows whose sum of c log2 c is at most `most`."""
    more = F.expr(f"array({', '.join(str(y - x) for x, y in zip(CLOGC[:-1], CLOGC[1:], strict=True))})")  # what one more adds
    count = lambda acc, x: F.call_function("shiftright", F.get(acc["counts"], x["word"]), x["shift"]).bitwiseAND(F.lit(31).cast("long")).cast("int")

    def step(acc: Column, x: Column) -> Column:
        come, go, full = x["come"], x["go"], x["i"] >= WINDOW
        left = count(acc, go) + F.when(come["k"] == go["k"], 1).otherwise(0)  # of what goes, when the next is in
        total = acc["total"] + F.get(more, count(acc, come)) - F.when(full, F.get(more, left - 1)).otherwise(0)
        return let(total, lambda t: moved(acc, x, t))

    def moved(acc: Column, x: Column, total: Column) -> Column:
        come, go = x["come"], x["go"]
        counts = F.transform(acc["counts"], lambda c, k: c + F.when(k == come["word"], come["unit"]).otherwise(0) - F.when(k == go["word"], go["unit"]).otherwise(0))
        last, a, b, low = F.get(acc["runs"], F.size(acc["runs"]) - 1), x["i"] + 1 - WINDOW, x["i"] + 1, total <= most
        fields = [counts.alias("counts"), total.alias("total")]
        if whole:
            letters, digits = (acc[k] + come[k] - go[k] for k in ("letter", "digit"))
            low = low | ((total <= MOST["hex"]) & (letters > 0) & (letters + digits == WINDOW))
            fields += [letters.alias("letter"), digits.alias("digit")]
        one = lambda p, q: F.array(F.struct(p.alias("a"), q.alias("b")))
        runs = F.when((a < 0) | ~low, acc["runs"]).when(last["b"] >= a, F.concat(F.slice(acc["runs"], F.lit(1), F.size(acc["runs"]) - 1), one(last["a"], b))).otherwise(F.concat(acc["runs"], one(a, b)))
        return F.struct(*fields, runs.alias("runs"))

    moves = F.transform(symbols, lambda c, i: F.struct(i.alias("i"), c.alias("come"), F.coalesce(F.get(symbols, i - WINDOW), F.expr(_symbol(-1))).alias("go")))
    words = -(-len(ALPHABET) // PACKED)
    start = [F.expr(f"array_repeat(0L, {words})").alias("counts"), F.lit(0).alias("total"), *([F.lit(0).alias("letter"), F.lit(0).alias("digit")] if whole else []), F.expr("cast(array() as array<struct<a:int,b:int>>)").alias("runs")]
    return F.aggregate(moves, F.struct(*start), step, lambda acc: acc["runs"])


def _windows(s: Column, most: Column, whole: bool) -> Column:
    """Stretches (a, b) of s that windows with a sum of c log2 c of at most `most` cover; s is looked at in blocks of STARTS starts.

    With `whole`, a window of hex digits, letters among them, is judged as `hex` whatever is beside it.
    """
    table = F.expr(f"array({', '.join(map(_symbol, SYMBOL))})")
    symbols = F.transform(F.split(s, ""), lambda c: F.get(table, F.ascii(c)))

    def parts(symbols: Column) -> Column:
        last = F.floor((F.size(symbols) - WINDOW) / STARTS).cast("int")
        moved = lambda b: F.transform(let(F.slice(symbols, b * STARTS + 1, F.lit(STARTS + WINDOW - 1)), lambda part: _runs(part, most, whole)), lambda r: F.struct((r["a"] + b * STARTS).alias("a"), (r["b"] + b * STARTS).alias("b")))
        return F.flatten(F.transform(F.sequence(F.lit(0), last), moved))

    def joined(runs: Column) -> Column:
        """Runs of neighbouring blocks that touch are one; both ends rise from run to run."""
        begins = F.filter(runs, lambda r, j: F.coalesce(F.get(runs, j - 1)["b"] < r["a"], F.lit(True)))
        ends = F.filter(runs, lambda r, j: F.coalesce(F.get(runs, j + 1)["a"] > r["b"], F.lit(True)))
        return F.zip_with(begins, ends, lambda x, y: F.struct(x["a"].alias("a"), y["b"].alias("b")))

    return let(let(symbols, parts), joined)


def _apart(added: Column, base: Column) -> Column:
    """Those of the spans `added`, in order and apart from each other, that touch none of `base`.

    A span touches one if, of those that start before its end, the furthest reaches beyond its start.
    """
    event = lambda at, kind, far, e: F.struct(at.alias("at"), F.lit(kind).alias("kind"), far.alias("far"), e.alias("e"))
    events = F.array_sort(F.concat(F.transform(added, lambda e: event(e["stop"], 0, F.lit(-1), e["start"])), F.transform(base, lambda b: event(b["start"], 1, b["stop"], F.lit(-1)))))
    reach = lambda es: _before(F.transform(es, lambda e: e["far"]), F.lit(-1), lambda x, y: F.greatest(x, y))
    kept = lambda es: F.filter(F.zip_with(es, reach(es), lambda e, far: F.struct(e["e"].alias("start"), e["at"].alias("stop"), (F.lit(3)).alias("kind"), ((e["kind"] == 0) & (far <= e["e"])).alias("ok"))), lambda x: x["ok"])
    return F.transform(let(events, kept), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind")))


def _spans(df: DataFrame, text_col: str, whole: bool) -> DataFrame:
    """df, whose columns have no name that starts with `__`, with `__z`, the spans of a text."""
    df = df.withColumn("__t", F.coalesce(F.col(text_col), F.lit("")))
    span = lambda a, b, k: F.struct(a.cast("int").alias("start"), b.cast("int").alias("stop"), F.lit(k).alias("kind"))
    base = lambda c, k: F.transform(c, lambda m: span(m["start"], m["start"] + F.length(m["s"]), k))
    long = F.filter(_matches(F.col("__t"), ASSIGN), lambda m: F.length(F.regexp_extract(m["s"], ASSIGN, 2)) >= 8)
    df = df.withColumn("__b", F.concat(base(long, 0), base(_matches(F.col("__t"), ACCESS), 1), base(_matches(F.col("__t"), HEX), 2)))
    df = df.withColumn("__c", _matches(F.col("__t"), CANDIDATE))
    if whole:
        masked = lambda s: F.array_join(F.transform(F.split(s, SEGMENTS), lambda x: F.when(x.rlike(PLACEHOLDER), F.repeat(F.lit("x"), F.length(x))).otherwise(x)), "")
        plain = F.transform("__c", lambda m: F.struct(m["start"].alias("start"), F.when(m["s"].rlike(NUMBERS), F.lit("")).otherwise(masked(m["s"])).alias("s")))
        open_ = F.filter(plain, lambda m: (F.length(m["s"]) > 0) & ~F.forall(F.split(m["s"], SEGMENTS), lambda x: x.rlike(WORDS)))
    else:
        open_ = F.filter("__c", lambda m: ~m["s"].rlike(ALLOWED))
    df = df.withColumn("__c", F.when(F.size("__c") > 0, open_).otherwise(F.col("__c")))
    most = lambda s: F.when(s.rlike("^[0-9a-fA-F]+$"), MOST["hex"]).otherwise(MOST["other"])
    added = F.flatten(F.transform("__c", lambda m: F.transform(let(most(m["s"]), lambda most: _windows(m["s"], most, whole)), lambda w: span(m["start"] + w["a"], m["start"] + w["b"], 3))))
    df = df.withColumn("__e", F.when(F.size("__c") > 0, added).otherwise(F.array().cast(_NO_SPANS)))
    fresh = F.col("__e") if whole else F.when((F.size("__e") > 0) & (F.size("__b") > 0), _apart(F.col("__e"), F.col("__b"))).otherwise(F.col("__e"))
    ordered = F.array_sort(F.transform(F.concat(F.col("__b"), fresh), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"))))
    spans = F.transform(ordered, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    return df.withColumn("__z", F.when(F.size("__b") + F.size("__e") > 0, spans).otherwise(F.array().cast(_NO_SPANS)))


def find_secrets(docs: DataFrame, text_col: str = "text", spans_col: str = "secret_spans", whole: bool = False) -> DataFrame:
    """docs with an array of (start, stop, kind), by start and then kind as in KINDS (0 for `assign`); none for a null or empty text.

    `whole` widens what the query's SQL and tests state, for the pipeline: spans that touch a base span stay, and each window
    is judged by its own characters; of the allow-list, placeholders count for their segment and words by their case.
    The column replaces one of its name. Each row is judged by itself, so repeated rows get the same spans, and an empty
    table gives no rows; a text, or a candidate in it, may be as long as a row can be.
    """
    df, names = renamed(docs)
    df = _spans(df, names[docs.columns.index(text_col)], whole)
    kept = [(n, c) for n, c in zip(names, docs.columns, strict=True) if c.lower() != spans_col.lower()]
    return df.select(*[n for n, _ in kept], "__z").toDF(*[c for _, c in kept], spans_col)


def spans_text(spans: Column) -> Column:
    """`kind:start:end`, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), s["kind"]), s["start"], s["stop"])), ",")


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", whole: bool = False) -> DataFrame:
    """docs, each stretch of text that spans cover replaced by `mark`; other rows, null and empty texts as they are. `whole` as in find_secrets."""
    df, names = renamed(docs)
    at = docs.columns.index(text_col)
    text = F.col(names[at])
    reach = _before(F.transform("__z", lambda s: s["stop"]), F.lit(-1), lambda x, y: F.greatest(x, y))
    df = _spans(df, names[at], whole).withColumn("__z", F.when(F.size("__z") > 0, F.zip_with("__z", reach, lambda s, far: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), far.alias("far")))))

    def clean(spans: Column) -> Column:
        heads = F.filter(spans, lambda s: s["far"] < s["start"])
        begins = F.concat(F.slice(F.transform(heads, lambda s: s["far"]), F.lit(2), F.size(heads)), F.array(F.array_max(F.transform(spans, lambda s: s["stop"]))))
        gaps = F.arrays_zip(F.concat(F.array(F.lit(0)), begins).alias("p"), F.concat(F.transform(heads, lambda s: s["start"]), F.array(F.length(text))).alias("q"))
        chunks = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / CHUNK).cast("int")), lambda k: F.substring(text, k * CHUNK + 1, F.lit(CHUNK)))

        def piece(chunks: Column, z: Column) -> Column:
            first = lambda k: F.greatest(z["p"] - k * CHUNK, F.lit(0))
            return F.array_join(F.transform(F.sequence(F.floor(z["p"] / CHUNK).cast("int"), F.floor(z["q"] / CHUNK).cast("int")), lambda k: F.substring(F.get(chunks, k), first(k) + 1, F.least(z["q"] - k * CHUNK, F.lit(CHUNK)) - first(k))), "")

        return let(chunks, lambda cs: F.array_join(F.transform(gaps, lambda z: piece(cs, z)), mark))

    df = df.withColumn("__o", F.when(F.size("__z") > 0, let(F.col("__z"), clean)).otherwise(text))
    return df.select(*["__o" if k == at else n for k, n in enumerate(names)]).toDF(*docs.columns)
