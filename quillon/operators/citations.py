"""Quotes as evidence: windows around an anchor, clipping, and re-anchoring to stored text.

Everything is a column expression over a row's own text, so it runs inside the stage that holds
the text and needs no shuffle. Positions count code points from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentence breaks, the window's least side and largest size, the placeholder format,
# and what counts as an anchor inside a quote.
BREAKS = "。！？；\\n"
SIDE, TOTAL, CLIP = 48, 180, 40
PLACEHOLDER = r"(?i)(?:PERSON|NAME|PHONE|ACCOUNT|ID|ORG|ORGANIZATION|DEVICE|BANK_CARD|CREDIT_CARD)_[a-f0-9]{1,16}"
INNER, RUN = "[“「\"']([^”」\"']{2,40})[”」\"']", "[\\x{4e00}-\\x{9fff}]{2,12}(?:有限公司|公司|银行|账户)?"


def _s(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def cut(c: Column, start: Column, end: Column) -> Column:
    return F.substr(c, start + 1, F.greatest(end - start, F.lit(0)))


def _bind(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def literal(c: Column) -> Column:
    """A pattern that matches exactly this text."""
    return F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def occurrences(text: Column, token: Column) -> Column:
    """Starts of the token in the text, left to right, without overlaps; none for fewer than two
    characters."""
    def ends(pieces: Column) -> Column:
        zero = F.array().cast("array<int>")
        seen = lambda a, p: F.array_append(a, F.coalesce(F.element_at(a, -1) + F.length(token), F.lit(0)) + F.length(p))
        return F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), zero, lambda a, p: F.when(F.size(a) == 0, F.array(F.length(p))).otherwise(seen(a, p)))

    return F.when(F.length(token) >= 2, _bind(F.split(text, literal(token), -1), ends)).otherwise(F.array().cast("array<int>"))


def window_bounds(text: Column, start: Column, end: Column, side: int = SIDE, total: int = TOTAL) -> Column:
    """struct(lo, hi): at least `side` characters and at least to the sentence's breaks on both
    sides, then grown alternately (left first) to `total`, or cut to it around the anchor."""
    n = F.length(text)
    left = F.length(F.regexp_extract(cut(text, F.lit(0), start), f"(?s)^.*[{BREAKS}]", 0))
    right = F.length(F.regexp_extract(cut(text, end, n), f"^[^{BREAKS}]*[{BREAKS}]", 0))
    limit = F.greatest(start - side, F.lit(0))
    first = F.struct(
        F.when(left > 0, F.least(left, limit)).otherwise(limit).alias("lo"),
        F.when(right > 0, F.greatest(end + right, F.least(n, end + side))).otherwise(F.least(n, end + side)).alias("hi"),
    )

    def sized(b: Column) -> Column:
        lo, hi = b["lo"], b["hi"]
        need = F.least(F.lit(total), n) - (hi - lo)
        take = F.least(lo, F.greatest(F.ceil(need / 2).cast("int"), need - (n - hi)))
        grown = F.struct((lo - take).alias("lo"), (hi + need - take).alias("hi"))
        room = F.greatest(F.lit(24), F.floor((F.lit(total) - (end - start)) / 3).cast("int"))
        a = F.greatest(start - F.least(start - lo, room), F.lit(0))
        z = F.least(n, a + total)
        far = F.least(n, end + 8)
        held = F.when(z < end, F.struct(F.greatest(far - total, F.lit(0)).alias("lo"), far.alias("hi"))).otherwise(F.struct(a.alias("lo"), z.alias("hi")))
        return F.when(need > 0, grown).when(need < 0, held).otherwise(b)

    return _bind(first, sized)


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, "^\\n+|\\n+$", "")


def locate_window(text: Column, surface: Column, preferred: Column | None = None, placeholders: Column | None = None) -> Column:
    """The quote around the surface's occurrence nearest to `preferred` (else the first), or around
    one of its placeholders where the surface itself is absent; empty if there is none, if the
    quote misses both, or if it has fewer than four characters."""
    text, surface = _s(text), F.trim(_s(surface))
    more = F.coalesce(placeholders, F.array().cast("array<string>")) if placeholders is not None else F.array().cast("array<string>")
    more = F.filter(more, lambda p: F.coalesce(F.length(p), F.lit(0)) >= 2)
    spots = lambda token: F.transform(occurrences(text, token), lambda at: F.struct(at.alias("a"), (at + F.length(token)).alias("b")))
    own = spots(surface)
    every = F.when(F.size(own) > 0, own).otherwise(F.flatten(F.transform(more, spots)))
    distance = (lambda x: F.abs(x["a"] - preferred)) if preferred is not None else (lambda x: F.lit(0))
    ranked = F.transform(every, lambda x, k: F.struct(F.coalesce(distance(x), F.lit(0)).alias("d"), k.alias("k"), x["a"].alias("a"), x["b"].alias("b")))
    covers = lambda q: (surface == "") | F.contains(q, surface) | F.exists(more, lambda p: F.contains(q, p))

    def quote(at: Column) -> Column:
        wide = _bind(window_bounds(text, at["a"], at["b"]), lambda w: _bare(cut(text, w["lo"], w["hi"])))
        near = _bare(cut(text, F.greatest(at["a"] - SIDE, F.lit(0)), F.least(F.length(text), at["b"] + SIDE)))
        best = _bind(wide, lambda q: F.when(covers(q), q).when(covers(near), near).otherwise(F.lit("")))
        return _bind(best, lambda q: F.when(F.length(F.trim(q)) >= 4, q).otherwise(F.lit("")))

    return F.coalesce(_bind(F.array_min(ranked), lambda at: F.when(at.isNotNull(), quote(at))), F.lit(""))


def whitespace_slice(text: Column, quote: Column) -> Column:
    """The text's own slice that equals the quote but for white space, else null."""
    text, quote = _s(text), _s(quote)
    tight = F.regexp_replace(quote, r"(?U)\s+", "")
    spaced = F.regexp_replace(tight, "(?s)(.)", r"\\Q$1\\E\\s*")
    pattern = F.concat(F.lit("(?U)"), F.substr(spaced, F.lit(1), F.length(spaced) - 3))
    found = F.when(F.contains(F.regexp_replace(text, r"(?U)\s+", ""), tight), F.regexp_substr(text, pattern))
    return F.when(tight == "", F.lit(None)).when(F.contains(text, quote), quote).otherwise(found)


def hashed(quote: Column) -> Column:
    return F.sha2(quote, 256)


def verified(text: Column, quote: Column, expected: Column) -> Column:
    """Whether the quote is in the text and has the hash that is stored for it."""
    return (F.coalesce(F.length(quote), F.lit(0)) > 0) & F.coalesce(F.contains(text, quote) & (hashed(quote) == expected), F.lit(False))


def clip(text: Column, most: int = CLIP) -> Column:
    """The first `most` characters; where a placeholder stands on the edge, the clip starts at it,
    or ends before it if it is longer than a clip."""
    text = _s(text)
    tokens = F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))
    between = F.transform(F.split(text, PLACEHOLDER), lambda x: F.length(x))

    def spans(t: Column) -> Column:
        lengths = F.transform(t, lambda x: F.length(x))
        at = lambda k: F.aggregate(F.slice(between, F.lit(1), k + 1), F.lit(0), lambda s, x: s + x) + F.aggregate(F.slice(lengths, F.lit(1), k), F.lit(0), lambda s, x: s + x)
        return F.transform(t, lambda x, k: F.struct(at(k).alias("a"), (at(k) + F.length(x)).alias("b")))

    edge = F.get(F.filter(spans(tokens), lambda x: (x["a"] < most) & (x["b"] > most)), F.lit(0))
    start = cut(text, F.lit(0), F.lit(most))

    def out(x: Column) -> Column:
        before = F.regexp_replace(cut(text, F.lit(0), x["a"]), r"(?U)\s+$", "")
        whole = F.when(x["a"] + most <= F.length(text), cut(text, x["a"], x["a"] + most)).otherwise(cut(text, x["a"], x["b"]))
        return F.when(x.isNull(), start).when(x["b"] - x["a"] <= most, whole).when(before != "", before).otherwise(start)

    return F.when(F.length(text) <= most, text).otherwise(_bind(edge, out))


def snippet(text: Column, term: Column, most: int = CLIP) -> Column:
    """A short slice of the text around the term: from its quotation marks if it has some, else a
    quarter of the spare room before it, else the text's start."""
    text, term = _s(text), F.trim(_s(term))
    n = F.length(text)
    places = [F.instr(text, F.concat(F.lit(a), term, F.lit(b))) for a, b in (("“", "”"), ('"', '"'), ("「", "」"))]
    marked = F.coalesce(*(F.when(p > 0, p - 1) for p in places))
    plain = F.instr(text, term) - 1
    lead = F.greatest(plain - F.floor(F.greatest(F.lit(most) - F.length(term), F.lit(0)) / 4).cast("int"), F.lit(0))
    hi = F.least(n, lead + most)
    out = F.when(marked.isNotNull(), clip(cut(text, marked, marked + F.greatest(F.length(term) + 2, F.lit(most))), most)).when(plain >= 0, clip(cut(text, F.greatest(hi - most, F.lit(0)), hi), most)).otherwise(clip(text, most))
    return F.when(n <= most, text).when(term == "", clip(text, most)).otherwise(out)


def quote_variants(quote: Column) -> Column:
    """The quote as it is, with straight quotation marks as curly ones and the other way round, and
    without white space."""
    q = F.trim(_s(quote))
    return F.filter(F.array(q, F.translate(q, '"', "“"), F.translate(q, "“”", '""'), F.regexp_replace(q, r"(?U)\s+", "")), lambda x: x != "")


def anchor_terms(quote: Column, terms: Column) -> Column:
    """Given terms, then what the quote itself sets in quotation marks, then its runs of Chinese."""
    q = _s(quote)
    inner = F.regexp_extract_all(q, F.lit(INNER), F.lit(1))
    runs = F.regexp_extract_all(q, F.lit(RUN), F.lit(0))
    given = F.transform(F.coalesce(terms, F.array().cast("array<string>")), lambda t: F.trim(_s(t)))
    return F.array_distinct(F.filter(F.concat(given, inner, runs), lambda t: F.length(t) >= 2))


def reanchored(text: Column, quote: Column, terms: Column, most: int | None = None) -> Column:
    """The stored slice a citation stands for, or null: the quote or a variant of it, with or
    without white space, else the window of the first anchor that is found. Longer ones than
    `most` are clipped around an anchor that they hold, as long as the clip is in the text."""
    text = _s(text)
    found = F.filter(F.transform(quote_variants(quote), lambda v: whitespace_slice(text, v)), lambda x: x.isNotNull())
    anchors = anchor_terms(quote, terms)
    windows = F.filter(F.transform(anchors, lambda t: locate_window(text, t)), lambda x: x != "")
    located = F.coalesce(F.get(found, F.lit(0)), F.get(windows, F.lit(0)))
    if most is None:
        return located

    def short(x: Column) -> Column:
        term = F.coalesce(F.get(F.filter(anchors, lambda t: F.contains(x, t)), F.lit(0)), F.lit(""))
        a, b = snippet(x, term, most), clip(x, most)
        return F.when(F.length(x) <= most, x).when((a != "") & F.contains(text, a), a).when(F.contains(text, b), b).otherwise(x)

    return _bind(located, lambda x: F.when(x.isNotNull(), short(x)))


def canonical(citations: DataFrame, chunks: DataFrame, most: int = 80) -> DataFrame:
    """Citations (citation_id, chunk_id, document_version_id, quote, terms array<string>) re-anchored
    to stored chunks (chunk_id, document_version_id, text_redacted, page_start, page_end): adds the
    stored quote, its hash, pages and error (CHUNK_NOT_FOUND, QUOTE_NOT_FOUND or null)."""
    own = chunks.select("chunk_id", "document_version_id", F.lit(True).alias("_in"), F.col("text_redacted").alias("_text"), "page_start", "page_end")
    j = citations.join(own, ["chunk_id", "document_version_id"], "left")
    j = j.withColumn("_q", reanchored(F.col("_text"), F.col("quote"), F.col("terms"), most))
    error = F.when(F.col("_in").isNull(), "CHUNK_NOT_FOUND").when(F.col("_q").isNull(), "QUOTE_NOT_FOUND")
    return j.select("citation_id", "chunk_id", "document_version_id", F.col("_q").alias("quote"), hashed(F.col("_q")).alias("quote_hash"), "page_start", "page_end", error.alias("error"))
