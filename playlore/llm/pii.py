"""Personal data: patterns, and terms that give protected values away, by DataFrame operations only.

The base finds e-mail addresses, IP addresses, card and telephone numbers by pattern.  Their
positions come from cutting the text at the matches: where the pieces between matches end is
where matches start, in code points.

What stands around a value can give it away as well.  The information-theoretic step
estimates that from the corpus.  A value is protected; its contexts are the whole texts that
hold it.  Everything is counted over different texts, so that
copies of a document add nothing to any count.  For a value c and a word t of its contexts

    PMI(c; t) = log2( p(c, t) / (p(c) p(t)) )      and      IC(c) = -log2 p(c)

are taken over all texts, p(t) being the share of texts that hold t.  A word whose
PMI reaches ``REMOVED`` of IC(c) tells (nearly) which value it stands with, and is removed
wherever it stands in a document that holds the value; between ``GENERALISED`` and that it
is replaced by a general term.  Where the value itself isn't written a word still gives it
away if most texts with the word are the value's: from p(c | t) of ``TELLING`` on the word is
treated so in every document.  A word needs ``SUPPORT`` different surroundings with the
value (the 200 characters before and after it), since one meeting is no estimate and texts
that repeat a passage are one meeting.  They may also lie in one text where the word is among
the ``WINDOW`` words on either side of the value each time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

KINDS = ("email", "ip", "card", "phone")
# The patterns in a form that reads each character a bounded number of times.  A match can
# only start where its run of characters starts or where the last match ended (\G), and
# possessive quantifiers don't go back where going back can't help.  A card's run must hold
# twelve digits to start a match at all; no part of a shorter run could be valid.
_PATTERN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?=[0-9](?:[\x20-]?[0-9]){11})[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for its pattern to have any chance.
_HINT = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Words on either side of a value; different contexts needed; shares of the value's
#: information from which a word is generalised and removed.
WINDOW, SUPPORT, GENERALISED, REMOVED = 4, 3, 0.6, 0.9
#: Share of a word's texts that hold the value, from which the word is looked for everywhere.
TELLING = 0.5
#: Characters of a stretch that surroundings are cut from.
STRETCH = 4096
#: Words that are broadcast to the words of all texts; more of them meet in a shuffle.
BROADCAST_TERMS = 100_000
_WORD = r"[^\s\p{Punct}]{3,}+"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    digits = _digits(match)
    place = F.sequence(F.lit(1), F.length(digits))

    def term(i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        doubled = d * 2
        return F.when(i % 2 == 1, d).when(doubled > 9, doubled - 9).otherwise(doubled)

    return F.aggregate(F.transform(place, term), F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
        return F.forall(F.split(match, r"\."), lambda x: (F.length(part(x)) <= 3) & (F.substring(part(x), 1, 3).cast("int") <= 255))
    n = F.length(_digits(match))
    return n.between(12, 19) & _luhn(match) if kind == "card" else n.between(9, 15)


def _cut(text: Column, pattern: str | Column, limit: int = -1) -> Column:
    return F.split(text, pattern, limit)


def _starts(pieces: Column, matches: Column) -> Column:
    """Code points before each match, from the pieces between the matches."""
    steps = F.zip_with(F.slice(pieces, 1, F.size(matches)), F.concat(F.array(F.lit("")), F.slice(matches, 1, F.greatest(F.size(matches) - 1, F.lit(0)))), lambda piece, before: F.length(piece) + F.length(before))
    return _running(steps)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once; a function's argument would be worked out at each mention."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _running(steps: Column, block: int = 128) -> Column:
    """Running totals of an array of numbers, in blocks, so that only blocks are copied while they grow."""
    empty = F.array().cast("array<int>")
    last = lambda done: F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0))
    grow = lambda part: F.aggregate(part, empty, lambda done, step: F.concat(done, F.array(last(done) + step)))
    cut = lambda all_: F.transform(F.filter(F.sequence(F.lit(0), F.ceil(F.size(all_) / block).cast("int")), lambda i: i * block < F.size(all_)), lambda i: grow(F.slice(all_, i * block + 1, F.lit(block))))
    shift = lambda part, by: F.transform(part, lambda x: x + by)
    joined = lambda parts: _let(F.concat(F.array(F.lit(0)), grow(F.transform(parts, last))), lambda before: F.flatten(F.zip_with(parts, F.slice(before, 1, F.size(parts)), lambda part, by: shift(part, by))))
    return _let(steps, lambda all_: _let(cut(all_), joined))


_NONE = "array<struct<kind:string,order:int,start:int,end:int,value:string>>"


def _found(text: str, kind: str) -> Column:
    """Valid matches of a kind in the column ``text`` as an array of structs."""
    pattern = _PATTERN[kind]
    body = F.col(text)
    span = lambda m, s: F.struct(F.lit(kind).alias("kind"), F.lit(KINDS.index(kind)).alias("order"), s.alias("start"), (s + F.length(m)).cast("int").alias("end"), m.alias("value"))
    spans = _let(F.regexp_extract_all(body, F.lit(pattern), 0), lambda matches: F.zip_with(matches, _starts(_cut(body, pattern), matches), span))
    hint = _HINT[kind]
    likely = F.contains(body, F.lit(hint)) if hint else F.lit(True)
    return F.when(likely & body.rlike(pattern), F.filter(spans, lambda x: _valid(kind, x["value"]))).otherwise(F.array().cast(_NONE))


def find_base(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``base``: matches by start, then kind as listed."""
    with_body = docs.withColumn("body", F.coalesce(F.col(text_col), F.lit("")))
    found = F.concat(*[_found("body", kind) for kind in KINDS])
    ordered = F.array_sort(found, lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["order"] - y["order"]))
    return with_body.withColumn("base", ordered)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), 0)


def _hits(based: DataFrame, *columns: str) -> DataFrame:
    """``columns``, value, before and after of every base span, and whether these reach the text's ends.

    The surroundings are cut from the stretch of the text that a value lies in and the two beside
    it, and rows are made of them, not of texts, so a text of very many values is read once a stretch.
    """
    size = F.lit(STRETCH)
    stretches = F.transform(F.sequence(F.lit(0), F.floor(F.length("body") / size).cast("int")), lambda i: F.substring(F.col("body"), i * size + 1, size))

    def around(hit: Column, cut: Column) -> Column:
        first = F.greatest(F.floor((hit["start"] - 200) / size).cast("int"), F.lit(0))
        final = F.floor((hit["end"] + 200) / size).cast("int")
        near, start = F.array_join(F.slice(cut, first + 1, final - first + 1), ""), hit["start"] - first * size
        end = hit["end"] - first * size
        low = F.greatest(start - 199, F.lit(1))
        return F.struct(F.lower(hit["value"]).alias("value"), F.substring(near, low, start - low + 1).alias("before"), F.substring(near, end + 1, F.lit(200)).alias("after"), (hit["start"] <= 200).alias("from_start"), (F.length("body") <= hit["end"] + 200).alias("to_end"))

    hits = _let(stretches, lambda cut: F.transform("base", lambda hit: around(hit, cut)))
    # explode_outer, as explode would have the patterns evaluated once more to filter rows.
    held = based.select(*columns, F.explode_outer(F.when(F.size("base") > 0, hits)).alias("hit")).filter(F.col("hit.value").isNotNull())
    return held.select(*columns, "hit.*")


def _holders(texts: DataFrame, name: str) -> DataFrame:
    """(term, ``name``): how many of the different texts hold each word."""
    return texts.select(F.explode(F.array_distinct(_words(F.col("body")))).alias("term")).groupBy("term").agg(F.count("*").alias(name))


def risky_terms(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """(value, term, removed, telling): words that give a value away, from all different texts."""
    # Copies meet in the map side already, and each text is read once for whatever is counted.
    texts = written(docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("body")).distinct(), "pii-texts")
    inside = written(find_base(texts, text_col="body").filter(F.size("base") > 0).select(F.sha2("body", 256).alias("of"), "body", "base"), "pii-inside")
    # A word that the stretch of text cuts is left out; each side has at most WINDOW words.
    left = F.slice(F.reverse(_words(F.when(F.col("from_start"), F.col("before")).otherwise(F.regexp_replace("before", r"^\S*\s", " ")))), 1, WINDOW)
    right = F.slice(_words(F.when(F.col("to_end"), F.col("after")).otherwise(F.regexp_replace("after", r"\s\S*$", " "))), 1, WINDOW)
    around = F.xxhash64("before", "after").alias("around")
    seen = written(_hits(inside, "of").select("of", "value", around, F.array_distinct(F.concat(left, right)).alias("terms")), "pii-seen")
    values = seen.groupBy("value").agg(F.countDistinct("of").alias("n_value"), F.countDistinct("around").alias("n")).filter(F.col("n") >= SUPPORT)
    values = written(values.select("value", "n_value"), "pii-values")
    # Texts whose occurrences of the value have the same surroundings are one meeting.
    surroundings = F.xxhash64(F.array_sort(F.collect_set("around"))).alias("around")
    meetings = written(seen.join(values, "value").groupBy("value", "of").agg(surroundings), "pii-meetings")
    held = meetings.join(inside.select("of", F.array_distinct(_words(F.col("body"))).alias("words")), "of").select("value", "around", F.explode("words").alias("term"))
    together = held.groupBy("value", "around", "term").agg(F.count("*").alias("n")).groupBy("value", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("n_around"))
    beside = seen.select("value", "around", F.explode("terms").alias("term")).groupBy("value", "term").agg(F.countDistinct("around").alias("n_beside")).filter(F.col("n_beside") >= SUPPORT)
    pairs = together.join(written(beside, "pii-beside"), ["value", "term"], "left").filter((F.col("n_around") >= SUPPORT) | F.col("n_beside").isNotNull())
    whole = float(max(texts.count(), 1))
    # PMI >= GENERALISED * IC says at most this many texts may hold the term.
    most = F.col("n_both") * F.pow(whole / F.col("n_value"), F.lit(1 - GENERALISED)) * (1 + 1e-9)
    # The texts that hold a value are a lower bound, which rules common words out.
    bounded = pairs.join(values, "value").join(_holders(inside, "at_least"), "term").filter(F.col("at_least") <= most)
    pairs = written(bounded.select("value", "term", "n_both", "n_value"), "pii-pairs")
    # Words are counted before they meet the pairs, so the rows don't grow with the terms looked for.
    counted = _holders(texts, "n_term")
    pmi = F.log2(F.col("n_both") * whole / (F.col("n_value") * F.col("n_term")))
    share = pmi / F.greatest(F.log2(whole / F.col("n_value")), F.lit(1e-9))
    return pairs.join(counted, "term").withColumn("share", share).filter(F.col("share") >= GENERALISED).select("value", "term", (F.col("share") >= REMOVED).alias("removed"), (F.col("n_both") >= TELLING * F.col("n_term")).alias("telling"))


def find_all(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``body``, ``base`` and ``more``: spans of words that give values away.

    Null texts count as empty.  Terms are looked for where the value itself stands, telling
    ones in every document.  In rows that share a null id only the base is found, and rows
    that repeat an id share the terms found for it.
    """
    based = find_base(docs.withColumn("__id", F.col(id_col)), text_col=text_col)
    held = written(_hits(based, "__id").select("__id", "value").distinct(), "pii-hits")
    risky = written(risky_terms(docs, text_col=text_col), "pii-risky")
    hits = held.join(risky, "value").select("__id", "term", "removed")
    telling = risky.filter("telling").groupBy("term").agg(F.max("removed").alias("removed"))
    many = telling.limit(BROADCAST_TERMS + 1).count()
    if many:
        words = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.explode(F.array_distinct(_words(F.coalesce(F.col(text_col), F.lit(""))))).alias("term"))
        hits = hits.unionByName(words.join(F.broadcast(telling) if many <= BROADCAST_TERMS else telling, "term"))
    hits = hits.groupBy("__id", "term").agg(F.max("removed").alias("removed"))
    by_doc = written(hits.groupBy("__id").agg(F.sort_array(F.collect_list(F.struct("term", "removed"))).alias("terms")), "pii-terms")
    joined = based.join(by_doc, "__id", "left")
    # Terms hold neither punctuation nor white space, so they stand for themselves in a pattern.
    pattern = F.concat(F.lit(r"(?iu)(?<![^\s\p{Punct}])(?:"), F.array_join(F.transform("terms", lambda x: x["term"]), "|"), F.lit(r")(?![^\s\p{Punct}])"))
    joined = joined.withColumn("pattern", F.when(F.col("terms").isNotNull(), pattern))
    span = lambda m, s: F.struct(m.alias("value"), s.alias("start"), (s + F.length(m)).cast("int").alias("end"))
    spans = _let(F.regexp_extract_all("body", F.col("pattern"), F.lit(0)), lambda matches: F.zip_with(matches, _starts(F.split("body", F.col("pattern"), F.lit(-1)), matches), span))
    removed = F.transform(F.filter("terms", lambda t: t["removed"]), lambda t: t["term"])
    kinds = F.transform(spans, lambda x: F.struct(F.when(F.array_contains(removed, F.lower(x["value"])), "removed").otherwise("term").alias("kind"), F.lit(len(KINDS)).alias("order"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))
    apart = F.filter(kinds, lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    more = F.when(F.col("pattern").isNotNull(), apart).otherwise(F.array().cast(_NONE))
    return joined.withColumn("more", more).drop("__id", "terms", "pattern")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _by_start(spans: Column) -> Column:
    return F.array_sort(spans, lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["order"] - y["order"]))


def pii_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of each kind, base_sha256 and spans for every row of ``docs``.

    Spans are written kind:start:end in code points, by start, then kind; the method's kinds
    are ``term`` (generalised) and ``removed``.  Null and empty texts have no spans.
    """
    found = find_all(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias("n_" + kind)

    counts = [count(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(_by_start(F.concat("base", "more"))).alias("spans"))


def sanitise(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data replaced by ``[KIND]``, terms by ``[TERM]``, or removed.

    Of spans that overlap the one that starts first is replaced, with the longest reach of
    those that overlap it.  Texts without spans are left as they are, null texts too; where a
    text changes, ``length_col`` (if there is one) becomes its new length.
    """
    columns = docs.columns
    renamed = docs.select(F.struct(*[F.col(c) for c in columns]).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = find_all(renamed).withColumn("spans", _by_start(F.concat("base", "more")))
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))

    def step(done: Column, x: Column) -> Column:
        label = F.when(x["kind"] == "removed", "").otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
        between = F.substring(F.col("body"), done["at"] + 1, F.greatest(x["start"] - done["at"], F.lit(0)))
        fresh = x["start"] >= done["at"]
        return F.struct(F.concat(done["text"], F.when(fresh, F.concat(between, label)).otherwise("")).alias("text"), F.greatest(done["at"], x["end"]).alias("at"))

    masked = F.aggregate("spans", start, step, lambda done: F.concat(done["text"], F.substring(F.col("body"), done["at"] + 1, F.length("body"))))
    changed = F.size("spans") > 0
    out = found.withColumn("masked", F.when(changed, masked).otherwise(F.col("text")))
    picked = []
    for c in columns:
        value = F.col("row").getField(c)
        if c == text_col:
            value = F.col("masked")
        elif c == length_col:
            value = F.when(changed, F.length("masked").cast(docs.schema[c].dataType)).otherwise(value)
        picked.append(value.alias(c))
    return out.select(*picked)
