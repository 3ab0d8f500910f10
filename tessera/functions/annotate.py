"""Rule annotation of texts: mentions with their places in 13 buckets, by a small grammar of patterns, in the JVM."""

from __future__ import annotations

import calendar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let

#: Word edges by Unicode letters and digits, whatever the regular expressions' own idea of a word is.
_BEFORE, _AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def word(pattern: str) -> str:
    """The pattern as whole words."""
    return f"{_BEFORE}(?:{pattern}){_AFTER}"


def one_of(*patterns: str) -> str:
    return "(?:" + "|".join(patterns) + ")"


def full_or_short(name: str) -> str:
    """A month by its name or its first three letters."""
    return name if len(name) == 3 else f"{name[:3]}(?:{name[3:]})?"


YEAR = "(?:1[7-9]|20)[0-9]{2}"
MONTH = one_of(*map(full_or_short, calendar.month_name[1:]))
DAY, MONTH_NUMBER, TO = "(?:0[1-9]|[12][0-9]|3[01])", "(?:0[1-9]|1[0-2])", r"\s*[-–—]\s*"
SHORT_DAY, SHORT_MONTH = f"(?:{DAY}|[1-9])", f"(?:{MONTH_NUMBER}|[1-9])"
CAPITAL = "[A-Z][a-z]+"
#: How dates are written; a mention counts in each form that it has.
DATE_FORMS = {
    "month_day_year": word(rf"(?i:{MONTH})\s+[0-9]{{1,2}},?\s+[0-9]{{4}}"),
    "iso": word(f"{YEAR}-{MONTH_NUMBER}-{DAY}"),
    "numeric": word(one_of(f"{SHORT_MONTH}[/.]{SHORT_DAY}[/.]{YEAR}", rf"{SHORT_DAY}\.{SHORT_MONTH}\.{YEAR}")),
    "month_year": word(rf"(?i:{MONTH})[,.]?\s+{YEAR}"),
    "span": word(YEAR + TO + YEAR),
    "about": word(rf"(?i:c\.|ca\.|circa|fl\.|floruit)\s*{YEAR}"),
}
#: Public numbers: an ISBN has nine digits and a check digit, with the prefix 978 or 979 or without; an ISSN has seven and
#: a check digit; a DOI is 10., a registrant, a slash and what the registrant likes.
IDENTIFIER_FORMS = {
    "isbn": word(r"ISBN(?:-1[03])?:?\s*(?:97[89][ -]?)?(?:[0-9][ -]?){9}[0-9Xx]"),
    "issn": word(r"ISSN:?\s*[0-9]{4}-[0-9]{3}[0-9Xx]"),
    "doi": word(r"10\.[0-9]{4,9}/(?:[^\s]*[A-Za-z0-9])"),
}
#: A page or a stretch of pages, called so in English.
PAGES = word(rf"(?:pp?\.|[Pp]ages?)\s*[0-9]{{1,5}}(?:{TO}[0-9]{{1,5}})?")
#: Authors by surname, joined by and, & or commas, perhaps with others, and a year in brackets.
SURNAME = f"{CAPITAL}(?:-{CAPITAL})?"
CITATIONS = _BEFORE + rf"{SURNAME}(?:(?:\s+and\s+|\s+&\s+|,\s+){SURNAME}){{0,5}}(?:\s+et\s+al\.?)?\s+\({YEAR}[a-z]?\)"
#: Names of up to five words that begin with a capital, initials and numbers among them ("Dr. Holt", "Speaker 2").
NAMED = r"\p{Lu}[\p{L}.'’-]*(?: (?:\p{Lu}[\p{L}.'’-]*|[0-9]{1,3})){0,4}"
#: Group 1 is the mention. A byline is a line of its own that says by whom the text is.
BYLINE = rf"(?m)^ *(?:(?i:(?:(?:text|story|words|report|article) )?by|authors?:|writer:) +)({NAMED}) *$"
#: A line that only numbers and names a part of a work.
CHAPTER = r"(?m)^ *((?i:chapter|part|section|book|act|appendix) +(?:[0-9]{1,4}(?:\.[0-9]{1,4})*|[IVXLC]{1,8}|[A-Z])(?: *[.:–—-] *\S[^\n]*?)?) *$"
#: Who speaks: a name at a line's beginning, perhaps after a time in square brackets, and a colon before what is said.
SPEAKER = rf"(?m)^ *(?:\[[0-9]{{1,2}}(?::[0-9]{{2}}){{1,2}}(?:\.[0-9]{{1,3}})?\] *)?({NAMED}): +(?=\S)"
#: Where a report comes from: a town in capitals, perhaps what it lies in, and a dash before the text.
DATELINE = r"(?m)^ *(\p{Lu}{2}(?:[\p{Lu} .'’-]*\p{Lu})?(?:, *\p{Lu}(?:[\p{L} .'’-]*\p{L})?)?) *(?:[–—]|--) +(?=\S)"
#: Used where no list is given: words that end names of organisations, and verbs of what happens once.
SUFFIXES = ("company", "limited", "plc", "college", "university", "school", "museum", "ministry", "bank", "council", "union", "society", "trust")
TRIGGERS = ("born", "built", "died", "elected", "ended", "founded", "married", "opened", "signed", "started", "won")
BUCKETS = ("years", "dates", "pages", "identifiers", "bylines", "datelines", "speakers", "citations", "chapters", "people", "organizations", "events", "locations")
STRETCH = 128
SPAN = "array<struct<text:string,start:int,end:int>>"


def places(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<text, start, end>> of a pattern's matches; places (of the group, where it isn't the whole match) count code points, ends are exclusive."""

    def placed(v: Column) -> Column:
        """In stretches of STRETCH matches, so that arrays that grow stay short."""
        last = F.floor((F.size(v["found"]) - 1) / STRETCH).cast("int")
        of = lambda k: F.sequence(k * STRETCH, F.least((k + 1) * STRETCH, F.size(v["found"])) - 1)
        gap = lambda i: F.char_length(F.get(v["between"], i)) + F.char_length(F.get(v["found"], i))
        total = lambda k: F.aggregate(of(k), F.lit(0), lambda t, i: t + gap(i))
        begins = F.aggregate(
            F.sequence(F.lit(0), last), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda a, k: F.struct((a["at"] + total(k)).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"],
        )

        def step(a: Column, i: Column) -> Column:
            begin = a["at"] + F.char_length(F.get(v["between"], i))
            whole, part = F.get(v["found"], i), F.get(v["inner" if group else "found"], i)
            off = F.greatest(F.instr(whole, part) - 1, F.lit(0)) if group else F.lit(0)
            span = F.struct(part.alias("text"), (begin + off).alias("start"), (begin + off + F.char_length(part)).alias("end"))
            return F.struct((begin + F.char_length(whole)).alias("at"), F.array_append(a["out"], span.cast("struct<text:string,start:int,end:int>")).alias("out"))

        local = lambda begin, k: F.aggregate(of(k), F.struct(begin.alias("at"), F.array().cast(SPAN).alias("out")), step, lambda a: a["out"])
        return F.flatten(F.transform(begins, local))

    all_of = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    # a text is searched as seldom as can be: the whole matches are their own group 0
    parts = F.struct(all_of(0).alias("found"), F.split(text, pattern, -1).alias("between"), *([all_of(group).alias("inner")] if group else []))
    return F.when(text.rlike(pattern), let(parts, placed)).otherwise(F.array().cast(SPAN))


def sentence_places(text: Column) -> Column:
    """Sentences with their places: what ends in ., ! or ? before white space, or with the text."""
    return places(text, r"(?s)\S.*?(?:[.!?](?=\s)|\z)")


def annotations(c: Column, first_names: tuple[str, ...] = (), suffixes: tuple[str, ...] = SUFFIXES, triggers: tuple[str, ...] = TRIGGERS) -> Column:
    """map<bucket, mentions> of BUCKETS but locations (see gazetteer_mentions). Without first names all pairs of capitalised words are people."""
    text = F.coalesce(c, F.lit(""))
    people = places(text, word(rf"{CAPITAL}\s+{CAPITAL}"))
    if first_names:
        people = F.filter(people, lambda m: F.lower(F.regexp_extract(m["text"], CAPITAL, 0)).isin(*first_names))
    # a run of words up to its last suffix
    ending = rf"(?is)^(.*\s{one_of(*suffixes)})(?:\s.*)?$"
    cut = lambda m: let(F.regexp_extract(m["text"], ending, 1), lambda t: F.struct(t.alias("text"), m["start"].alias("start"), (m["start"] + F.char_length(t)).alias("end")))
    organizations = F.transform(F.filter(places(text, r"[A-Za-z0-9&][A-Za-z0-9& \t]*"), lambda m: m["text"].rlike(ending)), cut)
    found = {
        "years": places(text, word(YEAR)),
        "dates": F.concat(*(places(text, p) for p in DATE_FORMS.values())),
        "pages": places(text, PAGES),
        "identifiers": F.concat(*(places(text, p) for p in IDENTIFIER_FORMS.values())),
        "bylines": places(text, BYLINE, 1),
        "datelines": places(text, DATELINE, 1),
        "speakers": places(text, SPEAKER, 1),
        "citations": places(text, CITATIONS),
        "chapters": places(text, CHAPTER, 1),
        "people": people,
        "organizations": organizations,
        "events": F.filter(sentence_places(text), lambda m: m["text"].rlike("(?i)" + word(one_of(*triggers)))),
    }
    return F.map_from_arrays(F.array(*map(F.lit, found)), F.array(*(v.cast(SPAN) for v in found.values())))


#: Buckets whose mentions are just what their patterns match.
PLAIN = {"years": [word(YEAR)], "dates": [*DATE_FORMS.values()], "pages": [PAGES], "identifiers": [*IDENTIFIER_FORMS.values()], "people": [word(rf"{CAPITAL}\s+{CAPITAL}")], "citations": [CITATIONS]}


def mention_count(c: Column, bucket: str) -> Column:
    """How many mentions a bucket of PLAIN has; without their places, which cost more."""
    return sum((F.regexp_count(F.coalesce(c, F.lit("")), F.lit(p)) for p in PLAIN[bucket]), F.lit(0)).cast("long")


def gazetteer_mentions(docs: DataFrame, terms: DataFrame, key: str = "doc_id", most: int = 4) -> DataFrame:
    """(key, term, kind, start, end) of each whole-word occurrence in `text` of a term (term, kind) of up to `most` words, by an equi join on words.

    Terms and texts meet in lower case with single spaces; words are runs of letters and digits.
    """
    words = docs.select(key, places(F.coalesce("text", F.lit("")), r"[\p{L}\p{N}]+").alias("w"))
    words = words.select(key, "w", F.explode(F.array(*(F.lit(n) for n in range(1, most + 1)))).alias("__n"))
    last = F.size("w") - F.col("__n")
    runs = words.where(last >= 0).select(key, F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(F.col("w"), i + 1, F.col("__n")))).alias("__i", "r"))
    joined = F.lower(F.array_join(F.transform("r", lambda x: x["text"]), " "))
    grams = runs.select(key, joined.alias("__t"), F.get("r", F.lit(0))["start"].alias("start"), F.element_at("r", -1)["end"].alias("end"))
    return grams.join(wanted_terms(terms), F.col("__t") == F.col("__k")).select(key, "term", "kind", "start", "end")


def wanted_terms(terms: DataFrame) -> DataFrame:
    return terms.select(F.lower(F.trim(F.regexp_replace("term", r"[^\p{L}\p{N}]+", " "))).alias("__k"), "term", "kind").distinct()


def gazetteer_counts(docs: DataFrame, terms: DataFrame, key: str = "doc_id", most: int = 4) -> DataFrame:
    """(key, term, kind, n): how many occurrences gazetteer_mentions finds. Only words and their runs are made, no places."""

    def of(w: Column, n: int) -> Column:
        return F.transform(w, lambda x, i: F.when(i + n <= F.size(w), F.lower(F.array_join(F.slice(w, i + 1, n), " ") if n > 1 else x)))

    runs = lambda w: F.concat(*(of(w, n) for n in range(1, most + 1)))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    grams = docs.select(key, F.explode(let(words, runs)).alias("__t"))
    return grams.join(wanted_terms(terms), F.col("__t") == F.col("__k")).groupBy(key, "term", "kind").agg(F.count("*").alias("n"))


def in_gazetteer(tokens: Column, terms: list[str]) -> Column:
    """Tokens that a (small) list of terms holds; long lists join a table of terms instead."""
    return F.array_intersect(tokens, F.array(*map(F.lit, terms)))


def mirrored(c: Column) -> Column:
    """Whether a phrase of two words comes back in reverse within the text."""
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))

    def found(w: Column) -> Column:
        pairs = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.struct(x.alias("a"), F.get(w, i + 1).alias("b")))
        back = F.transform(pairs, lambda p: F.struct(p["b"].alias("a"), p["a"].alias("b")))
        return let(pairs, lambda p: F.size(F.filter(F.array_intersect(p, back), lambda x: x["a"] != x["b"])) > 0)

    return let(words, found)


def gate_score(features: list[Column], weights: list[float], bias: float) -> Column:
    """Logistic gate of weighted features."""
    z = sum((f * w for f, w in zip(features, weights, strict=True)), F.lit(bias))
    return 1 / (1 + F.exp(-z))
