"""Text functions as Column expressions: nothing here leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Function words that tokens leave out. Other languages' lists are passed as a parameter.
STOP_WORDS = (
    # articles and pronouns
    "the", "an", "it", "its", "he", "she", "they", "them", "his", "her", "their", "we", "our", "you", "your", "this", "that", "these", "those", "which", "who", "what",
    # prepositions
    "of", "in", "on", "at", "to", "from", "by", "for", "with", "as", "into", "over", "under", "about", "after", "before", "between",
    # conjunctions and particles
    "and", "or", "but", "nor", "not", "if", "then", "than", "so", "because", "when", "where", "while", "how",
    # verbs that carry little
    "is", "are", "was", "were", "be", "been", "being", "am", "has", "have", "had", "do", "does", "did", "can", "could", "will", "would", "may", "might", "shall", "should", "must",
    # quantities
    "all", "any", "each", "few", "more", "most", "no", "some", "such", "only", "both", "other",
)
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once; within a lambda Spark would work it out for every element."""
    return F.transform(F.array(value), body)[0]


def dehyphenate(c: Column) -> Column:
    """Join words that a hyphen and white space broke apart."""
    return F.regexp_replace(c, r"([\p{L}\p{N}_])-\s+([a-zà-öø-ÿ])", "$1$2")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def repair_mojibake(c: Column) -> Column:
    """Undo UTF-8 read as Latin-1 where that gives valid text and lessens the marks of it."""
    marks = lambda x: F.length(x) - F.length(F.translate(x, "âÃ", ""))
    fixed = F.when(c.rlike("[âÃ]") & c.rlike(r"^[\x00-\xFF]*$"), F.try_validate_utf8(F.encode(c, "ISO-8859-1").cast("string")))
    return F.when(marks(fixed) < marks(c), fixed).otherwise(c)


def normalise_text(c: Column) -> Column:
    """Null to empty, mojibake undone, hyphens joined, white space squeezed."""
    return squeeze(dehyphenate(repair_mojibake(F.coalesce(c, F.lit("")))))


def tokenize(c: Column, stop: Iterable[str] = STOP_WORDS) -> Column:
    """Lower-case ASCII words of two letters or more that are no stop words."""
    # cut at runs of all else: putting a space for each such character first costs six times as much
    words = F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*stop))


def bigrams(tokens: Column) -> Column:
    """The set of adjacent pairs, sorted."""
    pairs = lambda ts: F.transform(F.slice(ts, 1, F.greatest(F.size(ts) - 1, F.lit(0))), lambda t, i: F.concat_ws(" ", t, F.get(ts, i + 1)))
    return F.array_sort(F.array_distinct(let(tokens, pairs)))


def sentences(c: Column) -> Column:
    """Cut after ., ! or ? before white space."""
    return F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"([.!?])\s+", "$1\x1f"), "\x1f")


def windows(c: Column, size: int = 2000, overlap: int = 200) -> Column:
    """Fixed windows of `size` characters that overlap."""
    last = F.greatest(F.floor((F.char_length(c) - overlap - 1) / (size - overlap)), F.lit(0))
    return F.transform(F.sequence(F.lit(0).cast("long"), last), lambda k: F.substring(c, (k * (size - overlap) + 1).cast("int"), F.lit(size)))


def phrases(c: Column, stop: Iterable[str] = STOP_WORDS) -> Column:
    """Runs of words between stop words and punctuation, longer than two characters."""
    cleaned = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s]+", " | ")
    words = F.transform(F.split(cleaned, r"\s+"), lambda w: F.when(w.isin(*stop), F.lit("|")).otherwise(w))
    return F.filter(F.transform(F.split(F.array_join(words, " "), r"\|"), lambda p: F.trim(p)), lambda p: F.length(p) > 2)


def keyword_variants(c: Column) -> Column:
    """As is, lower case, title case, without a plural's s, -ies as -y."""
    low = F.lower(c)
    return F.array_sort(F.array_distinct(F.array(c, low, F.initcap(low), F.regexp_replace(low, "s$", ""), F.regexp_replace(low, "ies$", "y"))))


def mention(c: Column) -> Column:
    """Lower-case ASCII words, joined by a space."""
    return F.array_join(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def normal_name(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", ""))


def normal_date(c: Column) -> Column:
    """ISO date of "Month d, yyyy" or "d Month yyyy", else the year, else as is. No calendar check."""
    names = "|".join([*(m.title() for m in MONTHS), *(m[:3].title() for m in MONTHS if m != "may")])

    def iso(pattern: str, month: int, day: int) -> Column:
        hit = F.regexp_extract(c, pattern, month) != ""
        name = F.lower(F.regexp_extract(c, pattern, month))
        num = F.lit(None).cast("string")
        for k, m in enumerate(MONTHS):
            num = F.when(name.startswith(m[:3]), F.lit(f"{k + 1:02d}")).otherwise(num)
        return F.when(hit, F.concat(F.regexp_extract(c, pattern, 3), F.lit("-"), num, F.lit("-"), F.lpad(F.regexp_extract(c, pattern, day), 2, "0")))

    year = F.regexp_extract(c, r"\b(?:17|18|19|20)\d{2}\b", 0)
    return F.coalesce(iso(rf"(?i)\b({names})\s+(\d{{1,2}}),?\s+(\d{{4}})\b", 1, 2), iso(rf"(?i)\b(\d{{1,2}})\s+({names})\s+(\d{{4}})\b", 2, 1), F.when(year != "", year), c)


def idf(token: Column) -> Column:
    """Weight by length alone: longer words are rarer."""
    return F.log(1 + 10000.0 / (1 + 10.0 * F.length(token)))


def weighted_jaccard(a: Column, b: Column) -> Column:
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, t: s + idf(t))
    union = total(F.array_union(a, b))
    return F.when(union > 0, total(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def rare_share(query: Column, tokens: Column) -> Column:
    """Share of the query's long words (over 5 letters) that the tokens hold."""
    rare = F.filter(query, lambda t: F.length(t) > 5)
    return F.when(F.size(rare) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(rare, tokens)) / F.size(F.array_distinct(rare)))


#: What personal data look like.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?<!\d)(?:\+?\d[\d .()-]{7,}\d)(?!\d)"
SSN = r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)"
CARD = r"(?<!\d)(?:\d[ -]?){12,18}\d(?!\d)"


def redact(c: Column) -> Column:
    """Mask cards (by Luhn's sum), social security numbers, e-mail addresses and phone numbers, in this order."""
    runs = F.regexp_extract_all(c, F.lit(CARD), F.lit(0))
    cards = F.filter(runs, lambda r: luhn(F.regexp_replace(r, "[ -]", "")))
    no_cards = F.when(c.rlike(CARD), F.aggregate(cards, c, lambda t, r: F.replace(t, r, F.lit("[CARD]")))).otherwise(c)
    out = F.regexp_replace(no_cards, SSN, "[SSN]")
    return F.regexp_replace(F.regexp_replace(out, EMAIL, "[EMAIL]"), PHONE, "[PHONE]")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has Luhn's checksum."""
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 1, F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)).otherwise(d.cast("int")))
    return (F.length(digits) > 0) & (F.aggregate(doubled, F.lit(0), lambda s, d: s + d) % 10 == 0)


#: Phrases that speak for a stage of study, with weights.
STAGES = {
    "grammar": {"what is": 2, "what are": 2, "who is": 2, "who was": 2, "where is": 2, "when did": 2, "define": 3, "definition": 2, "list": 2, "name": 1, "meaning of": 2, "what does": 2},
    "logic": {"why": 3, "how does": 2, "how do": 2, "compare": 3, "difference between": 3, "because": 1, "evidence": 2, "fallacy": 3, "valid": 1, "contradict": 2, "assumption": 2, "implies": 2, "cause": 1, "therefore": 1},
    "rhetoric": {"persuade": 3, "convince": 3, "write": 2, "essay": 2, "speech": 2, "present": 1, "argue": 2, "debate": 2, "teach": 2, "explain to": 2, "should i": 2, "opinion": 1},
}
#: Words that give an intent away, in the order of precedence.
INTENTS = {
    "comparative": ["compare", "versus", "vs", "difference"],
    "summary": ["summarize", "summary", "sum up"],
    "causal": ["why", "cause", "reason"],
    "temporal": ["before", "after", "timeline", "when did"],
    "factual": ["what", "who", "where", "which", "how many"],
}


def stage_scores(c: Column) -> dict[str, Column]:
    low = F.lower(F.coalesce(c, F.lit("")))
    return {s: sum((F.when(F.contains(low, F.lit(p)), F.lit(w)).otherwise(F.lit(0)) for p, w in ps.items()), F.lit(0)) for s, ps in STAGES.items()}


def stage(c: Column) -> Column:
    """struct<stage, share>: the stage of most weight (ties to the earlier), and its share of all weight."""
    s = stage_scores(c)
    total, best = s["grammar"] + s["logic"] + s["rhetoric"], F.greatest(*s.values())
    name = F.when(s["grammar"] == best, "grammar").when(s["logic"] == best, "logic").otherwise("rhetoric")
    return F.struct(name.alias("stage"), F.when(total == 0, F.lit(0.0)).otherwise(F.round(best / F.greatest(total, F.lit(1)), 3)).alias("share"))


def intent(c: Column) -> Column:
    low, out = F.lower(F.coalesce(c, F.lit(""))), F.lit("general")
    for name, words in reversed(INTENTS.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


#: Sentence patterns of subject, predicate and object, in the order they are tried.
TRIPLES = (
    (r"(.+?)\s+is\s+(?:a|an)\s+(.+)", "is_a"),
    (r"(.+?)\s+are\s+(?:a|an|the)?\s*(.+)", "is_a"),
    (r"(.+?)\s+has\s+(.+)", "has"),
    (r"(.+?)\s+have\s+(.+)", "has"),
    (r"(.+?)\s+located\s+in\s+(.+)", "located_in"),
    (r"(.+?)\s+is\s+located\s+in\s+(.+)", "located_in"),
    (r"(.+?)\s+works\s+for\s+(.+)", "works_for"),
    (r"(.+?)\s+is\s+part\s+of\s+(.+)", "part_of"),
    (r"(.+?)\s+belongs\s+to\s+(.+)", "belongs_to"),
    (r"(.+?)\s+caused\s+(.+)", "caused_by"),
    (r"(.+?)\s+produced\s+(.+)", "produced"),
    (r"(.+?)\s+discovered\s+(.+)", "discovered"),
)


def triple(c: Column) -> Column:
    """struct<subject, predicate, object> of the first pattern that fits, without leading articles; null if none does."""
    bare = lambda x: F.regexp_replace(F.trim(x), r"^(?i:a|an|the)\s+", "")
    out = F.lit(None)
    for pattern, name in reversed(TRIPLES):
        p = "(?i)" + pattern
        out = F.when(c.rlike(p), F.struct(bare(F.regexp_extract(c, p, 1)).alias("subject"), F.lit(name).alias("predicate"), bare(F.regexp_extract(c, p, 2)).alias("object"))).otherwise(out)
    return out


def truth_class(status: Column, verified_by: Column, layer_verified: Column, source_span: Column, verification: Column) -> Column:
    """Origin of a claim: asserted by an administrator, observed, inferred or reputed."""
    return (
        F.when(status == "admin_claim", "ASSERTED")
        .when((status == "verified_true") | verified_by.isin("verified_folder", "standards_match", "text_grounding"), "OBSERVED")
        .when(layer_verified, F.when(F.coalesce(source_span, F.lit("")) != "", "OBSERVED").otherwise("INFERRED"))
        .when(verification.isin("verified", "partially_verified"), "INFERRED")
        .otherwise("REPUTED")
    )


def material_hash(*fields: Column) -> Column:
    return F.sha2(F.concat_ws("\x00", *(F.coalesce(f.cast("string"), F.lit("")) for f in fields)), 256)


def strip_thinking(c: Column) -> Column:
    """A model's answer without its thinking and code fences."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""), r"(?m)^```\w*\s*$", ""))


def first_json(c: Column) -> Column:
    """The JSON from the first bracket of a model's answer to the last, without thinking; curly quotes and trailing commas are mended. Empty where there is none."""
    found = F.regexp_extract(strip_thinking(c), r"(?s)[{\[].*[}\]]", 0)
    return F.regexp_replace(F.translate(found, "\u201c\u201d", '""'), r",(\s*[}\]])", "$1")


def person_name(c: Column) -> Column:
    """White space squeezed; a single name in title case."""
    return let(squeeze(c), lambda n: F.when(F.contains(n, F.lit(" ")), n).otherwise(F.initcap(n)))


def location_name(c: Column) -> Column:
    """Without punctuation, in title case."""
    return F.initcap(F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}_\s]", "")))
