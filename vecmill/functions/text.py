"""Text scalars as column expressions: terms, stems, synonyms, question classes, value detectors, clean-up."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word lists, patterns and labels below define the results.
TOKEN = r"[A-Za-z][A-Za-z0-9'_-]{2,}|[\x{4e00}-\x{9fff}]{2,}"
STOP = [
    "the", "and", "for", "are", "was", "were", "what", "when", "where", "who",
    "how", "why", "which", "that", "this", "with", "from", "have", "has", "had",
    "did", "does", "you", "your", "our", "their", "about", "into", "just",
    "current", "date", "please", "tell", "know", "name",
    "mon", "tue", "wed", "thu", "fri", "sat", "sun",
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
    "什么", "多少", "哪个", "哪些", "怎么", "如何", "是否", "请问",
]
GENERIC = [
    "long", "short", "daily", "weekly", "monthly", "yearly", "often", "much",
    "many", "well", "good", "new", "old", "first", "last", "really", "also",
    "still", "going", "want", "need", "like", "make", "take", "time", "times",
    "year", "years", "month", "months", "week", "weeks", "day", "days",
    "hour", "hours", "minute", "minutes", "home", "life", "work", "working",
    "job", "people", "thing", "things", "around", "today", "personal",
    "information", "history", "chat", "session",
    "工作", "每天", "时间", "生活", "很久", "一天", "小时", "分钟",
]
SYNONYMS = {
    "play": ["theater", "theatre", "show", "performance", "musical", "drama", "playhouse"],
    "theater": ["theatre", "play", "playhouse", "stage"],
    "theatre": ["theater", "play", "playhouse", "stage"],
    "commute": ["commuting", "drive", "driving", "travel", "trip", "commuter"],
    "duration": ["minutes", "hours", "long", "length"],
    "size": ["inches", "inch", "diagonal", "screen"],
    "color": ["colour", "gray", "grey", "shade"],
    "colour": ["color", "gray", "grey", "shade"],
    "degree": ["bachelor", "master", "phd", "graduated", "graduation"],
    "discount": ["coupon", "percent", "off", "sale", "promo"],
    "coupon": ["discount", "promo", "voucher", "code"],
    "yoga": ["studio", "class", "pilates"],
    "store": ["shop", "mall", "retailer", "outlet"],
    "where": ["store", "shop", "location", "place", "address"],
}
TIME_CUES = [
    "now", "today", "currently", "recent", "recently", "latest", "before",
    "after", "ago", "year", "years", "month", "when", "since", "previous",
    "previously", "once", "updated", "update", "changed", "beforehand",
    "现在", "目前", "最近", "之前", "之后", "去年", "今年", "当时", "何时",
    "以前", "此前", "后来", "上次",
]
MONTHS = [
    "january", "february", "march", "april", "may", "june", "july", "august",
    "september", "october", "november", "december",
    "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "oct", "nov", "dec",
]
COLORS = [
    "red", "blue", "green", "yellow", "black", "white", "gray", "grey", "pink",
    "purple", "orange", "brown", "navy", "beige", "ivory", "gold", "silver",
]
DEGREES = r"(?:ph\.?d|mba|b\.?a\.?|b\.?s\.?|m\.?s\.?|m\.?a\.?|bachelors?|masters?|doctorate|associates?|business administration|computer science|electrical engineering)"
LIGHT_VERBS = ["did", "does", "do", "take", "attend", "buy", "bought", "pack", "packed"]
WEAK_BINDS = [
    "size", "name", "brand", "count", "number", "title", "item", "place",
    "color", "colour", "date", "year", "gift", "party",
]
ABSTRACT = [
    "specific count number", "specific duration minutes", "specific measured number", "specific named entity",
    "specific fact value", "specific place name", "specific degree name", "specific color",
    "specific date", "specific purchased item", "specific screen size number", "specific play title",
]
#: class, grain, label, tail of a search phrase, pattern on the lower-cased question; the first that fits wins.
QUESTION_CLASSES = [
    ("measure", "size", "specific screen size number", "size inches", r"\bwhat size\b|\bhow (?:big|large|wide|tall)\b|\binches?\b|\bdiagonal\b"),
    ("measure", "duration", "specific duration minutes", "duration minutes", r"\bhow long\b|\bhow far\b|\bcommute\b|\bduration\b"),
    ("measure", "duration", "specific duration minutes", "duration minutes", r"\bhow many\s+(?:days?|weeks?|months?|years?|hours?|minutes?)\b"),
    ("count", "count", "specific count number", "count number", r"\bhow many\b|\bhow much\b"),
    ("color", "color", "specific color", "color", r"\bwhat colou?r\b|\bwhich colou?r\b"),
    ("datetime", "day", "specific date", "calendar date", r"\bwhen\b|\bwhat date\b|\bwhich day\b|\bwhat day\b"),
    ("place", "place", "specific place name", "place name", r"\bwhere\b"),
    ("entity", "degree", "specific degree name", "degree name", r"\bwhat degree\b|\bgraduate with\b|\bgraduated with\b"),
    ("entity", "title", "specific play title", "play title", r"\bwhat play\b|\bwhich play\b|\bplay did i\b"),
    ("item", "item", "specific purchased item", "purchased item", r"\bwhat did i buy\b|\bwhat did i (?:get|purchase)\b|\bbirthday gift\b"),
    ("entity", "entity", "specific named entity", "name", r"\bwhat(?:'s| is| was)\b|\bwhich\b|\bwho\b|\bwhose\b"),
    ("entity", "entity", "specific fact value", "name", r""),
]
_MONTH = "|".join(MONTHS)
CAPITALS = r"\b([A-Z][a-zA-Z0-9'&.-]+(?:\s+[A-Z][a-zA-Z0-9'&.-]+)+)\b"
DETECTORS = {
    "measure": r"(?i)\b\d+(\.\d+)?\s*(minutes?|hours?|days?|weeks?|months?|%|inches?|inch|cm|km|miles?)\b",
    "size": r"(?i)\b\d+(\.\d+)?\s*(inches?|inch|\"|cm)\b",
    "duration": r"(?i)\b\d+(\.\d+)?\s*(minutes?|mins?|hours?|hrs?|days?)\b",
    "count": r"(?i)\b(?:packed|pack|shirts?|brought|took|items?|pairs?)\b.{0,48}\b([1-9]|[1-9]\d)\b|\b([1-9]|[1-9]\d)\b.{0,24}\b(?:shirts?|items?|pairs?)\b",
    "day": rf"(?i)\b\d{{4}}[-/]\d{{1,2}}[-/]\d{{1,2}}\b|\b([1-9]|[12]\d|3[01])(st|nd|rd|th)\b|\b({_MONTH})\s+\d{{1,2}}\b",
    "month": rf"(?i)\b({_MONTH})\b",
    "color": rf"(?i)\b({'|'.join(COLORS)})\b",
    "place": r"\b(at|from|in)\s+[A-Z][A-Za-z0-9'&.-]+",
    "degree": rf"(?i)\b{DEGREES}\b",
    "stage": r"(?i)\b(theater|theatre|playhouse|musical|drama|attended|saw)\b",
    "quoted": r"[“\"']([^\"']{3,80})[”\"']",
    "bought": r"(?i)\b(bought|buy|purchased|got)\b.{0,80}\b(a|an|the)\s+[a-z]{3,}",
}
COUNTED_DAYS = r"(?i)\b\d+\s*-?\s*days?\b"
PLANNING = r"(?i)\n(?:We need |Let's |Let me |I need to |Need (?:answer|follow|determine|obey|comply))"
ECHO = r"(?i)answer yes if|please answer yes|yes\s*/\s*no|yes or no|output format:|scoring rules:|first line that is exactly|exactly yes or exactly no"
LABEL = r"(?i)^(?:label\s*[:\-]\s*)?(yes|no)$"
JSON_LABEL = r'(?i)"correct"\s*:\s*(true|false)'


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(text, F.lit(" \t\n\r\f\v"))


def words(values: list[str]) -> Column:
    """A constant array: one string that is split, which is folded when the query is planned."""
    return F.split(F.lit("\x1f".join(values)), "\x1f") if values else F.array().cast("array<string>")


def found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def ordered_terms(text: Column) -> Column:
    """Distinct lower-cased terms in order of first appearance, without stop words."""
    low = F.transform(found(text, TOKEN), F.lower)
    return F.array_except(F.array_distinct(low), words(STOP))


def overlap(asked: Column, terms: Column) -> Column:
    """Share of the asked terms among terms; 0 if none is asked."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(asked, terms)), F.size(asked)), F.lit(0.0))


def snippet(text: Column, size: int = 500) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), 1, size)


def stems(word: Column) -> Column:
    """The word and its plain stems, those longer than two letters."""
    w = F.lower(word)
    less = lambda n, tail="": F.concat(F.substring(w, F.lit(1), F.length(w) - n), F.lit(tail))
    ends = lambda tail, n: (F.length(w) > n) & F.endswith(w, F.lit(tail))
    forms = F.array(
        w,
        F.when(ends("ies", 4), less(3, "y")), F.when(ends("es", 4), less(2)), F.when(ends("s", 3), less(1)),
        F.when(ends("ing", 5), less(3)), F.when(ends("ing", 5), less(3, "e")), F.when(ends("ed", 4), less(2)), F.when(ends("ed", 4), less(1)),
    )
    return F.array_distinct(F.filter(F.array_compact(forms), lambda x: F.length(x) > 2))


def synonym_groups() -> dict[str, list[str]]:
    """Every word of the dictionary with all words it shares a group with."""
    every = sorted({w for k, v in SYNONYMS.items() for w in [k, *v]})
    return {w: sorted({x for k, v in SYNONYMS.items() if w == k or w in v for x in [k, *v]}) for w in every}


def variants(word: Column) -> Column:
    groups = F.create_map(*[x for k, v in synonym_groups().items() for x in (F.lit(k), words(v))])
    return F.array_union(stems(word), F.coalesce(F.try_element_at(groups, F.lower(word)), words([])))


def read(text: Column, terms: Column) -> Column:
    """What `mentions` looks at, to be worked out once per text by `let`."""
    t = F.coalesce(text, F.lit(""))
    return F.struct(t.alias("text"), F.lower(t).alias("low"), terms.alias("terms"))


def mentions(seen: Column, term: Column) -> Column:
    """term is one of the terms of a text that was `read`, or stands in it as a word. Terms hold no pattern characters.

    The pattern is tried only on texts that have the term at all: it costs a compilation each time.
    """
    word = F.contains(seen["low"], F.lower(term)) & F.regexp_like(seen["text"], F.concat(F.lit(r"(?i)\b"), term, F.lit(r"\b")))
    return F.array_contains(seen["terms"], term) | word


def bound(text: Column, terms: Column, binds: Column) -> Column:
    """No bind, or any of the first six, a stem or a synonym of it, is mentioned."""
    any_ = lambda x: F.exists(x["binds"], lambda b: F.exists(variants(b), lambda v: mentions(x["seen"], v)))
    return let(F.slice(binds, 1, 6), lambda b: F.when(F.size(b) == 0, True).otherwise(let(F.struct(read(text, terms).alias("seen"), b.alias("binds")), any_)))


def question_body(question: Column) -> Column:
    body = strip(F.regexp_replace(F.coalesce(question, F.lit("")), r"(?i)^Current date:.*\n", ""))
    return F.when(body == "", F.coalesce(question, F.lit(""))).otherwise(body)


def bind_terms(question: Column) -> Column:
    """Up to eight terms of the question that are neither generic nor light verbs, in its order."""
    return F.slice(F.array_except(F.array_except(ordered_terms(question_body(question)), words(GENERIC)), words(LIGHT_VERBS)), 1, 8)


def distinctive_binds(question: Column) -> Column:
    return F.slice(F.filter(F.array_except(bind_terms(question), words(WEAK_BINDS)), lambda b: F.length(b) >= 4), 1, 6)


def target_slot(question: Column) -> Column:
    """struct(cls, label, grain, tail): the kind of fact a question asks for."""
    low = F.lower(question_body(question))
    chain = None
    for cls, grain, label, tail, pattern in QUESTION_CLASSES[:-1]:
        value = F.struct(F.lit(cls).alias("cls"), F.lit(label).alias("label"), F.lit(grain).alias("grain"), F.lit(tail).alias("tail"))
        chain = F.when(low.rlike(pattern), value) if chain is None else chain.when(low.rlike(pattern), value)
    cls, grain, label, tail, _ = QUESTION_CLASSES[-1]
    return chain.otherwise(F.struct(F.lit(cls).alias("cls"), F.lit(label).alias("label"), F.lit(grain).alias("grain"), F.lit(tail).alias("tail")))


def hop_phrase(binds: Column, tail: Column) -> Column:
    """Up to five bound nouns and the tail of the class; empty if nothing is bound."""
    return F.when(F.size(binds) == 0, F.lit("")).otherwise(F.substring(F.concat_ws(" ", F.slice(binds, 1, 5), tail), 1, 80))


def is_abstract(phrase: Column) -> Column:
    p = F.lower(F.trim(F.regexp_replace(F.coalesce(phrase, F.lit("")), r"\s+", " ")))
    return p.isin(ABSTRACT) | (F.startswith(p, F.lit("specific ")) & (F.size(F.split(p, " ")) <= 4))


def new_names(text: Column, question: Column) -> Column:
    """A capitalised phrase of two words or more that the question does not have."""
    names = found(text, CAPITALS, 1)
    return let(F.lower(question_body(question)), lambda low: F.exists(names, lambda p: ~F.contains(low, F.lower(p))))


def detects(text: Column, which: str) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.regexp_replace(t, COUNTED_DAYS, " ").rlike(DETECTORS[which]) if which == "count" else t.rlike(DETECTORS[which])


def value_asserted(text: Column, terms: Column, question: Column, slot: Column, binds: Column) -> Column:
    """The text mentions the question's topic and has a value of the asked class."""
    entity = detects(text, "quoted") | new_names(text, question)
    staged = detects(text, "stage") | F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit("play"))
    value = (
        F.when(slot["grain"] == "size", detects(text, "size")).when(slot["grain"] == "duration", detects(text, "duration"))
        .when(slot["cls"] == "count", detects(text, "count")).when(slot["cls"] == "datetime", detects(text, "day"))
        .when(slot["cls"] == "place", detects(text, "place") | new_names(text, question)).when(slot["cls"] == "color", detects(text, "color"))
        .when(slot["cls"] == "item", detects(text, "bought") | entity).when(slot["grain"] == "degree", detects(text, "degree"))
        .when(slot["grain"] == "title", staged & entity).otherwise(entity)
    )
    return bound(text, terms, binds) & value


def clip_planning(text: Column, least: int = 24) -> Column:
    """The text before leaked planning, if that begins at `least` characters or later."""
    t = strip(F.coalesce(text, F.lit("")))
    at = F.regexp_instr(t, F.lit(PLANNING))
    return F.when(at > least, strip(F.substring(t, F.lit(1), at - 1))).otherwise(t)


def judge_label(verdict: Column) -> Column:
    """The last JSON label; else the last line that is only yes or no; else false."""
    v = F.coalesce(verdict, F.lit(""))
    packed = F.try_element_at(found(v, JSON_LABEL, 1), F.lit(-1))
    lines = F.transform(F.split(v, r"\r?\n"), lambda x: strip(F.regexp_replace(strip(F.regexp_replace(x, r"[*`#_]", "")), r"[.!]+$", "")))
    labels = F.filter(lines, lambda x: (x != "") & ~x.rlike(ECHO) & x.rlike(LABEL))
    last = F.try_element_at(labels, F.lit(-1))
    return F.when(packed.isNotNull(), F.lower(packed) == "true").otherwise(F.coalesce(F.lower(last).rlike("yes$"), F.lit(False)))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def aliases(missing: Column, bag: Column, most: int = 6) -> Column:
    """Words of a bag that are variants of missing ones: one the beginning of the other, at most four letters apart, or
    with d, ing or ion at the end; in order of the missing words, then of the alphabet."""
    def of(known: Column, m: Column) -> Column:
        near = F.filter(known, lambda t: (F.startswith(t, m) | F.startswith(m, t)) & (t != m) & (F.abs(F.length(t) - F.length(m)) <= 4))
        longer = F.filter(F.array(*[F.concat(m, F.lit(e)) for e in ("d", "ing", "ion")]), lambda t: F.array_contains(known, t))
        return F.concat(near, longer)

    # the bag is sorted once, not once for each missing word
    found = let(F.array_sort(F.array_distinct(bag)), lambda known: F.flatten(F.transform(missing, lambda m: of(known, m))))
    return F.slice(F.array_except(F.array_distinct(found), missing), 1, most)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is written, and worked out, once."""
    return F.get(F.transform(F.array(value), body), 0)


OBJECT_BEGINS = r'(?s)(?=\{\s*"(?:[^"\\]|\\.)*+"\s*:)'
JSON_PART = r'(?s)"(?:[^"\\]|\\.)*+"|[{}]|[^"{}]++'


def _closed(text: Column) -> Column:
    """A text that begins with a JSON object, up to the brace that closes it."""
    def step(s: Column, part: Column) -> Column:
        depth = s["depth"] + F.when(part == "{", 1).when(part == "}", -1).otherwise(0)
        return F.struct(F.when(s["open"], s["n"] + F.length(part)).otherwise(s["n"]).alias("n"), depth.alias("depth"), (s["open"] & (depth > 0)).alias("open"))

    begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("depth"), F.lit(True).alias("open"))
    return let(text, lambda t: F.substring(t, F.lit(1), F.aggregate(found(t, JSON_PART, 0), begin, step, lambda s: s["n"])))


def json_object(text: Column, keys: list[str]) -> Column:
    """The first JSON object in free text that has any of the keys, as it stands there; null if there is none.

    An object may stand within another one or within broken JSON.  Objects are tried at each brace that a name and a colon
    follow, by Spark's own parser, which stops at the object's end; only texts that have a key in quotes are looked at.
    """
    def first(t: Column) -> Column:
        pieces = F.split(t, OBJECT_BEGINS)

        def tried(parts: Column) -> Column:
            rest = lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "")
            has = lambda x: F.startswith(x, F.lit("{")) & F.coalesce(F.arrays_overlap(F.json_object_keys(x), words(keys)), F.lit(False))
            step = lambda s, i: F.when(s.isNotNull(), s).otherwise(let(rest(i), lambda x: F.when(has(x), x)))
            return F.aggregate(F.sequence(F.lit(1), F.size(parts)), F.lit(None).cast("string"), step)

        return let(let(pieces, tried), _closed)

    t = F.coalesce(text, F.lit(""))
    return F.when(any_of([F.contains(t, F.lit(f'"{k}"')) for k in keys]), first(t))


# A document with three marked slots.

SLOTS = ["QUERY", "RANK", "FILTER"]


def slot_body(text: Column, name: str) -> Column:
    return strip(F.regexp_extract(text, rf"(?s)<!-- EVOLVE:{name}:START -->(.*?)<!-- EVOLVE:{name}:END -->", 1))


def with_slot(text: Column, name: str, body: Column | str) -> Column:
    """The text with one slot's body replaced; it is an error if the slot's marks are missing. Cut by position, so that a
    body may hold anything."""
    open_, close = (F.lit(f"<!-- EVOLVE:{name}:{x} -->") for x in ("START", "END"))
    place = lambda mark, t, after: F.call_function("locate", mark, t, after)
    new = F.regexp_replace(F.lit(body) if isinstance(body, str) else body, r"\s+$", "")

    def cut(t: Column) -> Column:
        start = place(open_, t, F.lit(1))
        return F.struct(t.alias("t"), (start + F.length(open_)).alias("a"), F.when(start > 0, place(close, t, start)).otherwise(0).alias("b"))

    def joined(x: Column) -> Column:
        made = F.concat(F.substring(x["t"], F.lit(1), x["a"] - 1), F.lit("\n"), new, F.lit("\n"), F.substring(x["t"], x["b"], F.length(x["t"])))
        return F.when(x["t"].isNull() | (x["b"] > 0), made).otherwise(F.raise_error(F.lit(f"the marks of slot {name} are missing")))

    return let(let(text, cut), joined)


def backbone(text: Column) -> Column:
    """Hash of everything but the slots' bodies: equal as long as only slots change."""
    for name in SLOTS:
        text = F.regexp_replace(text, rf"(?s)(<!-- EVOLVE:{name}:START -->).*?(<!-- EVOLVE:{name}:END -->)", "$1$2")
    return F.sha2(text, 256)
