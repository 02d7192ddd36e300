"""Review of retrieved evidence: coverage of the question's terms, relevance of hits, cause of a gap, next slot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecmill.functions import text as T
from vecmill.operators import replay

# Thresholds, and patterns that find what a question asks about.
RELEVANT, IRRELEVANT = 0.15, 0.08
YEAR, HALF_YEAR = 365, 180
READ_CHARS = 2500
MISSING_TERMS = 12

WH_HEADS = [
    r"(?i)how (?:long|far|often|much|many) (?:is|was|are|were|do|does|did) (?:my |the |our |your |a |an )?(.+?)(?:\?|$)",
    r"(?i)what(?:'s| is| was| are) (?:the )?(?:name of (?:the |my |our )?)?(.+?)(?:\?|$)",
    r"(?i)\bwhat ([a-z][a-z0-9'-]{2,}) (?:is|are|was|were|do|does|did)\b",
    r"(?i)what ([a-z][a-z0-9'-]+) did i",
    r"(?i)(?:which|whose) ([a-z][a-z0-9'-]+)",
]
PROPER = r"\b([A-Z][a-zA-Z0-9'-]{1,})\b"


def attribute_terms(question: Column) -> Column:
    """What a question asks about: heads of its wh-phrases and its proper words; else all its terms that are not generic."""
    q = T.question_body(question)
    heads = []
    for pattern in WH_HEADS:
        head = F.regexp_extract(q, pattern, 1)
        alone = F.lower(F.trim(head))
        heads += [T.ordered_terms(head), F.when(alone.rlike(r"^[a-z][a-z0-9'-]{1,}$"), F.array(alone)).otherwise(T.words([]))]
    proper = F.transform(T.found(q, PROPER, 1), F.lower)
    found = F.array_except(F.array_except(F.array_distinct(F.concat(*heads, proper)), T.words(T.GENERIC)), T.words(T.STOP))
    return F.when(F.size(found) > 0, found).otherwise(F.array_except(T.ordered_terms(q), T.words(T.GENERIC)))


def proxy(hits: DataFrame, key: str) -> DataFrame:
    """hits (key, rk, ov): (key, proxy), twice the mean coverage of the first three, their share of relevant ones, and a little of the rest."""
    top = F.col("rk") <= 3
    mean3 = F.avg(F.when(top, F.col("ov")))
    share = F.avg(F.when(top, (F.col("ov") >= RELEVANT).cast("double")))
    return hits.groupBy(key).agg((2.0 * F.coalesce(mean3, F.lit(0.0)) + F.coalesce(share, F.lit(0.0)) + 0.3 * F.avg("ov")).alias("proxy"))


def time_cue(question: Column) -> Column:
    """The question has a cue of time, also within a longer word."""
    low = F.lower(question)
    return T.any_of([F.contains(low, F.lit(c)) for c in T.TIME_CUES])


def _ids(condition: Column) -> Column:
    return F.transform(F.array_sort(F.array_compact(F.collect_list(F.when(condition, F.struct("rk", "doc_id"))))), lambda x: x["doc_id"])


def review(hits: DataFrame) -> DataFrame:
    """hits (query_id, question, doc_id, rk, text, time_days, query_days): one row per question.

    cause is that after the question of sufficiency, first_cause that before it.

    A text is relevant by its share of those key terms that the first three texts have.  The rest are soft
    negatives, or hard ones if they cover something but are over a year older than the question.  The question is
    covered if one of the first three texts asserts a value of the asked kind within its first 2500 characters.
    """
    q = hits.withColumn("terms", T.ordered_terms(F.col("text"))).withColumn("keys", attribute_terms(F.col("question"))).withColumn("binds", T.bind_terms(F.col("question"))).withColumn("target", T.target_slot(F.col("question")))
    asked = F.when(F.size("keys") > 0, F.col("keys")).otherwise(T.ordered_terms(T.question_body(F.col("question"))))
    q = q.withColumn("ov", T.overlap(asked, F.col("terms"))).withColumn("cov", T.overlap(F.col("keys"), F.col("terms")))
    text = F.coalesce("text", F.lit(""))
    mentioned = F.when(F.col("rk") <= 3, T.let(T.read(text, F.col("terms")), lambda x: F.filter("keys", lambda k: T.mentions(x, k)))).otherwise(T.words([]))
    front = F.substring(text, 1, READ_CHARS)
    asserted = (F.col("rk") <= 3) & T.value_asserted(front, T.ordered_terms(front), F.col("question"), F.col("target"), F.col("binds"))
    q = q.withColumn("mentioned", mentioned).withColumn("asserted", asserted)
    facts = q.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("mentioned"))).alias("present"), F.bool_or("asserted").alias("covers"))
    q = q.join(facts, "query_id")
    q = q.withColumn("relevant", (F.size("present") > 0) & (T.overlap(F.col("present"), F.col("terms")) >= RELEVANT))
    old = F.coalesce(F.col("time_days") < F.col("query_days") - YEAR, F.lit(False))
    hard = ~F.col("relevant") & (F.col("ov") >= IRRELEVANT) & old
    each = q.groupBy("query_id", "question", "covers").agg(
        F.array_distinct(F.flatten(F.collect_list("terms"))).alias("bag"),
        _ids(F.col("relevant")).alias("relevant_ids"), _ids(~F.col("relevant") & ~hard).alias("soft_ids"), _ids(hard).alias("hard_ids"),
        F.sum((F.col("relevant") & (F.col("rk") <= 3)).cast("int")).alias("top_relevant"),
        F.count("time_days").alias("n_dated"), (F.max("time_days") - F.min("time_days")).alias("spread"),
        F.coalesce(F.min(F.when(F.col("relevant"), F.col("time_days"))) < F.coalesce(F.max("query_days"), F.max("time_days")) - YEAR, F.lit(False)).alias("old_relevant"),
    )
    each = each.join(proxy(q.select("query_id", "rk", F.col("cov").alias("ov")), "query_id"), "query_id")
    mismatch = time_cue(F.col("question")) & (F.col("n_dated") >= 3) & ((F.col("spread") > HALF_YEAR) | F.col("old_relevant"))
    hop = T.hop_phrase(T.bind_terms(F.col("question")), T.target_slot(F.col("question"))["tail"])
    noise = (F.size("relevant_ids") > 0) & (F.col("top_relevant") < F.least(F.lit(2), F.size("relevant_ids")))
    each = each.withColumn("time_mismatch", mismatch).withColumn("hop", hop)
    first = F.when(~F.col("covers") & (F.col("hop") != ""), "unrecalled").when(F.size("relevant_ids") == 0, "semantic_gap").when(F.col("time_mismatch"), "time_mismatch").when(noise, "noise_top3").otherwise("rank_refine")
    each = each.withColumn("first_cause", first)
    # words that the question has and no hit has; where a phrase is searched for, its variants are looked up instead
    missing = F.slice(F.array_sort(F.array_except(T.ordered_terms(T.question_body(F.col("question"))), F.col("bag"))), 1, MISSING_TERMS)
    each = each.withColumn("missing_terms", missing)
    variants = T.aliases(F.when(~F.col("covers") & (F.col("hop") != ""), F.array("hop")).otherwise(F.col("missing_terms")), F.col("bag"))
    each = each.withColumn("aliases", variants).drop("bag")
    cause = F.when(~F.col("covers") & (F.col("hop") != ""), "unrecalled").when(~F.col("covers") | (F.size("relevant_ids") == 0), "rank_refine").when(F.col("time_mismatch"), "time_mismatch").when(noise, "noise_top3").otherwise("rank_refine")
    slot = F.when(~F.col("covers") & (F.col("hop") != ""), "query").otherwise("rank")
    return each.withColumn("cause", cause).withColumn("slot", slot)


def sane_phrases(items: Column, question: Column, texts: Column, most: int = 3, touching: bool = True) -> Column:
    """Up to three short phrases that are not copied out of the texts and, if touching, share words with the question."""
    low_q, blob = F.lower(T.question_body(question)), F.lower(texts)
    clean = F.transform(items, lambda s: F.btrim(F.trim(F.regexp_replace(s, r"\s+", " ")), F.lit(" .,;:\"'`")))
    common = T.words(T.STOP + T.GENERIC)

    def fine(s: Column) -> Column:
        parts = F.split(s, " ")
        low = F.lower(s)
        shape = (s != "") & ~F.contains(s, F.lit(".")) & ~F.contains(s, F.lit("?")) & (F.length(s) <= 48) & (F.size(parts) <= 4)
        telling = F.exists(parts, lambda w: ~F.array_contains(common, w))
        copied = (F.length(low) >= 12) & F.contains(blob, low)
        touches = F.contains(low_q, low) | F.exists(parts, lambda w: (F.length(w) > 2) & F.contains(low_q, F.lower(w)))
        return shape & telling & ~copied & (touches | (F.size(parts) <= 2) if touching else F.lit(True))

    return F.slice(F.array_distinct(F.transform(F.filter(clean, fine), F.lower)), 1, most)


# A model may review the evidence too. Its answer is JSON with these fields, of which one at least is there.
ANSWER = "query_intents array<string>, missing_keys array<string>, slot_decision string, slot string"
ANSWER_KEYS = ["missing_keys", "slot_decision", "query_intents"]
SHOWN, SHOWN_CHARS = 10, 400

TASK = """You judge whether search results suffice; do not answer the question itself.
They suffice if one of the first three states a concrete value of class %s (%s) on the question's topic.
If none does, name what to search for: short phrases of the question's own nouns, such as [%s], never a label or a copied sentence.
Answer with JSON alone: {"query_intents": [...], "missing_keys": [...], "slot_decision": "QUERY" or "RANK"}

Question: %s

Results, best first:
%s"""


def asked(reviewed: DataFrame, hits: DataFrame, model: str) -> DataFrame:
    """reviewed with shown (the texts that the model sees), prompt and call_key; a blank question asks nothing."""
    seen = F.when(F.col("rk") <= SHOWN, F.struct("rk", F.col("doc_id").cast("string").alias("id"), T.snippet(F.col("text")).alias("text")))
    shown = hits.groupBy("query_id").agg(F.array_sort(F.array_compact(F.collect_list(seen))).alias("shown"))
    q = reviewed.join(shown, "query_id")
    cut = F.transform("shown", lambda x: F.struct(x["id"].alias("id"), x["rk"].alias("rank"), F.substring(x["text"], 1, SHOWN_CHARS).alias("text")))
    body, target = T.question_body(F.col("question")), T.target_slot(F.col("question"))
    text = F.format_string(TASK, target["cls"], target["grain"], F.col("hop"), body, F.to_json(cut))
    q = q.withColumn("prompt", F.when(T.strip(F.col("question")) != "", text))
    return q.withColumn("call_key", replay.call_key(F.lit(model), F.col("prompt")))


def refined(called: DataFrame) -> DataFrame:
    """called: `asked` rows with answers. (query_id, answered, covers, cause, slot, phrase, focus, intents) of each question.

    An answer without a fitting JSON object counts as none, and the review stands as it is.  A value that the first
    three texts assert outweighs what a model says is missing; where nothing is asserted, the question's own phrase is
    searched for, or else the first phrase of the model that is no label.
    """
    found = F.from_json(T.json_object(F.col("answer"), ANSWER_KEYS), ANSWER)
    blob = F.array_join(F.transform("shown", lambda x: x["text"]), " ")
    none = T.words([])
    q = called.withColumn("a", found).withColumn("said", F.col("a").isNotNull())
    list_of = lambda name: F.transform(F.coalesce(F.col("a")[name], none), lambda x: F.coalesce(x, F.lit("")))
    intents = sane_phrases(list_of("query_intents"), F.col("question"), F.lit(""))
    missing = sane_phrases(list_of("missing_keys"), F.col("question"), blob, touching=False)
    q = q.withColumn("intents", intents).withColumn("lacking", missing)
    label = F.lower(T.target_slot(F.col("question"))["label"])
    kept = F.filter("lacking", lambda k: ~T.is_abstract(k) & (k != label))
    own = F.when(F.col("hop") != "", F.col("hop")).otherwise(F.coalesce(F.get(kept, F.lit(0)), F.lit("")))
    q = q.withColumn("phrase", F.when(F.col("covers"), F.lit("")).otherwise(own))
    more = F.col("phrase") != ""
    # an answer takes the place of the first cause, and coverage turns what it says is missing into ranking
    cause = F.when(more, "unrecalled").when(~F.col("covers") | F.col("said"), "rank_refine").otherwise(F.col("cause"))
    told = F.array_join(F.when(F.size("lacking") > 0, F.col("lacking")).otherwise(F.col("intents")), " ")
    return q.select(
        "query_id", F.col("said").alias("answered"), "covers", cause.alias("cause"), F.when(more, "query").otherwise("rank").alias("slot"), "phrase",
        F.when(F.col("covers"), F.when(F.col("said"), told).otherwise(F.lit(""))).otherwise(F.col("phrase")).alias("focus"), "intents",
    )
