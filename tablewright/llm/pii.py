"""Personal data: base patterns, and further identifiers found by bootstrapped contexts.

Entities that the base patterns find are seeds. What stands around them are lexical patterns: the two words in
front, the two words behind, and a label, that is one word in front which ends in a separator. Strings elsewhere
of certain shapes (numbers, numbers with a letter prefix, handles, spelt-out mail addresses) are candidate
instances. Patterns and instances form a graph that is scored in rounds until the trusted patterns stay the same:
a pattern's score is the mean score of its distinct instances, an instance's the chance that at least one of its
trusted patterns is right, seeds stay at one. Patterns of high score with enough different seeds turn the
candidates beside them into findings. Everything is DataFrame expressions; scores are whole millionths, and
logarithms are rounded before they are added up, so they do not depend on the order of sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPAN, blocks_of, count_of, hex_sha256, in_order, once, pattern_spans, replaced, span_text, stored

KINDS = ("email", "ip", "card", "phone")
FOUND = "context"
ONE = 1_000_000
MOST_ROUNDS = 8
# A pattern discovers identifiers from this mean score and this many different seeds on.
CONFIDENCE = 800_000
LEAST_SEEDS = 3
CONTEXT_CHARS = 48

# Equal in matches to the base patterns, written so that long runs are not tried again from each of their places:
# a match starts at the start of a run or where the last match ended, and runs give nothing back.
EMAIL = "(?:(?<![A-Za-z0-9._%+-])|\\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)++"
IP = "(?<![0-9])[0-9]++(?:\\.[0-9]+)(?:\\.[0-9]+)(?:\\.[0-9]+)"
CARD = "[0-9](?:[\\x20-]?[0-9]){13,}+"
PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
# Candidate shapes: numbers of six digits or more, digits behind a letter prefix, handles, mail addresses spelt out.
CANDIDATE = (
    "(?<![0-9A-Za-z])(?:[A-Za-z]{1,4}[-_/]?+[0-9]{4,}+|[0-9](?:[\\x20.()-]?[0-9]){5,}+|@[A-Za-z0-9_]{3,}+"
    "|[A-Za-z0-9._+-]{2,40}+\\x20?[(\\[{](?:at|AT)[)\\]}]\\x20?[A-Za-z0-9.-]{2,}+)"
)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _ip_parts(match: Column) -> Column:
    return F.forall(F.split(match, "\\."), lambda part: part.rlike("^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"))


def _luhn(match: Column) -> Column:
    back = F.reverse(_digits(match))

    def value(i: Column) -> Column:
        digit = F.substring(back, i, F.lit(1)).cast("int")
        double = digit * 2
        return F.when(i % 2 == 1, digit).otherwise(F.when(double > 9, double - 9).otherwise(double))

    n = F.length(back)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + value(i))
    return (n >= 14) & (n <= 19) & (total % 10 == 0)


def _phone_digits(match: Column) -> Column:
    return F.length(_digits(match)).between(10, 15)


def _context(gap: Column, behind: Column) -> Column:
    """The patterns a match takes part in, one a line: lower-case, without digits, with a letter."""

    def plain(words: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(F.lower(words), "[0-9]++", ""), "\\s++", " ")

    front = F.substring(gap, -CONTEXT_CHARS, CONTEXT_CHARS)
    back = F.substring(behind, 1, CONTEXT_CHARS)
    two = plain(F.regexp_extract(front, "((?:[^\\s]+\\s+)?[^\\s]+)\\s*$", 1))
    label = plain(F.regexp_extract(front, "([^\\s]*\\p{L}[^\\s]*[:=#])\\s*$", 1))
    after = plain(F.regexp_extract(back, "^\\s*([^\\s]+\\s+[^\\s]+)\\s", 1))
    named = [F.when(words.rlike("\\p{L}"), F.concat(F.lit(f"{place} "), words)) for place, words in (("before", two), ("label", label), ("after", after))]
    return F.nullif(F.concat_ws("\n", *named), F.lit(""))


def base_spans(text: Column, context: bool = False) -> Column:
    """Spans of the four base kinds in order; a null text has none."""
    around = _context if context else None
    body = F.coalesce(text, F.lit(""))
    return in_order(
        pattern_spans(body, "email", 1, EMAIL, None, body.contains("@"), around),
        pattern_spans(body, "ip", 2, IP, _ip_parts, body.rlike("[0-9]\\.[0-9]++\\.[0-9]++\\.[0-9]"), around),
        pattern_spans(body, "card", 3, CARD, _luhn, None, around),
        pattern_spans(body, "phone", 4, PHONE, _phone_digits, body.contains("+"), around),
    )


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, code, seeds, candidates): one row per row; ``code`` is a hash of the text and, with doc_id, its key.

    Candidates are sought in the text with the seeds blanked out, so they overlap none.
    """
    narrow = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    seeds = narrow.withColumn("seeds", base_spans(F.col("text"), context=True))
    blank = F.when(F.size("seeds") > 0, replaced(F.col("text"), merged(F.col("seeds")), lambda s: F.repeat(F.lit("\u00b7"), s["stop"] - s["start"])))
    seeds = seeds.withColumn("rest", F.coalesce(blank, F.col("text")))
    others = pattern_spans(F.col("rest"), FOUND, len(KINDS) + 1, CANDIDATE, context=_context)
    return seeds.select("doc_id", F.xxhash64("text").alias("code"), "seeds", others.alias("candidates"))


def merged(spans: Column) -> Column:
    """Sorted spans with overlapping ones cut to what the spans before them leave, empty ones dropped."""
    before = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("found"))

    def step(state: Column, span: Column) -> Column:
        begin = F.greatest(span["start"], state["at"])
        one = F.array(F.struct(begin.alias("start"), span["stop"].alias("stop")))
        return F.struct(
            F.greatest(state["at"], span["stop"]).alias("at"),
            F.when(begin < span["stop"], F.concat(state["found"], one)).otherwise(state["found"]).alias("found"),
        )

    def gather(state: Column, block: Column) -> Column:
        inner = F.struct(state["at"].alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("found"))
        return once(
            F.aggregate(block, inner, step),
            lambda done: F.struct(done["at"].alias("at"), F.concat(state["found"], F.array(done["found"])).alias("found")),
        )

    whole = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,stop:int>>>").alias("found"))
    return F.aggregate(blocks_of(spans), whole, gather, lambda state: F.flatten(state["found"]))


def scored_patterns(edges: DataFrame, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(pattern, score, seeds) from distinct (pattern, instance, seed) edges, by rounds over the graph."""
    instances = edges.groupBy("instance").agg((F.max(F.col("seed").cast("long")) * ONE).alias("worth"))
    trusted_before, patterns = -1, None
    for _ in range(most_rounds):
        patterns = (
            edges.join(instances, "instance")
            .groupBy("pattern")
            .agg(F.floor(F.sum("worth") / F.count(F.lit(1))).alias("score"), F.sum(F.col("seed").cast("long")).alias("seeds"))
        )
        patterns = stored(patterns, "pii-patterns")
        trusted = patterns.filter((F.col("score") >= CONFIDENCE) & (F.col("seeds") >= LEAST_SEEDS)).count()
        if trusted == trusted_before:  # scores only rise from round to round, so the trusted set has not changed
            break
        trusted_before = trusted
        score = F.when(F.col("seeds") >= LEAST_SEEDS, F.col("score")).otherwise(0)
        doubt = F.floor(F.log(F.greatest(1 - F.col("score") / ONE, F.lit(1e-6))) * ONE).cast("long")
        instances = (
            edges.join(patterns.select("pattern", score.alias("score")), "pattern")
            .groupBy("instance")
            .agg(
                F.when(F.max("seed"), F.lit(ONE))
                .otherwise(F.floor((1 - F.exp(F.sum(doubt) / ONE)) * ONE))
                .cast("long")
                .alias("worth")
            )
        )
    return patterns


def discovered(found: DataFrame) -> DataFrame:
    """(doc_id, code, extra): candidates beside patterns of high confidence."""
    named = found.select("doc_id", "code", F.explode(F.concat("seeds", "candidates")).alias("span")).select(
        "doc_id", "code", "span", F.explode(F.split(F.col("span")["context"], "\n")).alias("pattern")
    )
    form = F.lower(F.col("span")["match"])
    digits = _digits(form)
    instance = F.when(F.length(digits) >= 6, digits).otherwise(form)
    edges = named.groupBy("pattern", instance.alias("instance")).agg(F.max(F.col("span")["kind"] != FOUND).alias("seed"))
    patterns = scored_patterns(stored(edges, "pii-edges"))
    sure = patterns.filter((F.col("score") >= CONFIDENCE) & (F.col("seeds") >= LEAST_SEEDS)).select("pattern")
    extra = named.filter(F.col("span")["kind"] == FOUND).join(sure, "pattern", "left_semi")
    return extra.groupBy("doc_id", "code").agg(F.array_sort(F.collect_set("span")).alias("extra"))


def _with_extra(rows: DataFrame, extra: DataFrame) -> DataFrame:
    """Left join on (doc_id, code); the stored table of findings is broadcast only if Spark finds it small."""
    right = extra.select(F.col("doc_id").alias("__id"), F.col("code").alias("__code"), "extra")
    return rows.join(right, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("code") == F.col("__code")), "left").withColumn(
        "extra", F.coalesce("extra", F.array().cast(SPAN))
    )


def identifier_rows(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, one row per row of ``docs``.

    ``spans`` holds the base spans and those of kind ``context``. Null and empty texts have none, repeated
    rows the same ones; a document that repeats a doc_id with another text keeps its own. No rows give no
    rows. Columns other than doc_id and text are ignored.
    """
    found = stored(occurrences(docs), "pii-occurrences")
    rows = _with_extra(found, stored(discovered(found), "pii-extra"))
    line = span_text(F.col("seeds"))
    return rows.select(
        "doc_id",
        *[count_of(F.col("seeds"), kind).alias(f"n_{kind}") for kind in KINDS],
        hex_sha256(line).alias("base_sha256"),
        span_text(in_order(F.col("seeds"), F.col("extra"))).alias("spans"),
    )


def redact(text: Column, spans: Column) -> Column:
    """``text`` with every span, in order, replaced by its kind in brackets; of overlapping spans the first counts."""
    return replaced(text, spans, lambda span: F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]")))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced in ``text`` and ``n_chars``, if there is one, brought up to date.

    All rows stay; rows without personal data are unchanged, null texts too. The base spans are worked out
    in the row; only the discovered ones, a narrow table, are joined.
    """
    extra = stored(discovered(stored(occurrences(docs), "pii-occurrences")), "pii-extra")
    names = {c: f"own_{i}" for i, c in enumerate(docs.columns)}
    inner = docs.select(
        *[F.col(f"`{c}`").alias(n) for c, n in names.items()],
        "doc_id",
        F.col("text").alias("body"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("code"),
    )
    rows = _with_extra(inner, extra).withColumn("spans", in_order(base_spans(F.col("body")), F.col("extra")))
    rows = rows.withColumn("once", redact(F.col("body"), F.col("spans")))
    # A span that overlapped another one may leave a part that is a match by itself.
    rest = F.when(F.size("spans") > 1, base_spans(F.col("once"))).otherwise(F.array().cast(SPAN))
    rows = rows.withColumn("rest", rest).withColumn("clean", redact(F.col("once"), F.col("rest")))
    clean = {"text": F.col("clean")}
    if "n_chars" in names:
        kind = dict(docs.dtypes)["n_chars"]
        clean["n_chars"] = F.when(F.size("spans") > 0, F.length("clean").cast(kind)).otherwise(F.col(names["n_chars"]))
    return rows.select(*[clean.get(c, F.col(n)).alias(c) for c, n in names.items()])
