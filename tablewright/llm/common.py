"""Helpers shared by the training-data operators: stored tables, word patterns, spans of regular expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

# A word is a run of anything but space and the five ASCII control blanks.
BLANKS = " \\t-\\r"
BLANK_CHARACTERS = " \t\n\x0b\f\r"

SPAN = "array<struct<start:int,rank:int,kind:string,stop:int,context:string,match:string>>"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: cuts the lineage, survives lost executors, and gives
    the planner the true size, so that a join broadcasts it only below Spark's own threshold."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# ---- spans of regular expressions ----------------------------------------------------------------


BLOCK = 256


def blocks_of(items: Column) -> Column:
    """The items in arrays of BLOCK, so that an array that grows by one item a step stays short."""
    def cut(known: Column) -> Column:
        last = F.greatest(F.ceil(F.size(known) / BLOCK) - 1, F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(known, b * BLOCK + 1, F.lit(BLOCK)))

    return once(items, cut)


def pattern_spans(
    text: Column,
    kind: str,
    rank: int,
    pattern: str,
    keep: Callable[[Column], Column] | None = None,
    gate: Column | None = None,
    context: Callable[[Column, Column], Column] | None = None,
) -> Column:
    """Leftmost non-overlapping matches of a Java regular expression as an array of SPAN structs.

    A match's place is the summed length of the pieces before it, which ``split`` gives with the same
    search as ``regexp_extract_all``. Places are code points, ``stop`` exclusive. ``keep`` drops
    matches, ``gate`` is a cheap test that must hold for any text with a match, ``context`` makes the
    context from the pieces in front of and behind a match. ``pattern`` must not match the empty string, and
    a repeated group in it must be possessive: others recurse once per repetition. Places are added up in
    blocks of matches and then over the blocks, so the work is in proportion to the matches.
    """
    empty = F.array().cast(SPAN)
    gaps = F.split(text, pattern, -1)
    pieces = once(
        gaps,
        lambda g: F.arrays_zip(
            g.alias("gap"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"),
            F.slice(g, F.lit(2), F.size(g)).alias("behind"),
        ),
    )
    start = F.struct(F.lit(0).alias("at"), empty.alias("found"))

    def step(state: Column, piece: Column) -> Column:
        gap, match = piece["gap"], piece["match"]
        begin = state["at"] + F.length(gap)
        end = begin + F.coalesce(F.length(match), F.lit(0))
        one = F.struct(
            begin.alias("start"),
            F.lit(rank).alias("rank"),
            F.lit(kind).alias("kind"),
            end.alias("stop"),
            (context(gap, piece["behind"]) if context else F.lit(None).cast("string")).alias("context"),
            match.alias("match"),
        )
        good = match.isNotNull() if keep is None else match.isNotNull() & keep(match)
        found = F.when(good, F.concat(state["found"], F.array(one).cast(SPAN))).otherwise(state["found"])
        return F.struct(end.alias("at"), found.alias("found"))

    def moved(span: Column, by: Column) -> Column:
        return F.struct(
            (span["start"] + by).alias("start"), span["rank"].alias("rank"), span["kind"].alias("kind"),
            (span["stop"] + by).alias("stop"), span["context"].alias("context"), span["match"].alias("match"),
        )

    def gather(state: Column, block: Column) -> Column:
        here = F.transform(block["found"], lambda span: moved(span, state["at"]))
        return F.struct((state["at"] + block["at"]).alias("at"), F.concat(state["found"], F.array(here)).alias("found"))

    counted = once(pieces, lambda p: F.transform(blocks_of(p), lambda block: F.aggregate(block, start, step)))
    whole = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("found"))
    spans = F.aggregate(counted, whole, gather, lambda state: F.flatten(state["found"]))
    return F.when(gate if gate is not None else text.rlike(pattern), spans).otherwise(empty)


def replaced(text: Column, spans: Column, mark: Callable[[Column], Column]) -> Column:
    """``text`` with every span, in order, replaced by its mark; of overlapping spans the first counts."""

    def part(block: Column, at: Column) -> Column:
        """From a block of spans and the place so far: the new place and the text up to it."""
        end = F.greatest(at, F.array_max(F.transform(block, lambda s: s["stop"])))
        segment = F.substring(text, at + 1, end - at)
        start = F.struct(at.alias("at"), F.array().cast("array<string>").alias("parts"))

        def build(body: Column) -> Column:
            def step(state: Column, span: Column) -> Column:
                piece = F.substring(body, state["at"] - at + 1, span["start"] - state["at"])
                fresh = span["start"] >= state["at"]
                grown = F.concat(state["parts"], F.array(piece, mark(span)))
                return F.struct(
                    F.greatest(state["at"], span["stop"]).alias("at"), F.when(fresh, grown).otherwise(state["parts"]).alias("parts")
                )

            return F.aggregate(block, start, step, lambda s: F.struct(s["at"].alias("at"), F.array_join(s["parts"], "").alias("text")))

        return once(segment, build)

    def gather(state: Column, block: Column) -> Column:
        return once(
            part(block, state["at"]),
            lambda done: F.struct(done["at"].alias("at"), F.concat(state["parts"], F.array(done["text"])).alias("parts")),
        )

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    whole = F.aggregate(
        blocks_of(spans), begin, gather, lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(text, s["at"] + 1, F.length(text)))
    )
    return F.when(F.size(spans) == 0, text).otherwise(whole)


def in_order(*spans: Column) -> Column:
    """All spans by start, then by rank of the kind."""
    return F.array_sort(F.concat(*spans))


def span_text(spans: Column) -> Column:
    """``kind:start:stop`` of every span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ","
    )


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def hex_sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
