"""Field extraction, coverage and match spans for grok and regex patterns."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions.binding import capture_groups, with_parsed
from logloom.functions.regexes import CompiledPattern
from logloom.session import quoted

RAW_FIELD = "raw_message"
# Up to so many patterns are counted by running each on every line.
FEW_PATTERNS = 16
# Patterns travel to every task with the function that counts them.
MAX_PATTERN_CHARS = 32 * 1024 * 1024


def matches(line: Column, pattern: CompiledPattern) -> Column:
    """True where the pattern matches at the start of the line."""
    return F.coalesce(_possible(line, pattern) & line.rlike(pattern.anchored), F.lit(False))


def _possible(line: Column, pattern: CompiledPattern) -> Column:
    """Cheap necessary condition for a match."""
    return line.contains(pattern.required_text) if pattern.required_text else F.lit(True)


def _python_fields(line: Column, pattern: CompiledPattern) -> Column:
    """Exact absent-or-empty distinction, one Arrow batch at a time."""
    regex, names = pattern.python_regex, pattern.field_names

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compiled = re.compile(regex)
        for batch in batches:
            found = (compiled.match(text) if text is not None else None for text in batch)
            yield pd.Series([[m[name] for name in names] if m else None for m in found])

    return extract(line)


def extract_fields(
    lines: DataFrame, pattern: CompiledPattern, value: str = "value", engine: str = "auto"
) -> DataFrame:
    """One column per named group; unmatched lines are kept whole in ``raw_message``.

    ``engine='auto'`` stays in the JVM unless a field could be both absent and empty.
    """
    line = quoted(value)
    if not pattern.fields:
        return lines.withColumn(RAW_FIELD, line)
    if engine == "python" or (engine == "auto" and pattern.ambiguous):
        found = lines.withColumn("_found", _python_fields(line, pattern))
        columns = {name: F.get("_found", F.lit(at)) for at, name in enumerate(pattern.field_names)}
        matched = F.col("_found").isNotNull()
    else:
        numbers = [number for _, number in pattern.fields]
        found = with_parsed(
            lines,
            "_groups",
            F.when(_possible(line, pattern), capture_groups(line, pattern.spanning, numbers)),
        )
        matched = F.coalesce(F.size("_groups") > 1, F.lit(False))
        columns = {}
        for at, name in enumerate(pattern.field_names, start=1):
            text = F.get("_groups", F.lit(at))
            # a group that took no part comes back as ''
            columns[name] = text if name in pattern.always_present else F.nullif(text, F.lit(""))
    kept = [quoted(c) for c in lines.columns if c not in columns and c != RAW_FIELD]
    raw = F.when(~matched, line)
    if RAW_FIELD in columns:
        columns[RAW_FIELD] = F.coalesce(columns[RAW_FIELD], raw)
    else:
        columns[RAW_FIELD] = raw
    return found.select(*kept, *[c.alias(name) for name, c in columns.items()])


def pattern_coverage(
    lines: DataFrame, patterns: dict[str, CompiledPattern], value: str = "value", engine: str = "auto"
) -> DataFrame:
    """Lines, matches and match rate of every pattern.

    All patterns are counted in one pass with map-side partial sums: a few of them in the JVM, each
    on every line (``engine='jvm'``); more than ``FEW_PATTERNS`` by an automaton over the texts their
    matches must hold, which names the patterns a line may match at all (``engine='automaton'``).
    """
    many = len(patterns) > FEW_PATTERNS if engine == "auto" else engine == "automaton"
    counts = _counts_by_automaton if many else _counts_by_pattern
    return counts(lines, patterns, quoted(value)).withColumn(
        "match_rate", F.when(F.col("lines") > 0, F.col("matches") / F.col("lines"))
    )


def _counts_by_pattern(lines: DataFrame, patterns: dict[str, CompiledPattern], line: Column) -> DataFrame:
    flagged = lines.select(
        line.alias("_line"),
        *[matches(line, pattern).alias(f"_hit{at}") for at, pattern in enumerate(patterns.values())],
    )
    counters = [F.count(F.lit(1)).alias("_lines")]
    for at in range(len(patterns)):
        counters.append(F.count_if(F.col(f"_hit{at}")).alias(f"_n{at}"))
    totals = flagged.agg(*counters)
    rows = [
        F.struct(F.lit(name).alias("pattern"), F.col("_lines").alias("lines"), F.col(f"_n{at}").alias("matches"))
        for at, name in enumerate(patterns)
    ]
    return totals.select(F.inline(F.array(*rows)))


def _counts_by_automaton(lines: DataFrame, patterns: dict[str, CompiledPattern], line: Column) -> DataFrame:
    """One row of counts per pattern and task, summed by Spark.

    The automaton is built once per task from the required texts; a pattern's regex is compiled when
    a line first needs it. Patterns without a required text are tried on every line.
    """
    size = sum(len(pattern.python_regex) for pattern in patterns.values())
    if size > MAX_PATTERN_CHARS:
        raise ValueError(f"{size} characters of patterns are too many to send to every task")
    regexes = [pattern.python_regex for pattern in patterns.values()]
    holders: dict[str, list[int]] = {}
    for at, pattern in enumerate(patterns.values()):
        holders.setdefault(pattern.required_text, []).append(at)
    always = holders.pop("", [])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for text, numbers in holders.items():
            automaton.add_word(text, numbers)
        if holders:
            automaton.make_automaton()
        compiled: dict[int, re.Pattern] = {}
        found, seen = [0] * len(regexes), 0
        for batch in batches:
            seen += len(batch)
            for text in batch["value"]:
                if text is None:
                    continue
                candidates = set(always)
                if holders:
                    for _, numbers in automaton.iter(text):
                        candidates.update(numbers)
                for at in candidates:
                    regex = compiled.get(at)
                    if regex is None:
                        regex = compiled[at] = re.compile(regexes[at])
                    found[at] += regex.match(text) is not None
        hit = [at for at, n in enumerate(found) if n]
        yield pd.DataFrame({"at": [-1, *hit], "n": [seen, *[found[at] for at in hit]]})

    partial = lines.select(line.alias("value")).mapInPandas(count, "at int, n bigint")
    totals = partial.groupBy("at").agg(F.sum("n").alias("n"))
    names = lines.sparkSession.createDataFrame(list(enumerate(patterns)), "at int, pattern string")
    n_lines = totals.filter("at = -1").select(F.col("n").alias("lines"))
    by_pattern = names.join(totals, "at", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # one row, so the cross join adds a constant; without any task there is no row at all
    counted = by_pattern.join(F.broadcast(n_lines.agg(F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"))))
    return counted.select("pattern", "lines", F.col("n").alias("matches"))


def sample_misses(
    lines: DataFrame, pattern: CompiledPattern, value: str = "value", limit: int = 10, smallest: bool = False
) -> DataFrame:
    """A few unmatched lines; stops reading once enough are found, unless the smallest are asked for."""
    line = quoted(value)
    missed = lines.filter(~matches(line, pattern)).select(line.alias("line"))
    return (missed.orderBy("line") if smallest else missed).limit(limit)


def match_spans(lines: DataFrame, pattern: CompiledPattern, value: str = "value") -> DataFrame:
    """Adds ``match_start``/``match_end`` and ``<field>_start``/``<field>_end``, 0-based.

    The search is not anchored. A field's span is where its text first occurs at or after
    the match start; fields that took no part have null spans. One regex run per line gives the
    text before the match, the match and all fields; the two groups this adds in front move the
    numbers by which a pattern refers back to its own.
    """
    line = quoted(value)
    shifted = re.sub(
        r"\\(?:([1-9][0-9]*)|.)", lambda m: f"\\{int(m[1]) + 2}" if m[1] else m[0], pattern.java_regex, flags=re.S
    )
    groups = capture_groups(
        line, f"(?dU)^((?s:.*?))({shifted})(?s:.*)$", [1, 2, *[number + 2 for _, number in pattern.fields]]
    )
    located = with_parsed(lines, "_parts", groups).withColumn(
        "match_start", F.when(F.size("_parts") > 1, F.length(F.get("_parts", F.lit(1))))
    )
    begun = F.col("match_start")
    whole = F.get("_parts", F.lit(2))
    columns = [F.when(begun.isNotNull(), begun + F.length(whole)).alias("match_end")]
    for at, (name, _) in enumerate(pattern.fields, start=3):
        text = F.get("_parts", F.lit(at))
        if name not in pattern.always_present:
            text = F.nullif(text, F.lit(""))
        # locate() finds an empty text at position 1 whatever the offset
        position = F.when(text == "", begun).otherwise(_index_from(text, line, begun))
        position = F.when(begun.isNotNull() & text.isNotNull(), position)
        columns += [position.alias(f"{name}_start"), (position + F.length(text)).alias(f"{name}_end")]
    return located.select(*[quoted(c) for c in lines.columns], "match_start", *columns)


def _index_from(needle: Column, text: Column, offset: Column) -> Column:
    """0-based position of the first occurrence at or after a 0-based offset."""
    return F.call_function("locate", needle, text, offset + 1) - 1
