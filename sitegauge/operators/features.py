"""Structural, keyword, distinct-term and first-number features per company.

The features are defined on all texts of a company joined by spaces, in category order.
That text is never built. Counts, lengths and distinct terms add up over records, because no
match contains white space. A first number may start in one record and end in a later one;
for it each record is reduced to a small summary, and summaries merge associatively, first
inside blocks of bounded size, then across blocks.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rules import (
    COUNT_RULES,
    FEATURE_CATEGORIES,
    NUMBER_RULES,
    UNIQUE_RULES,
    CountRule,
    NumberRule,
    UniqueRule,
)
from ..functions.text import number_or
from ..functions.once import computed_once
from .ranking import block_numbers, null_safe_join

BLOCK_ROWS = 1_000
_ANY_DISTANCE = 1 << 40
_NONE = -1

# Word lists are tried script by script: one class test skips all words of another script.
_SCRIPTS = ("[ァ-ヿ]", "[ぁ-ゟ]", "[一-\u9fff]")
_NOT_ASCII = r"(?=[^\x00-\x7f])"


def _plain_words(pattern: str) -> list[str] | None:
    """The words of a plain list; None if the pattern is more than that."""
    if not re.fullmatch(r"(?:[^\\.^$*+?{}\[\]()]|\\[.&])+", pattern):
        return None
    return re.sub(r"\\(.)", r"\1", pattern).split("|")


def _may_overlap(words: list[str]) -> bool:
    """Whether one word can begin inside another, or a word inside itself."""
    return any(
        b.startswith(a[i:]) or a[i:].startswith(b) for a in words for b in words for i in range(0 if a != b else 1, len(a))
    )


def _grouped(words: list[str]) -> str:
    """Alternatives grouped by the script of their first character. Words of different scripts
    never start at one position, so only the order inside a group matters, and that is kept."""
    groups = {chars: [re.escape(w) for w in words if re.match(chars, w)] for chars in _SCRIPTS}
    arms = [f"(?={chars})(?:{'|'.join(found)})" for chars, found in groups.items() if found]
    return f"{_NOT_ASCII}(?:{'|'.join(arms)})"


def count_matches(text: Column, pattern: str) -> Column:
    """Number of matches of ``pattern``, found faster for plain word lists.

    ASCII words and words of other scripts share no character, so their matches never overlap
    and can be counted apart: ASCII words by what removing them takes away, the others by a
    search that passes over ASCII text at one test per character. Lists that mix characters
    inside a word, or whose ASCII words can overlap, are searched as they are.
    """
    words = _plain_words(pattern)
    ascii_words = [w for w in words or [] if w.isascii()]
    others = [w for w in words or [] if not w.isascii()]
    mixed = any(any(c.isascii() for c in w) or not any(re.match(s, w) for s in _SCRIPTS) for w in others)
    if words is None or mixed or _may_overlap(ascii_words) or not all(words):
        return F.regexp_count(text, F.lit(pattern)).cast("long")
    counts = [
        ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(w), F.lit("")))) / len(w)).cast("long")
        for w in ascii_words
    ]
    if others:
        counts.append(F.regexp_count(text, F.lit(_grouped(others))).cast("long"))
    return sum(counts[1:], counts[0])


def _reach(rule: NumberRule) -> str:
    return "*" if rule.max_gap is None else f"{{0,{rule.max_gap}}}"


def _number(rule: NumberRule) -> str:
    return f"({rule.number}){rule.unit}"


def _anchored(text: Column, rule: NumberRule) -> Column:
    """First stretch from an anchor to its number or, failing that, to the end of the record."""
    # An anchor spelled without ASCII cannot start at an ASCII character.
    start = "" if re.search(r"[A-Za-z0-9.\\]", rule.anchor) else _NOT_ASCII
    pattern = rf"{start}{rule.anchor}{rule.gap}{_reach(rule)}?(?:{_number(rule)}|\z)"
    return F.regexp_extract(text, pattern, 0)


def _stretch(rule: NumberRule) -> str:
    """The stretch of ``_anchored`` for Arrow's expressions."""
    return rf"{rule.anchor}{rule.gap}{_reach(rule)}?(?:(?:{rule.number}){rule.unit}|\z)"


def _first_match(text, pattern: str):
    """The first match in each text, an empty string if there is none."""
    return pc.fill_null(pc.struct_field(pc.extract_regex(text, f"(?P<found>{pattern})"), 0), "")


def _alike(pattern: str, empty: bool = True) -> bool:
    """Whether Arrow's expressions find what Spark's do: nothing that only one of them knows or reads in its own way.

    ``empty`` says whether a match may be an empty string.
    """
    rest = pattern.replace(r"\s\x0B", r"\x0B")  # what they take for white space differs in this character alone
    rest = re.sub(r"\\(?:[^\sA-Za-z0-9]|[dwnrtf]|x[0-9a-fA-F]{2}|p\{[LNZ]\})", "a", rest)
    if "&&" in rest or re.search(r"[\\\[\]^$.]|\(\?(?!:)|\((?!\?)|[*+?}]\+", re.sub(r"\[\^?[^\[\]]+\]", "a", rest)):
        return False
    try:
        _first_match(pa.array([""]), pattern)
    except pa.ArrowInvalid:
        return False
    return empty or not pc.match_substring_regex(pa.array([""]), pattern)[0].as_py()


def _searched(df: DataFrame, text: str, counts: dict[str, str], stretches: dict[str, str]) -> DataFrame:
    """``df`` with the number of matches of some patterns and the first match of others, searched in Arrow batches.

    Arrow's expressions read a text in one pass without going back, many times faster than Spark's.
    """
    if not counts and not stretches:
        return df
    added = [T.StructField(k, T.LongType()) for k in counts] + [T.StructField(s, T.StringType()) for s in stretches]
    schema = T.StructType([*df.schema.fields, *added])

    def search(batches):
        for batch in batches:
            texts = batch[text]
            found = [pc.count_substring_regex(texts, p).cast(pa.int64()) for p in counts.values()]
            found += [_first_match(texts, p) for p in stretches.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=schema.names)

    return df.mapInArrow(search, schema)


def _start(rule: NumberRule) -> str:
    """A number within reach of the start of a record: groups gap and number.

    The optional group makes the search succeed at once at the start of the text instead of
    trying every later position in vain.
    """
    return rf"\A(?:({rule.gap}{_reach(rule)}?){_number(rule)})?"


def _head(text: Column, start: str, unit: str) -> Column:
    found = F.regexp_extract(text, start, 2)
    return F.when(text.contains(unit), found).otherwise(F.lit("")) if unit and re.escape(unit) == unit else found


def _number_summary(text: Column, stretch: Column, head: Column, rule: NumberRule) -> Column:
    """What one record tells about a number rule.

    first  the record's own match
    head   a number that an anchor of an earlier record can reach, ``gap`` characters in
    through  length of the record if a gap may run through all of it, else -1
    tail   characters of gap still allowed after an anchor near the end of the record, else -1
    """
    gap, reach = rule.gap, _reach(rule)
    own = F.regexp_extract(stretch, rf"\A{rule.anchor}{gap}{reach}?{_number(rule)}", 1)
    if rule.max_gap is None:
        skipped = F.lit(0)
        through = F.when(text.contains("\n"), F.lit(_NONE)).otherwise(F.lit(0))
        allowed = F.lit(_ANY_DISTANCE)
    else:
        skipped = F.length(F.regexp_extract(text, _start(rule), 1))
        whole = F.regexp_extract(text, rf"\A({gap}{{1,{rule.max_gap}}}\z)?", 1)
        through = F.when((text == "") | (whole != ""), F.length(text)).otherwise(F.lit(_NONE))
        end = F.right(text, F.lit(rule.max_gap + rule.anchor_chars))
        closing = rf"(?s)\A.*{rule.anchor}({gap}{reach})\z"
        allowed = F.lit(rule.max_gap) - F.length(F.regexp_extract(end, closing, 1))
    # An own match makes everything after it irrelevant.
    tail = F.when((stretch != "") & (own == ""), allowed).otherwise(F.lit(_NONE))
    return F.struct(
        F.when(own != "", own).alias("first"),
        F.when(head != "", head).alias("head"),
        F.when(head != "", skipped).otherwise(F.lit(0)).cast("long").alias("gap"),
        through.cast("long").alias("through"),
        tail.cast("long").alias("tail"),
    )


def _merge_summaries(left: Column, right: Column, spaces: Column) -> Column:
    reaches = (left["tail"] >= 0) & (left["tail"] - spaces - right["gap"] >= 0)
    runs_on = (left["tail"] >= 0) & (right["through"] >= 0)
    both = (left["through"] >= 0) & (right["through"] >= 0)
    return F.struct(
        F.coalesce(left["first"], F.when(reaches, right["head"]), right["first"]).alias("first"),
        F.coalesce(left["head"], F.when(left["through"] >= 0, right["head"])).alias("head"),
        F.when(left["head"].isNotNull(), left["gap"])
        .otherwise(left["through"] + spaces + right["gap"])
        .alias("gap"),
        F.when(both, left["through"] + spaces + right["through"]).otherwise(F.lit(_NONE).cast("long")).alias("through"),
        F.greatest(
            right["tail"],
            F.when(runs_on, left["tail"] - spaces - right["through"]).otherwise(F.lit(_NONE).cast("long")),
        ).alias("tail"),
    )


def _fold(pieces: Column) -> Column:
    """Merge ordered pieces ``struct<cat, at, numbers>``; absent categories are empty texts, so
    pieces of different categories stand ``difference`` spaces apart."""

    def step(acc: Column, piece: Column) -> Column:
        spaces = F.greatest(piece["cat"] - acc["cat"], F.lit(1)).cast("long")
        return F.struct(
            piece["cat"].alias("cat"),
            piece["at"].alias("at"),
            F.zip_with(acc["numbers"], piece["numbers"], lambda a, b: _merge_summaries(a, b, spaces)).alias("numbers"),
        )

    return F.when(
        F.size(pieces) > 0,
        F.aggregate(F.slice(pieces, F.lit(2), F.size(pieces)), F.get(pieces, 0), step),
    )


def _distinct_terms(text: Column, number: int, rule: UniqueRule) -> Column:
    """Terms behind the number of their rule. Strings are told apart by hash, structs would be compared pair by pair."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)))
    return F.transform(found, lambda term: F.concat(F.lit(f"{number} "), term))


def _check_additive(rules: tuple) -> None:
    for rule in rules:
        if re.search(r"\s", rule.pattern):
            raise ValueError(f"matches of {rule.feature} may not contain white space")


def structural_features(
    records: DataFrame,
    company: str,
    category: str,
    seq: str,
    text: str,
    categories: tuple[str, ...] = FEATURE_CATEGORIES,
    count_rules: tuple[CountRule, ...] = COUNT_RULES,
    unique_rules: tuple[UniqueRule, ...] = UNIQUE_RULES,
    number_rules: tuple[NumberRule, ...] = NUMBER_RULES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per company with every rule-based feature; the text column is read once.

    ``seq`` is a unique integer giving the record order, with any gaps: blocks of records are
    counted. Records of other categories count for nothing, but their company still gets a row.
    """
    _check_additive(count_rules)
    _check_additive(unique_rules)
    body = F.coalesce(F.col(text), F.lit(""))
    cat = (F.array_position(F.array(*[F.lit(c) for c in categories]), F.col(category)) - 1).cast("int")
    known = records.select(
        F.col(company).alias("_company"),
        F.col(seq).cast("long").alias("_at"),
        F.when(cat >= 0, cat).alias("_cat"),
        F.when(cat >= 0, body).alias("_text"),
    )
    t = F.col("_text")
    terms = [_distinct_terms(t, i, r) for i, r in enumerate(unique_rules)]
    no_terms = F.array().cast("array<string>")
    counts = [f"_k{i}" for i in range(len(count_rules))]
    stretches = [f"_s{i}" for i in range(len(number_rules))]
    # Rules with the same gap, number and unit share one search.
    searches = dict.fromkeys((_start(r), r.unit) for r in number_rules)
    starts = {search: f"_h{i}" for i, search in enumerate(searches)}
    counted = {k: r.pattern for k, r in zip(counts, count_rules) if _alike(r.pattern, empty=False)}
    # With an anchor before it and \z behind, a stretch is alike if its parts are.
    stretched = {s: _stretch(r) for s, r in zip(stretches, number_rules) if _alike(_stretch(r).removesuffix(r"|\z)") + ")")}
    searched = _searched(known, "_text", counted, stretched)
    scanned = computed_once(
        searched,
        ["_company", "_cat", "_at", "_text", *counted, *stretched],
        **{k: count_matches(t, r.pattern) for k, r in zip(counts, count_rules) if k not in counted},
        **{s: _anchored(t, r) for s, r in zip(stretches, number_rules) if s not in stretched},
        **{h: _head(t, pattern, unit) for (pattern, unit), h in starts.items()},
        _terms=F.coalesce(F.concat(*terms), no_terms) if terms else no_terms,
    )
    columns = [
        "_company",
        "_cat",
        "_at",
        F.length(t).cast("long").alias("_chars"),
        *counts,
        "_terms",
    ]
    if number_rules:
        numbers = F.array(
            *[_number_summary(t, F.col(s), F.col(starts[_start(r), r.unit]), r) for s, r in zip(stretches, number_rules)]
        )
        piece = F.struct(F.col("_cat").alias("cat"), F.col("_at").alias("at"), numbers.alias("numbers"))
        columns.append(F.when(t.isNotNull(), piece).alias("_piece"))
    order = ["_company", "_cat", "_at"]
    numbers = block_numbers(known, order[:2], "_at", "_block", block_rows)
    # Both sides have a row per record: neither is for broadcasting.
    rows = null_safe_join(scanned.select(*columns).hint("merge"), numbers, order)

    sums = [F.sum(k).alias(k) for k in counts]
    fold = [_fold(F.sort_array(F.collect_list("_piece"))).alias("_piece")] if number_rules else []
    blocks = rows.groupBy("_company", "_cat", "_block").agg(
        F.count("_chars").alias("_n"),
        F.sum("_chars").alias("_chars"),
        *sums,
        F.array_distinct(F.flatten(F.collect_list("_terms"))).alias("_terms"),
        *fold,
    )

    # One base row per block plus one row per distinct term of it, so that both kinds share the
    # shuffles and the texts are not read a second time. Base rows merge in two steps, runs of
    # ``block_rows`` blocks first, so that no step gathers more than about ``block_rows`` pieces
    # until few are left.
    split = blocks.withColumn("_u", F.explode(F.concat(F.array(F.lit("")), F.col("_terms"))))
    base = F.col("_u") == ""
    parted = split.select(
        "_company",
        F.when(base, F.lit(-1)).otherwise(F.substring_index("_u", " ", 1).cast("int")).alias("_rule"),
        F.col("_u").alias("_term"),
        "_cat",
        F.when(base, F.floor(F.col("_block") / block_rows)).alias("_run"),
        *[F.when(base, F.col(c)).alias(c) for c in ("_n", "_chars", *counts)],
        *([F.when(base, F.col("_piece")).alias("_piece")] if number_rules else []),
    )
    runs = parted.groupBy("_company", "_rule", "_term", F.when(F.col("_rule") == -1, F.col("_cat")).alias("_cat"), "_run").agg(
        F.sum("_n").alias("_n"), F.sum("_chars").alias("_chars"), *sums, *fold
    )
    per_cat = [
        F.sum(F.when(F.col("_cat") == i, F.col(c))).alias(f"{c[:2]}{i}")
        for i in range(len(categories))
        for c in ("_n", "_chars")
    ]
    merged = runs.groupBy("_company", "_rule", "_term").agg(*per_cat, *sums, *fold)
    cat_columns = [c for i in range(len(categories)) for c in (f"_n{i}", f"_c{i}")]
    whole = merged.groupBy("_company").agg(
        *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in cat_columns],
        *[F.coalesce(F.max(k), F.lit(0)).alias(k) for k in counts],
        *[F.count(F.when(F.col("_rule") == i, 1)).alias(r.feature) for i, r in enumerate(unique_rules)],
        *([F.any_value("_piece", True).alias("_piece")] if number_rules else []),
    )

    lengths = [
        F.when(F.col(f"_n{i}") > 0, F.col(f"_c{i}") + F.col(f"_n{i}") - 1).otherwise(F.lit(0))
        for i in range(len(categories))
    ]
    total = sum(lengths[1:], lengths[0]) + (len(categories) - 1) + 1
    out = [F.col("_company").alias(company)]
    for name, length in zip(categories, lengths):
        out += [
            (length > 0).cast("int").alias(f"has_{name}"),
            F.log1p(length).alias(f"{name}_length_log"),
            (length / total).alias(f"{name}_ratio"),
        ]
    out += [F.log1p(F.col(k)).alias(r.feature) for r, k in zip(count_rules, counts)]
    out += [F.col(r.feature).cast("int").alias(r.feature) for r in unique_rules]
    out += [
        number_or(F.get(F.col("_piece.numbers"), F.lit(i))["first"], r.default).alias(r.feature)
        for i, r in enumerate(number_rules)
    ]
    return whole.select(*out)
