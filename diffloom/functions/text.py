"""Line and text expressions over a content column.

Everything here stays inside one row: a file is an array of lines, and array
functions replace per-line rows wherever the result is one value per file.
"""

from __future__ import annotations

from functools import reduce
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from diffloom import fixed_values as fv


def filled(template: str, **values: Column) -> Column:
    """A text with its named gaps filled from columns."""
    pieces = []
    for literal, name, _, _ in Formatter().parse(template):
        pieces += [F.lit(literal)] + ([values[name].cast("string")] if name else [])
    return F.concat(*pieces)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(fv.WHITESPACE))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def lines(content: Column) -> Column:
    """All lines; a trailing newline yields a last empty line."""
    return F.split(content, "\n", -1)


def nonblank_lines(line_array: Column) -> Column:
    """Stripped lines without the blank ones."""
    return F.filter(F.transform(line_array, strip), lambda text: text != "")


def code_text(line_array: Column, limit: int | None = None) -> Column:
    """Non-blank stripped lines joined by one space; a model with a bounded input passes its ``limit``."""
    joined = F.array_join(nonblank_lines(line_array), " ")
    return joined if limit is None else F.substring(joined, 1, limit)


def keyword_complexity(content: Column) -> Column:
    """1 plus, per line, one for each control word found anywhere in it; capped."""
    keywords = fv.COMPLEXITY_KEYWORDS

    def hits(total: Column, line: Column) -> Column:
        return reduce(lambda acc, word: acc + F.contains(line, F.lit(word)).cast("int"), keywords, total)

    counted = F.aggregate(lines(F.lower(content)), F.lit(1), hits)
    return F.least(counted, F.lit(fv.COMPLEXITY_CAP))


def duplicate_line_ratio(nonblank: Column) -> Column:
    """Share of repeated lines. Repeats over distinct values need no grouping: total - distinct."""
    long_lines = F.filter(nonblank, lambda text: F.length(text) > fv.MIN_LENGTH_FOR_DUPLICATION)
    ratio = F.aggregate(
        # Bind the filtered array once; both uses below read the bound value.
        F.array(long_lines),
        F.lit(0.0),
        lambda _, kept: (F.size(kept) - F.size(F.array_distinct(kept))).cast("double"),
    ) / F.greatest(F.size(nonblank), F.lit(1))
    return F.when(F.size(nonblank) < fv.MIN_LINES_FOR_DUPLICATION, F.lit(0.0)).otherwise(
        F.least(ratio, F.lit(1.0))
    )


def maintainability(total_lines: Column, complexity: Column, duplication: Column) -> Column:
    """0..100, lowered by length over 300 lines, complexity over 10 and duplication."""
    length_cost = F.when(
        total_lines > 300, F.least(F.lit(20), F.floor((total_lines - 300) / 50).cast("int"))
    ).otherwise(0)
    complexity_cost = F.when(complexity > 10, F.least(F.lit(30), (complexity - 10) * 2)).otherwise(0)
    duplication_cost = (duplication * 40).cast("int")
    return F.greatest(F.lit(100) - length_cost - complexity_cost - duplication_cost, F.lit(0))


def def_name(line: Column) -> Column:
    """Name after a leading ``def``, else ''. The byte search spares most lines the pattern."""
    return F.when(F.contains(line, F.lit("def")), F.regexp_extract(line, fv.DEF_NAME_PATTERN, 1)).otherwise("")


def indent(line: Column) -> Column:
    return F.length(line) - F.length(F.ltrim(line, F.lit(fv.WHITESPACE)))


def _following(array: Column) -> Column:
    """The array shifted by one, so that zip_with pairs each element with its successor."""
    return F.slice(array, F.lit(2), F.greatest(F.size(array), F.lit(1)))


def function_definitions(line_array: Column) -> Column:
    """array<struct<name, pos, indent, end>>: each ``def`` line and where the next one begins."""
    marked = F.filter(
        F.transform(
            line_array,
            lambda line, pos: F.struct(
                def_name(line).alias("name"),
                pos.alias("pos"),
                indent(line).alias("indent"),
            ),
        ),
        lambda item: item["name"] != "",
    )
    return F.flatten(
        F.transform(
            F.array(marked),
            lambda defs: F.zip_with(
                defs,
                _following(defs),
                lambda this, after: F.struct(
                    this["name"].alias("name"),
                    this["pos"].alias("pos"),
                    this["indent"].alias("indent"),
                    F.coalesce(after["pos"], F.size(line_array)).alias("end"),
                ),
            ),
        )
    )


def line_indents(line_array: Column) -> Column:
    """Indent per line, null for a blank line."""
    return F.transform(line_array, lambda line: F.when(~is_blank(line), indent(line)))


def function_lengths(definitions: Column, indents: Column) -> Column:
    """array<struct<name, pos, length>>; for a repeated name only the last one stays.

    A function ends at the first later non-blank line that is indented no deeper
    than its ``def``, else at the next ``def``, else at the end of the file.
    """

    def measured(item: Column) -> Column:
        body = F.slice(indents, item["pos"] + 2, item["end"] - item["pos"] - 1)
        closing = F.array_position(F.transform(body, lambda depth: depth <= item["indent"]), True)
        return F.struct(
            item["name"].alias("name"),
            item["pos"].alias("pos"),
            F.when(closing > 0, closing).otherwise(item["end"] - item["pos"]).cast("bigint").alias("length"),
        )

    by_name = F.array_sort(F.transform(definitions, measured))
    return F.flatten(
        F.transform(
            F.array(by_name),
            lambda items: F.filter(
                F.zip_with(
                    items,
                    _following(items),
                    lambda this, after: F.when(~this["name"].eqNullSafe(after["name"]), this),
                ),
                lambda item: item.isNotNull(),
            ),
        )
    )


def code_blocks(line_array: Column) -> Column:
    """Cut the non-blank lines into blocks, a new one at every declaration line."""

    def starts_block(line: Column) -> Column:
        head = F.ltrim(line, F.lit(fv.WHITESPACE))
        # A line that strips to exactly the word has lost the blank it needs.
        stripped = strip(head)
        return reduce(lambda a, b: a | b, [F.startswith(stripped, F.lit(s)) for s in fv.BLOCK_STARTERS])

    def cut(code: Column) -> Column:
        starts = F.filter(
            F.transform(code, lambda line, pos: F.when((pos == 0) | starts_block(line), pos)),
            lambda pos: pos.isNotNull(),
        )
        return F.transform(
            F.array(starts),
            lambda bounds: F.zip_with(
                bounds,
                _following(bounds),
                lambda first, after: F.array_join(
                    F.slice(code, first + 1, F.coalesce(after, F.size(code)) - first), "\n"
                ),
            ),
        )

    code_lines = F.filter(line_array, lambda line: ~is_blank(line))
    return F.flatten(F.flatten(F.transform(F.array(code_lines), cut)))


def words(text: Column) -> Column:
    """Lower-case whitespace-separated words of a text; empty array for a blank one."""
    return F.filter(F.split(F.lower(text), fv.SPACE + "+", -1), lambda word: word != "")


def word_jaccard(left_words: Column, right_words: Column) -> Column:
    """|A and B| / |A or B| over word sets; two empty sets count as equal."""
    union = F.size(F.array_union(left_words, right_words))
    return F.when(union == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(left_words, right_words)) / F.greatest(union, F.lit(1))
    )


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def threshold_flags(
    longest_function: Column, total_lines: Column, complexity: Column, duplication: Column
) -> Column:
    return F.struct(
        (F.coalesce(longest_function, F.lit(0)) > fv.MAX_FUNCTION_LINES).alias("long_function"),
        (total_lines > fv.MAX_FILE_LINES).alias("long_file"),
        (complexity > fv.MAX_COMPLEXITY).alias("high_complexity"),
        (duplication > fv.MAX_DUPLICATION).alias("high_duplication"),
    )


def summary_line(
    file_name: Column,
    file_type: Column,
    maintainability_index: Column,
    critical: Column,
    issues: Column,
    added: Column,
    removed: Column,
) -> Column:
    """One readable line per file; absent parts are left out."""
    kind = F.coalesce(F.nullif(file_type, F.lit("")), F.lit("unknown"))
    found = (
        F.when(critical > 0, F.concat(F.lit("⚠️ "), critical.cast("string"), F.lit(" critical issues")))
        .when(issues > 0, F.concat(issues.cast("string"), F.lit(" issues found")))
        .otherwise(F.lit("✅ No issues found"))
    )
    return F.concat_ws(
        " | ",
        F.concat(F.lit("**"), file_name, F.lit("** ("), kind, F.lit(")")),
        F.when(
            maintainability_index != 0,
            F.concat(
                F.lit("Maintainability: "),
                F.bround(maintainability_index, 0).cast("bigint").cast("string"),
                F.lit("/100"),
            ),
        ),
        found,
        F.when(
            (added != 0) & (removed != 0),
            F.concat(F.lit("+"), added.cast("string"), F.lit("/-"), removed.cast("string"), F.lit(" lines")),
        ),
    )
