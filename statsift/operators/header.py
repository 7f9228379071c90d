"""Header and delimiter detection: explode lines, score, take the best.

Input lines are ``source_id, line_idx, line``, physical lines from 0 on.  Only
the first ``MAX_LINES`` of a source are candidates, so a source gives a bounded
number of rows whatever its size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statsift.functions.cells import NUMBER_IN_HEADERS, is_data_row, normalised_name, trimmed
from statsift.vocabulary import STRIPPED_PREFIX, Vocabulary

# Delimiters in order of preference, and the limits and weights of the score.
DELIMITERS = ("\t", ",", ";", " ", "|")
MAX_LINES, LOOK_AHEAD, SAMPLE_ROWS = 200, 7, 50
HINTS = (
    "chr", "chrom", "chromosome", "pos", "position", "bp", "base_pair_location", "snp", "rsid", "variant_id", "markername", "marker", "a1", "a2",
    "allele1", "allele2", "effect_allele", "other_allele", "ea", "nea", "beta", "or", "odds_ratio", "effect", "log_odds", "z", "zscore", "se",
    "standard_error", "stderr", "p", "pval", "pvalue", "p_value", "n", "sample_size", "n_cases", "n_controls", "eaf", "maf", "freq",
    "effect_allele_frequency", "info", "direction",
)


def held(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def physical_lines(text: Column, most: int | None = None) -> Column:
    """The lines of a decoded text, the first ``most``; an unfinished last line is not one of them unless it is all there is."""
    pieces = F.split(F.regexp_replace(text, "\r\n|\r", "\n"), "\n")
    whole = F.when(F.size(pieces) > 1, F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)
    return F.slice(whole, 1, most) if most else whole


def explode_lines(texts: DataFrame, text: str = "text", most: int | None = None) -> DataFrame:
    """``source_id, line_idx, line`` of decoded texts."""
    return texts.select("source_id", F.posexplode(physical_lines(F.col(text), most)).alias("line_idx", "line"))


def numbered(lines: Column) -> Column:
    """An array of lines as one of ``line_idx, line``."""
    return F.transform(lines, lambda line, i: F.struct(i.alias("line_idx"), line.alias("line")))


def gathered(lines: DataFrame, most: int = MAX_LINES + LOOK_AHEAD) -> DataFrame:
    """``source_id, lines``: the lines below ``most`` of each source, in order, as one array."""
    head = lines.filter(F.col("line_idx") < most)
    return head.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("line_idx", "line"))).alias("lines"))  # no more than ``most``


def is_comment(line: Column) -> Column:
    return F.coalesce(line.rlike(r"^\s*(#|!|;;|//)"), F.lit(False))


def is_key_value(line: Column) -> Column:
    """A ``key=value`` or ``key: value`` line without tabs."""
    return F.coalesce(~line.contains("\t") & (line.rlike(r"^\s*[^\s=]+\s*=\s*\S") | line.rlike(r"^\s*[^\s:]+: \s*\S")), F.lit(False))


def _quoted_cells(line: Column, delimiter: str) -> Column:
    """Cells of a line in which some stand in quotes; a doubled quote is one.

    A quote counts at the start of a cell only; one that is never closed takes the rest of the line."""
    d = "\\Q" + delimiter + "\\E"
    found = F.regexp_extract_all(F.concat(F.lit(delimiter), line), F.lit(rf'{d}[ ]*("(?:[^"]++|"")*+(?:"[^{delimiter}]*)?|[^{delimiter}]*)'), F.lit(1))
    inner = r'(?s)^"((?:[^"]++|"")*+)(?:"(.*))?$'
    bare = lambda x: F.when(F.startswith(x, F.lit('"')), F.concat(F.regexp_replace(F.regexp_extract(x, inner, 1), '""', '"'), F.regexp_extract(x, inner, 2))).otherwise(x)
    return F.transform(found, lambda x: trimmed(bare(x)))


def split_line(line: Column, delimiter: Column) -> Column:
    """Cells of a line, trimmed; runs of spaces are one delimiter."""
    out = F.split(trimmed(line), r"\s+")
    for d in DELIMITERS:
        if d != " ":
            plain = F.transform(F.split(line, "\\Q" + d + "\\E"), trimmed)
            out = F.when(delimiter == d, F.when(line.contains('"'), _quoted_cells(line, d)).otherwise(plain)).otherwise(out)
    return out


def _delimiters() -> Column:
    return F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(d).alias("delimiter")) for i, d in enumerate(DELIMITERS)))


def delimiter_of(lines: Column, sample: int = 20) -> Column:
    """A struct (delimiter, fields, confidence) from an array of lines, by how many of the first usable ones agree on a field count; else NULL.

    Of equally frequent counts the one seen first stands; of equal scores the preferred delimiter."""
    usable = F.slice(F.filter(lines, lambda x: (trimmed(x) != "") & ~is_comment(x)), 1, sample)

    def mode(sizes: Column) -> Column:
        """The most frequent size: (how often, minus its first place, size)."""
        counts = F.transform(F.array_distinct(sizes), lambda v: F.struct(F.size(F.filter(sizes, lambda s: s == v)).alias("n"), (-F.array_position(sizes, v)).alias("seen"), v.alias("fields")))
        return F.array_max(counts)

    def of(d: Column, usable: Column) -> Column:
        def score(m: Column) -> Column:
            agreement = m["n"] / F.size(usable)
            total = 10 * agreement + 0.1 * F.least(m["fields"], F.lit(30)) + F.when(d["delimiter"] == "\t", 0.35).otherwise(0.0)
            return F.when(m["fields"] > 1, F.struct(total.alias("score"), (-d["ord"]).alias("ord"), d["delimiter"].alias("delimiter"), m["fields"].alias("fields"), F.round(agreement, 4).alias("confidence")))

        return held(held(F.transform(usable, lambda x: F.size(split_line(x, d["delimiter"]))), mode), score)

    best = held(usable, lambda u: F.array_max(F.array_compact(F.transform(_delimiters(), lambda d: of(d, u)))))
    return held(best, lambda b: F.when(b.isNotNull(), F.struct(b["delimiter"].alias("delimiter"), b["fields"].alias("fields"), b["confidence"].alias("confidence"))))


def detect_delimiter(lines: DataFrame, sample: int = 20) -> DataFrame:
    """``source_id, delimiter, fields, confidence`` from exploded lines."""
    usable = lines.filter((trimmed(F.col("line")) != "") & ~is_comment(F.col("line")))
    nth = F.row_number().over(Window.partitionBy("source_id").orderBy("line_idx"))
    first = usable.withColumn("nth", nth).filter(F.col("nth") <= sample)
    arrays = first.groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "line"))), lambda x: x["line"]).alias("lines"))
    return arrays.select("source_id", delimiter_of(F.col("lines"), sample).alias("found")).filter("found IS NOT NULL").select("source_id", "found.*")


def delimiters_of_texts(texts: DataFrame, text: str = "text", sample: int = 20) -> DataFrame:
    """The same from decoded texts: a text stays in its row, so nothing is shuffled."""
    found = texts.select("source_id", delimiter_of(physical_lines(F.col(text)), sample).alias("found"))
    return found.filter("found IS NOT NULL").select("source_id", "found.*")


def _sql_list(names: list[str]) -> str:
    return ", ".join("'" + n.replace("\\", "\\\\").replace("'", "\\'") + "'" for n in names)


def scored_lines(lines: Column, vocabulary: Vocabulary | None = None, cells: bool = True) -> Column:
    """Every candidate of an array of ``line_idx, line`` with its score: an array of ``score, delim_ord, line_idx, delimiter, cells, fields, mapped_share``.

    Without ``cells`` they are left out, since every step copies what it hands on.  A line looks ahead at the ``LOOK_AHEAD`` lines behind it in the array, so nothing leaves its row."""
    vocabulary = vocabulary or Vocabulary()
    known = _sql_list([r[0] for r in vocabulary.rows()])
    suffixes = "|".join(r[0] for r in vocabulary.suffix_rules)
    parts = "|".join(r[0] for r in vocabulary.contains_rules)
    # lists of names as SQL: an expression of hundreds of literals takes seconds to put together piece by piece
    least = min((len(r[0]) for r in (*vocabulary.suffix_rules, *vocabulary.contains_rules)), default=0)  # a shorter name fits no rule
    by_rule = f"length(x) >= {least} AND x RLIKE '({suffixes})$|{parts}'"
    mapped = F.expr(f"x -> x <> '' AND (x IN ({known}) OR {by_rule} OR startswith(x, '{STRIPPED_PREFIX}') AND regexp_replace(x, '^{STRIPPED_PREFIX}', '') IN ({known}))")
    hinted = F.expr(f"x -> x IN ({_sql_list(list(HINTS))})")

    def score(r: Column, look: Column, i: Column, d: Column) -> Column:
        following = F.filter(F.slice(look, i + 2, F.lit(LOOK_AHEAD)), lambda x: x["usable"])

        def of_names(names: Column, following: Column) -> Column:
            filled = F.filter(names, lambda n: n != "")
            fields = F.greatest(r["fields"], F.lit(1))
            share = F.size(F.call_function("filter", names, mapped)) / fields
            numeric = r["numbers"] / fields
            after = F.size(following)
            same = F.size(F.filter(following, lambda x: x["fields"] == r["fields"]))
            data = F.size(F.filter(following, lambda x: x["data_like"]))

            def total(m: Column) -> Column:
                # The weights of the score.
                sum_of = (
                    m["share"] * 6
                    + F.least(F.size(F.call_function("filter", names, hinted)), F.lit(8)) * 0.45
                    + (1 - m["numeric"]) * 3
                    - F.when(m["numeric"] > 0.5, 4.0).otherwise(0.0)
                    + F.size(F.array_distinct(filled)) / F.greatest(F.size(filled), F.lit(1)) * 1.5
                    + F.when(after > 0, same / F.greatest(after, F.lit(1)) * 3 + data / F.greatest(after, F.lit(1)) * 3).otherwise(-1.0)
                    + F.when(r["fields"].between(3, 200), 1.0).when(r["fields"] == 2, -0.5).otherwise(-2.0)
                    + F.when(r["comment"], F.when(m["share"] >= 0.5, -0.5).otherwise(-2.5)).otherwise(0.0)
                    - F.when(r["key_value"], 4.0).otherwise(0.0)
                    - F.size(F.filter(r["cells"], lambda x: x == "")) * 0.5
                    + F.greatest(F.lit(0.0), 1 - 0.02 * r["line_idx"])
                    + F.when(d["delimiter"] == "\t", 0.3).otherwise(0.0)
                )
                own = (r["cells"].alias("cells"),) if cells else ()
                return F.struct(sum_of.alias("score"), d["ord"].alias("delim_ord"), r["line_idx"].alias("line_idx"), d["delimiter"].alias("delimiter"), *own, r["fields"].alias("fields"), m["share"].alias("mapped_share"))

            return held(F.struct(share.alias("share"), numeric.alias("numeric")), total)

        return held(following, lambda f: held(F.transform(r["cells"], normalised_name), lambda n: of_names(n, f)))

    marked = F.transform(lines, lambda x: F.struct(
        x["line_idx"].alias("line_idx"), x["line"].alias("line"), is_comment(x["line"]).alias("comment"), (trimmed(x["line"]) == "").alias("blank"),
        ((trimmed(x["line"]) != "") & ~is_comment(x["line"])).alias("usable"), is_key_value(x["line"]).alias("key_value"),
    ))

    def of_delimiter(d: Column, marked: Column) -> Column:
        space = d["delimiter"] == " "
        bare = lambda v: F.when(space, trimmed(v)).otherwise(v)  # noqa: E731 cells of the others are trimmed
        info = F.transform(marked, lambda x: held(split_line(x["line"], d["delimiter"]), lambda c: F.struct(
            *(x[k].alias(k) for k in ("line_idx", "comment", "blank", "usable", "key_value")), c.alias("cells"), F.size(c).alias("fields"),
            F.size(F.filter(c, lambda v: bare(v).rlike(NUMBER_IN_HEADERS))).alias("numbers"), is_data_row(c, bare=bare).alias("data_like"),
        )))
        look = lambda rows: F.transform(rows, lambda r: F.struct(*(r[k].alias(k) for k in ("usable", "fields", "data_like"))))
        candidate = lambda r: (r["line_idx"] < MAX_LINES) & ~r["blank"] & (r["fields"] >= 2)
        found = held(info, lambda rows: held(look(rows), lambda ahead: F.array_compact(F.transform(rows, lambda r, i: F.when(candidate(r), score(r, ahead, i, d))))))
        # no line without the delimiter has two fields; cells by white space are told by no one character
        return F.when(space | F.exists(marked, lambda x: F.contains(x["line"], d["delimiter"])), found)

    return held(marked, lambda m: F.flatten(F.array_compact(F.transform(_delimiters(), lambda d: of_delimiter(d, m)))))


def score_candidates(lines: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """Every candidate line with its score: ``source_id, delim_ord, delimiter, line_idx, cells, fields, mapped_share, score``."""
    scored = gathered(lines).select("source_id", F.inline(scored_lines(F.col("lines"), vocabulary)))
    return scored.select("source_id", "delim_ord", "delimiter", "line_idx", "cells", "fields", "mapped_share", "score")


def confidence(best: Column, runner_up: Column) -> Column:
    """How sure a winner is, from its score and its lead; one that stands alone leads by all."""
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return F.round(0.7 * clip(best / 14) + 0.3 * F.when(runner_up.isNull(), 1.0).otherwise(clip((best - runner_up) / 4)), 4)


def _winners(arrays: DataFrame, vocabulary: Vocabulary | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The winner of each row ``source_id, lines``: highest score, then the preferred delimiter, then the earliest line."""

    def best(all_of: Column) -> Column:
        first = F.array_max(F.transform(all_of, lambda x: F.struct(x["score"].alias("score"), (-x["delim_ord"]).alias("d"), (-x["line_idx"]).alias("l"), x.alias("row"))))["row"]
        return F.struct(first.alias("best"), F.try_element_at(F.sort_array(F.transform(all_of, lambda x: x["score"]), asc=False), F.lit(2)).alias("runner_up"))

    found = arrays.select("source_id", *keep, "lines", F.inline(F.array(held(scored_lines(F.col("lines"), vocabulary, cells=False), best)))).filter("best.score > 0")
    line = F.filter("lines", lambda x: x["line_idx"] == F.col("best.line_idx"))[0]["line"]
    header = F.transform(split_line(line, F.col("best.delimiter")), lambda x: F.regexp_replace(x, "^\ufeff|^#+\\s*", ""))
    return found.select("source_id", F.col("best.line_idx").alias("header_row"), "best.delimiter", header.alias("header"), F.round("best.score", 6).alias("score"), confidence(F.col("best.score"), F.col("runner_up")).alias("confidence"), *keep)


def detect_headers(lines: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """The winner of each source: ``source_id, header_row, delimiter, header, score, confidence``.

    Sources without a candidate above 0 give no row; see ``header_failures``."""
    return _winners(gathered(lines), vocabulary)


def headers_of_texts(texts: DataFrame, vocabulary: Vocabulary | None = None, text: str = "text") -> DataFrame:
    """The same from decoded texts: a text stays in its row, so nothing is exploded or shuffled."""
    return _winners(texts.select("source_id", numbered(physical_lines(F.col(text), MAX_LINES + LOOK_AHEAD)).alias("lines")), vocabulary)


def tables_of_texts(texts: DataFrame, vocabulary: Vocabulary | None = None, most: int = SAMPLE_ROWS, text: str = "text") -> DataFrame:
    """The winners of ``headers_of_texts`` with the first rows below each header: ``rows``, an array of arrays of cells.

    Each text is gone through once and stays in its row."""
    lined = texts.select("source_id", physical_lines(F.col(text)).alias("every"))
    found = _winners(lined.select("source_id", numbered(F.slice("every", 1, MAX_LINES + LOOK_AHEAD)).alias("lines"), "every"), vocabulary, ("every",))
    usable = F.filter(F.slice("every", F.col("header_row") + 2, F.size("every")), lambda x: (trimmed(x) != "") & ~is_comment(x))
    return found.withColumn("rows", F.transform(F.slice(usable, 1, most), lambda x: split_line(x, F.col("delimiter")))).drop("every")


def header_failures(lines: DataFrame, found: DataFrame) -> DataFrame:
    """Sources without a header, as failure rows."""
    return lines.select("source_id").distinct().join(found.select("source_id"), "source_id", "left_anti").select("source_id", F.lit("header_not_found").alias("category"))


def sample_rows(lines: DataFrame, found: DataFrame, most: int = SAMPLE_ROWS) -> DataFrame:
    """The first rows below each header: ``source_id, row_idx, cells``."""
    below = lines.join(found.select("source_id", "header_row", "delimiter"), "source_id").filter(F.col("line_idx") > F.col("header_row"))
    below = below.filter((trimmed(F.col("line")) != "") & ~is_comment(F.col("line")))
    nth = F.row_number().over(Window.partitionBy("source_id").orderBy("line_idx"))
    kept = below.withColumn("row_idx", nth - 1).filter(F.col("row_idx") < most)
    return kept.select("source_id", "row_idx", split_line(F.col("line"), F.col("delimiter")).alias("cells"))


def preamble(lines: DataFrame, found: DataFrame) -> DataFrame:
    """The lines above each header."""
    return lines.join(found.select("source_id", "header_row"), "source_id").filter(F.col("line_idx") < F.col("header_row")).select("source_id", "line_idx", "line")


def is_data_table(found: DataFrame, mapped: DataFrame, samples: DataFrame) -> DataFrame:
    """``source_id, data_table``: a mapped column, or rows that keep the header's arity and look like data."""
    any_mapped = mapped.groupBy("source_id").agg(F.max((F.col("concept") != "unknown").cast("int")).alias("mapped"))
    rows = samples.join(found.select("source_id", F.size("header").alias("arity")), "source_id")
    shares = rows.groupBy("source_id").agg(F.avg((F.size("cells") == F.col("arity")).cast("int")).alias("even"), F.avg(is_data_row(F.col("cells")).cast("int")).alias("data"))
    joined = found.select("source_id").join(any_mapped, "source_id", "left").join(shares, "source_id", "left")
    return joined.select("source_id", F.coalesce((F.col("mapped") == 1) | ((F.col("even") >= 0.8) & (F.col("data") >= 0.5)), F.lit(False)).alias("data_table"))
