"""Quality rules: word and line statistics, and cross-document line frequency; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from nodewell.llm.common import SPACE, SPACE_CLASS, fresh, join_few, materialise

SYMBOLS = "#*$%&|<>"


def let(value: Column, body) -> Column:
    """body(value) with value worked out once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Array of the words [^\\x20\\x09-\\x0D]+ of a text that is not null."""
    return let(
        F.btrim(text, F.lit(SPACE)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_CLASS + "+")),
    )


def repeated_words(words: Column, width: int) -> Column:
    """Number of words in windows of width words found twice or more in the array; windows are compared by 64-bit hash."""

    def covered(windows: Column) -> Column:
        def spans(s: Column) -> Column:
            twice = F.filter(
                s, lambda e, i: F.coalesce(e["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(e["h"] == F.get(s, i + 1)["h"], F.lit(False))
            )
            at = F.array_sort(F.transform(twice, lambda e: e["i"]))
            return let(
                at,
                lambda p: F.aggregate(
                    F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width)))),
                    F.lit(0),
                    lambda a, x: a + x,
                ),
            )

        ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(ordered, spans)).otherwise(F.lit(0))

    def windows_of(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(hashes) - (width - 1)), lambda i: F.xxhash64(F.slice(hashes, i, F.lit(width))))

    return F.when(
        F.size(words) > width,
        let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows_of(h), covered)),
    ).otherwise(F.lit(0))


def text_statistics(text: Column, window: int = 8) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long) of one text; null counts as empty."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    numbers = let(words_of(whole), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w, window).alias("r")))

    def without(chars: str) -> Column:
        return F.length(F.translate(whole, chars, ""))

    # One use of numbers: it is most of the work, and a generator works each use out.
    return let(
        numbers,
        lambda x: F.struct(
            x["n"].cast("bigint").alias("n_words"),
            without(SPACE).cast("bigint").alias("word_chars"),
            (F.length(whole) - without(SYMBOLS)).cast("bigint").alias("n_symbols"),
            let(lines, lambda y: F.size(y) - F.size(F.array_distinct(y))).cast("bigint").alias("n_dup_lines"),
            x["r"].cast("bigint").alias("n_repeat_words"),
        ),
    )


def normalised_line(line: Column) -> Column:
    """Lower case and single spaces: lines that differ only in these count as one."""
    return F.regexp_replace(F.btrim(F.lower(line), F.lit(SPACE)), SPACE_CLASS + "+", " ")


def _text_lines(df: DataFrame, text: str, host: str) -> DataFrame:
    """One row per document: host, th and tb (hash and bytes of the text), lines (lh, hash of the line, and words of those with a word)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.transform(
        F.filter(F.transform(F.split(whole, "\n"), normalised_line), lambda x: x != ""),
        lambda x: F.struct(F.xxhash64(x).alias("lh"), (F.length(x) - F.length(F.translate(x, " ", "")) + 1).alias("words")),
    )
    return df.select(F.coalesce(F.col(host), F.lit("")).alias("host"), F.xxhash64(whole).alias("th"), F.octet_length(whole).alias("tb"), lines.alias("lines"))


def _line_rows(texts: DataFrame) -> DataFrame:
    """One row per line of _text_lines: host, th, tb, pos, lh, words."""
    return texts.select("host", "th", "tb", F.posexplode("lines").alias("pos", "y")).select("host", "th", "tb", "pos", "y.lh", "y.words")


def frequent_lines(df: DataFrame, text: str = "text", host: str = "source", min_docs: int = 20, max_share: float = 0.05) -> DataFrame:
    """Lines above the limits: (host, lh, docs) found in more than min_docs documents and more than max_share of the host's.

    Documents are the distinct texts of a host: exact copies have one vote, any other text a vote of its own, near copies
    too. Counts are made in the tasks first, so a line that every document holds is no hot key.
    """
    return _frequent(_text_lines(df, text, host), min_docs, max_share)


def _frequent(texts: DataFrame, min_docs: int = 20, max_share: float = 0.05) -> DataFrame:
    counts = _line_rows(texts).groupBy("host", "lh").agg(F.count_distinct("th").alias("docs")).where(F.col("docs") > min_docs)
    hosts = texts.groupBy("host").agg(F.count_distinct("th").alias("host_docs"))
    return counts.join(hosts, "host").where(F.col("docs") > max_share * F.col("host_docs")).select("host", "lh", "docs")


def removed_lines(df: DataFrame, text: str = "text", host: str = "source", **limits) -> DataFrame:
    """(host, th, tb, removed_words, removed): per text with frequent lines, their words and the array of their hashes."""
    # Written once, as 64-bit hashes: splitting and normalising the lines is most of the work.
    texts = materialise(_text_lines(df, text, host), "text-lines")
    frequent = materialise(_frequent(texts, **limits).select("host", "lh"), "frequent-lines")
    found = join_few(_line_rows(texts), frequent, ["host", "lh"], "inner")
    # Equal texts have equal rows: one of each place counts.
    once = found.groupBy("host", "th", "tb", "pos").agg(F.first("lh").alias("lh"), F.first("words").alias("words"))
    return once.groupBy("host", "th", "tb").agg(F.sum("words").alias("removed_words"), F.collect_set("lh").alias("removed"))


def judge(
    df: DataFrame, text: str = "text", host: str = "source", min_words: int = 20, max_repeat_percent: int = 30, min_left_percent: int = 50, name: str = "quality", **limits
) -> DataFrame:
    """All rows and columns of df with a struct column `quality` (or another name): the text statistics, removed_words,
    removed (hashes of the lines above the limits), base_failed and kept.

    base_failed: fewer than min_words words, or more than max_repeat_percent of them in repeated windows.
    A document is depleted, and so not kept, if the lines above the limits leave it less than min_left_percent
    of its words. A column of that name is replaced. Null text: empty, so base_failed. Null host: a host of its
    own. Copies of a text on one host get one verdict. Texts of any length are taken whole; a task holds one at a time. A line
    at a limit is kept: it must be above both. The lines are counted in one aggregation, and only the lines above
    the limits are joined back, of lines and texts that a Bloom filter passes.
    """
    df = df.drop(name)
    host_, th, tb, gone_, lines, stats = (fresh(df, c) for c in ("_nw_host", "_nw_th", "_nw_tb", "_nw_gone", "_nw_lines", "_nw_s"))
    whole = F.coalesce(F.col(text), F.lit(""))
    keyed = df.withColumns({host_: F.coalesce(F.col(host), F.lit("")), th: F.xxhash64(whole), tb: F.octet_length(whole)})
    gone = removed_lines(df, text, host, **limits).toDF(host_, th, tb, gone_, lines)
    joined = join_few(keyed, materialise(gone, "removed-lines"), [host_, th, tb])
    # After the join, whose two ways would each work them out; a generator, as a projection would be repeated per use.
    joined = joined.select("*", F.inline(F.array(F.struct(text_statistics(F.col(text)).alias(stats)))))
    n, r = F.col(f"{stats}.n_words"), F.coalesce(F.col(gone_), F.lit(0))
    failed = (n < min_words) | (100 * F.col(f"{stats}.n_repeat_words") > max_repeat_percent * n)
    left = n - r
    verdict = F.struct(
        f"{stats}.*",
        r.cast("bigint").alias("removed_words"),
        F.coalesce(lines, F.array().cast("array<bigint>")).alias("removed"),
        failed.alias("base_failed"),
        (~failed & (100 * left >= min_left_percent * n)).alias("kept"),
    )
    return joined.select(*df.columns, verdict.alias(name))


def clean(df: DataFrame, text: str = "text", host: str = "source", **options) -> DataFrame:
    """The kept rows of df, their text without the lines above the limits. Texts without such lines stay byte for byte."""
    name = fresh(df, "quality")
    judged = judge(df, text, host, name=name, **options).where(F.col(f"{name}.kept"))
    left = F.array_join(
        F.filter(F.split(F.col(text), "\n"), lambda x: ~F.coalesce(F.array_contains(F.col(f"{name}.removed"), F.xxhash64(normalised_line(x))), F.lit(False))),
        "\n",
    )
    out = judged.withColumn(text, F.when(F.size(f"{name}.removed") > 0, left).otherwise(F.col(text)))
    return out.select(*df.columns)
