"""Quality rules: document statistics in Spark expressions, and a decision list learned from labelled ones.

Sequential covering grows one rule after the other as a conjunction of thresholds, prunes it on rows it wasn't grown on,
and goes on with the rows no rule covers. All counts are small grouped aggregations over binned statistics; the list
comes out as ordered Spark conditions, so judging runs without Python.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, words, written

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Shares that rules are learned on, by name, over the counts of `statistics`.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
}
MAX_TRAIN_ROWS = 12_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_distinct_words")


def _count_of(c: Column, chars: str) -> Column:
    """How many of the given characters a text has."""
    bare = c
    for x in chars:
        bare = F.replace(bare, F.lit(x), F.lit(""))
    return F.length(c) - F.length(bare)


def _without(c: Column, runs: str) -> Column:
    """How many characters a text loses with all matches of a pattern."""
    return F.length(c) - F.length(F.regexp_replace(c, runs, ""))


def _windows(df: DataFrame) -> DataFrame:
    """Adds __h, 64-bit hashes of all windows of eight words of __words, by pairing hashes of one, two and four words with
    those that far behind; each step is one pass over the array."""
    df = df.withColumn("__h1", F.transform("__words", lambda w: F.xxhash64(w)))
    for n in (1, 2, 4):
        behind = F.slice(f"__h{n}", F.lit(n + 1), F.size("__words"))
        df = df.withColumn(f"__h{2 * n}", F.zip_with(f"__h{n}", behind, lambda x, y: F.xxhash64(x, y)))
    return df.withColumn("__h", F.when(F.size("__words") >= WINDOW, F.slice("__h8", F.lit(1), F.size("__words") - (WINDOW - 1))))


def _repeat_words(df: DataFrame) -> DataFrame:
    """Adds __repeats from __words: words inside windows that are found twice or more; only texts in which hashes repeat
    are sorted to find out where."""
    df = _windows(df)
    again = F.size(F.array_distinct("__h")) < F.size("__h")
    df = df.withColumn("__s", F.when(again, F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda i: F.coalesce(F.get("__s", i)["h"] == F.get("__s", i + 1)["h"], F.lit(False))
    at = F.array_sort(F.transform(F.filter("__s", lambda x, i: same(i) | same(i - 1)), lambda x: x["i"]))
    df = df.withColumn("__at", F.when(F.col("__s").isNotNull(), at))
    gaps = F.zip_with("__at", F.slice("__at", F.lit(2), F.size("__at")), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    return df.withColumn("__repeats", F.coalesce(F.when(F.col("__at").isNotNull(), F.aggregate(gaps, F.lit(0), lambda s, x: s + x)), F.lit(0)))


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` without the text, with the counts of every whole text as longs (see COUNTS). Null texts have no words.

    Words are runs of anything but space and tab to carriage return. n_dup_lines: lines with a word that equal an
    earlier line; n_repeat_words: words in 8-word windows found at least twice in the text. Existing columns with the
    names of counts give way to the new ones.
    """
    keep = [c for c in docs.columns if c != text_col and c not in COUNTS]
    df = docs.select(*(F.col(f"`{c}`") for c in keep), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"))
    df = df.withColumn("__words", words(F.col("__text")))
    df = df.withColumn("__lines", F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = _repeat_words(df)
    text = F.col("__text")
    made = {
        "n_words": F.size("__words"),
        "word_chars": F.length(F.array_join("__words", "")),
        "n_symbols": _count_of(text, SYMBOLS),
        "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
        "n_repeat_words": F.col("__repeats"),
        "n_lines": F.size("__lines"),
        "n_upper": _without(text, "[A-Z]+"),
        "n_digits": _without(text, "[0-9]+"),
        "n_distinct_words": F.size(F.array_distinct("__words")),
    }
    return df.select(*(F.col(f"`{c}`") for c in keep), *(x.cast("long").alias(n) for n, x in made.items()))


def base_failed() -> Column:
    """The fixed rule: under 20 words, or over 30 % of the words in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    cut: float

    def column(self) -> Column:
        x = F.expr(FEATURES[self.feature])
        return x >= F.lit(self.cut) if self.at_least else x < F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.cut:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Ordered conjunctions that reject; what none of them covers is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def rejects(self) -> Column:
        out = F.lit(False)
        for rule in reversed(self.rules):
            fits = F.lit(True)
            for c in rule:
                fits = fits & c.column()
            out = F.when(fits, F.lit(True)).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(map(str, r)) for r in self.rules) + "\nelse keep"


def labelled(docs: DataFrame, labels: DataFrame, bad: str = "quality = 0", max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """Statistics and label (y: 1 for bad) of at most `max_rows` labelled documents, those with the least hash of their id
    (rows that repeat an id count too; beyond the bound each id keeps its largest text)."""
    chosen = labels.select(F.col("doc_id").alias("__id"), F.expr(f"cast({bad} as int)").alias("y")).where("__id is not null and y is not null")
    chosen = chosen.dropDuplicates(["__id"]).orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    rows = bounded(docs.select(F.col("doc_id").alias("__id"), "text").join(F.broadcast(chosen), "__id"), "__id", "text", max_rows)  # the broadcast too is bounded by max_rows
    return written(statistics(rows), "labelled")


def learn(rows: DataFrame, cuts: int = 24, max_rules: int = 8, max_conditions: int = 3, min_precision: float = 0.9, min_rows: int = 5) -> DecisionList:
    """Sequential covering over labelled statistics (y = 1 is what rules reject).

    A rule grows by the condition of the largest information gain, loses the last conditions that don't help on the
    third of the rows kept for pruning, and is taken if its precision is at least `min_precision`. Rows with no label of
    either kind, or none at all, give an empty list, which keeps everything.
    """
    names = list(FEATURES)
    quantiles = [i / cuts for i in range(1, cuts)]
    got = rows.agg(*(F.expr(f"percentile_approx({FEATURES[n]}, array({', '.join(map(str, quantiles))}), 2000)").alias(n) for n in names)).first()
    more = rows.where("y = 1").agg(*(F.expr(f"percentile_approx({FEATURES[n]}, array({', '.join(map(str, quantiles))}), 2000)").alias(n) for n in names)).first()
    points = {n: sorted({x for g in (got, more) for x in (g[n] or [])}) for n in names}

    def bin_of(name: str) -> Column:
        """How many cut points a value reaches."""
        cuts_ = F.array(*map(F.lit, points[name])).cast("array<double>")
        return F.size(F.filter(cuts_, lambda c: F.expr(FEATURES[name]) >= c))

    bins = [bin_of(n).alias(f"b{i}") for i, n in enumerate(names)]
    left = kept = written(rows.select("y", (F.pmod(F.xxhash64("__id"), F.lit(3)) == 0).alias("prune"), *bins), "binned").cache()
    stack = f"stack({len(names)}, " + ", ".join(f"{i}, b{i}" for i in range(len(names))) + ") as (f, b)"

    def counts(df: DataFrame) -> tuple[int, int, dict]:
        """All bad and good rows, and those in each bin of each feature."""
        table: dict = {}
        for x in df.selectExpr("y", stack).groupBy("f", "b", "y").count().collect():
            table.setdefault(x["f"], {}).setdefault(x["b"], [0, 0])[1 - x["y"]] += x["count"]
        bad, good = (sum(v[k] for v in table.get(0, {}).values()) for k in (0, 1))
        return bad, good, table

    def conjunction(rule) -> Column:
        out = F.lit(True)
        for f, up, b in rule:
            out = out & (F.col(f"b{f}") >= b if up else F.col(f"b{f}") < b)
        return out

    rules = []
    for _ in range(max_rules):
        rule: list[tuple[int, bool, int]] = []
        while len(rule) < max_conditions:
            bad, good, table = counts(left.where(~F.col("prune")).where(conjunction(rule)))
            if not bad or not good:
                break
            best = (0.0, None)
            for f, by_bin in sorted(table.items()):
                p = n = 0
                for b in range(len(points[names[f]]), 0, -1):  # from the top: at least cut b
                    p, n = p + by_bin.get(b, (0, 0))[0], n + by_bin.get(b, (0, 0))[1]
                    for up, pp, nn in ((True, p, n), (False, bad - p, good - n)):
                        if pp >= min_rows:
                            gain = pp * (math.log2(pp / (pp + nn)) - math.log2(bad / (bad + good)))
                            best = max(best, (gain, (f, up, b)), key=lambda x: x[0])
            if best[1] is None or best[0] <= 1e-9:
                break
            rule.append(best[1])
        if not rule:
            break
        tests = [F.sum((conjunction(rule[: i + 1]) & (F.col("y") == k)).cast("int")).alias(f"c{i}_{k}") for i in range(len(rule)) for k in (0, 1)]
        got = left.where("prune").agg(*tests).first()
        value = lambda i: ((got[f"c{i}_1"] or 0) - (got[f"c{i}_0"] or 0)) / max(1, (got[f"c{i}_1"] or 0) + (got[f"c{i}_0"] or 0))
        keep = max(range(len(rule)), key=lambda i: (value(i), -i))
        hits, misses = got[f"c{keep}_1"] or 0, got[f"c{keep}_0"] or 0
        if hits < min_rows or hits < min_precision * (hits + misses):
            break
        rule = rule[: keep + 1]
        rules.append(tuple(Condition(names[f], up, points[names[f]][b - 1]) for f, up, b in rule))
        left = left.where(~conjunction(rule))
    kept.unpersist()
    return DecisionList(tuple(rules))


def judge(docs: DataFrame, rules: DecisionList, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed and kept (false if base_failed, else the list's verdict) of every row.

    Null ids stay; null or empty texts have no words and fail; rows with the same id are judged one by one; an empty
    table gives no rows; other columns are not read.
    """
    s = statistics(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")))
    s = s.withColumn("base_failed", base_failed())
    return s.select("doc_id", *COUNTS[:5], "base_failed", (~F.col("base_failed") & ~rules.rejects()).alias("kept"))


def keep_good(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """The rows of `docs`, with all their columns as they are, that `judge` keeps."""
    plain = [F.col(f"`{c}`").alias(f"__col{i}") for i, c in enumerate(docs.columns)]
    s = statistics(docs.select(*plain, F.col("text").alias("__judged")), "__judged")
    # The row number, never negative, keeps the filter above the counts: pushed below, it would repeat them inside each other.
    keep = ~base_failed() & ~rules.rejects() & (F.monotonically_increasing_id() >= 0)
    s = s.withColumn("__keep", keep).where("__keep")
    return s.select(*(F.col(f"__col{i}").alias(c) for i, c in enumerate(docs.columns)))
