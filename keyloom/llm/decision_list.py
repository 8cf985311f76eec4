"""Quality rules: a learned decision list over text statistics; DataFrame functions only.

Statistics of whole texts come from array and string functions, one row per document and no
shuffle. From labelled rows, sequential covering learns conjunctions of thresholds that mark
low quality: a rule grows by the condition with the highest FOIL gain on two thirds of the
rows, is pruned on the last third, is kept if it is precise there, and takes its rows away. The
list becomes ordered conditional expressions that Spark compiles.

Learning reads a bounded sample (``MOST_ROWS`` labelled rows by a hash of the id). Spark
reduces it to counts per cell of the threshold grid; the driver sees those counts only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.plans.workspace import stored

MOST_ROWS = 20_000
CUTS, MOST_RULES, MOST_CONDITIONS, PRECISION, LEAST_ROWS = 16, 12, 4, 0.98, 3

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_upper", "n_marks", "n_lines", "n_distinct_words"]


def with_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and COUNTS. Null is empty.

    Three-word windows are compared by 96 bits of hashes and sorted with their places, so the cost
    of a text of n words is n log n, however often it repeats itself.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), t.alias("t"))
    space = r"[\x20\x09-\x0D]+"
    d = d.select(
        "doc_id",
        F.filter(F.split("t", space), lambda w: w != "").alias("w"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.length("t").alias("n_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]+", ""))).alias("n_symbols"),
        F.length(F.regexp_replace("t", r"[^A-Z]+", "")).alias("n_upper"),
        (F.length("t") - F.length(F.regexp_replace("t", r"[!?]+", ""))).alias("n_marks"),
    )
    windows = F.expr("if(size(w) < 3, array(), transform(sequence(0, size(w) - 3), i -> struct(xxhash64(w[i], w[i + 1], w[i + 2]) as h, hash(w[i], w[i + 1], w[i + 2]) as g, i as i)))")
    d = d.withColumn("s", F.sort_array(windows))
    twice = F.expr("filter(transform(s, (x, k) -> if((k > 0 and s[k - 1].h = x.h and s[k - 1].g = x.g) or (k + 1 < size(s) and s[k + 1].h = x.h and s[k + 1].g = x.g), x.i, -1)), i -> i >= 0)")
    d = d.withColumn("at", F.sort_array(twice))
    covered = F.expr("aggregate(transform(at, (p, k) -> if(k = 0, 3, least(3, p - at[k - 1]))), 0, (a, x) -> a + x)")
    return d.select(
        "doc_id",
        *[
            c.cast("long").alias(name)
            for name, c in {
                "n_words": F.size("w"),
                "word_chars": F.length(F.array_join("w", "")),
                "n_symbols": F.col("n_symbols"),
                "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
                "n_repeat_words": covered,
                "n_chars": F.col("n_chars"),
                "n_upper": F.col("n_upper"),
                "n_marks": F.col("n_marks"),
                "n_lines": F.size("lines"),
                "n_distinct_words": F.size(F.array_distinct("w")),
            }.items()
        ],
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> dict[str, Column]:
    """The values that rules may test; each is defined for empty texts."""

    def per(a: str, b: str) -> Column:
        return F.col(a) / F.greatest(F.col(b), F.lit(1))

    return {
        "symbols_per_word": per("n_symbols", "n_words"),
        "upper_share": per("n_upper", "word_chars"),
        "marks_per_word": per("n_marks", "n_words"),
        "duplicate_line_share": per("n_dup_lines", "n_lines"),
        "repeated_word_share": per("n_repeat_words", "n_words"),
        "distinct_word_share": per("n_distinct_words", "n_words"),
        "word_length": per("word_chars", "n_words"),
        "words": F.col("n_words").cast("double"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        x = features()[self.feature]
        return x > self.cut if self.above else x <= self.cut


@dataclass(frozen=True)
class Rule:
    """A conjunction that marks low quality, with its rows in the pruning third."""

    conditions: tuple[Condition, ...]
    right: int
    wrong: int

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out


Cell = tuple[tuple[int, ...], int, int, int]  # bins, label (1: low quality), third, rows


def learned(cells: list[Cell], names: list[str], cuts: list[list[float]], *, most_rules: int = MOST_RULES, most_conditions: int = MOST_CONDITIONS, precision: float = PRECISION, least_rows: int = LEAST_ROWS) -> list[Rule]:
    """Sequential covering on counts. Bin b of a feature holds x with cuts[b - 1] < x <= cuts[b]."""

    def holds(test: tuple[int, bool, int], cell: Cell) -> bool:
        k, above, b = test
        return (cell[0][k] > b) == above

    def tally(some: list[Cell]) -> tuple[int, int]:
        right = sum(c[3] for c in some if c[1])
        return right, sum(c[3] for c in some) - right

    rules: list[Rule] = []
    passed_over: list[list] = []  # what rules that were not precise enough found is not looked for again
    for _ in range(2 * most_rules):
        growing = [c for c in cells if c[2] != 2 and not (c[1] and any(all(holds(t, c) for t in r) for r in passed_over))]
        tests = []
        while len(tests) < most_conditions:
            p0, n0 = tally(growing)
            if not p0 or not n0:
                break
            best, gain = None, 1e-9
            for k in range(len(names)):
                size = len(cuts[k]) + 1
                pos, neg = [0] * size, [0] * size
                for bins, label, _, rows in growing:
                    (pos if label else neg)[bins[k]] += rows
                p = n = 0
                for b in range(size - 1):
                    p, n = p + pos[b], n + neg[b]
                    for above, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
                        if pp >= least_rows:
                            g = pp * (math.log2(pp / (pp + nn)) - math.log2(p0 / (p0 + n0)))
                            if g > gain:
                                best, gain = (k, above, b), g
            if best is None:
                break
            tests.append(best)
            growing = [c for c in growing if holds(best, c)]
        if not tests or len(rules) == most_rules:
            break
        pruning = [c for c in cells if c[2] == 2]

        def worth(some: list) -> float:
            p, n = tally([c for c in pruning if all(holds(t, c) for t in some)])  # noqa: B023
            return (p - n) / (p + n) if p + n else -1.0

        full = list(tests)
        while len(tests) > 1 and worth(tests[:-1]) >= worth(tests):
            tests.pop()
        for tests in (tests, full):  # noqa: B020  the shorter one first, if it is precise enough
            right, wrong = tally([c for c in pruning if all(holds(t, c) for t in tests)])
            precise = right >= least_rows and right >= precision * (right + wrong)
            if precise:
                break
        if not precise:
            passed_over.append(tests)
            continue
        rules.append(Rule(tuple(Condition(names[k], above, cuts[k][b]) for k, above, b in tests), right, wrong))
        cells = [c for c in cells if not all(holds(t, c) for t in tests)]
    return rules


def fit(counts: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", most_rows: int = MOST_ROWS) -> list[Rule]:
    """Rules from the counts of documents and their labels (0: low quality).

    Rows that fail the base rule teach nothing here. Without labelled rows of both kinds the
    list is empty and keeps everything.
    """
    own = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    own = own.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    values = features()
    names = list(values)
    rows = counts.filter(~base_failed()).join(F.broadcast(own), "doc_id").select((1 - F.col("label")).alias("low"), F.pmod(F.xxhash64(F.lit("third"), "doc_id"), F.lit(3)).alias("third"), *[v.alias(k) for k, v in values.items()])
    rows = stored(rows, "labelled")
    steps = [i / CUTS for i in range(CUTS + 1)]
    points = rows.agg(*[F.percentile(F.when(F.col("low") == 1, F.col(k)) if low else F.col(k), F.array(*map(F.lit, steps))).alias(f"{k}_{low}") for k in names for low in (0, 1)]).first()
    cuts = [sorted({float(x) for low in (0, 1) for x in points[f"{k}_{low}"] or []}) for k in names]
    bins = [sum(((F.col(k) > c).cast("int") for c in own_cuts), F.lit(0)).alias(f"b{i}") for i, (k, own_cuts) in enumerate(zip(names, cuts, strict=True))]
    cells = rows.select("low", "third", *bins).groupBy("low", "third", *[f"b{i}" for i in range(len(names))]).count().collect()
    grid = sorted((tuple(r[f"b{i}"] for i in range(len(names))), r["low"], r["third"], r["count"]) for r in cells)
    return learned(grid, names, cuts)


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: false for the first rule that holds, else true."""
    out = None
    for r in rules:
        out = F.when(r.column(), F.lit(False)) if out is None else out.when(r.column(), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def quality_rules(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, COUNTS, base_failed, kept for every row of ``docs``.

    Null text is empty, and empty texts fail the base rule. Repeated rows are judged alike, null
    ids stay, an empty input gives no rows; other columns are ignored, whatever their names.
    """
    counts = stored(with_counts(docs, id_col=id_col, text_col=text_col), "counts")
    rules = fit(counts, labels)
    return counts.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: the statistics and the verdict for every document."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
