"""Learned decision lists over text statistics.

Statistics of whole texts are plain column expressions. A bounded sample of labelled documents
teaches an ordered list of rules, each a conjunction of thresholds: sequential covering grows a
conjunction on two thirds of the sample, prunes it on the rest, keeps it if it is precise there and
goes on with the documents it does not cover. The list becomes one ordered `when` expression.

Defined cases: a null or empty text has no words, all statistics 0 and fails the base rule; labels
that are null or without a document teach nothing; without labels of both kinds the list is empty
and every document passes it; repeated rows are judged alike, each on its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, pieces, shift_left, shift_right, words_of

WINDOW = 5
SYMBOLS = "[#*$%&|<>]"
#: Statistics the rules may test; ratios to the number of words (or lines), so that length alone decides little.
FEATURES = ["n_words", "mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "bang_ratio", "digit_ratio", "distinct_ratio", "stop_ratio"]
TRAIN_ROWS = 6000
THRESHOLDS = 24


def repeat_words(words: Column) -> Column:
    """Words that stand in a 5-word window found twice or more in the array.

    Window hashes are sorted together with their positions in one array of longs: the low bits hold
    the position, the rest the hash; neighbours are compared by their full 64-bit hashes.
    """
    n = F.size(words)
    windows = F.when(
        n >= WINDOW,
        F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(hashes: Column) -> Column:
        bits = F.length(F.bin(F.size(hashes).cast("bigint")))
        mask = shift_left(F.lit(1).cast("bigint"), bits) - 1
        packed = F.array_sort(F.transform(hashes, lambda h, i: shift_left(h, bits).bitwiseOR(i.cast("bigint"))))

        def at(x: Column) -> Column:
            return F.get(hashes, x.bitwiseAND(mask).cast("int"))

        def same(x: Column, y: Column) -> Column:
            return F.coalesce(
                F.when(shift_right(x, bits) == shift_right(y, bits), at(x) == at(y)).otherwise(False), F.lit(False)
            )

        def positions(p: Column) -> Column:
            found = F.filter(p, lambda x, k: same(x, F.get(p, k - 1)) | same(x, F.get(p, k + 1)))
            return F.array_sort(F.transform(found, lambda x: x.bitwiseAND(mask)))

        def total(d: Column) -> Column:
            steps = F.transform(d, lambda x, k: F.least(F.lit(WINDOW).cast("bigint"), F.coalesce(F.get(d, k + 1) - x, F.lit(WINDOW).cast("bigint"))))
            return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)

        return let(packed, lambda p: let(positions(p), total))

    # most texts repeat no window at all, which a distinct count tells without sorting
    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("bigint")))


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a struct column `_stats` of counts over whole texts."""
    body = F.coalesce(F.col(text), F.lit(""))

    def stats(cut: Column) -> Column:
        def with_words(words: Column) -> Column:
            lines = F.filter(F.split(body, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
            return F.struct(
                F.size(words).cast("bigint").alias("n_words"),
                (F.length(body) - F.size(cut) + 1).cast("bigint").alias("word_chars"),
                F.regexp_count(body, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
                let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
                repeat_words(words).alias("n_repeat_words"),
                let(lines, F.size).cast("bigint").alias("n_lines"),
                F.regexp_count(body, F.lit("\\p{Lu}")).cast("bigint").alias("n_upper"),
                F.regexp_count(body, F.lit("!")).cast("bigint").alias("n_bangs"),
                F.regexp_count(body, F.lit("[0-9]")).cast("bigint").alias("n_digits"),
                F.size(F.array_distinct(words)).cast("bigint").alias("n_distinct"),
                F.size(F.filter(words, lambda w: F.length(w) <= 3)).cast("bigint").alias("n_short"),
            )

        return let(words_of(cut), with_words)

    return docs.withColumn("_stats", let(pieces(body), stats))


def features(stats: str = "_stats") -> dict[str, Column]:
    """The tested values by name."""
    s = lambda k: F.col(f"{stats}.{k}").cast("double")
    words, lines, chars = F.greatest(s("n_words"), F.lit(1.0)), F.greatest(s("n_lines"), F.lit(1.0)), F.greatest(s("word_chars"), F.lit(1.0))
    return {
        "n_words": s("n_words"), "mean_word": s("word_chars") / words, "symbol_ratio": s("n_symbols") / words,
        "dup_line_ratio": s("n_dup_lines") / lines, "repeat_ratio": s("n_repeat_words") / words, "upper_ratio": s("n_upper") / chars,
        "bang_ratio": s("n_bangs") / words, "digit_ratio": s("n_digits") / chars, "distinct_ratio": s("n_distinct") / words,
        "stop_ratio": s("n_short") / words,
    }


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    threshold: float

    def column(self, values: dict[str, Column]) -> Column:
        x = values[self.feature]
        return x > F.lit(self.threshold) if self.above else x <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Literal, ...]


def _literals(rows: list[dict[str, float]]) -> dict[Literal, int]:
    """Every candidate literal with the set of rows it covers, as bits of an integer."""
    found = {}
    for name in FEATURES:
        values = [r[name] for r in rows]
        order = sorted(set(values))
        cuts = {(order[i] + order[i + 1]) / 2 for i in range(len(order) - 1)}
        if len(cuts) > THRESHOLDS:
            ranked = sorted(values)
            cuts = {ranked[len(ranked) * q // (THRESHOLDS + 1)] for q in range(1, THRESHOLDS + 1)}
        for cut in sorted(cuts):
            above = sum(1 << i for i, v in enumerate(values) if v > cut)
            found[Literal(name, True, cut)] = above
            found[Literal(name, False, cut)] = ((1 << len(values)) - 1) ^ above
    return found


def learn(rows: list[dict[str, float]], bad: list[bool], min_precision: float = 0.9, max_rules: int = 12, max_literals: int = 4) -> list[Rule]:
    """Ordered rules that reject; rows are fixed samples, every third one prunes.

    A rule is kept if at least min_precision of what it newly covers in both parts is bad.
    """
    if not any(bad) or all(bad):
        return []
    literals = _literals(rows)
    full = (1 << len(rows)) - 1
    prune_set = sum(1 << i for i in range(0, len(rows), 3))
    positive = sum(1 << i for i, b in enumerate(bad) if b)
    rules: list[Rule] = []
    left = full

    def counts(cover: int, part: int) -> tuple[int, int]:
        inside = cover & part
        return (inside & positive).bit_count(), (inside & ~positive).bit_count()

    def value(cover: int, part: int) -> float:
        p, n = counts(cover, part)
        return (p + 1) / (p + n + 2)

    while len(rules) < max_rules:
        grow, prune = left & ~prune_set, left & prune_set
        rule: list[Literal] = []
        cover = full
        while len(rule) < max_literals:
            p0, n0 = counts(cover, grow)
            if not p0 or not n0:
                break
            best, gain = None, 0.0
            for lit, rows_of in literals.items():
                p1, n1 = counts(cover & rows_of, grow)
                if p1 >= 3 and n0 - n1:
                    g = p1 * ((p1 + 1) / (p1 + n1 + 2) - (p0 + 1) / (p0 + n0 + 2))
                    if g > gain:
                        best, gain = lit, g
            if best is None:
                break
            rule.append(best)
            cover &= literals[best]
        while len(rule) > 1:  # drop last literals while the pruning part does not suffer
            shorter = full
            for lit in rule[:-1]:
                shorter &= literals[lit]
            if value(shorter, prune) < value(cover, prune):
                break
            rule.pop()
            cover = shorter
        p, n = counts(cover, left)
        pp, pn = counts(cover, prune)
        if not rule or p < 3 or p < min_precision * (p + n) or pp < min_precision * (pp + pn):
            break
        rules.append(tuple(rule))
        left &= ~cover
    return rules


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> tuple[list[dict[str, float]], list[bool]]:
    """Statistics of at most `limit` labelled documents, chosen by the hash of their id."""
    sample = (
        labels.select("doc_id", "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(limit)
    )
    known = text_statistics(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"))
    got = known.select("doc_id", "quality", *[v.alias(k) for k, v in features().items()]).collect()
    got = sorted(got, key=lambda r: (r["doc_id"] * 2654435761 % 2**32, r["doc_id"], r["quality"]))
    return [{k: r[k] for k in FEATURES} for r in got], [r["quality"] == 0 for r in got]


def verdict(rules: list[Rule], stats: str = "_stats") -> Column:
    """Number of the first rule that rejects, in order, or null."""
    values = features(stats)
    out = F.lit(None).cast("int")
    for k in range(len(rules) - 1, -1, -1):
        test = F.lit(True)
        for lit in rules[k]:
            test = test & lit.column(values)
        out = F.when(test, F.lit(k)).otherwise(out)
    return out


def judge(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """(row, stats, base_failed, rule, kept): docs' columns as one struct, base counts, the first rejecting rule (null: none)."""
    d = text_statistics(docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("_text")), "_text").drop("_text")
    n = F.col("_stats.n_words")
    failed = (n < 10) | (100 * F.col("_stats.n_repeat_words") > 20 * n)
    judged = d.select("row", F.col("_stats").alias("stats"), failed.alias("base_failed"), verdict(rules).alias("rule"))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
