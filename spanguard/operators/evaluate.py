"""Scoring: span matching, confusion, precision / recall, parity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanguard.functions.bio import entity_chunks_sql
from spanguard.functions.text import ranks_below_sql, sql_let
from spanguard.schema import BIO_LABELS, IGNORE_LABEL

CATEGORIES = ["PII", "SECRET"]
_BLOCK = 64
_OUTCOME = "struct<gold:string,pred:string,pred_type:string>"


def match_outcomes(gold: str, pred: str, iou: float = 0.5) -> Column:
    """Outcomes of matching predictions (start, end, category, entity_type) to
    gold spans (start, end, label) of one text.

    First every gold span takes the first free prediction of its category that
    overlaps enough; then the rest take the first free one of any category or
    count as missed; predictions left over are spurious.
    """
    inter = "greatest(0, least(g.end, p.end) - greatest(g.start, p.start))"
    union = "(greatest(g.end, p.end) - least(g.start, p.start))"
    overlap = f"if({union} = 0, false, {inter} / {union} >= {iou})"

    # A prediction that overlaps enough starts before the gold span's end and is at most
    # 1/iou times as long: a range of the predictions sorted by start.
    places = "transform(sorted, p -> p.start)"
    first_start = f"transform({gold}, g -> cast(floor(g.start - greatest(0, g.end - g.start) / {iou}) - 1 as int))"
    if iou > 0:
        window = "slice(sorted, lo[gi] + 1, greatest(0, hi[gi] - lo[gi]))"
    else:
        window, first_start = "sorted", f"transform({gold}, g -> 0)"
    near = f"transform({gold}, (g, gi) -> array_sort(transform(filter({window}, p -> {overlap}), p -> p.pi)))"
    near = sql_let(
        "sorted",
        f"array_sort(transform({pred}, (p, pi) -> struct(p.start as start, pi as pi, p.end as end)))",
        sql_let(
            "lo",
            ranks_below_sql(places, first_start),
            sql_let("hi", ranks_below_sql(places, f"transform({gold}, g -> g.end)"), near),
        ),
    )

    # Predictions taken are bits of an array of longs.
    free_bits = f"array_repeat(0L, cast(ceil(size({pred}) / 64) as int))"
    is_free = "(shiftright({u}[pi div 64], cast(pi % 64 as int)) & 1) = 0"
    marked = (
        "transform(acc.used, (w, j) -> if(j = hit div 64, w | shiftleft(1L, cast(hit % 64 as int)), w))"
    )
    hits = "cast(array() as array<int>)"
    indices = f"if(size({gold}) > 0, sequence(0, size({gold}) - 1), {hits})"

    def walk(used: str, condition: str, todo: str) -> str:
        """For each gold span the first free prediction of its near ones, or -1, in blocks."""
        free = f"{condition}{is_free.format(u='acc.used')}"
        step = sql_let(
            "hit",
            f"if({todo}, coalesce(get(filter(near[gi], pi -> {free}), 0), -1), -1)",
            f"struct(if(hit >= 0, {marked}, acc.used) as used, array_append(acc.hits, hit) as hits)",
        )
        in_block = (
            f"aggregate(slice(gis, c, {_BLOCK}), struct(whole.used as used, {hits} as hits),"
            f" (acc, gi) -> {step})"
        )
        block = sql_let("b", in_block, "struct(b.used as used, array_append(whole.blocks, b.hits) as blocks)")
        folded = (
            f"aggregate(if(size(gis) > 0, sequence(1, size(gis), {_BLOCK}), {hits}),"
            f" struct({used} as used, cast(array() as array<array<int>>) as blocks), (whole, c) -> {block},"
            " whole -> struct(whole.used as used, flatten(whole.blocks) as hits))"
        )
        return sql_let("gis", indices, folded)

    first = walk(free_bits, f"{pred}[pi].category = {gold}[gi].label and ", "true")
    second = walk("m1.used", "", "m1.hits[gi] < 0")
    outcome = (
        f"transform({gold}, (g, gi) -> case"
        f" when m1.hits[gi] >= 0 then named_struct('gold', g.label, 'pred', g.label,"
        f" 'pred_type', {pred}[m1.hits[gi]].entity_type)"
        f" when m2.hits[gi] >= 0 then named_struct('gold', g.label,"
        f" 'pred', {pred}[m2.hits[gi]].category, 'pred_type', cast(null as string))"
        " else named_struct('gold', g.label, 'pred', 'NONE', 'pred_type', cast(null as string))"
        " end)"
    )
    spurious = (
        f"transform(filter({pred}, (p, pi) -> {is_free.format(u='m2.used')}),"
        " p -> named_struct('gold', 'NONE', 'pred', p.category, 'pred_type', cast(null as string)))"
    )
    matched = sql_let("near", near, sql_let("m1", first, sql_let("m2", second, f"concat({outcome}, {spurious})")))
    clean = "array(named_struct('gold', 'NONE', 'pred', 'NONE', 'pred_type', cast(null as string)))"
    return F.expr(
        f"if(size({gold}) = 0 and size({pred}) = 0, {clean}, {matched})"
    ).cast(f"array<{_OUTCOME}>")


def match_spans(df: DataFrame, *keys: str, iou: float = 0.5) -> DataFrame:
    """One row per outcome from columns `gold` and `pred`."""
    matched = df.withColumn("_o", match_outcomes("gold", "pred", iou))
    return matched.select(*keys, F.explode_outer("_o").alias("o")).select(*keys, "o.*")


def confusion(outcomes: DataFrame) -> DataFrame:
    """3 x 3 counts in long form, zeros included."""
    names = [*CATEGORIES, "NONE"]
    cells = [
        F.count_if((F.col("gold") == g) & (F.col("pred") == p)).alias(f"{g}|{p}")
        for g in names
        for p in names
    ]
    wide = outcomes.agg(*cells)
    long = wide.unpivot([], [F.col(f"`{c}`") for c in wide.columns], "cell", "n")
    return long.select(
        F.split_part("cell", F.lit("|"), F.lit(1)).alias("gold"),
        F.split_part("cell", F.lit("|"), F.lit(2)).alias("pred"),
        "n",
    )


def ratios(tp: Column, fp: Column, fn: Column, digits: int = 4) -> list[Column]:
    """Precision, recall and F1; 0 where undefined."""
    safe = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    p, r = safe(tp, tp + fp), safe(tp, tp + fn)
    f1 = F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))
    return [
        F.round(c, digits).alias(n) for c, n in ((p, "precision"), (r, "recall"), (f1, "f1"))
    ]


def prf(outcomes: DataFrame) -> DataFrame:
    """Scores per category and over both (micro)."""
    is_gold, is_pred = F.col("gold") == F.col("category"), F.col("pred") == F.col("category")
    counted = (
        outcomes.select(
            "gold", "pred", F.explode(F.array(*map(F.lit, CATEGORIES))).alias("category")
        )
        .groupBy("category")
        .agg(
            F.count_if(is_gold & is_pred).alias("tp"),
            F.count_if(is_pred & ~is_gold).alias("fp"),
            F.count_if(is_gold & ~is_pred).alias("fn"),
        )
    )
    total = counted.agg(
        F.lit("micro").alias("category"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
    )
    both = counted.unionByName(total)
    return both.select("*", *ratios(F.col("tp"), F.col("fp"), F.col("fn")))


def tp_type_breakdown(outcomes: DataFrame) -> DataFrame:
    """True positives per predicted entity type."""
    return (
        outcomes.filter(F.col("pred_type").isNotNull())
        .groupBy(F.col("pred_type").alias("entity_type"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _kept_tags(ids: str, truth: str) -> str:
    names = "array(" + ", ".join(f"'{b}'" for b in BIO_LABELS) + ")"
    return (
        f"transform(filter({ids}, (p, i) -> {truth}[i] <> {IGNORE_LABEL}), l -> {names}[l])"
    )


def entity_prf(df: DataFrame, true: str = "true", pred: str = "pred") -> DataFrame:
    """Entity-level scores of label-id arrays: an entity counts if type, start
    and end agree. Positions whose true label is ignored are dropped first.
    """
    chunked = (
        df.withColumn("_t", F.expr(_kept_tags(f"`{true}`", f"`{true}`")))
        .withColumn("_p", F.expr(_kept_tags(f"`{pred}`", f"`{true}`")))
        .withColumn("_tc", F.expr(entity_chunks_sql("_t")))
        .withColumn("_pc", F.expr(entity_chunks_sql("_p")))
    )
    sides = F.expr(
        "concat(transform(array_intersect(_tc, _pc), c -> struct(c.label as label, 'tp' as side)),"
        " transform(array_except(_pc, _tc), c -> struct(c.label as label, 'fp' as side)),"
        " transform(array_except(_tc, _pc), c -> struct(c.label as label, 'fn' as side)))"
    )
    counted = (
        chunked.select(F.explode_outer(sides).alias("s"))
        .filter(F.col("s.label").isNotNull())
        .groupBy(F.col("s.label").alias("label"))
        .agg(*[F.count_if(F.col("s.side") == c).alias(c) for c in ("tp", "fp", "fn")])
    )
    total = counted.agg(
        F.lit("micro").alias("label"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")],
    )
    both = counted.unionByName(total)
    return both.select("*", *ratios(F.col("tp"), F.col("fp"), F.col("fn")))


def label_distribution(df: DataFrame, labels: str = "labels") -> DataFrame:
    """Count and share of each label over positions that are not ignored."""
    names = F.array(*map(F.lit, BIO_LABELS))
    counted = (
        df.select(F.explode(labels).alias("l"))
        .filter(F.col("l").between(0, len(BIO_LABELS) - 1))
        .groupBy(F.get(names, F.col("l")).alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    share = F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0))) * 100  # at most 5 rows
    return counted.withColumn("pct", F.round(share, 1))


def parity(
    a: DataFrame, b: DataFrame, key: str, keys_equal: Sequence[str] = ("category", "start", "end")
) -> DataFrame:
    """Compare two backends per example: columns `scores` (token scores) and
    `findings`. Yields the worst logit difference, whether the best label
    differs anywhere, and whether the decoded spans differ.
    """
    joined = a.select(key, F.col("scores").alias("sa"), F.col("findings").alias("fa")).join(
        b.select(key, F.col("scores").alias("sb"), F.col("findings").alias("fb")), key
    )
    spans = lambda c: F.transform(
        F.col(c), lambda f: F.struct(*[f[k].alias(k) for k in keys_equal])
    )
    best = lambda c: F.transform(
        F.col(c), lambda t: F.array_position(t["logits"], F.array_max(t["logits"]))
    )
    diff = F.expr(
        "coalesce(array_max(flatten(zip_with(sa, sb, (x, y) ->"
        " zip_with(x.logits, y.logits, (l, r) -> abs(l - r))))), 0D)"
    )
    return joined.select(
        key,
        diff.alias("max_diff"),
        (best("sa") != best("sb")).alias("argmax_differs"),
        (spans("fa") != spans("fb")).alias("spans_differ"),
    )


def parity_summary(compared: DataFrame, tol: float = 1e-4) -> DataFrame:
    return compared.agg(
        F.count(F.lit(1)).alias("examples"),
        F.max("max_diff").alias("max_diff"),
        F.count_if("argmax_differs").alias("argmax_mismatches"),
        F.count_if("spans_differ").alias("span_mismatches"),
        (
            (F.max("max_diff") < tol)
            & (F.count_if("argmax_differs") == 0)
            & (F.count_if("spans_differ") == 0)
        ).alias("within_tolerance"),
    )
