"""Per-unit feature summaries from long tables.

Gene and residue tables are small fixed dimensions (parameters with defaults);
windows here run inside one unit after aggregation to one row per (unit,
feature), so a window partition never exceeds the feature vocabulary.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import fixed_values as fv
from ..functions.lineage import settle
from ..functions.scalars import cascade, fixed3, safe_ratio
from .contracts import enforce, key_text
from .ordered import exact_quantiles, with_average_rank
from .rankstats import zscore


def round4(value: Column | str) -> Column:
    """Four digits; the inner round removes summation noise before a tie is decided."""
    return F.round(F.round(value, 12), 4)


def set_dim(spark: SparkSession, sets: Mapping[str, Sequence[str]], name: str = "set_name") -> DataFrame:
    """(name, gene, set_size) of a small fixed mapping."""
    rows = [(s, g, len(genes)) for s, genes in sets.items() for g in genes]
    return spark.createDataFrame(rows, f"{name} string, gene string, set_size int")


# ------------------------------------------------------------- repertoires


_LETTERS = len(fv.AMINO_ACIDS)
_CODE = np.full(256, -1, dtype=np.int64)
_CODE[list(fv.AMINO_ACIDS.encode())] = np.arange(_LETTERS)
_TRIPLETS = pa.array(["".join(x) for x in itertools.product(fv.AMINO_ACIDS, repeat=3)])


def _count_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Valid windows of a batch of sequences, one row per (sample, triplet).

    Letters of the alphabet are single bytes, so valid windows of bytes and of characters are the same.
    """
    for batch in batches:
        sample = batch.column(0).dictionary_encode(null_encoding="encode")
        of_row = sample.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        text = batch.column(1).cast(pa.large_binary())
        at = np.frombuffer(text.buffers()[1], np.int64)[text.offset: text.offset + len(text) + 1]
        code = _CODE[np.frombuffer(text.buffers()[2], np.uint8)[at[0]: at[-1]]]
        row = np.repeat(np.arange(len(text)), np.diff(at))
        a, b, c = code[:-2], code[1:-1], code[2:]
        valid = ((a | b | c) >= 0) & (row[:-2] == row[2:])
        triplet = (a * _LETTERS + b) * _LETTERS + c
        key, n = np.unique((of_row[row[:-2]] * len(_TRIPLETS) + triplet)[valid], return_counts=True)
        yield pa.RecordBatch.from_arrays([
            sample.dictionary.take(pa.array(key // len(_TRIPLETS))), _TRIPLETS.take(pa.array(key % len(_TRIPLETS))),
            pa.array(n, pa.int64()),
        ], names=[batch.schema.names[0], "triplet", "_n"])


def triplet_counts(seqs: DataFrame, sample: str = "sample_id", seq: str = "seq") -> DataFrame:
    """(sample, triplet, count) of the valid 3-letter windows inside sequences longer than three.

    Tasks count the windows of a batch in arrays; batches of a sample are added by Spark.
    """
    eligible = seqs.select(sample, F.upper(F.trim(F.col(seq))).alias("_s")).where(F.length("_s") > 3)
    kind = eligible.schema[sample].dataType.simpleString()
    windows = eligible.mapInArrow(_count_windows, f"`{sample}` {kind}, triplet string, _n bigint")
    return windows.groupBy(sample, "triplet").agg(F.sum("_n").alias("count"))


def without_windows(seqs: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Violations: samples whose sequences hold no valid window, for :func:`contracts.enforce`."""
    empty = repertoire_qc(seqs, sample).where("valid_windows = 0")
    detail = F.concat(F.lit("eligible="), F.col("eligible").cast("string"))
    return empty.select(F.lit("no_valid_window").alias("rule"), key_text([sample]).alias("key"), detail.alias("detail"))


def triplet_frequencies(seqs: DataFrame, sample: str = "sample_id", strict: bool = False) -> DataFrame:
    """Counts normalised per sample; every sequence row has equal weight.

    A sample without a valid window has no frequencies: it is an error with
    ``strict`` and has no row otherwise (:func:`repertoire_qc` lists it). It is never filled with zeros.
    """
    if strict:
        enforce(without_windows(seqs, sample))
    counts = triplet_counts(seqs, sample)
    totals = counts.groupBy(sample).agg(F.sum("count").alias("_t"))
    return counts.join(totals, sample).withColumn("frequency", F.col("count") / F.col("_t")).drop("_t")


def vocabulary(spark: SparkSession) -> DataFrame:
    """The 20^3 triplets in lexicographic order with a 0-based index."""
    letters = F.split(F.lit(fv.AMINO_ACIDS), "")
    n = len(fv.AMINO_ACIDS)
    index = spark.range(n**3).withColumnRenamed("id", "index")
    pick = lambda e: F.element_at(letters, (e + 1).cast("int"))
    i = F.col("index")
    word = F.concat(pick(F.floor(i / (n * n))), pick(F.floor(i / n) % n), pick(i % n))
    return index.withColumn("triplet", word)


def repertoire_qc(seqs: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Eligible sequences, valid and invalid windows of every sample, all from per-sequence sums.

    A run of k valid letters holds k - 2 valid windows, so the windows are
    counted without being built.  A sample of short sequences alone has a row of zeros.
    """
    s = F.upper(F.trim(F.col("seq")))
    runs = F.split(F.col("_s"), f"[^{fv.AMINO_ACIDS}]+")
    valid = F.aggregate(runs, F.lit(0), lambda t, r: t + F.greatest(F.lit(0), F.length(r) - 2))
    long_enough = F.length("_s") > 3
    rows = seqs.select(sample, s.alias("_s")).select(
        sample, long_enough.alias("_l"), valid.alias("_v"), (F.length("_s") - 2).alias("_n")
    )
    return rows.groupBy(sample).agg(
        F.count_if("_l").alias("eligible"),
        F.sum(F.when(F.col("_l"), F.col("_v")).otherwise(0)).alias("valid_windows"),
        F.sum(F.when(F.col("_l"), F.col("_n") - F.col("_v")).otherwise(0)).alias("invalid_windows"),
    )


# ---------------------------------------------------------- gene expression


def normal_symbol(symbol: Column) -> Column:
    return F.upper(F.trim(symbol))


def gene_profile(df: DataFrame, unit: str = "unit_id") -> DataFrame:
    """(unit, gene, value): normalised symbols, duplicates keep the maximum."""
    return df.groupBy(unit, normal_symbol(F.col("gene")).alias("gene")).agg(F.max("value").alias("value"))


def is_generic(gene: Column) -> Column:
    generic = gene.isin(fv.GENERIC_GENES)
    for prefix in fv.GENERIC_GENE_PREFIXES:
        generic = generic | gene.startswith(prefix)
    return generic


def top_features(profile: DataFrame, k: int = 12, unit: str = "unit_id") -> DataFrame:
    """Top k by value; generic genes only fill up.  The rank filter limits rows map-side."""
    order = W.partitionBy(unit).orderBy(is_generic(F.col("gene")), F.desc("value"), "gene")
    return profile.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def theme_tags(
    df: DataFrame, themes: Mapping[str, Sequence[str]] | None = None,
    prefixes: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row per (row, theme): set membership plus prefix themes, without duplicates."""
    dim = set_dim(df.sparkSession, themes or fv.EXPRESSION_THEMES, "theme")
    if not prefixes:
        return df.join(F.broadcast(dim.select("theme", "gene")), "gene")  # fixed table of some hundred rows
    # the themes of a row come from one pass over it
    listed = F.broadcast(dim.groupBy("gene").agg(F.collect_list("theme").alias("_listed")))
    by_prefix = F.array(*[F.when(F.col("gene").startswith(p), F.lit(theme)) for p, theme in prefixes.items()])
    found = F.concat(F.coalesce("_listed", F.array().cast("array<string>")), by_prefix)
    held = F.array_distinct(F.filter(found, lambda t: t.isNotNull()))
    tagged = df.join(listed, "gene", "left").withColumn("theme", F.explode(held)).drop("_listed")
    return tagged.dropDuplicates([*df.columns, "theme"])


def theme_snapshot(tagged: DataFrame, unit: str = "unit_id", keep: int = 5) -> DataFrame:
    """Top themes per unit by matched genes, with up to five example genes."""
    counts = tagged.groupBy(unit, "theme").agg(
        F.count(F.lit(1)).alias("matched"),
        F.array_join(F.slice(F.array_sort(F.collect_set("gene")), 1, 5), ",").alias("examples"),
    )
    order = W.partitionBy(unit).orderBy(F.desc("matched"), "theme")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def _top_programs(df: DataFrame, unit: str, top_n: int) -> DataFrame:
    order = W.partitionBy(unit).orderBy(F.desc("score"), F.desc("matched"), "program")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)


def program_activity_rank(
    profile: DataFrame, programs: Mapping[str, Sequence[str]] | None = None, top_n: int = 6,
    unit: str = "unit_id",
) -> DataFrame:
    """Mean within-unit percentile of program genes; at least two genes and 0.55."""
    dim = set_dim(profile.sparkSession, programs or fv.EXPRESSION_PROGRAMS, "program").select("program", "gene")
    in_unit = W.partitionBy(unit)
    average = F.rank().over(in_unit.orderBy("value")) + (
        F.count(F.lit(1)).over(W.partitionBy(unit, "value")) - 1
    ) / 2.0
    ranked = profile.withColumn("_pct", average / F.count(F.lit(1)).over(in_unit))
    matched = ranked.join(F.broadcast(dim), "gene")  # fixed table of some hundred rows
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("v"), "gene"))), 1, 5)
    scored = matched.groupBy(unit, "program").agg(
        F.avg("_pct").alias("_s"),
        F.count(F.lit(1)).alias("matched"),
        F.array_join(F.transform(best, lambda x: x["gene"]), ",").alias("genes"),
    ).where((F.col("matched") >= 2) & (F.round("_s", 12) >= 0.55))
    named = scored.select(
        unit, "program", round4("_s").alias("score"),
        cascade(F.round("_s", 12), fv.ACTIVITY_LEVELS, "mild").alias("level"), "matched", "genes",
    )
    return _top_programs(named, unit, top_n)


def program_activity_overlap(
    altered: DataFrame, programs: Mapping[str, Sequence[str]] | None = None, top_n: int = 6,
    unit: str = "unit_id",
) -> DataFrame:
    """Overlap / min(size, 6), at most 1."""
    dim = set_dim(altered.sparkSession, programs or fv.ALTERATION_PROGRAMS, "program")
    scored = altered.join(F.broadcast(dim), "gene").groupBy(unit, "program").agg(  # fixed table
        F.count(F.lit(1)).alias("matched"),
        F.max("set_size").alias("_size"),
        F.array_join(F.slice(F.array_sort(F.collect_set("gene")), 1, 5), ",").alias("genes"),
    )
    raw = F.least(F.lit(1.0), F.col("matched") / F.least(F.col("_size"), F.lit(6)))
    named = scored.select(
        unit, "program", round4(raw).alias("score"),
        cascade(raw, fv.OVERLAP_LEVELS, "mild").alias("level"), "matched", "genes",
    )
    return _top_programs(named, unit, top_n)


def program_columns(
    activity: DataFrame, programs: Sequence[str], unit: str = "unit_id", units: DataFrame | None = None
) -> DataFrame:
    """One column per program (0 when absent); ``units`` adds units without any program."""
    wide = activity.groupBy(unit).agg(
        *[F.max(F.when(F.col("program") == p, F.col("score"))).alias(p) for p in programs]
    )
    if units is not None:
        wide = units.select(unit).distinct().join(wide, unit, "left")
    return wide.select(unit, *[F.coalesce(F.col(p), F.lit(0.0)).alias(p) for p in programs])


def evidence_balance(
    activity: DataFrame, supporting: Sequence[str], resisting: Sequence[str], unit: str = "unit_id"
) -> DataFrame:
    """Top-3 strengths and counts of both sides, and their difference."""
    side = (
        F.when(F.col("program").isin(list(supporting)), "response")
        .when(F.col("program").isin(list(resisting)), "resistance")
        .when(F.col("program") == "cell_cycle_program", "context")
    )
    order = W.partitionBy(unit, "side").orderBy(F.desc("score"), "program")
    ranked = activity.withColumn("side", side).where("side IS NOT NULL").withColumn(
        "_r", F.row_number().over(order)
    )

    def strength(name: str) -> Column:
        top = (F.col("side") == name) & (F.col("_r") <= 3)
        return round4(F.coalesce(F.sum(F.when(top, F.col("score"))), F.lit(0.0)))

    def count(name: str) -> Column:
        return F.sum((F.col("side") == name).cast("bigint"))

    out = ranked.groupBy(unit).agg(
        strength("response").alias("response_strength"), strength("resistance").alias("resistance_strength"),
        count("response").alias("response_count"), count("resistance").alias("resistance_count"),
    )
    return out.withColumn("net", round4(F.col("response_strength") - F.col("resistance_strength")))


# --------------------------------------------------------------- alterations


def prevalence(altered: DataFrame, n_units: Column, feature: str = "gene") -> DataFrame:
    """Share of units carrying each feature."""
    return altered.groupBy(feature).agg(F.count(F.lit(1)).alias("carriers")).withColumn(
        "prevalence", F.col("carriers") / n_units
    )


def burden(units: DataFrame, altered: DataFrame, unit: str = "unit_id") -> DataFrame:
    """Active count per unit with its average-rank percentile and levels."""
    counts = altered.groupBy(unit).agg(F.count(F.lit(1)).alias("_c"))
    full = units.select(unit).distinct().join(counts, unit, "left").select(
        unit, F.coalesce("_c", F.lit(0)).cast("bigint").alias("altered_count")
    )
    ranked = with_average_rank(full, [], "altered_count", "_r")
    pct = F.col("_r") / F.col("_n")
    return ranked.select(
        unit, "altered_count", round4(pct).alias("burden_percentile"),
        cascade(pct, fv.BURDEN_LEVELS, "low").alias("burden_level"),
        cascade(round4(pct), fv.BURDEN_SUPPORT, 0.05).alias("burden_support_step"),
    )


def priority_top(altered: DataFrame, shares: DataFrame, k: int = 12, unit: str = "unit_id") -> DataFrame:
    """Order by priority (tags + 4 adverse + 3 favorable + 2 listed), rarity, name."""
    spark = altered.sparkSession
    tags = set_dim(spark, fv.ALTERATION_THEMES, "theme").groupBy("gene").agg(F.count(F.lit(1)).alias("_tags"))
    gene = F.col("gene")
    priority = (
        F.coalesce("_tags", F.lit(0))
        + 4 * gene.isin(fv.ADVERSE_GENES).cast("int")
        + 3 * gene.isin(fv.FAVORABLE_GENES).cast("int")
        + 2 * gene.isin(fv.PRIORITY_GENES).cast("int")
    )
    scored = altered.join(F.broadcast(tags), "gene", "left").join(shares.select("gene", "prevalence"), "gene")
    scored = scored.withColumn("priority", priority)
    order = W.partitionBy(unit).orderBy(F.desc("priority"), "prevalence", "gene")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        unit, "gene", "priority", round4("prevalence").alias("prevalence"), "rank"
    )


def marker_lists(altered: DataFrame, unit: str = "unit_id") -> DataFrame:
    """Adverse and favorable markers (up to eight names) and pathway hits (up to six)."""
    gene = F.col("gene")

    def names(members: Sequence[str], keep: int) -> Column:
        hits = F.collect_set(F.when(gene.isin(list(members)), gene))
        return F.array_join(F.slice(F.array_sort(hits), 1, keep), ",")

    def count(members: Sequence[str]) -> Column:
        return F.sum(gene.isin(list(members)).cast("bigint"))

    return altered.groupBy(unit).agg(
        names(fv.ADVERSE_GENES, 8).alias("adverse_markers"),
        names(fv.FAVORABLE_GENES, 8).alias("favorable_markers"),
        names(fv.ALTERATION_PROGRAMS["antigen_presentation_escape_program"], 6).alias("escape_hits"),
        names(fv.ALTERATION_PROGRAMS["dna_repair_instability_program"], 6).alias("repair_hits"),
        count(fv.ADVERSE_GENES).alias("n_adverse"),
        count(fv.FAVORABLE_GENES).alias("n_favorable"),
    )


# ------------------------------------------------------ repertoire chemistry


def motif_tags(motif: Column) -> Column:
    """Residue-class tags of a motif, in a fixed order; 'neutral' when nothing applies."""
    raw = F.upper(motif)
    letters = F.regexp_replace(raw, "[^A-Z]", "")
    tags = [F.when(raw.rlike("[* ]"), F.lit("boundary"))]
    tags += [F.when(letters.rlike(f"[{r}]"), F.lit(t)) for t, r in fv.RESIDUE_CLASSES.items()]
    tags.append(F.when(letters.rlike("^(.)\\1*$"), F.lit("repeat")))
    present = F.filter(F.array(*tags), lambda t: t.isNotNull())
    return F.when(F.size(present) == 0, F.array(F.lit("neutral"))).otherwise(present)


def motif_dim(motifs: DataFrame, motif: str = "triplet") -> DataFrame:
    """One row per distinct motif with its tags, flags and complexity."""
    tags = motif_tags(F.col(motif))
    letters = F.regexp_replace(F.upper(F.col(motif)), "[^A-Z]", "")
    listed = lambda names: F.array(*[F.lit(n) for n in names])
    return motifs.select(motif).distinct().withColumn("tags", tags).withColumns({
        "reactive": F.arrays_overlap("tags", listed(fv.REACTIVE_TAGS)),
        "regulatory": F.arrays_overlap("tags", listed(fv.REGULATORY_TAGS)),
        "complexity": F.coalesce(
            safe_ratio(F.size(F.array_distinct(F.split(letters, ""))), F.length(letters)), F.lit(0.0)
        ),
    })


def repertoire_shape(counts: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Totals, top shares, normalised entropy and ECDF positions per sample."""
    # one row per (sample, count): shares of the top k need no order among equal counts
    levels = counts.groupBy(sample, "count").agg(F.count(F.lit(1)).alias("_m"))
    higher = W.partitionBy(sample).orderBy(F.desc("count")).rowsBetween(W.unboundedPreceding, -1)
    ranked = levels.withColumn("_above", F.coalesce(F.sum("_m").over(higher), F.lit(0)))
    ranked = ranked.withColumn("_c", F.col("count").cast("double"))
    taken = lambda k: F.least(F.col("_m"), F.greatest(F.lit(0), k - F.col("_above")))
    share = lambda k: F.sum(F.col("_c") * taken(k)) / F.sum(F.col("_c") * F.col("_m"))
    sums = ranked.groupBy(sample).agg(
        F.sum(F.col("count") * F.col("_m")).alias("total"),
        F.sum("_m").alias("active"),
        share(1).alias("top1_share"),
        share(3).alias("top3_share"),
        share(5).alias("top5_share"),
        F.sum(F.col("_c") * F.log("_c") * F.col("_m")).alias("_clogc"),
    )
    # entropy = log(total) - sum(c log c) / total
    entropy = F.log("total") - F.col("_clogc") / F.col("total")
    shaped = sums.withColumn(
        "normalized_entropy", F.when(F.col("active") > 1, entropy / F.log("active")).otherwise(0.0)
    ).drop("_clogc")
    shaped = settle(shaped)  # read by both ranks and the result
    for source, out in (("total", "total_percentile"), ("active", "richness_percentile")):
        shaped = with_average_rank(shaped, [], source, "_rank").withColumn(
            out, F.col("_upto") / F.col("_n")
        ).drop("_rank", "_n", "_upto")
    return shaped


FRACTION_TAGS = ["boundary", *fv.RESIDUE_CLASSES, "repeat"]


def chemistry(counts: DataFrame, shape: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Weight shares per tag and rarity / complexity means, joined to the shape; rounded to 4."""
    n_samples = shape.agg(F.count(F.lit(1)).alias("n")).scalar()
    shares = counts.groupBy("triplet").agg(F.count(F.lit(1)).alias("_carriers")).withColumn(
        "_rarity", 1 - F.col("_carriers") / n_samples
    )
    shares = settle(shares)
    dim = F.broadcast(motif_dim(shares).join(shares, "triplet"))  # at most 20^3 rows
    joined = counts.join(dim, "triplet").withColumn("_w", F.col("count").cast("double"))
    tag_sums = [
        F.sum(F.when(F.array_contains("tags", t), F.col("_w")).otherwise(0.0)).alias(f"{t}_fraction")
        for t in FRACTION_TAGS
    ]
    when = lambda flag, v: F.sum(F.when(F.col(flag), v).otherwise(0.0))
    w, rarity = F.col("_w"), F.col("_rarity")
    sums = joined.groupBy(sample).agg(
        *tag_sums,
        F.sum(w * rarity).alias("rarity_weighted_mean"),
        when("reactive", w).alias("reactive_fraction"),
        when("regulatory", w).alias("regulatory_fraction"),
        when("reactive", w * rarity).alias("rare_reactive_fraction"),
        when("reactive", w * (1 - rarity)).alias("common_reactive_fraction"),
        F.avg("complexity").alias("complexity_mean"),
    )
    weights = [f"{t}_fraction" for t in FRACTION_TAGS] + [
        "rarity_weighted_mean", "reactive_fraction", "regulatory_fraction",
        "rare_reactive_fraction", "common_reactive_fraction",
    ]
    total = F.greatest(F.col("total"), F.lit(1))
    out = sums.join(shape, sample)
    return out.select(
        sample,
        *[round4(F.col(c) / total).alias(c) for c in weights],
        round4("complexity_mean").alias("complexity_mean"),
        *[round4(c).alias(c) for c in ("top1_share", "top3_share", "top5_share", "normalized_entropy")],
        "total_percentile", "richness_percentile", "total", "active",
    )


def rule_profile(
    chem: DataFrame, sample: str = "sample_id", weights: Mapping[str, float] | None = None, quantile: float = 0.3
) -> DataFrame:
    """Weighted z-scores against the 30 % quantile, logistic / 2, clipped to [.05, .95]."""
    weights = weights or fv.RULE_WEIGHTS
    named = chem.select(
        sample,
        *[(F.col("regulatory_fraction") if n == "regulatory_motif_fraction" else F.col(n)).alias(n) for n in weights],
    )
    z = zscore(named, [], list(weights))
    z = z.withColumns({f"c_{n}": F.col(f"z_{n}") * w for n, w in weights.items()})
    raw = None
    for n in weights:
        raw = F.col(f"c_{n}") if raw is None else raw + F.col(f"c_{n}")
    scored = z.withColumn("raw", F.round(raw, 9))
    threshold = exact_quantiles(scored.select("raw"), [], "raw", {"t": quantile}).scalar()
    scored = scored.withColumn("threshold", threshold)
    centered = F.col("raw") - F.col("threshold")
    toxicity = F.greatest(F.lit(0.05), F.least(F.lit(0.95), 1 / (1 + F.exp(-centered / 2.0))))
    scored = scored.withColumns({"centered": centered, "toxicity_support": toxicity})
    side = F.when(F.col("toxicity_support") >= 0.55, "toxicity").when(
        F.col("toxicity_support") <= 0.45, "tolerance"
    ).otherwise("mixed")
    return scored.withColumns({
        "tolerance_support": 1 - F.col("toxicity_support"),
        "prediction": F.when(F.col("raw") >= F.col("threshold"), "positive").otherwise("negative"),
        "dominant_side": side,
    })


_ENTRY = "array<struct<c:double,i:int,t:string>>"

# rationale sentences (fixed values): text before the number, text after it, motif suffix
REASONS = {
    "basic_fraction": ("Higher basic-residue burden (", ") shifts the rule-based score toward toxicity.", True),
    "glycine_proline_fraction": ("Higher glycine/proline burden (", ") supports a structurally reactive repertoire.", True),
    "acidic_fraction": ("Higher acidic motif fraction (", ") contributes to the rule-based toxicity axis.", True),
    "hydrophobic_fraction": ("Higher hydrophobic motif burden (", ") increases the repertoire risk score.", True),
    "polar_fraction": ("Higher polar motif fraction (", ") acts as a tolerance-leaning counterweight in the rule set.", False),
    "regulatory_motif_fraction": ("Higher regulatory motif fraction (", ") pushes the rule score away from toxicity.", False),
    "top1_share": ("Higher top1 clonotype share (", ") is a major rule-based discriminator for this sample.", False),
}


def rule_rationale(profile: DataFrame, motifs: DataFrame, calibration: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Top two positive and the first negative contribution as text, one index line, at most three."""
    joined = profile.join(motifs.select(sample, "top_motifs"), sample).join(calibration, sample)
    suffix = F.concat(F.lit(" Top motifs include "), F.col("top_motifs"), F.lit("."))
    entries = F.array(*[
        F.struct(
            F.round(F.col(f"c_{n}"), 9).alias("c"),
            F.lit(-i).alias("i"),
            F.concat(
                F.lit(before), fixed3(F.col(n)), F.lit(after), suffix if motif else F.lit("")
            ).alias("t"),
        )
        for i, (n, (before, after, motif)) in enumerate(REASONS.items())
    ])
    ordered = F.sort_array(entries, asc=False)
    best = F.filter(F.slice(ordered, 1, 2), lambda e: e["c"] > 0)
    lowest = F.array_min(entries)
    worst = F.when(lowest["c"] < 0, F.array(lowest)).otherwise(F.array().cast(_ENTRY))
    line = F.when(
        F.col("prediction") == "positive",
        F.concat(
            F.lit("Rule-first toxicity index is elevated with summary_toxicity_index "),
            fixed3(F.col("toxicity_index_r")),
            F.lit(" and autoreactivity pressure "), fixed3(F.col("autoreactivity_r")), F.lit("."),
        ),
    ).otherwise(
        F.concat(
            F.lit("Rule-first toxicity index remains limited with regulatory_diversity_score "),
            fixed3(F.col("diversity_r")),
            F.lit(" and tolerance_support_score "), fixed3(F.col("tolerance_r")), F.lit("."),
        )
    )
    texts = F.concat(F.transform(F.concat(best, worst), lambda e: e["t"]), F.array(line))
    return joined.select(sample, F.slice(F.array_distinct(texts), 1, 3).alias("rationale"))

