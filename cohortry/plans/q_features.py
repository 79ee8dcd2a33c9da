"""Registered queries: per-unit feature summaries (l)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed_values as fv, formulas as fm
from ..functions.lineage import settle
from ..operators import features as ft
from . import views
from .q_class_rank import rounded
from .registry import query


def sets_sql(sets, name: str) -> str:
    rows = ",".join(f"('{s}','{g}',{len(gs)})" for s, gs in sets.items() for g in gs)
    return f"(values {rows}) as t({name}, gene, set_size)"


def in_list(names) -> str:
    return "(" + ",".join(f"'{n}'" for n in names) + ")"


_WIN = f"""clone as (select sample_id, seq from seqs where length(seq)>3),
win as (select sample_id, substr(seq, i::bigint, 3) triplet from (select sample_id, seq, unnest(range(1, length(seq)-1)) i from clone)),
cnt as (select sample_id, triplet, count(*) "count" from win where regexp_full_match(triplet, '[{fv.AMINO_ACIDS}]{{3}}') group by 1,2)"""


@query("l01_kmer_frequency", f"with {_WIN} " + """
select sample_id, triplet, "count", round("count"*1.0/sum("count") over (partition by sample_id), 9) frequency from cnt""", ("seqs",))
def l01(spark, sf):
    return rounded(ft.triplet_frequencies(views.seqs(spark, sf)), 9, "frequency")


@query("l02_kmer_vocabulary", f"""with {_WIN},
v as (select a.c||b.c||d.c triplet from (select unnest(string_split('{fv.AMINO_ACIDS}','')) c) a, (select unnest(string_split('{fv.AMINO_ACIDS}','')) c) b,
 (select unnest(string_split('{fv.AMINO_ACIDS}','')) c) d)
select row_number() over (order by triplet)-1 as "index", triplet, cast(coalesce(sum("count"),0) as bigint) observed from v left join cnt using (triplet) group by triplet""", ("seqs",))
def l02(spark, sf):
    seen = ft.triplet_counts(views.seqs(spark, sf)).groupBy("triplet").agg(F.sum("count").alias("_c"))
    return ft.vocabulary(spark).join(seen, "triplet", "left").select(
        "index", "triplet", F.coalesce("_c", F.lit(0)).alias("observed")
    )


@query("l03_repertoire_qc", f"""with {_WIN},
w as (select sample_id, count(*) n, sum(regexp_full_match(triplet, '[{fv.AMINO_ACIDS}]{{3}}')::int) v from win group by 1),
c as (select sample_id, count(*) filter (length(seq)>3) eligible from seqs group by 1)
select sample_id, eligible, cast(coalesce(v,0) as bigint) valid_windows, cast(coalesce(n-v,0) as bigint) invalid_windows from c left join w using (sample_id)""", ("seqs",))
def l03(spark, sf):
    return ft.repertoire_qc(views.seqs(spark, sf))


# one gene written two ways: symbols must be normalised and duplicates keep the maximum
def _raw_genes(spark, sf) -> DataFrame:
    lines = views._customer_brand(spark, sf)
    names = F.array(*[F.lit(g) for g in views.GENES])
    gene = F.element_at(names, (F.col("p_partkey") % len(views.GENES) + 1).cast("int"))
    odd = F.col("p_partkey") % 2 == 1
    return lines.select(
        "unit_id", F.when(odd, F.concat(F.lit(" "), F.lower(gene))).otherwise(gene).alias("gene"),
        F.col("l_quantity").alias("value"),
    )


_GENE_AT = f"([{','.join(chr(39) + g + chr(39) for g in views.GENES)}])[p_partkey % {len(views.GENES)} + 1]"


@query("l04_gene_profile", f"select unit_id, {_GENE_AT} gene, max(l_quantity) as value from ({views._CUSTOMER_BRAND}) group by 1,2")
def l04(spark, sf):
    return ft.gene_profile(_raw_genes(spark, sf))


_GENERIC = f"(gene in {in_list(fv.GENERIC_GENES)} or gene like 'RPL%' or gene like 'RPS%' or gene like 'MT-%')"
_TOP = f"""topg as (select * from (select *, row_number() over (partition by unit_id order by {_GENERIC}, value desc, gene) "rank" from genes) where "rank"<=12)"""
_THEMES = f"""tag as (select unit_id, gene, value, theme from topg join (select theme, gene from {sets_sql(fv.BULK_THEMES, 'theme')}) using (gene)
 union select unit_id, gene, value, p.theme from topg join (values {','.join(f"('{k}','{v}')" for k, v in fv.PREFIX_THEMES.items())}) p(prefix, theme) on starts_with(gene, prefix))"""


@query("l05_top_k_features", f"""with {_TOP} select unit_id, gene, value, cast("rank" as int) as "rank" from topg""", ("genes",))
def l05(spark, sf):
    return ft.top_features(views.genes(spark, sf)).select("unit_id", "gene", "value", "rank")


def _tagged(spark, sf) -> DataFrame:
    top = ft.top_features(views.genes(spark, sf)).select("unit_id", "gene", "value")
    return ft.theme_tags(top, fv.BULK_THEMES, fv.PREFIX_THEMES)


@query("l06_theme_tags", f"with {_TOP},{_THEMES} select unit_id, gene, theme from tag", ("genes",))
def l06(spark, sf):
    return _tagged(spark, sf).select("unit_id", "gene", "theme")


@query("l07_theme_snapshot", f"""with {_TOP},{_THEMES},
c as (select unit_id, theme, count(*) matched, array_to_string(list_slice(list_sort(list(distinct gene)),1,5),',') examples from tag group by 1,2)
select unit_id, theme, matched, examples, cast(r as int) as "rank" from (select *, row_number() over (partition by unit_id order by matched desc, theme) r from c) where r<=5""", ("genes",))
def l07(spark, sf):
    return ft.theme_snapshot(_tagged(spark, sf))


def activity_sql(top_n: int) -> str:
    steps = " ".join(f"when round(s,12)>={t} then '{n}'" for t, n in fv.ACTIVITY_LEVELS)
    return f"""pct as (select unit_id, gene, value, (rank() over (partition by unit_id order by value)
 + (count(*) over (partition by unit_id, value)-1)/2.0)/count(*) over (partition by unit_id) p from genes),
sc as (select unit_id, program, avg(p) s, count(*) matched,
 array_to_string(list_slice(list(gene order by value desc, gene),1,5),',') genes
 from pct join (select program, gene from {sets_sql(fv.EXPRESSION_PROGRAMS, 'program')}) using (gene) group by 1,2),
pr as (select unit_id, program, round(round(s,12),4) score, case {steps} else 'mild' end "level", matched, genes from sc where matched>=2 and round(s,12)>=0.55),
act as (select * from (select *, cast(row_number() over (partition by unit_id order by score desc, matched desc, program) as int) "rank" from pr) where "rank"<={top_n})"""


def pivot_sql(source: str, programs, name: str) -> str:
    cols = ", ".join(f"max(case when program='{p}' then score else 0.0 end)::double {p}" for p in programs)
    return f"{name} as (select unit_id, {cols} from {source} group by 1)"


@query("l08_program_activity_rank", f"with {activity_sql(6)} select * from act", ("genes",))
def l08(spark, sf):
    return ft.program_activity_rank(views.genes(spark, sf))


_OVER = f"""ov as (select unit_id, program, least(1.0, count(*)::double/least(max(set_size),6)) s, count(*) matched,
 array_to_string(list_slice(list_sort(list(distinct gene)),1,5),',') genes from mutations join (select program, gene, set_size from {sets_sql(fv.ALTERATION_PROGRAMS, 'program')}) using (gene) group by 1,2),
op as (select unit_id, program, round(round(s,12),4) score, case {" ".join(f"when s>={t} then '{n}'" for t, n in fv.OVERLAP_LEVELS)} else 'mild' end "level", matched, genes from ov),
oa as (select * from (select *, cast(row_number() over (partition by unit_id order by score desc, matched desc, program) as int) "rank" from op) where "rank"<=6)"""


@query("l09_program_activity_overlap", f"with {_OVER} select * from oa", ("mutations",))
def l09(spark, sf):
    return ft.program_activity_overlap(views.mutations(spark, sf))


def customers(spark, sf) -> DataFrame:
    return views.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("unit_id"))


_PREV = "pv as (select gene, count(*) carriers, count(*)*1.0/(select count(*) from customer) prevalence from mutations group by 1)"


def _prevalence(spark, sf) -> DataFrame:
    n = customers(spark, sf).agg(F.count(F.lit(1)).alias("n")).scalar()
    return ft.prevalence(views.mutations(spark, sf), n)


@query("l10_prevalence", f"with {_PREV} select gene, carriers, round(prevalence,6) prevalence from pv", ("mutations",))
def l10(spark, sf):
    return rounded(_prevalence(spark, sf), 6, "prevalence")


_BURDEN = """bc as (select cast(c_custkey as varchar) unit_id, count(gene) altered_count from customer left join mutations on unit_id=cast(c_custkey as varchar) group by 1),
bp as (select *, (rank() over (order by altered_count) + (count(*) over (partition by altered_count)-1)/2.0)/count(*) over () p from bc),
bu as (select unit_id, altered_count, round(round(p,12),4) burden_percentile, """ + fm.level("p", fv.BURDEN_LEVELS, "low") + """ burden_level,
 """ + fm.level("round(round(p,12),4)", fv.BURDEN_SUPPORT, 0.05) + """::double burden_support_step from bp)"""


@query("l11_burden", f"with {_BURDEN} select * from bu", ("mutations",))
def l11(spark, sf):
    return ft.burden(customers(spark, sf), views.mutations(spark, sf))


@query("l12_priority_top_k", f"""with {_PREV},
tg as (select gene, count(*) t from {sets_sql(fv.ALTERATION_THEMES, 'theme')} group by 1),
pq as (select unit_id, gene, cast(coalesce(t,0) + 4*(gene in {in_list(fv.ADVERSE_GENES)})::int + 3*(gene in {in_list(fv.FAVORABLE_GENES)})::int
 + 2*(gene in {in_list(fv.PRIORITY_GENES)})::int as bigint) priority, prevalence from mutations left join tg using (gene) join pv using (gene))
select unit_id, gene, priority, round(round(prevalence,12),4) prevalence, cast(r as int) as "rank" from
 (select *, row_number() over (partition by unit_id order by priority desc, prevalence, gene) r from pq) where r<=12""", ("mutations",))
def l12(spark, sf):
    return ft.priority_top(views.mutations(spark, sf), _prevalence(spark, sf))


def _names_sql(members, keep, name):
    return f"coalesce(array_to_string(list_slice(list_sort(list(distinct gene) filter (gene in {in_list(members)})),1,{keep}),','),'') {name}"


_MARK = f"""mk as (select unit_id, {_names_sql(fv.ADVERSE_GENES, 8, 'adverse_markers')}, {_names_sql(fv.FAVORABLE_GENES, 8, 'favorable_markers')},
 {_names_sql(fv.ALTERATION_PROGRAMS['antigen_presentation_escape_program'], 6, 'escape_hits')},
 {_names_sql(fv.ALTERATION_PROGRAMS['dna_repair_instability_program'], 6, 'repair_hits')},
 cast(sum((gene in {in_list(fv.ADVERSE_GENES)})::int) as bigint) n_adverse, cast(sum((gene in {in_list(fv.FAVORABLE_GENES)})::int) as bigint) n_favorable from mutations group by 1)"""
_ALT = f"with {_OVER},{_BURDEN},{_MARK}," + pivot_sql("oa", fv.ALTERATION_PROGRAMS, "pv0") + """,
base as (select * from mk join bu using (unit_id) join pv0 using (unit_id))"""


def _alteration_base(spark, sf) -> DataFrame:
    altered = settle(views.mutations(spark, sf))
    wide = ft.program_columns(ft.program_activity_overlap(altered), list(fv.ALTERATION_PROGRAMS))
    load = ft.burden(customers(spark, sf), altered)
    return ft.marker_lists(altered).join(load, "unit_id").join(wide, "unit_id")


_L13 = "unit_id, adverse_markers, favorable_markers, escape_hits, repair_hits, altered_count, burden_level, risk_signal_strength, benefit_signal_strength"


@query("l13_marker_relevance", _ALT + "," + fm.stages_sql("base", fm.RELEVANCE, "rel") + f" select {_L13} from rel", ("mutations",))
def l13(spark, sf):
    return fm.with_formulas(_alteration_base(spark, sf), fm.RELEVANCE).select(*_L13.split(", "))


_EXPR = list(fv.EXPRESSION_PROGRAMS)
_L14 = "unit_id, response_high_axes, resistance_high_axes, calibrated_response_score, calibrated_resistance_score, calibrated_net_evidence"


@query("l14_calibration_response", f"with {activity_sql(6)}," + pivot_sql("act", _EXPR, "pv") + "," +
       fm.stages_sql("pv", fm.RESPONSE_CALIBRATION, "cal") + f" select {_L14} from cal", ("genes",))
def l14(spark, sf):
    wide = ft.program_columns(ft.program_activity_rank(views.genes(spark, sf)), _EXPR)
    return fm.with_formulas(wide, fm.RESPONSE_CALIBRATION).select(*_L14.split(", "))


_L15 = ("unit_id, adverse_high_axes, favorable_high_axes, dominant_adverse, sparse_profile, repair_supported, strong_favorable, "
        "ultra_favorable, burden_only, high_risk_ready, calibrated_risk_score, calibrated_benefit_score, calibrated_net_risk")


@query("l15_calibration_mutation", _ALT + "," + fm.stages_sql("base", fm.ALTERATION_CALIBRATION, "cal") + f" select {_L15} from cal", ("mutations",))
def l15(spark, sf):
    return fm.with_formulas(_alteration_base(spark, sf), fm.ALTERATION_CALIBRATION).select(*_L15.split(", "))


ECO_SQL = f"{activity_sql(8)}," + pivot_sql("act", _EXPR, "pv") + "," + fm.stages_sql("pv", fm.ECOLOGY, "eco")
_DOM = [
    ("dominant_protective", fv.PROTECTIVE_PROGRAMS), ("dominant_adverse_programs", fv.ADVERSE_PROGRAMS),
]


def ecology(spark, sf) -> DataFrame:
    activity = ft.program_activity_rank(views.genes(spark, sf), top_n=8)
    wide = ft.program_columns(activity, _EXPR)
    return fm.with_formulas(wide, fm.ECOLOGY)


_L16 = ("unit_id, inflamed_r, inflamed_level, suppressive_r, suppressive_level, proliferative_level, favorability_r, barrier_r, reserve_r, "
        "escape_r, gap_r, reserve_gap_r, balance_r, exclusion_gap_r, net_r, net_direction, protective_axes, adverse_axes, strong_protective, strong_adverse")


@query("l16_ecology", f"with {ECO_SQL}" + f" select {_L16} from eco", ("genes",))
def l16(spark, sf):
    return ecology(spark, sf).select(*_L16.split(", "))


_L17 = ("unit_id, near_zero, excluded_inflamed, stromal_dominant, myeloid_exhausted, proliferative_escape, favorable_ready, low_blocked, "
        "low_ready, high_ready, mixed_profile")


@query("l17_calibration_ecology", f"with {ECO_SQL}," + fm.stages_sql("eco", fm.ECOLOGY_STATES, "st") + f" select {_L17} from st", ("genes",))
def l17(spark, sf):
    return fm.with_formulas(ecology(spark, sf), fm.ECOLOGY_STATES).select(*_L17.split(", "))


_TAGS = "[x for x in [" + ",".join(
    [f"case when regexp_matches(triplet,'[{r}]') then '{t}' end" for t, r in fv.RESIDUE_CLASSES.items()]
    + ["case when triplet=repeat(triplet[1],3) then 'repeat' end"]
) + "] if x is not null]"


@query("l18_motif_tags", f"""with {_WIN}, m as (select distinct triplet from cnt)
select triplet, array_to_string({_TAGS}, ',') tags from m""", ("seqs",))
def l18(spark, sf):
    motifs = ft.triplet_counts(views.seqs(spark, sf)).select("triplet").distinct()
    return motifs.select("triplet", F.array_join(ft.motif_tags(F.col("triplet")), ",").alias("tags"))


_SHAPE = """rk as (select *, row_number() over (partition by sample_id order by "count" desc, triplet) r from cnt),
s0 as (select sample_id, cast(sum("count") as bigint) total, count(*) active, sum(case when r<=1 then "count" else 0 end)::double/sum("count") top1_share,
 sum(case when r<=3 then "count" else 0 end)::double/sum("count") top3_share, sum(case when r<=5 then "count" else 0 end)::double/sum("count") top5_share,
 sum("count"*ln("count")) cl from rk group by 1),
sh as (select *, case when active>1 then (ln(total)-cl/total)/ln(active) else 0.0 end normalized_entropy,
 cume_dist() over (order by total) total_percentile, cume_dist() over (order by active) richness_percentile from s0)"""


@query("l19_repertoire_shape", f"with {_WIN},{_SHAPE} " + """
select sample_id, total, active, round(top1_share,6) top1_share, round(top3_share,6) top3_share, round(top5_share,6) top5_share,
 round(normalized_entropy,6) normalized_entropy, round(total_percentile,6) total_percentile, round(richness_percentile,6) richness_percentile from sh""", ("seqs",))
def l19(spark, sf):
    out = ft.repertoire_shape(settle(ft.triplet_counts(views.seqs(spark, sf))))
    return rounded(out, 6, "top1_share", "top3_share", "top5_share", "normalized_entropy", "total_percentile", "richness_percentile")


_REACT = " or ".join(f"list_contains(tags,'{t}')" for t in fv.REACTIVE_TAGS)
_REG = " or ".join(f"list_contains(tags,'{t}')" for t in fv.REGULATORY_TAGS)
_CHEM = f"""mo as (select triplet, {_TAGS} tags, 1-count(*)*1.0/(select count(*) from sh) rarity,
 len(list_distinct(string_split(triplet,'')))/3.0 cx from cnt group by 1),
mm as (select *, {_REACT} reactive, {_REG} regulatory from mo),
cj as (select sample_id, "count"::double w, mm.* from cnt join mm using (triplet)),
cs as (select sample_id, {", ".join(f"sum(case when list_contains(tags,'{t}') then w else 0 end) {t}_fraction" for t in ft.FRACTION_TAGS)},
 sum(w*rarity) rarity_weighted_mean, sum(case when reactive then w else 0 end) reactive_fraction, sum(case when regulatory then w else 0 end) regulatory_fraction,
 sum(case when reactive then w*rarity else 0 end) rare_reactive_fraction, sum(case when reactive then w*(1-rarity) else 0 end) common_reactive_fraction,
 avg(cx) complexity_mean from cj group by 1),
ch as (select sample_id, {", ".join(f"round(round({c}/greatest(total,1),12),4) {c}" for c in [t + "_fraction" for t in ft.FRACTION_TAGS] + ["rarity_weighted_mean", "reactive_fraction", "regulatory_fraction", "rare_reactive_fraction", "common_reactive_fraction"])},
 round(round(complexity_mean,12),4) complexity_mean, round(round(top1_share,12),4) top1_share, round(round(top3_share,12),4) top3_share, round(round(top5_share,12),4) top5_share,
 round(round(normalized_entropy,12),4) normalized_entropy, total_percentile, richness_percentile, total, active from cs join sh using (sample_id))"""


def chem(spark, sf) -> DataFrame:
    counts = settle(ft.triplet_counts(views.seqs(spark, sf)))
    return ft.chemistry(counts, settle(ft.repertoire_shape(counts)))


_L20 = ["sample_id"] + [t + "_fraction" for t in ft.FRACTION_TAGS] + [
    "rarity_weighted_mean", "complexity_mean", "reactive_fraction", "regulatory_fraction", "rare_reactive_fraction", "common_reactive_fraction",
]


@query("l20_chemistry", f"with {_WIN},{_SHAPE},{_CHEM} select {', '.join(_L20)} from ch", ("seqs",))
def l20(spark, sf):
    return chem(spark, sf).select(*_L20)


_L21 = [f"{n}_r" for n in ("autoreactivity", "tolerance", "clonal_focus", "instability", "skew", "burden", "reactive_score", "rare_burden",
                           "common_penalty", "diversity", "toxicity_index", "net_toxicity")] + [
    "autoreactivity_level", "tolerance_level", "burden_level", "near_zero_toxicity", "low_toxicity_ready", "high_toxicity_ready", "mixed_toxicity",
]
_TOX = f"with {_WIN},{_SHAPE},{_CHEM}," + fm.stages_sql("ch", fm.TOXICITY, "tox")


@query("l21_toxicity_calibration", _TOX + f" select sample_id, {', '.join(_L21)} from tox", ("seqs",))
def l21(spark, sf):
    return fm.with_formulas(chem(spark, sf), fm.TOXICITY).select("sample_id", *_L21)


def _z(n):
    c = "regulatory_fraction" if n == "regulatory_motif_fraction" else n
    return f"coalesce(({c}-avg({c}) over ())/case when stddev_samp({c}) over ()=0 then 1 else stddev_samp({c}) over () end,0)*{fv.RULE_WEIGHTS[n]}"


_RULE = "," + f"""zz as (select tox.*, regulatory_fraction regulatory_motif_fraction, {', '.join(f'{_z(n)} c_{n}' for n in fv.RULE_WEIGHTS)} from tox),
rw as (select *, round({' + '.join(f'c_{n}' for n in fv.RULE_WEIGHTS)},9) raw from zz),
rt as (select *, quantile_cont(raw,0.3) over () threshold from rw),
rp as (select *, raw-threshold centered, greatest(0.05,least(0.95,1/(1+exp(-(raw-threshold)/2.0)))) toxicity_support from rt),
rule as (select *, 1-toxicity_support tolerance_support, case when raw>=threshold then 'positive' else 'negative' end prediction,
 case when toxicity_support>=0.55 then 'toxicity' when toxicity_support<=0.45 then 'tolerance' else 'mixed' end dominant_side from rp)"""
RULE_SQL = _TOX + _RULE
RULE_OUT = """sample_id, round(raw,4) rule_raw_score, round(threshold,4) rule_threshold, round(centered,4) rule_centered_score,
 round(toxicity_support,4) toxicity_support_score, round(tolerance_support,4) tolerance_support_score, prediction, dominant_side"""


def rule_rows(profile: DataFrame) -> DataFrame:
    return profile.select(
        "sample_id", F.round("raw", 4).alias("rule_raw_score"), F.round("threshold", 4).alias("rule_threshold"),
        F.round("centered", 4).alias("rule_centered_score"), F.round("toxicity_support", 4).alias("toxicity_support_score"),
        F.round("tolerance_support", 4).alias("tolerance_support_score"), "prediction", "dominant_side",
    )


@query("l22_rule_profile", RULE_SQL + f" select {RULE_OUT} from rule", ("seqs",))
def l22(spark, sf):
    return rule_rows(ft.rule_profile(settle(chem(spark, sf))))


def _reason_sql(n, before, after, motif):
    tail = " || ' Top motifs include ' || top_motifs || '.'" if motif else ""
    return f"{{'c': round(c_{n},9), 'i': {-list(ft.REASONS).index(n)}, 't': '{before}' || printf('%.3f', {n}) || '{after}'{tail}}}"


@query("l23_rule_rationale", RULE_SQL + """,
tm as (select sample_id, array_to_string(list(triplet order by r),', ') top_motifs from rk where r<=2 group by 1),
en as (select rule.*, top_motifs, list_reverse_sort([""" + ", ".join(_reason_sql(n, *v) for n, v in ft.REASONS.items()) + """]) e from rule join tm using (sample_id))
select sample_id, array_to_string(list_slice(list_concat(list_concat([x.t for x in e[1:2] if x.c>0],
 case when e[7].c<0 then [e[7].t] else [] end),
 [case when prediction='positive' then 'Rule-first toxicity index is elevated with summary_toxicity_index '||printf('%.3f', toxicity_index_r)||' and autoreactivity pressure '||printf('%.3f', autoreactivity_r)||'.'
  else 'Rule-first toxicity index remains limited with regulatory_diversity_score '||printf('%.3f', diversity_r)||' and tolerance_support_score '||printf('%.3f', tolerance_r)||'.' end]),1,3),' | ') rationale from en""", ("seqs",))
def l23(spark, sf):
    counts = settle(ft.triplet_counts(views.seqs(spark, sf)))
    table = settle(ft.chemistry(counts, settle(ft.repertoire_shape(counts))))
    # the two most frequent motifs per sample as an aggregate of bounded structs
    top = counts.groupBy("sample_id").agg(
        F.min(F.struct((-F.col("count")).alias("c"), "triplet")).alias("a")
    )
    rest = counts.join(top, "sample_id").where("triplet <> a.triplet").groupBy("sample_id").agg(
        F.min(F.struct((-F.col("count")).alias("c"), "triplet")).alias("b")
    )
    motifs = top.join(rest, "sample_id", "left").select(
        "sample_id", F.concat_ws(", ", "a.triplet", "b.triplet").alias("top_motifs")
    )
    calibration = fm.with_formulas(table, fm.TOXICITY).select(
        "sample_id", "toxicity_index_r", "autoreactivity_r", "diversity_r", "tolerance_r"
    )
    out = ft.rule_rationale(ft.rule_profile(table), motifs, calibration)
    return out.select("sample_id", F.array_join("rationale", " | ").alias("rationale"))


_BAL = f"""sd as (select *, case when program in {in_list(fv.RESPONSE_PROGRAMS)} then 'response' when program in {in_list(fv.RESISTANCE_PROGRAMS + ['epithelial_keratin_program'])} then 'resistance'
 when program='cell_cycle_program' then 'context' end side from act),
sr as (select *, row_number() over (partition by unit_id, side order by score desc, program) r from sd where side is not null),
bal as (select unit_id, round(round(coalesce(sum(case when side='response' and r<=3 then score end),0.0),12),4)::double response_strength,
 round(round(coalesce(sum(case when side='resistance' and r<=3 then score end),0.0),12),4)::double resistance_strength,
 cast(sum((side='response')::int) as bigint) response_count, cast(sum((side='resistance')::int) as bigint) resistance_count from sr group by 1)"""


def balance(activity: DataFrame) -> DataFrame:
    return ft.evidence_balance(activity, fv.RESPONSE_PROGRAMS, [*fv.RESISTANCE_PROGRAMS, "epithelial_keratin_program"])


@query("l24_evidence_balance", f"with {activity_sql(6)},{_BAL} select *, round(round(response_strength-resistance_strength,12),4) net from bal", ("genes",))
def l24(spark, sf):
    return balance(ft.program_activity_rank(views.genes(spark, sf)))


@query("l25_summary_struct", f"""with {activity_sql(6)},{_TOP},
tg as (select unit_id, string_agg(gene||'='||round(value,4)::decimal(18,1)::varchar, ';' order by "rank") top_genes from topg group by 1),
pg as (select unit_id, string_agg(program||'='||"level", ';' order by "rank") programs from act group by 1)
select unit_id, top_genes, coalesce(programs,'') programs from tg left join pg using (unit_id)""", ("genes",))
def l25(spark, sf):
    """Nested summary per unit, read back through its own JSON."""
    profile = views.genes(spark, sf)
    top = ft.top_features(profile).groupBy("unit_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "gene", F.round("value", 4).alias("value")))).alias("top_ranked_genes")
    )
    programs = ft.program_activity_rank(profile).groupBy("unit_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "program", "score", "level"))).alias("program_activity_snapshot")
    )
    nested = top.join(programs, "unit_id", "left").select(
        "unit_id", F.to_json(F.struct("unit_id", "top_ranked_genes", "program_activity_snapshot")).alias("summary")
    )
    schema = (
        "top_ranked_genes array<struct<gene:string,value:double>>,"
        "program_activity_snapshot array<struct<program:string,level:string>>"
    )
    parsed = nested.withColumn("s", F.from_json("summary", schema))
    gene_text = F.transform("s.top_ranked_genes", lambda x: F.concat(x["gene"], F.lit("="), x["value"].cast("string")))
    program_text = F.transform("s.program_activity_snapshot", lambda x: F.concat(x["program"], F.lit("="), x["level"]))
    return parsed.select(
        "unit_id", F.array_join(gene_text, ";").alias("top_genes"),
        F.coalesce(F.array_join(program_text, ";"), F.lit("")).alias("programs"),
    )
