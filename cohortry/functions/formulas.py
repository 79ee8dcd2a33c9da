"""Composite scores as SQL text, evaluated stage by stage.

Every stage may use the columns of earlier stages.  Weights and thresholds are
fixed values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

Stages = Sequence[Mapping[str, str]]


def with_formulas(df: DataFrame, stages: Stages) -> DataFrame:
    for stage in stages:
        df = df.withColumns({name: F.expr(text) for name, text in stage.items()})
    return df


def stages_sql(source: str, stages: Stages, name: str) -> str:
    """CTEs name_0 .. name that compute the same stages in SQL."""
    def decimal_ties(text: str) -> str:
        # the other engine rounds doubles through a product; decimals decide ties alike
        return text.replace("round(round(", "cast(round(cast((").replace(", 12), 4)", ") as decimal(30,12)), 4) as double)")

    parts, current = [], source
    for i, stage in enumerate(stages):
        label = name if i == len(stages) - 1 else f"{name}_{i}"
        columns = ", ".join(f"{decimal_ties(text)} as {col}" for col, text in stage.items())
        parts.append(f"{label} as (select *, {columns} from {current})")
        current = label
    return ",\n".join(parts)


def level(column: str, steps: Sequence[tuple[float, object]], otherwise: object) -> str:
    show = lambda v: f"'{v}'" if isinstance(v, str) else f"{v}"
    arms = " ".join(f"when {column} >= {t} then {show(v)}" for t, v in steps)
    return f"case {arms} else {show(otherwise)} end"


def count_of(*conditions: str) -> str:
    return " + ".join(f"(case when {c} then 1 else 0 end)" for c in conditions)


def r4(text: str) -> str:
    """Four digits; the inner round removes summation noise before a tie is decided."""
    return f"round(round({text}, 12), 4)"


def rounded(names: Sequence[str]) -> dict[str, str]:
    return {f"{n}_r": r4(n) for n in names}


# --- response calibration from expression programs (fixed values) -------------
RESPONSE_CALIBRATION: Stages = [
    {
        "response_high_axes": count_of(
            "cytotoxic_lymphocyte_program >= 0.85", "interferon_gamma_program >= 0.85",
            "b_cell_plasma_program >= 0.85", "chemokine_inflamed_program >= 0.85",
        ),
        "resistance_high_axes": count_of(
            "t_cell_exhaustion_program >= 0.85", "myeloid_inflammation_program >= 0.85",
            "cell_cycle_program >= 0.85", "tgfb_stromal_program >= 0.85",
        ),
        "response_raw": (
            "0.32 * cytotoxic_lymphocyte_program + 0.18 * interferon_gamma_program"
            " + 0.28 * b_cell_plasma_program + 0.07 * chemokine_inflamed_program"
            " + 0.05 * antigen_presentation_program"
        ),
        "resistance_raw": (
            "0.34 * t_cell_exhaustion_program + 0.28 * myeloid_inflammation_program"
            " + 0.28 * cell_cycle_program + 0.1 * tgfb_stromal_program"
        ),
    },
    {
        "calibrated_response_score": r4("response_raw"),
        "calibrated_resistance_score": r4("resistance_raw"),
        "calibrated_net_evidence": r4("response_raw - resistance_raw"),
    },
]

# --- marker relevance and calibration from alterations (fixed values) ---------
RELEVANCE: Stages = [
    {
        "risk_signal_strength": (
            "round(round(antigen_presentation_escape_program + stk11_keap1_resistance_program"
            " + cell_cycle_p53_program + mapk_signaling_program + pi3k_akt_mtor_program"
            " + wnt_beta_catenin_program + 0.12 * n_adverse, 12), 4)"
        ),
        "benefit_signal_strength": (
            "round(round(dna_repair_instability_program + chromatin_remodeling_program"
            " + 0.1 * n_favorable + 0.2 * burden_percentile, 12), 4)"
        ),
    }
]
ALTERATION_CALIBRATION: Stages = [
    {
        "burden_support": level(
            "burden_percentile", [(0.9, 0.95), (0.7, 0.72), (0.5, 0.45), (0.35, 0.25)], 0.05
        ),
        # marker lists are cut at eight entries before they are counted
        "favorable_load": "least(1.0, least(n_favorable, 8) / 3e0)",
        "adverse_load": "least(1.0, least(n_adverse, 8) / 3e0)",
    },
    {
        "adverse_high_axes": count_of(
            "antigen_presentation_escape_program >= 0.55", "stk11_keap1_resistance_program >= 0.55",
            "cell_cycle_p53_program >= 0.55", "mapk_signaling_program >= 0.55",
            "pi3k_akt_mtor_program >= 0.55", "wnt_beta_catenin_program >= 0.55", "adverse_load >= 0.55",
        ),
        "favorable_high_axes": count_of(
            "dna_repair_instability_program >= 0.55", "chromatin_remodeling_program >= 0.55",
            "burden_support >= 0.55", "favorable_load >= 0.55",
        ),
        "dominant_adverse": count_of(
            "antigen_presentation_escape_program >= 0.3", "stk11_keap1_resistance_program >= 0.3",
            "cell_cycle_p53_program >= 0.3", "mapk_signaling_program >= 0.3",
            "pi3k_akt_mtor_program >= 0.3", "wnt_beta_catenin_program >= 0.3",
        ),
        "sparse_profile": (
            "altered_count <= 4 and greatest(antigen_presentation_escape_program,"
            " stk11_keap1_resistance_program, cell_cycle_p53_program, mapk_signaling_program,"
            " pi3k_akt_mtor_program, wnt_beta_catenin_program, adverse_load) < 0.3"
            " and dna_repair_instability_program < 0.3 and chromatin_remodeling_program < 0.55"
            " and n_favorable <= 1"
        ),
        "repair_supported": "dna_repair_instability_program >= 0.3 and burden_support >= 0.6",
        "burden_only": (
            "burden_support >= 0.72 and dna_repair_instability_program < 0.3 and favorable_load < 0.67"
        ),
        "risk_raw": (
            "0.24 * antigen_presentation_escape_program + 0.15 * stk11_keap1_resistance_program"
            " + 0.16 * cell_cycle_p53_program + 0.15 * mapk_signaling_program"
            " + 0.1 * pi3k_akt_mtor_program + 0.12 * wnt_beta_catenin_program + 0.08 * adverse_load"
        ),
        "benefit_raw": (
            "0.3 * dna_repair_instability_program + 0.22 * chromatin_remodeling_program"
            " + 0.3 * burden_support + 0.18 * favorable_load"
        ),
    },
    {
        "net_raw": "risk_raw - benefit_raw",
        "ultra_favorable": (
            "dna_repair_instability_program >= 0.5"
            " or (repair_supported and chromatin_remodeling_program >= 0.5)"
            " or (dna_repair_instability_program >= 0.3 and favorable_load >= 0.67 and burden_support >= 0.6)"
        ),
    },
    {
        "strong_favorable": (
            "ultra_favorable or (chromatin_remodeling_program >= 0.5"
            " and dna_repair_instability_program >= 0.15 and burden_support >= 0.6)"
        ),
    },
    {
        "high_risk_ready": (
            "not strong_favorable and not burden_only and net_raw >= 0.03 and ("
            "(stk11_keap1_resistance_program >= 0.3 and cell_cycle_p53_program >= 0.3)"
            " or (antigen_presentation_escape_program >= 0.3 and (cell_cycle_p53_program >= 0.16"
            " or mapk_signaling_program >= 0.16 or pi3k_akt_mtor_program >= 0.16))"
            " or (dominant_adverse >= 2 and adverse_load >= 0.67)"
            " or (net_raw >= 0.08 and adverse_load >= 1.0 and not sparse_profile))"
        ),
        "calibrated_risk_score": r4("risk_raw"),
        "calibrated_benefit_score": r4("benefit_raw"),
        "calibrated_net_risk": r4("net_raw"),
    },
]

# --- ecology of bulk expression (fixed values) ---------------------------------
_SIGNAL = [(0.8, "very_high"), (0.68, "high"), (0.55, "moderate"), (0.4, "mild")]
ECOLOGY: Stages = [
    {
        "inflamed": (
            "(interferon_gamma_program + antigen_presentation_program + cytotoxic_lymphocyte_program"
            " + chemokine_inflamed_program) / 4"
        ),
        "suppressive": (
            "(myeloid_inflammation_program + tgfb_stromal_program + t_cell_exhaustion_program) / 3"
        ),
        "strong_protective": count_of(
            "interferon_gamma_program >= 0.8", "antigen_presentation_program >= 0.8",
            "cytotoxic_lymphocyte_program >= 0.8", "chemokine_inflamed_program >= 0.8",
        ),
        "strong_adverse": count_of(
            "myeloid_inflammation_program >= 0.78", "tgfb_stromal_program >= 0.78",
            "t_cell_exhaustion_program >= 0.78", "cell_cycle_program >= 0.78",
        ),
        "protective_axes": count_of(
            "interferon_gamma_program >= 0.72", "antigen_presentation_program >= 0.72",
            "cytotoxic_lymphocyte_program >= 0.72", "chemokine_inflamed_program >= 0.72",
        ),
        "adverse_axes": count_of(
            "myeloid_inflammation_program >= 0.72", "tgfb_stromal_program >= 0.72",
            "t_cell_exhaustion_program >= 0.72", "cell_cycle_program >= 0.72",
        ),
        "favorability": (
            "0.36 * antigen_presentation_program + 0.28 * cytotoxic_lymphocyte_program"
            " + 0.2 * interferon_gamma_program + 0.16 * chemokine_inflamed_program"
        ),
        "barrier": (
            "0.44 * tgfb_stromal_program + 0.34 * myeloid_inflammation_program"
            " + 0.22 * t_cell_exhaustion_program"
        ),
        "reserve": (
            "0.5 * antigen_presentation_program + 0.3 * cytotoxic_lymphocyte_program"
            " + 0.2 * chemokine_inflamed_program - 0.18 * t_cell_exhaustion_program"
        ),
    },
    {
        "escape": "0.7 * cell_cycle_program + 0.3 * greatest(0.0, barrier - favorability)",
        "gap": "favorability - barrier",
        "balance": "inflamed - suppressive",
        "exclusion_gap": "suppressive - inflamed",
    },
    {
        "reserve_gap": "reserve - escape",
        "net": (
            "0.34 * barrier + 0.26 * cell_cycle_program + 0.14 * t_cell_exhaustion_program"
            " + 0.08 * greatest(0.0, escape - 0.62) - 0.24 * reserve - 0.16 * favorability"
        ),
    },
    {
        "inflamed_level": level("inflamed", _SIGNAL, "low"),
        "suppressive_level": level("suppressive", _SIGNAL, "low"),
        "proliferative_level": level("cell_cycle_program", _SIGNAL, "low"),
        "net_direction": (
            "case when net >= 0.18 then 'strongly_adverse' when net >= 0.06 then 'adverse_leaning'"
            " when net <= -0.12 then 'strongly_favorable' when net <= -0.03 then 'favorable_leaning'"
            " else 'balanced' end"
        ),
        **rounded(
            ["inflamed", "suppressive", "favorability", "barrier", "reserve", "escape", "gap",
             "reserve_gap", "balance", "exclusion_gap", "net"]
        ),
    },
]
ECOLOGY_STATES: Stages = [
    {
        "near_zero": "net_r between -0.03 and 0.08",
        "excluded_inflamed": (
            "favorability_r >= 0.72 and barrier_r >= 0.74 and gap_r <= 0.04 and reserve_r >= 0.66"
        ),
        "stromal_dominant": (
            "tgfb_stromal_program >= 0.8 and barrier_r >= 0.74 and gap_r < 0.0 and reserve_r < 0.74"
        ),
        "myeloid_exhausted": (
            "myeloid_inflammation_program >= 0.74 and t_cell_exhaustion_program >= 0.68"
            " and reserve_r < 0.72 and balance_r <= 0.1"
        ),
        "proliferative_escape": (
            "cell_cycle_program >= 0.72 and escape_r >= 0.68 and reserve_gap_r <= 0.06 and balance_r <= 0.08"
        ),
    },
    {
        "favorable_ready": (
            "favorability_r >= 0.74 and reserve_r >= 0.74 and antigen_presentation_program >= 0.76"
            " and gap_r >= -0.02 and reserve_gap_r >= 0.12 and cell_cycle_program < 0.62"
            " and adverse_axes <= 1 and not excluded_inflamed"
        ),
        "low_blocked": (
            "excluded_inflamed or stromal_dominant or proliferative_escape"
            " or (strong_adverse >= 2 and suppressive_r >= 0.58 and gap_r < 0.02)"
        ),
    },
    {
        "low_ready": (
            "favorable_ready and inflamed_r >= 0.72 and suppressive_r < 0.6 and cell_cycle_program < 0.58"
            " and strong_adverse <= 1 and net_r <= 0.0 and not low_blocked"
        ),
        "high_ready": (
            "(stromal_dominant and cell_cycle_program >= 0.66 and net_r >= 0.12)"
            " or (myeloid_exhausted and net_r >= 0.1 and reserve_r < 0.68)"
            " or (proliferative_escape and barrier_r >= 0.62 and net_r >= 0.12)"
            " or (adverse_axes >= 3 and barrier_r >= 0.68 and gap_r < 0.0 and net_r >= 0.14)"
        ),
    },
    {
        "mixed_profile": (
            "not low_ready and not high_ready and ((excluded_inflamed and reserve_r >= 0.7 and net_r <= 0.18)"
            " or (gap_r between -0.02 and 0.08 and net_r between 0.02 and 0.14)"
            " or (strong_protective >= 2 and strong_adverse >= 2 and net_r between 0.0 and 0.18)"
            " or (reserve_gap_r between 0.08 and 0.2 and net_r between 0.0 and 0.12))"
        ),
    },
]

# --- repertoire toxicity (fixed values) ------------------------------------------
_TOX = [(0.66, "high"), (0.4, "moderate")]
TOXICITY: Stages = [
    {
        "autoreactivity": (
            "0.28 * aromatic_fraction + 0.22 * basic_fraction + 0.16 * glycine_proline_fraction"
            " + 0.1 * cysteine_fraction + 0.12 * top5_share + 0.12 * boundary_fraction"
        ),
        "tolerance": (
            "0.24 * polar_fraction + 0.2 * acidic_fraction + 0.22 * normalized_entropy"
            " + 0.16 * (1.0 - top5_share) + 0.1 * complexity_mean + 0.08 * rarity_weighted_mean"
        ),
        "clonal_focus": "0.65 * top5_share + 0.35 * (1.0 - normalized_entropy)",
        "instability": (
            "0.32 * boundary_fraction + 0.24 * repeat_fraction + 0.22 * cysteine_fraction"
            " + 0.22 * glycine_proline_fraction"
        ),
        "skew": "0.52 * top1_share + 0.3 * top3_share + 0.18 * top5_share - 0.34 * normalized_entropy",
        "burden": (
            "0.4 * total_percentile + 0.14 * (1.0 - richness_percentile) + 0.24 * top3_share"
            " + 0.22 * top5_share"
        ),
        "reactive_score": (
            "0.32 * reactive_fraction + 0.28 * aromatic_fraction + 0.18 * basic_fraction"
            " + 0.12 * cysteine_fraction + 0.1 * boundary_fraction"
        ),
        "common_penalty": (
            "0.54 * common_reactive_fraction + 0.26 * greatest(0.0, reactive_fraction - rare_reactive_fraction)"
            " + 0.2 * greatest(0.0, top5_share - top3_share)"
        ),
        "diversity": (
            "0.24 * regulatory_fraction + 0.24 * polar_fraction + 0.12 * acidic_fraction"
            " + 0.24 * normalized_entropy + 0.16 * complexity_mean"
        ),
    },
    {
        "rare_burden": (
            "0.38 * rare_reactive_fraction + 0.18 * rarity_weighted_mean + 0.26 * skew + 0.18 * burden"
        ),
    },
    {
        "toxicity_index": (
            "0.26 * skew + 0.2 * burden + 0.14 * autoreactivity + 0.12 * clonal_focus + 0.12 * instability"
            " + 0.08 * reactive_score + 0.08 * rare_burden - 0.18 * tolerance - 0.12 * diversity"
            " - 0.06 * common_penalty"
        ),
    },
    {
        "net_toxicity": (
            "0.3 * toxicity_index + 0.24 * autoreactivity + 0.14 * clonal_focus + 0.1 * instability"
            " - 0.22 * tolerance"
        ),
    },
    {
        "autoreactivity_level": level("autoreactivity", _TOX, "low"),
        "tolerance_level": level("tolerance", _TOX, "low"),
        "burden_level": level("burden", _TOX, "low"),
        "near_zero_toxicity": "net_toxicity between -0.015 and 0.06",
        "low_toxicity_ready": (
            "diversity >= 0.36 and common_penalty <= 0.08 and rare_burden < 0.1 and skew < 0.05"
            " and net_toxicity <= 0.0"
        ),
        "high_toxicity_ready": (
            "(skew >= 0.055 and burden >= 0.28 and toxicity_index >= 0.02)"
            " or (autoreactivity >= 0.295 and clonal_focus >= 0.155 and toxicity_index >= 0.015)"
        ),
        "mixed_toxicity": (
            "toxicity_index between -0.005 and 0.02"
            " or (net_toxicity between -0.005 and 0.04 and rare_burden between 0.075 and 0.11)"
            " or (reactive_score >= 0.22 and diversity >= 0.34)"
        ),
        **rounded(
            ["autoreactivity", "tolerance", "clonal_focus", "instability", "skew", "burden",
             "reactive_score", "rare_burden", "common_penalty", "diversity", "toxicity_index", "net_toxicity"]
        ),
    },
]

# --- decisions -------------------------------------------------------------------
MARGIN_THRESHOLDS = {"biopsy": 0.04, "bulk": 0.12, "repertoire": 0.0}


def margin_decision(support: str, resistance: str, threshold: str) -> Stages:
    """Margin rule with confidence clip(.5 + .9 * distance, .5, .95)."""
    return [
        {"margin": f"{support} - {resistance}"},
        {
            "prediction": f"case when margin >= {threshold} then 'positive' else 'negative' end",
            "confidence": r4(f"greatest(0.5, least(0.95, 0.5 + 0.9 * abs(margin - {threshold})))"),
            "score_margin": r4("margin"),
        },
    ]


RISK_GROUP = "case when risk >= 0.67 then 'high' when risk <= 0.33 then 'low' else 'intermediate' end"


def risk_decision(score: str) -> Stages:
    return [
        {"risk": f"greatest(0.0, least(1.0, {score}))"},
        {
            "risk_group": RISK_GROUP,
            "risk_score": r4("risk"),
            "confidence": r4("greatest(0.5, least(0.95, 0.5 + 0.9 * abs(risk - 0.5)))"),
        },
    ]


# --- ordered recalibration cascade (fixed values) -----------------------------------
RECALIBRATION: Stages = [
    {
        "low_candidate": (
            "not low_blocked and (low_ready or (favorable_ready and inflamed_r >= 0.8 and suppressive_r < 0.58"
            " and cell_cycle_program < 0.64 and strong_adverse <= 1 and net_r <= -0.02))"
        ),
    },
    {"t_low": "low_candidate and risk0 > 0.33"},
    {"risk1": "case when t_low then least(risk0, case when net_r <= -0.08 then 0.24 else 0.3 end) else risk0 end"},
    {
        "t_guard": (
            "risk1 >= 0.67 and inflamed_r >= 0.76 and reserve_r >= 0.68 and strong_protective >= 3"
            " and net_r < 0.16 and barrier_r < 0.68 and (not high_ready or mixed_profile or excluded_inflamed"
            " or (net_r between 0.02 and 0.12 and inflamed_r >= 0.82))"
        ),
    },
    {"risk2": "case when t_guard then least(risk1, case when near_zero then 0.6 else 0.63 end) else risk1 end"},
    {
        "t_promote": (
            "risk2 < 0.67 and ((high_ready and adverse_axes >= 2 and barrier_r >= 0.66 and net_r >= 0.14"
            " and (stromal_dominant or myeloid_exhausted or proliferative_escape))"
            " or (adverse_axes >= 3 and strong_adverse >= 2 and escape_r >= 0.7 and barrier_r >= 0.68"
            " and net_r >= 0.16 and reserve_r < 0.68))"
        ),
    },
    {"risk3": "case when t_promote then greatest(risk2, case when net_r >= 0.2 then 0.72 else 0.68 end) else risk2 end"},
    {
        "t_lift": (
            "not t_promote and (adverse_axes >= 2 or excluded_inflamed or proliferative_escape)"
            " and net_r >= 0.06 and risk3 < 0.64"
        ),
    },
    {"risk4": "case when t_lift then greatest(risk3, case when net_r >= 0.12 then 0.64 else 0.6 end) else risk3 end"},
    {
        "last_rule": (
            "case when low_candidate or t_promote or t_lift then null"
            " when near_zero then 'compress_near_zero'"
            " when favorable_ready and reserve_r >= 0.68 and risk4 > 0.5 then 'spread_favorable_intermediate'"
            " when net_r between -0.02 and 0.06 and risk4 > 0.64 then 'soften_borderline_high'"
            " when net_r between 0.02 and 0.08 then 'spread_intermediate_mid'"
            " when net_r > 0.08 and net_r < 0.14 and risk4 > 0.66 then 'cap_borderline_high' end"
        ),
    },
    {
        "recalibrated": (
            "greatest(0.0, least(1.0, round(case last_rule"
            " when 'compress_near_zero' then least(greatest(risk4, 0.5), 0.58)"
            " when 'spread_favorable_intermediate' then least(risk4, 0.48)"
            " when 'soften_borderline_high' then 0.62"
            " when 'spread_intermediate_mid' then least(greatest(risk4, 0.52), 0.58)"
            " when 'cap_borderline_high' then 0.64 else risk4 end, 4)))"
        ),
        "tags": (
            "concat_ws(',', case when t_low then 'release_low_risk' end,"
            " case when t_guard then 'suppress_false_high' end,"
            " case when t_promote then 'promote_true_high' end,"
            " case when t_lift then 'lift_moderate_adverse' end, last_rule)"
        ),
    },
]
