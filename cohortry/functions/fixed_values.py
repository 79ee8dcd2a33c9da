"""Fixed values.

Word lists, weights and thresholds below must equal the published ones for the
results to be right.  They are plain constants; every operator also takes its
table as a parameter.
"""

# --- expression programs: gene symbols per program (fixed values) -----------
EXPRESSION_PROGRAMS = {
    "interferon_gamma_program": (
        "B2M CXCL9 CXCL10 CXCL11 GBP1 HLA-A HLA-B HLA-C IDO1 IFI27 IFIT1 IFIT2 IFIT3 IRF1 ISG15 "
        "PSMB8 PSMB9 STAT1 TAP1"
    ).split(),
    "antigen_presentation_program": (
        "B2M HLA-A HLA-B HLA-C HLA-DPA1 HLA-DPB1 HLA-DRA HLA-DRB1 PSMB8 PSMB9 TAP1 TAP2"
    ).split(),
    "cytotoxic_lymphocyte_program": (
        "CD2 CD3D CD3E CD8A CD8B EOMES GNLY GZMA GZMB GZMK IFNG NKG7 PRF1"
    ).split(),
    "t_cell_exhaustion_program": "CTLA4 ENTPD1 HAVCR2 LAG3 PDCD1 TIGIT TOX".split(),
    "chemokine_inflamed_program": "CCL4 CCL5 CXCL9 CXCL10 CXCL11 CXCR3 STAT1".split(),
    "b_cell_plasma_program": "BANK1 BLK CD19 CD22 CD79A CD79B MZB1 MS4A1 SDC1".split(),
    "myeloid_inflammation_program": (
        "CCR1 CCR2 CD14 CXCL8 FCGR3A IL1B LILRB1 S100A8 S100A9 TYMP"
    ).split(),
    "tgfb_stromal_program": (
        "ACTA2 COL1A1 COL1A2 COL3A1 COL5A1 FAP FN1 MMP2 TAGLN TGFB1 VIM"
    ).split(),
    "epithelial_keratin_program": "EPCAM KRT1 KRT5 KRT8 KRT10 KRT14 KRT18 KRT19".split(),
    "cell_cycle_program": (
        "AURKA BIRC5 CCNB1 CDC20 CDC6 CDK1 CENPF MKI67 PCNA TOP2A UBE2C"
    ).split(),
}

# --- expression themes (fixed values) ---------------------------------------
EXPRESSION_THEMES = {
    "interferon_response": (
        "STAT1 STAT2 IRF1 IRF7 IFI6 IFI27 IFI35 IFI44 IFI44L IFIT1 IFIT2 IFIT3 IFITM1 ISG15 MX1 "
        "OAS1 OAS2 RSAD2"
    ).split(),
    "antigen_presentation": (
        "B2M HLA-A HLA-B HLA-C HLA-DRA HLA-DRB1 HLA-E PSMB8 PSMB9 TAP1 TAP2"
    ).split(),
    "cytotoxic_effector": "CD8A CD8B EOMES GNLY GZMA GZMB IFNG NKG7 PRF1".split(),
    "t_cell_activation": (
        "CD2 CD3D CD3E CD27 CD28 CXCL9 CXCL10 CXCL11 ICOS PDCD1 TIGIT"
    ).split(),
    "b_cell_plasma": "BANK1 BLK CD19 CD22 CD79A CD79B MZB1 MS4A1 SDC1".split(),
    "myeloid_inflammation": (
        "CCR1 CCR2 CD14 CXCL8 FCGR3A IL1B LILRB1 S100A8 S100A9 TYMP"
    ).split(),
    "stroma_emt": "ACTA2 COL1A1 COL1A2 COL3A1 COL5A1 FAP FN1 MMP2 TAGLN VIM".split(),
    "cell_cycle": "AURKA BIRC5 CCNB1 CDC20 CDK1 CENPF MKI67 TOP2A UBE2C".split(),
}

# Bulk-expression variant: same themes with these differences (fixed values).
BULK_THEMES = {
    "interferon_response": (
        "STAT1 STAT2 IRF1 IRF7 IFI6 IFI27 IFI35 IFI44 IFI44L IFIH1 IFIT1 IFIT2 IFIT3 IFITM1 ISG15 "
        "MX1 MX2 OAS1 OAS2 OAS3 RSAD2"
    ).split(),
    "antigen_presentation": EXPRESSION_THEMES["antigen_presentation"],
    "cytotoxic_effector": "CD8A CD8B EOMES GNLY GZMA GZMB GZMH IFNG NKG7 PRF1".split(),
    "t_cell_activation": (
        "CD2 CD3D CD3E CD27 CD28 CXCL9 CXCL10 CXCL11 ICOS LAG3 PDCD1 TIGIT"
    ).split(),
    "b_cell_signature": "BANK1 BLK CD19 CD22 CD79A CD79B MS4A1 MZB1".split(),
    "myeloid_inflammation": EXPRESSION_THEMES["myeloid_inflammation"],
    "stroma_emt": "ACTA2 COL1A1 COL1A2 COL3A1 COL5A1 FN1 MMP2 TAGLN VIM".split(),
    "cell_cycle": "AURKA BIRC5 CCNB1 CDC20 CDC6 CDK1 CENPF MKI67 PCNA TOP2A UBE2C".split(),
}
PREFIX_THEMES = {
    "SNORA": "small_nucleolar_rna",
    "SNORD": "small_nucleolar_rna",
    "SCARNA": "small_cajal_body_rna",
    "MT-": "mitochondrial_transcript",
    "KRT": "epithelial_keratinization",
    "ACT": "cytoskeleton_actin",
    "RPL": "ribosomal_large_subunit",
    "RPS": "ribosomal_small_subunit",
}
GENERIC_GENE_PREFIXES = ["RPL", "RPS", "MT-"]
GENERIC_GENES = (
    "ACTB ACTG1 B2M EEF1A1 GAPDH HSP90AA1 HSP90AB1 MALAT1 TMSB10 TMSB4X UBB UBC"
).split()

# --- alteration themes and programs (fixed values) ---------------------------
ALTERATION_THEMES = {
    "immune_escape": "B2M HLA-A HLA-B IFNGR1 JAK1 JAK2 JAK3".split(),
    "checkpoint_axis": "CD274 CTLA4 PDCD1 ICOSLG IL10".split(),
    "mapk_signaling": (
        "ALK ARAF BRAF EGFR ERBB2 ERBB3 ERBB4 FGFR1 FGFR2 FGFR3 FGFR4 HRAS KRAS MAP2K1 MAP2K2 MET "
        "NF1 NRAS RET ROS1"
    ).split(),
    "pi3k_akt_mtor": (
        "AKT1 AKT2 AKT3 INPP4A INPP4B INPPL1 MTOR PDPK1 PIK3CA PIK3CB PIK3CD PIK3CG PIK3R1 PIK3R2 "
        "PIK3R3 PTEN TSC1 TSC2"
    ).split(),
    "cell_cycle_p53": (
        "AURKA AURKB CCND1 CCND2 CCND3 CCNE1 CDK4 CDK6 CDKN1A CDKN1B CDKN2A CDKN2B CDKN2C CHEK1 "
        "CHEK2 MDM2 MDM4 MYC RB1 TP53"
    ).split(),
    "dna_repair": (
        "ATM ATR BAP1 BARD1 BRCA1 BRCA2 BRIP1 CHEK1 CHEK2 ERCC2 ERCC3 ERCC4 ERCC5 FANCA FANCC MLH1 "
        "MSH2 MSH3 MSH6 MUTYH NBN PALB2 PMS1 PMS2 POLE POLD1 RAD51 SETD2"
    ).split(),
    "chromatin_remodeling": (
        "ARID1A ARID1B ARID2 ASXL1 ASXL2 ATRX BAP1 CREBBP DNMT3A EP300 EZH2 KDM5C KDM6A KMT2A KMT2B "
        "KMT2C KMT2D PBRM1 SETD2 SMARCA4"
    ).split(),
    "wnt_beta_catenin": "APC AXIN1 AXIN2 CTNNB1 FAT1 RNF43".split(),
    "rtk_growth_factor": (
        "CSF1R EGFR EPHA3 EPHA5 EPHA7 EPHB1 ERBB2 ERBB3 ERBB4 FGFR1 FGFR2 FGFR3 FGFR4 FLT1 FLT3 FLT4 "
        "HGF IGF1R INSR KDR KIT MET PDGFRA PDGFRB RET ROS1"
    ).split(),
}
ALTERATION_PROGRAMS = {
    "antigen_presentation_escape_program": "B2M HLA-A HLA-B IFNGR1 JAK1 JAK2 JAK3".split(),
    "stk11_keap1_resistance_program": "KEAP1 NFE2L2 STK11".split(),
    "mapk_signaling_program": (
        "BRAF EGFR ERBB2 FGFR1 FGFR2 FGFR3 FGFR4 HRAS KRAS MAP2K1 MAP2K2 MET NF1 NRAS RET ROS1"
    ).split(),
    "pi3k_akt_mtor_program": (
        "AKT1 AKT2 AKT3 MTOR PDPK1 PIK3CA PIK3CB PIK3CD PIK3CG PIK3R1 PIK3R2 PIK3R3 PTEN TSC1 TSC2"
    ).split(),
    "cell_cycle_p53_program": (
        "AURKA AURKB CCND1 CCND2 CCND3 CCNE1 CDK4 CDK6 CDKN2A MDM2 MDM4 MYC RB1 TP53"
    ).split(),
    "dna_repair_instability_program": (
        "ATM ATR BRCA1 BRCA2 BRIP1 CHEK1 CHEK2 FANCA FANCC MLH1 MSH2 MSH6 PMS2 POLE POLD1"
    ).split(),
    "chromatin_remodeling_program": (
        "ARID1A ARID1B ARID2 ATRX CREBBP EP300 KDM5C KDM6A KMT2C KMT2D PBRM1 SETD2 SMARCA4 VHL"
    ).split(),
    "wnt_beta_catenin_program": "APC AXIN1 AXIN2 CTNNB1 FAT1 RNF43".split(),
}
ADVERSE_GENES = (
    "B2M CTNNB1 EGFR HLA-A HLA-B IFNGR1 JAK1 JAK2 KEAP1 KRAS MDM2 MET MYC PIK3CA PTEN RB1 STK11 TP53"
).split()
FAVORABLE_GENES = (
    "ARID2 ATM BRCA1 BRCA2 MLH1 MSH2 MSH6 PBRM1 POLE POLD1 PMS2 SETD2 VHL"
).split()
PRIORITY_GENES = "POLE POLD1 PBRM1 STK11 KEAP1 TP53".split()

# --- roles of programs (fixed values) ----------------------------------------
RESPONSE_PROGRAMS = (
    "interferon_gamma_program antigen_presentation_program cytotoxic_lymphocyte_program "
    "chemokine_inflamed_program b_cell_plasma_program"
).split()
RESISTANCE_PROGRAMS = (
    "tgfb_stromal_program t_cell_exhaustion_program myeloid_inflammation_program"
).split()
PROTECTIVE_PROGRAMS = (
    "interferon_gamma_program antigen_presentation_program cytotoxic_lymphocyte_program "
    "chemokine_inflamed_program"
).split()
ADVERSE_PROGRAMS = (
    "myeloid_inflammation_program tgfb_stromal_program t_cell_exhaustion_program cell_cycle_program"
).split()

# --- level cut-offs, highest first (fixed values) -----------------------------
ACTIVITY_LEVELS = [(0.85, "very_high"), (0.72, "high"), (0.6, "moderate")]
OVERLAP_LEVELS = [(0.8, "very_high"), (0.5, "high"), (0.3, "moderate")]
BURDEN_LEVELS = [(0.9, "very_high"), (0.7, "high"), (0.35, "intermediate")]
BURDEN_SUPPORT = [(0.9, 0.95), (0.7, 0.72), (0.5, 0.45), (0.35, 0.25)]
SIGNAL_LEVELS = [(0.8, "very_high"), (0.68, "high"), (0.55, "moderate"), (0.4, "mild")]
TOXICITY_LEVELS = [(0.66, "high"), (0.4, "moderate")]

# --- repertoire chemistry (fixed values) --------------------------------------
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
RESIDUE_CLASSES = {
    "aromatic": "FYW",
    "basic": "KRH",
    "acidic": "DE",
    "polar": "STNQ",
    "glycine_proline": "GP",
    "cysteine": "C",
    "hydrophobic": "AVILM",
}
REACTIVE_TAGS = ["aromatic", "basic", "glycine_proline", "cysteine", "boundary", "repeat"]
REGULATORY_TAGS = ["polar", "acidic"]
RULE_WEIGHTS = {
    "basic_fraction": 2.0,
    "glycine_proline_fraction": 1.5,
    "acidic_fraction": 1.2,
    "hydrophobic_fraction": 1.0,
    "polar_fraction": -1.2,
    "regulatory_motif_fraction": -1.0,
    "top1_share": -1.2,
}

# --- reporting thresholds (fixed values) --------------------------------------
MIN_N, MIN_EVENTS, MIN_PAIRS, MIN_FOLDS = 40, 20, 100, 4
FORBIDDEN_FIELDS = (
    "sample_id patient_id group_id dataset dataset_name task_name prompt_version duration "
    "survival_time event event_status fold true_label outcome label response_support_score risk_score"
).split()
