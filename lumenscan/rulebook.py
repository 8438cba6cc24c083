"""Rule parameters.

The dictionaries keep the key names of the parameter documents users already have, so a user's own document can
replace an entry as it is: ``rules = {**RULES, "c1": doc["parameters"]}``.
"""
from __future__ import annotations

# ---------------------------------------------------------------------------------------------------------------
# Fixed values. Everything in this block must equal the published rule parameters for results to agree.
# ---------------------------------------------------------------------------------------------------------------
WL_TOL = 1e-6

GRID = {"start_nm": 350.0, "step_nm": 1.0, "n": 2151}

KERNEL_E31 = {"absorbance_clip": 1e-6, "savgol": {"window": 31, "polyorder": 3, "deriv": 2, "delta": 1.0}, "scale": -1e5}
KERNEL_N17 = {"absorbance_clip": 1e-3, "savgol": {"window": 17, "polyorder": 2, "deriv": 2, "delta": 1.0}, "scale": -1e5}

N2_CLIP = 1e-4
N2_MAD_FACTOR = 1.4826
N2_UNITS = 1e5
N2_WINDOWS = [(2000.0, 2100.0), (1500.0, 1600.0), (1500.0, 1550.0), (2300.0, 2400.0)]

ACQUISITION = {
    "input_matrix": {
        "file_magic": ["as8", "as7", "ASD"],
        "data_type_by_magic": {"as8": 0, "as7": 0, "ASD": 1},
        "require_dark_corrected_magic": ["as8"],
        "grid": GRID,
        "reference_range_nm": [1000, 2450],
        "join_windows_nm": [[950.0, 1050.0], [1700.0, 1900.0]],
    },
    "default_joins_nm": [1000.0, 1800.0],
    "join_jump_clear": 3.0,
    "join_jump_min": 0.01,
    "integrity_range_nm": [1000, 2450],
    "B2_saturation": {"dn_at_least": 65000, "flat_top_run": 3},
    "B3_impossible": {"r_at_most": 0.0},
    "B4_panel_or_empty": {"panel_mean_range": [0.95, 1.05], "panel_sd_below": 0.03, "empty_mean_below": 0.03},
    "B5_dark": {"mean_R_below": 0.08},
    "B6_noise": {"cuts": [0.5, 3.0], "check_if_cut_within_sd": 2.6},
    "B6b_signs_gate": {
        "n2_window_nm": [2000, 2100],
        "signs": ["plaster", "wax", "ester", "burnt", "C1"],
        "contaminant_signs": ["plaster", "wax", "ester", "C1"],
        "uncorrected_n2_above": 60.0,
        "std_like_within": 0.15,
        "corrected": {
            "plaster": {"statistic": "plaster_1945", "n2_window_nm": [2000, 2100], "sd_above": 0.02828399202273366},
            "wax": {"statistic": "wax_1766", "n2_window_nm": [1500, 1600], "sd_above": 2.1095118686937884},
            "ester": {"statistic": "ester_2254", "n2_window_nm": [2220, 2245], "sd_above": 7.80219477122152},
            "burnt": None,
            "C1": {"statistic": "c1", "n2_window_nm": [2000, 2100], "sd_above": 1.8171613293840232},
        },
        "fallbacks": {
            "plaster": {"variant": "band_1446", "statistic": "plaster_1446", "n2_window_nm": [1500, 1600],
                        "sd_at_most": 0.008695836931998813},
            "C1": {"variant": "swir1", "statistic": "c1_swir1", "n2_window_nm": [1500, 1600],
                   "sd_at_most": 0.7879697644590612},
        },
        "correlation_nm": 1.25,
        "statistics": {
            "plaster_1945": {"kernel": "signs", "windows": [[1942, 1948, 0.006050062389121104],
                                                            [1930, 1935, -0.003025031194560552],
                                                            [1955, 1960, -0.003025031194560552]]},
            "wax_1766": {"kernel": "signs", "windows": [[1763, 1769, 1.0], [1751, 1757, -0.5], [1775, 1781, -0.5]]},
            "ester_2254": {"kernel": "signs", "windows": [[2251, 2257, 1.0], [2239, 2245, -0.5], [2263, 2269, -0.5]]},
            "c1": {"kernel": "c1", "windows": [[1726, 1730, 1.0], [1760, 1764, 1.0], [2260, 2264, 1.0],
                                               [2348, 2352, 1.0], [1508, 1512, -0.7237030866308519],
                                               [2042, 2046, -0.7237030866308519],
                                               [2173, 2177, -0.7237030866308519]]},
            "plaster_1446": {"kernel": "signs", "windows": [[1444, 1448, 0.007310342683907804],
                                                            [1434, 1438, -0.003655171341953902],
                                                            [1454, 1458, -0.003655171341953902]]},
            "c1_swir1": {"kernel": "c1", "windows": [[1726, 1730, 1.0], [1760, 1764, 1.0],
                                                     [1508, 1512, -2.368329199992467]]},
        },
    },
    "B7_above_one": {"range_offsets_nm": [1, 0], "max_R_above": 1.0},
    "B8_splice_step": {"fit_points_lower": 5, "fit_points_upper": 6, "note_above": 0.05, "check_above": 0.15},
}

EVIDENCE = {
    "kernel": KERNEL_E31,
    "core_bands": ["CH1728", "CH1689", "CH2262", "AM2175", "NH1545c"],
    "extra_band": "NH2044",
    "extra_band_faint_u": 0.0,
    "readability": {"sd_max_u": 0.25, "unreadable_only_if_u_below": 1.5},
    "thresholds_u": {"clear": 1.5, "strong": 4.0},
    "guard": {"window_nm": [1675, 1770], "max_E_below": 1.5},
    "none_rule": {"must_be_readable": ["CH1728", "AM2175"], "min_readable_core": 3, "extra_band_max_u": 0.0},
    "nh_type_bands": ["AM2175", "NH2044"],
    "nh_type_min_u": 1.5,
    "clear_min_lit_core": 3,
}

ZOOMS_PATTERNS = {
    "kernel": KERNEL_E31,
    "protein_bands": ["NH2044", "AM2175"],
    "ch_bands": ["CH1689", "CH1728", "CH2262", "CH2284"],
    "lit_if_E_above": 0.0,
    "readability": {"sd_max_frac_w": 0.25, "unreadable_only_if_E_below_frac_w": 1.5},
    "vote": {"band": "NH1545c", "lit_if_u_above": 1.25, "from_verdict": "Unlikely", "to_verdict": "Borderline"},
}

SIGNS = {
    "kernel": KERNEL_N17,
    "plaster": {
        "bands": [
            {"sharp": [1446, 2, 8, 12], "fauna_median": -3.471468164711178, "plaster_contrast": 136.7924929430862},
            {"sharp": [1945, 3, 10, 15], "fauna_median": -2.4107746203449807, "plaster_contrast": 165.2875517115569},
        ],
        "fires_if_joint_load_above": 0.04859387541885367,
        "reduced_1446": {"sharp": [1446, 2, 8, 12], "fauna_median": -3.471468164711178,
                         "plaster_contrast": 136.7924929430862, "fires_if_load_above": 0.044254707664456654},
    },
    "wax": {"all_of": [{"sharp": [1766, 3, 9, 15], "at_least": 10.0}, {"sharp": [1217, 3, 9, 15], "at_least": 4.0}]},
    "ester": {"sharp": [2254, 3, 9, 15], "at_least": 35.0},
    "soft_tier": {"ester": {"at_least": 13.1}, "plaster": {"joint_load_at_least": 0.026},
                  "requires_no_hard_sign": ["plaster", "wax", "ester", "C1"],
                  "otherwise_n2_window_nm": [2000, 2100], "otherwise_sd_at_most": 0.8722374381043311},
}

C1 = {
    "kernel": KERNEL_E31,
    "read_half_width_nm": 2,
    "ch_bands_nm": [1728, 1762, 2262, 2350],
    "nh_bands_nm": [1510, 2044, 2175],
    "a": 2.048979435668694,
    "b": 0.7237030866308519,
    "fires_if_excess_above": 8.0,
    "film": {"peak_nm": 2299, "trough_nm": 2325, "half_width_nm": 3, "fires_if_at_least": 17.8},
    "runs_only_if_not_fired": ["plaster", "wax", "ester"],
    "soft_tier": {"excess_at_least": 6.6},
    "truncated": {"ch_bands_nm": [1728, 1762, 2262], "nh_bands_nm": [1510, 2044, 2175], "a": 3.7984583230957534,
                  "b": 0.6310989707028958, "fires_if_excess_above": 7.5, "soft_tier": {"excess_at_least": 6.1}},
    "swir1": {"ch_bands_nm": [1728, 1762], "nh_bands_nm": [1510], "a": 3.6137328146932295, "b": 2.368329199992467,
              "fires_if_excess_above": 10.8},
}

HEAT = {
    "charred": {"scan_from_nm": 450, "reference_nm": [1250, 1300], "fraction": 0.5, "edge50_at_least_nm": 969.1812},
    "calcined": {"OH1433": {"sharp": [1433, 2, 9, 13], "at_least": 90.02670822216136},
                 "OH979": {"sharp": [979, 2, 8, 12], "at_least": 4.475763472609483},
                 "R_vis": {"range_nm": [450, 700], "at_least": 0.103380825435112}},
}

LONGWAVE = {
    "n2_window_nm": [2300, 2400],
    "tail_statistic": {"kernel": "c1", "windows": [[2348, 2352, 1.0]]},
    "correlation_nm": 1.25,
    "b9_sd_above": 1.2491178732534014,
    "c1_sd_above": 2.0818631220890023,
    "when_unreliable": {"b9": "truncated", "c1": "truncated"},
}

B9 = {
    "kernel": KERNEL_E31,
    "windows_nm": [[1350, 1560], [1850, 2400]],
    "std_epsilon": 1e-12,
    "fail_if_score_below": 0.4,
    "truncated": {"windows_nm": [[1350, 1560], [1850, 2300]], "fail_if_score_below": 0.4},
}

# centre, half width, weight, faint threshold, sign of u
BANDS = {
    "CH1689": {"centre_nm": 1689, "half_width_nm": 2, "weight": 0.85, "faint_u": 0.0, "u_sign": 1},
    "CH1728": {"centre_nm": 1728, "half_width_nm": 2, "weight": 1.0, "faint_u": 0.5, "u_sign": 1},
    "NH2044": {"centre_nm": 2044, "half_width_nm": 2, "weight": 1.6, "faint_u": 0.0, "u_sign": 1},
    "AM2175": {"centre_nm": 2175, "half_width_nm": 2, "weight": 1.1, "faint_u": 0.0, "u_sign": 1},
    "CH2262": {"centre_nm": 2262, "half_width_nm": 2, "weight": 1.6, "faint_u": 1.0, "u_sign": 1},
    "CH2284": {"centre_nm": 2284, "half_width_nm": 2, "weight": 1.14, "faint_u": 0.0, "u_sign": 1},
    "NH1545c": {"centre_nm": 1545, "half_width_nm": 2, "weight": 0.6, "faint_u": 1.5, "u_sign": -1},
}

INSTRUMENTS = {
    "default_class": "asd.labspec4.std",
    "classes": [
        {"class": "asd.labspec4.std", "display_name": "Standard", "serials": [28404, 28011, 28058],
         "swir_gain": [150, 65535], "file_format": [], "unless_joins_nm": None},
        {"class": "asd.labspec4.hires", "display_name": "High-res", "serials": [28313, 28247],
         "swir_gain": [1, 60], "file_format": [], "unless_joins_nm": None},
        {"class": "asd.fieldspec3", "display_name": "FieldSpec 3 (older ASD file format)", "serials": [],
         "swir_gain": None, "file_format": ["legacy"], "unless_joins_nm": None},
        {"class": "asd.trek", "display_name": "Trek-type handheld", "serials": [],
         "swir_gain": None, "file_format": ["as7"], "unless_joins_nm": [1000.0, 1800.0]},
    ],
}

NOTE_BASE_KEYS = {
    "lift_good": "lift", "lift_borderline": "lift",
    "lift_blocked_contaminant": "lift_blocked", "lift_blocked_noisy": "lift_blocked",
    "positive_signs_all_six": "positive_signs", "positive_signs_clear": "positive_signs",
    "zooms_better_good": "zooms_better", "zooms_better_protein": "zooms_better",
    "zooms_better_1545": "zooms_better", "zooms_better_1545_flat": "zooms_better",
    "zooms_better_ryder": "zooms_better",
    "ch_above_nh_possible": "ch_above_nh", "ch_above_nh_strong": "ch_above_nh",
}

PANEL_CONTRASTS = ["CH", "CHN", "GL", "SHP", "SP3", "RAW"]
READER_OFFSET_MAX = 5.0
SECOND_OPINION_MIN_SCANS = 20
TOLERANCE = {"abs": 1e-9, "rel": 1e-9}

PROFILE_COLLAGEN = {
    "kind": "collagen",
    "cuts": {"unlikely_below": 0.5, "good_from": 3.0},
    "flags": {"contaminant": ["plaster", "wax", "ester", "C1"], "burnt": ["burnt"]},
    "flat_bands_lead": {"enabled": True, "evidence_level": "none", "verdict": "Unlikely"},
    "plus_d": {"enabled": True, "zooms_verdict": "Unlikely", "m_at_least": 3.0, "verdict": "Borderline"},
    "lift": {"requires_zooms_verdict": "Good", "to_good_levels": ["strong"],
             "to_at_least_borderline_levels": ["clear"], "blocked_by_signs": ["plaster", "wax", "ester", "C1"],
             "requires_contaminants_checked": True},
    "notes": {
        "max_shown": 2,
        "above_bone_range_m_above": 20.0,
        "models_disagree_min_span": 1.0,
        "positive_signs": {"all_six_zooms_verdict": "Good", "clear_levels": ["clear", "strong"], "clear_min_m": 1.0,
                           "suppressed_by_notes": ["ch_above_nh", "readers_disagree_strongly"]},
        "positive_signs_hidden_after_lift": True,
        "bands_too_noisy_level": "can't tell",
        "zooms_better": {"enabled": True, "protein": {"m_at_least": 0.3, "n_type_lit_at_least": 2,
                                                      "n_type_bands": ["NH2044", "AM2175", "NH1545c"]},
                         "ryder_2045_at_least": 0.34, "ryder_2045_model_key": "ryder2045",
                         "suppressed_by_signs": ["wax", "ester", "plaster", "C1"],
                         "suppressed_by_notes": ["ch_above_nh"]},
        "precedence_rule": ["plus_d", "flat_bands_lead", "lift", "lift_blocked"],
        "precedence_zooms": ["zooms_better"],
        "precedence_supporting": ["above_bone_range", "possible_thin_coating", "ch_above_nh",
                                  "readers_disagree_strongly", "contaminants_not_checked", "positive_signs",
                                  "bands_too_noisy"],
        "precedence_last": ["zooms_faint_protein"],
        "warnings": ["ch_above_nh_strong", "readers_disagree_strongly"],
        # the bin tables of the panel notes were never published: pass your own under "panel"
        "panel": None,
    },
    "sort": {"verdict_order": ["Good", "Borderline", "Can't tell", "Unlikely", "Rescan", "Doesn't look like bone"],
             "within": {"Good": "m", "Borderline": "m", "Can't tell": "m", "Unlikely": "S"},
             "penalty_signs": ["plaster", "wax", "ester", "C1"]},
    "second_opinion": {"streams": "non_native", "gap_points": 4.1},
    "domain_note_ratio_above": 3.0,
}

PROFILE_ZOOMS = {
    "kind": "zooms_pattern",
    "flags": {"contaminant": ["plaster", "wax", "ester", "C1"], "burnt": ["burnt"]},
    "notes": {"max_shown": 2, "above_bone_range_m_above": 20.0,
              "precedence_supporting": ["above_bone_range", "possible_thin_coating"]},
    "sort": {"verdict_order": ["Good", "Borderline", "Can't tell", "Unlikely", "Rescan", "Doesn't look like bone"],
             "within": {"Good": "S", "Borderline": "S", "Can't tell": "S", "Unlikely": "S"}},
    "second_opinion": {"streams": "non_native", "gap_points": 4.1},
    "domain_note_ratio_above": 3.0,
}
# ---------------------------------------------------------------------------------------------------------------

RULES = {"acquisition": ACQUISITION, "evidence_levels": EVIDENCE, "zooms_patterns": ZOOMS_PATTERNS, "signs": SIGNS,
         "c1": C1, "heat": HEAT, "longwave": LONGWAVE, "b9": B9}
STANDARD_CLASS = "asd.labspec4.std"
