"""Fixed values of the data model. They must hold exactly for right results."""

# The measurement groups that feed the feature set.
ESSENTIAL_GROUPS = (
    "UECOMBINED_L1DLCARRIERSTATS",
    "UECOMBINED_L1CARRIERPOWERS",
    "UECOMBINED_MACRXSTATS_ALL",
    "UECOMBINED_MACTXSTATS_ALL",
    "UECOMBINED_RLCRXSTATS_ALL",
    "UECOMBINED_RLCTXSTATS_ALL",
    "UECOMBINED_PDCPRXSTATS_ALL",
)

# Column prefix of each known measurement group.
GROUP_TAGS = {
    "UECOMBINED_L1DLCARRIERSTATS": "l1_dl_carrier",
    "UECOMBINED_L1ULCARRIERSTATS": "l1_ul_carrier",
    "UECOMBINED_L1CARRIERPOWERS": "l1_powers",
    "UECOMBINED_MACRXSTATS_ALL": "mac_rx",
    "UECOMBINED_MACTXSTATS_ALL": "mac_tx",
    "UECOMBINED_PDCPRXSTATS_ALL": "pdcp_rx",
    "UECOMBINED_PDCPTXSTATS_ALL": "pdcp_tx",
    "UECOMBINED_RLCRXSTATS_ALL": "rlc_rx",
    "UECOMBINED_RLCTXSTATS_ALL": "rlc_tx",
    "UECOMBINED_L1DLSTATS_NA": "l1_dl_stats",
    "UECOMBINED_L1ULSTATS_NA": "l1_ul_stats",
    "UECOMBINED_SCCSTATUS_ALL": "scc_status",
    "UECOMBINED_CARRIERTHROUGHPUT3D": "tput_3d",
    "UECOMBINED_CARRIERTHROUGHPUTGRID": "tput_grid",
    "UECOMBINED_CARRIERTHROUGHPUTOVERVIEW": "tput_overview",
    "UECOMBINED_CARRIERTHROUGHPUTTEXT_NA": "tput_text",
    "UECOMBINED_THROUGHPUT3D_NA": "tput_3d_na",
    "UECOMBINED_THROUGHPUTGRID_NA": "tput_grid_na",
    "L1CELLDLOVERVIEW": "l1_cell_dl",
    "L1CELLULOVERVIEW": "l1_cell_ul",
    "L1CELLDLCARRIEROVERVIEW": "l1_cell_dl_carrier",
    "L1CELLULCARRIEROVERVIEW": "l1_cell_ul_carrier",
    "L1CELLWATCH_NA": "l1_watch",
    "L1CELLSSBPOWERS": "l1_ssb",
    "SYSOVERVIEW_NA": "sys_overview",
}
GROUP_TAG_LENGTH = 25

# Spellings of the two labels in a session's label table.
ON_WORDS = ("on", "1", "true", "enabled", "cipheron")
OFF_WORDS = ("off", "0", "false", "disabled", "cipheroff")
ON_PREFIX, OFF_PREFIX = "cipheron", "cipheroff"

# Trimming and run acceptance.
TRIM_SECONDS = 5
ROW_TRIM_MAX = 25
ROW_TRIM_SHARE = 20
MIN_RUN_ROWS = 200

# Texts that mean "no value"; they do not make a numeric column textual.
MISSING_TEXTS = ("", "nan", "-nan", "na", "n/a", "#n/a", "#na", "<na>", "null", "none")

# A layer text belongs to the first group that has a term in it. Only the
# shortest terms are kept; every longer spelling in use contains one of them.
LAYER_TERMS = {
    "L1 Physical": ("physical layer", "dl control channel (pdcch, pcfich, phich)"),
    "L2 MAC": ("mac layer",),
    "L2 RLC": ("rlc layers",),
    "L2 PDCP": ("pdcp layer (overview of the cell)",),
    "L3/App/System": ("application layer", "system layers (overview of the cell)"),
    "Wireshark": ("network",),
}

# Layer of a feature by the start of its name.
LAYER_PREFIXES = {
    "l1": "L1 Physical",
    "vsa": "L1 Physical",
    "mac": "L2 MAC",
    "rlc": "L2 RLC",
    "pdcp": "L2 PDCP",
    "sys": "L3/App/System",
    "wireshark": "Wireshark",
}

# Plausible range of a column by name fragment (sanitized spelling).
VALUE_RANGES = {
    "dl_sch_bler": (0.0, 1.0),
    "dl_sch_throughput": (0.0, 1e6),
    "snr": (-30.0, 60.0),
    "path_loss": (0.0, 200.0),
    "mean_mcs": (0.0, 28.0),
    "lost_pdu": (0.0, 1e5),
    "bad_pdu": (0.0, 1e5),
    "sdu_throughput": (0.0, 1e6),
}
NULL_RATE_FRAGMENTS = ("bler", "lost_pdu", "throughput", "snr", "mcs")

# Features that stand behind each domain KPI.
KPI_FEATURES = {
    "harq_efficiency": ("x35", "x36", "x37", "x148"),
    "spectral_efficiency": ("x22", "x23", "x24", "x25", "x26"),
    "bler_spread": ("x38", "x42"),
    "dl_ul_asymmetry": ("x45", "x405", "x406", "x407"),
    "pdcp_discard_rate": ("resolve from pdcprxstats_ prefix",),
}

# Expected range of each domain KPI.
KPI_RANGES = {
    "harq_efficiency": (0.0, 1.0),
    "spectral_efficiency": (0.0, 30000.0),
    "bler_spread": (0.0, 1.0),
    "dl_ul_asymmetry": (2.0, 20.0),
    "pdcp_discard_rate": (0.0, 1.0),
}

# Bounds of the declarative rules.
RSRP_RANGE = (-72.0, -65.3)
RUN_ROWS_RANGE = (1000, 20000)

# Position of 5/25/50/75/95 % among quantiles.
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)
SHORT_QUANTILES = (0.25, 0.5, 0.75)

# The sheets of the measurand workbook, and the headers of its catalogue.
SHEETS = {"utg": "UTG Measurands", "defs": "UTG Definitions", "net": "Network Protocol Measurands"}
CATALOGUE_HEADERS = {
    "Layer": "layer_raw",
    "UE Logging": "ue_logging",
    "Meas. Item Key (for Python coding)": "meas_key",
    "Decision (0 - dont use, 1 - 25% use, 2 - 50% use, 3 - 100% use)": "priority",
    "Key types: Continuous, discrete, unknown, and NA": "key_type",
    "Type": "data_type",
    "Minimum Value": "min_value",
    "Maximum Value": "max_value",
    "Description": "description",
}
