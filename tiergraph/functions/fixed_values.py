"""Names, orders, colours, patterns and word lists.

Results depend on these exact values, so they are written out plainly and in
their natural order. They are data; the operators that read them take them as
parameters and users can pass their own.
"""

# --- Fixed values: the layer stack, top to bottom (slug, name, colour) -----------
LAYERS = (
    ("application", "Application", "#a855f7"),
    ("ai_models", "AI Models", "#8b5cf6"),
    ("software_infra", "Software Infrastructure", "#6366f1"),
    ("cloud_infra", "Cloud Infrastructure", "#3b82f6"),
    ("system_integration", "System Integration", "#16a34a"),
    ("compute_hardware", "Compute Hardware", "#0ea5e9"),
    ("memory", "Memory", "#06b6d4"),
    ("interconnect", "Interconnect", "#14b8a6"),
    ("advanced_packaging", "Advanced Packaging", "#ec4899"),
    ("foundry", "Semiconductor Foundry", "#f97316"),
    ("equipment", "Semiconductor Equipment", "#f59e0b"),
    ("materials", "Semiconductor Materials", "#84cc16"),
    ("minerals", "Critical Minerals", "#a16207"),
)

# --- Fixed values: the cross-cutting domains (slug, name, colour) ----------------
DOMAINS = (
    ("power", "Power Infrastructure", "#dc2626"),
    ("thermal", "Thermal Management", "#0891b2"),
    ("security", "Security", "#7c3aed"),
    ("edge_ai", "Edge & Physical AI", "#db2777"),
)

# --- Fixed values: colour of each chain, and the defaults ------------------------
CHAIN_COLORS = {
    "nvidia_vera_rubin": "#76b900",
    "google_tpu_v7_ironwood": "#4285f4",
    "nvda_b200": "#ff6b35",
    "optical_networking": "#8b5cf6",
    "broadcom_custom_asic": "#f43f5e",
    "hbm_memory": "#06d6a0",
    "nand_flash": "#f59e0b",
    "cpu_datacenter": "#ef4444",
    "mlcc": "#0ea5e9",
    "power_cooling": "#f97316",
    "foundry": "#a78bfa",
    "amd_mi450_helios": "#ed1c24",
    "aws_trainium2": "#ff9900",
    "packaging_substrate": "#14b8a6",
    "tpu_v8t": "#1a73e8",
    "tpu_v8i": "#34a853",
    "amd_mi355": "#b91c1c",
    "aws_trainium3": "#cc7a00",
    "neocloud": "#2dd4bf",
    "power_semiconductor": "#eab308",
}
DEFAULT_GROUP_COLOR = "#94a3b8"
DEFAULT_CHAIN_COLOR = "#8b949e"

# --- Fixed values: generation changes (key, from chains, to chains) --------------
TRANSITIONS = (
    ("nvidia", ("nvda_b200",), ("nvidia_vera_rubin",)),
    ("amd", ("amd_mi355",), ("amd_mi450_helios",)),
    ("aws", ("aws_trainium2",), ("aws_trainium3",)),
    ("google", ("google_tpu_v7_ironwood",), ("tpu_v8t", "tpu_v8i")),
)

# --- Fixed values: badge patterns, in display order, matched ignoring case -------
BADGE_RULES = (
    (
        "tight",
        r"sold out|fully allocated|fully booked|booked out|almost fully"
        r"|nearly fully subscribed|exceed.{0,12}(production )?capacity"
        r"|demand.{0,20}outpac|demand.{0,20}exceed|capacity.{0,15}constrain"
        r"|allocated through|supply.{0,20}tight|very tight|capacity.{0,12}tight"
        r"|tight (into|through|beyond)",
    ),
    (
        "guideup",
        r"rais(ed|ing)\s[^.;]{0,45}(guidance|outlook|target|growth|forecast|guide)"
        r"|guidance raised|raised guidance|outlook raised|raised to"
        r"|increase[sd]? (our |its )?(full[- ]year|fy|annual)",
    ),
    (
        "lta",
        r"\bLTA|long[- ]term (supply )?(agreement|contract|offtake)"
        r"|multi[- ]?year (supply |purchase |contract|agreement|commitment)"
        r"|supply agreement|\bNBM|\bSCA\b|build[- ]to[- ]order contract"
        r"|purchase commitment",
    ),
    (
        "capex",
        r"capacity expansion|expand(ing)? (our |its )?(manufacturing |production )?capacity"
        r"|new (fab|facility|factory|plant|cleanroom|building)|additional capacity"
        r"|capacity invest|broke ground|increase[sd]? capacity",
    ),
)

# --- Fixed values: label and period patterns, freshness and similarity limits ----
LABEL_DATE = r"\((\d{2}-\d{2}-\d{4})\)"
EARNINGS_LABEL = r"(?i)Q\d\s*FY\s*\d{4}"
PERIOD = (
    r"(?i)\b(Q[1-4]\s*(?:FY\s*)?20\d\d|[12]H\s*20\d\d|H[12]\s*(?:FY\s*)?20\d\d"
    r"|(?:early|mid|late|end of|exiting|through|by)\s*(?:calendar |CY|fiscal |FY)?\s*20\d\d"
    r"|CY20\d\d|FY20\d\d|20\d\d)\b"
)
STALE_DAYS = 180
UPCOMING_DAYS = 14
SENTENCE_MIN, SENTENCE_MAX = 25, 240
DUPLICATE_SIMILARITY = 0.6
PLACEHOLDERS = ("no specific figure", "not stated")
US_EXCHANGES = ("NYSE", "NASDAQ")

# --- Fixed values: exchange -> market symbol suffix, and symbol overrides --------
EXCHANGE_SUFFIX = {
    "TSE": ".T",
    "KOSPI": ".KS",
    "KRX": ".KS",
    "KOSDAQ": ".KQ",
    "TWSE": ".TW",
    "SZSE": ".SZ",
    "XETRA": ".DE",
    "AMS": ".AS",
    "Euronext Amsterdam": ".AS",
    "EPA": ".PA",
    "Euronext Paris": ".PA",
    "MIL": ".MI",
    "STO": ".ST",
    "OMX Stockholm": ".ST",
    "OSE": ".OL",
    "SIX": ".SW",
    "HKEX": ".HK",
    "VIE": ".VI",
    "LSE": ".L",
    "IDX": ".JK",
}
SYMBOL_OVERRIDE = {"BESI": "BESI.AS"}
NUMERIC_TICKER_SUFFIX = ".KS"

# --- Fixed values: event-study parameters ----------------------------------------
BENCHMARKS = ("SOXX", "SPY", "QQQ")
WINDOWS = (5, 10, 20)
GROUPS = ("full_capacity", "rest")

# --- Fixed values: display order of timelines and of their categories ------------
TIMELINE_ORDER = (
    "cpo", "optical_speed", "silicon_photonics", "ocs", "hbm", "nand_storage",
    "cpu", "foundry", "power_cooling", "product_launches",
)
CATEGORY_ORDER = (
    "transitions", "supply", "optical", "memory", "compute", "manufacturing",
    "infrastructure", "products",
)

# --- Fixed values: company renames and label corrections -------------------------
RENAMES = {
    "Amazon AWS": "Amazon Web Services",
    "Amkor": "Amkor Technology",
    "Google Cloud": "Google",
    "Microsoft Azure": "Microsoft",
    "Thinking Machines": "Thinking Machines Lab",
    "StacyX AI": "SpaceX",
}
LABEL_FIXES = {
    "NVDA Q1 2027": "NVDA Q1 2027 (05-20-2026)",
    "NVDA GTC Taipei 2026": "NVDA GTC Taipei 2026 (06-01-2026)",
    "Google Q1 2026": "Google Q1 2026 (04-29-2026)",
    "NVDA Q1 2027 (2026-05-20)": "NVDA Q1 2027 (05-20-2026)",
    "NVDA GTC Taipei 2026 (2026-06-01)": "NVDA GTC Taipei 2026 (06-01-2026)",
    "Google Q1 2026 (2026-04-29)": "Google Q1 2026 (04-29-2026)",
    "Broadcom Q2 2026 (2026-06-03)": "Broadcom Q2 2026 (06-03-2026)",
}
