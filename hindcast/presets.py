"""Defaults of the original study, usable as arguments of the operators."""

# They must equal the study's own for equal results.
NEED_PATTERN = "ANXIETY|EMOTIONAL|MENTAL|BEHAVIORAL|PSYCHIATRIC|CONSCIOUSNESS"
NEED_EXCLUSION = "CONCUSSION"
ENCOUNTER_PATTERN = "MENTAL HEALTH"
ADMISSION_PROGRAMS = [
    "ADULT MH PROGRAM",
    "PEDIATRICS MH PROGRAM",
    "EMERGENCY SERVICES",
    "MOBILE CRISIS RESPONSE TEAM",
]
CALL_RISK_PATTERNS = ["%violence%", "%homicid%"]
CALL_ISSUES = [
    "SELF HARM",
    "BEH PROB/AGGRESSION",
    "ANXIETY",
    "SUBSTANCE ABUSE",
    "DEPRESSION",
    "PSYCHOSIS",
]
INVENTORY_ANSWERS = [f"ans_{i}" for i in range(37, 51)]
INVENTORY_REVERSED = ["ans_39", "ans_40"]
MISSING_START_TIME = "00:00:01"
MISSING_END_TIME = "23:59:59"
LOOKBACK = "5yr"
LONG_STAY = "2 weeks"
BASE_RATE_SIGNALS = ["screen", "inventory", "pretrial", "incident"]
HORIZONS = ["6 months", "1yr"]
FEATURE_INTERVALS = ["1 year", "5 years", "all"]
DURATION_INTERVALS = ["1 year", "3 years", "all"]
TOP_N = [100, 200, 500, 1000]
TOP_PERCENT = list(range(1, 101))
RANDOM_SEED = 23895478
