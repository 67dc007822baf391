"""Fixed values of the analysis; results depend on all of them."""

#: Days after which a build counts as resolved.
RESOLUTION_DAYS = 30
MIN_BUILDS = 10
WINDOW_SPEC, WINDOWS_RETAINED = "month", 6
BOOTSTRAP, PERMUTATIONS, SEED = 2000, 1000, 20260910
DEFAULT_OBJECTIVES = ("cost", "lead_time", "debt_defect")
HV_REFERENCE, HV_EXACT_POINTS, HV_SAMPLES = 1.1, 16, 200_000
LEAST_OBJECTIVES, MOST_OBJECTIVES = 2, 8
CUBE_GROUPS, CUBE_WINDOWS, CUBE_SLACK = 6, 4, 2
ATTAINMENT_REPLICATES, ATTAINMENT_GRID = 200, 40
FALLBACK_DIVERGENCE = 0.20
UTILITY_SAMPLES = 500
REDUNDANT_TAU, CONFLICTING_TAU = 0.8, -0.4
NULL_BAND = (0.05, 0.95)
SENSITIVITY = (("0.5u", 0.5), ("u", 1.0), ("2u", 2.0))
FLIP = 0.10
ANGLES = (45.0, 90.0, 135.0)
MOST_FORMULA_CHARS, MOST_FORMULA_NODES, MOST_FORMULA_DEPTH = 4096, 512, 64
SUMMARY_CELLS = 40
QUIET_DAYS, SWEEP, DAYS_PER_MONTH = 14, (2, 3, 4, 6), 30.44

IMPACT_CLASSES = ("impactful", "low_impact", "liability", "carried", "sunk", "unresolved")
QUESTION_CLASSES = ("features", "correctness", "performance", "economics")
